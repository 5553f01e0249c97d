"""Token ids of whole Arrow batches, encoded once for each distinct unit of text."""

from __future__ import annotations

import json
import re
from itertools import repeat

import numpy as np

from .common import text_buffers

#: What each byte becomes with A-Z in lower case.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space besides space and newline, by which a text could be cut otherwise than at single spaces and newlines.
_ODD = re.compile(r"[ \n][ \n]|[^\S \n]|[\x1c-\x1f\x85\u200b\u2060\ufeff\u180e]|<\|")


def _suspect(raw: np.ndarray) -> np.ndarray:
    """Places of bytes by which a text may match _ODD: a quick look before the exact one."""
    out = (raw < 32) & (raw != 10)
    space = (raw == 32) | (raw == 10)
    if len(raw) > 1:
        a, b = raw[:-1], raw[1:]
        two = space[:-1] & space[1:]
        for lead, follow in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A, 0xA0)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)), (0xEF, (0xBB,)), (0x3C, (0x7C,))):
            at = a == lead
            if at.any():
                two |= at & np.isin(b, follow)
        out[:-1] |= two
    return out


class UnitEncoder:
    """Ids of texts by a tokenizers file, the same as encoding each whole text without special tokens.

    A text is cut where the tokenizer cuts it in any case: before each single space and around each single newline
    between other characters. Equal units of a batch are encoded once, and at most `most` units are kept for the
    next batches. Texts with other white space or markers are encoded whole. Where the tokenizer lower-cases anyway, A-Z are
    lowered before equal units are sought, but for texts with combining marks, whose composition comes first."""

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = [t for t, a in self.tok.get_added_tokens_decoder().items() if a.content == "<|endoftext|>"]
        self.mark = special[0] if special else None
        self.most = most
        normalizer = json.loads(self.tok.to_str())["normalizer"] or {}
        self.lowers = any(n["type"] == "Lowercase" for n in [normalizer, *normalizer.get("normalizers", [])] if n)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32)
        self.end = np.zeros(1 << 16, np.int64)  # where the ids of unit k end
        self.used = self.size = 0

    def _grow(self, name: str, n: int) -> None:
        while n > len(held := getattr(self, name)):
            setattr(self, name, np.concatenate([held, np.zeros_like(held)]))

    def _put(self, units: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self._grow("ids", self.used + len(flat))
        self._grow("end", self.size + len(units))
        self.ids[self.used : self.used + len(flat)] = flat
        self.end[self.size : self.size + len(units)] = self.used + np.cumsum(sizes)
        self.known.update(zip(units, range(self.size, self.size + len(units))))
        self.used, self.size = self.used + len(flat), self.size + len(units)

    def _span(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        k = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        first = np.where(k > 0, self.end[np.maximum(k - 1, 0)], 0)
        return first, self.end[k] - first

    def _places(self, units: list[str]) -> np.ndarray:
        """Number of each unit, -1 for those not known."""
        return np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))

    def _encode_units(self, units: list[str]) -> None:
        for lo in range(0, len(units), 4096):
            part = units[lo : lo + 4096]
            if self.mark is None:
                found = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
                self._put(part, np.array([i for x in found for i in x], self.ids.dtype), np.array([len(x) for x in found]))
            else:  # many units go as one text, with the special token between them
                ids: list[int] = []
                for at in range(0, len(part), 256):
                    ids += self.tok.encode_batch_fast(["<|endoftext|>".join(part[at : at + 256])], add_special_tokens=False)[0].ids
                    ids.append(self.mark)
                found = np.array(ids, np.int64)
                marks = np.flatnonzero(found == self.mark)
                self._put(part, found[found != self.mark], np.diff(marks, prepend=-1) - 1)

    def _learn(self, units: list[str]) -> None:
        """Letters before full stops and commas are encoded apart from them, as the tokenizer parts them too."""
        whole, base, tail = [], [], []
        for u in units:
            b = u.rstrip(".,")
            if len(b) < len(u) and b and b[-1] < "\u0130" and b[-1].isalpha():
                base.append(b)
                tail.append(u[len(b) :])
            else:
                whole.append(u)
        known = self.known
        self._encode_units([u for u in dict.fromkeys([*whole, *base, *tail]) if u not in known])
        if base:
            (f1, n1), (f2, n2) = self._span(base), self._span(tail)
            first, size = np.stack([f1, f2], 1).ravel(), np.stack([n1, n2], 1).ravel()
            places = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            self._put([b + t for b, t in zip(base, tail)], self.ids[places], n1 + n2)

    @staticmethod
    def _lowered(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A-Z in lower case, but for texts with combining marks (U+0300 to U+037F)."""
        out = _LOWER[raw]
        for i in np.unique(np.searchsorted(ends, np.flatnonzero((raw == 0xCC) | (raw == 0xCD)), "right") - 1).tolist():
            out[ends[i] : ends[i + 1]] = raw[ends[i] : ends[i + 1]]
        return out

    def encode(self, col) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow string column (nulls: none), and the ends of each text's ids."""
        import pyarrow as pa

        raw, ends = text_buffers(col)
        cut = np.zeros(len(raw) + 1, np.bool_)
        cut[ends] = True
        newline = raw == 10
        cut[:-1] |= newline | (raw == 32)
        cut[1:] |= newline
        odd: dict[int, str] = {}
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(_suspect(raw)), "right") - 1).tolist():
            if _ODD.search(x := col[i].as_py()):
                odd[i] = x
                cut[ends[i] + 1 : ends[i + 1]] = False
        if self.lowers:
            raw = self._lowered(raw, ends)
        cuts = np.flatnonzero(cut)
        units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        which, names = units.indices.to_numpy(zero_copy_only=False), units.dictionary.to_pylist()
        whole = {int(np.searchsorted(cuts, ends[i])): x for i, x in odd.items()}
        plain = np.ones(len(which), np.bool_)
        plain[list(whole)] = False
        used = np.zeros(len(names), np.bool_)
        used[which[plain]] = True
        wanted = names if used.all() else [u for u, y in zip(names, used.tolist()) if y]
        at = self._places(wanted)
        new = np.flatnonzero(at < 0)
        if self.size + len(new) > self.most:
            self._forget()
            new = np.arange(len(wanted))
        fresh = [wanted[i] for i in new.tolist()]
        self._learn(fresh)
        at[new] = self._places(fresh)
        first, size = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        first[used] = np.where(at > 0, self.end[np.maximum(at - 1, 0)], 0)
        size[used] = self.end[at] - first[used]
        first, size = first[which], size[which]
        extra = {u: np.array(self.tok.encode(x, add_special_tokens=False).ids, self.ids.dtype) for u, x in whole.items()}
        for u, x in extra.items():
            first[u], size[u] = 0, len(x)
        upto = np.concatenate([[0], np.cumsum(size)])
        if extra:
            self._grow("ids", max(map(len, extra.values())))
        ids = self.ids[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])]
        for u, x in extra.items():
            ids[upto[u] : upto[u + 1]] = x
        return ids, upto[np.searchsorted(cuts, ends)]


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str, most: int = 1_000_000) -> UnitEncoder:
    """This worker's encoder for a tokenizers file; it keeps `most` units at most."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path, most)
    _ENCODERS[path].most = most
    return _ENCODERS[path]
