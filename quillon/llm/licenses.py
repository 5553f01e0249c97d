"""Licence scan: canonical digests of entire texts, and of entire lines, looked up among known licences."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Spellings that count as the same.
SPELLINGS = {
    "licence": "license", "organisation": "organization", "authorised": "authorized", "authorisation": "authorization",
    "recognised": "recognized", "utilisation": "utilization", "favour": "favor", "merchantibility": "merchantability",
    "acknowledgement": "acknowledgment", "sub license": "sublicense", "non commercial": "noncommercial", "non infringement": "noninfringement",
    "copyright holder": "copyright owner", "per cent": "percent", "judgement": "judgment", "fulfil ": "fulfill ", "https": "http",
}

#: Texts of licences, and notices that stand for one.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
LICENSES = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]

#: Customary titles of the texts above.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"],
}
_END = "END OF TERMS AND CONDITIONS"


def known_texts() -> list[tuple[str, str]]:
    """LICENSES, its full texts under their titles, and the full texts of license_texts, with their titles and without, with what
    follows their terms and without."""
    out = [*LICENSES, *[(name, f"{title}\n{text}") for name, text in LICENSES if "\n" in text for title in TITLES[name]]]
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        whole = path.read_text(encoding="utf-8").strip()
        for text in (whole, whole[: whole.find(_END) + len(_END)] if _END in whole else whole):
            out += [(path.stem, text), (path.stem, text.partition("\n\n")[2])]
    return out


#: Patterns over lower-case text. A copyright line names a year, a sign or "by" after the word; a list mark stands at a paragraph's start or after a sentence.
_GAP = r"[\t\n\f\r ]"
_YEAR = r"[\[<{(]?(\d{4}|19yy|yyyy|year)"
_COPYRIGHT = rf"^[^\p{{L}}\p{{N}}(©]*((portions )?copyright{_GAP}*[:,]?{_GAP}*(\(c\)|©|{_YEAR}|by )|\(c\){_GAP}*(copyright{_GAP}*)?{_YEAR}|©|all rights reserved[^\p{{L}}\p{{N}}]*$)"
_NAMED = rf"^[^\p{{L}}\p{{N}}]*Copyright{_GAP}+[A-Z][a-z]"
_NOT_NAMED = rf"^[^\p{{L}}\p{{N}}]*Copyright{_GAP}+(Holder|Owner|Notice|Law|Act|Licen|Statement|Office|Disclaimer|And|Or|Infringement)"
_PARAGRAPHS = r"\n[ \t\r]*\n"
_MARK = rf"(^{_GAP}*|[.:;]{_GAP}+((and|or){_GAP}+)?|\n[ \t\r]*\n{_GAP}*)\(?([0-9]{{1,2}}|[a-z]|[ivx]+)[.)]{_GAP}+"
#: A paragraph that begins with a copyright notice and is shorter is that notice, wrapped.
_NOTICE = 400


def _words(text: Column) -> Column:
    """Lower case without list marks, other than letters and digits to single spaces, one spelling."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), _MARK, "$1 "), r"[^\p{L}\p{N}]+", " "))
    for other, one in SPELLINGS.items():
        plain = F.replace(plain, F.lit(other), F.lit(one))
    return plain


def _is_notice(text: Column) -> Column:
    return F.lower(text).rlike(_COPYRIGHT) | (text.rlike(_NAMED) & ~text.rlike(_NOT_NAMED))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def canonical(text: Column) -> Column:
    """The canonical forms of an entire text, an array: with its copyright notices, without the lines that are one, and without the paragraphs.

    Lines are joined before punctuation and spellings go, so a form doesn't depend on where lines are wrapped. A licence's own copyright lines, which
    wrapping may join to what follows, meet by the first form, a holder's by the second, a holder's that is wrapped itself by the third."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    by_line = F.array_join(F.filter(_lines(text), lambda x: ~_is_notice(x)), "\n")
    by_paragraph = F.array_join(F.filter(F.split(text, _PARAGRAPHS, -1), lambda x: ~(_is_notice(x) & (F.length(x) < _NOTICE))), "\n\n")
    forms = F.when(F.lower(text).rlike(r"copyright|\(c\)|©|all rights reserved"), F.array(text, by_line, by_paragraph)).otherwise(F.array(text))
    return F.array_remove(F.array_distinct(F.transform(forms, _words)), "")


def known_licenses(spark: SparkSession, licenses: list[tuple[str, str]] = LICENSES) -> DataFrame:
    """(license, digest) of every canonical form, each pair once."""
    texts = spark.createDataFrame(licenses, "license string, text string")
    return texts.select("license", F.explode(F.transform(canonical(F.col("text")), F.md5)).alias("digest")).distinct()


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, license, scope, n): licences of which a canonical form is one of a document's entire text (scope text, n = 1) or that of
    n of its lines (scope line).

    docs: doc_id, text; known: license, digest, of a size fixed by the list of licences, so it is broadcast. Null and empty
    texts, and those of copyright lines only, match none; repeated rows of a doc_id, and different texts under one, add up their lines; rows
    with a null doc_id are found under it; a digest with two names gives both. Empty tables give an empty one."""
    lines = F.filter(F.transform(F.filter(_lines(F.coalesce(F.col("text").cast("string"), F.lit(""))), lambda x: ~_is_notice(x)), _words), lambda x: x != "")
    digests = lambda forms, scope: F.transform(forms, lambda x: F.struct(F.lit(scope).alias("scope"), F.md5(x).alias("digest")))
    pieces = docs.select("doc_id", F.explode(F.concat(digests(canonical(F.col("text")), "text"), digests(lines, "line"))).alias("p"))
    found = pieces.select("doc_id", "p.scope", "p.digest").join(F.broadcast(known), "digest")
    return found.groupBy("doc_id", "license", "scope").agg(F.count("*").alias("n")).select("doc_id", "license", "scope", F.when(F.col("scope") == "text", F.lit(1)).otherwise(F.col("n")).cast("long").alias("n"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents", "doc_id", "text"), known_licenses(spark, known_texts()))


def _op3_sql() -> str:
    """The same over the same known texts; forms are compared themselves, not their digests."""

    def words(x: str) -> str:
        mark, one_space = _MARK.replace("'", "''"), r"[^\p{L}\p{N}]+"
        out = rf"trim(regexp_replace(regexp_replace(lower({x}), '{mark}', '\1 ', 'g'), '{one_space}', ' ', 'g'))"
        for other, one in SPELLINGS.items():
            out = f"replace({out}, '{other}', '{one}')"
        return out

    def notice(x: str) -> str:
        return f"(regexp_matches(lower({x}), '{_COPYRIGHT}') OR (regexp_matches({x}, '{_NAMED}') AND NOT regexp_matches({x}, '{_NOT_NAMED}')))"

    def forms(source: str, *keys: str) -> str:
        names = ", ".join(keys)
        return f"""SELECT DISTINCT {names}, {words("t")} AS form FROM (
    SELECT {names}, t FROM {source}
    UNION ALL SELECT {names}, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT {notice("x")}), chr(10)) FROM {source}
    UNION ALL SELECT {names}, array_to_string(list_filter(string_split_regex(t, '{_PARAGRAPHS}'), lambda x: NOT ({notice("x")} AND length(x) < {_NOTICE})), chr(10) || chr(10)) FROM {source}
  ) AS f WHERE {words("t")} <> ''"""

    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in dict.fromkeys(known_texts()))
    return f"""
WITH known AS (SELECT license, t FROM (VALUES {rows}) AS v(license, t)),
docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
names AS (SELECT DISTINCT license, form FROM ({forms("known", "license")}) AS n),
lines AS (SELECT doc_id, unnest(list_filter(string_split(t, chr(10)), lambda x: NOT {notice("x")})) AS line FROM docs),
pieces AS (
  SELECT doc_id, 'line' AS scope, {words("line")} AS form FROM lines WHERE {words("line")} <> ''
  UNION ALL SELECT doc_id, 'text', form FROM ({forms("docs", "doc_id")}) AS d)
SELECT doc_id, license, scope, CASE WHEN scope = 'text' THEN 1 ELSE count(*) END AS n FROM pieces JOIN names USING (form) GROUP BY doc_id, license, scope
"""


OP3_SQL = _op3_sql()
