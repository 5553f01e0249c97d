"""Layout of pages: boilerplate, body fonts, headings, contents pages, fragments, reading order, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import margin_key, normalized

HEIGHT, WIDTH = 792.0, 612.0


def margin_side(top: Column, bottom: Column, height: Column | float = HEIGHT) -> Column:
    """top or bottom for boxes inside the outer 9 % of a page, else null."""
    return F.when(bottom < height * 0.09, "top").when(top > height * 0.91, "bottom")


def margin_counts(elements: DataFrame) -> DataFrame:
    """(doc_id, side, key, pages): on how many pages of its document a margin's text stands, numbers apart."""
    height = F.col("_height") if "_height" in elements.columns else HEIGHT
    placed = elements.withColumn("side", margin_side(F.col("y0"), F.col("y1"), height)).where("side is not null")
    return placed.groupBy("doc_id", "side", margin_key(F.col("text"), False).alias("key")).agg(F.count_distinct("page").alias("pages"))


def _with_height(elements: DataFrame, pages: DataFrame | None) -> DataFrame:
    if pages is None:
        return elements.withColumn("_height", F.lit(HEIGHT))
    return elements.join(pages.select("doc_id", "page", F.col("height").alias("_height")), ["doc_id", "page"], "left").withColumn("_height", F.coalesce("_height", F.lit(HEIGHT)))


def boilerplate(elements: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """elements with side and excluded: margins whose text repeats on enough pages, or is a page number, are headers and footers.

    pages: doc_id, page, height of all pages, blank ones too; without it pages are HEIGHT high, and the last one with elements is a
    document's last. Rows without a doc_id are left out."""
    tall = _with_height(elements, pages)
    keyed = tall.withColumn("side", margin_side(F.col("y0"), F.col("y1"), F.col("_height"))).withColumn("key", F.when(F.col("side").isNotNull(), margin_key(F.col("text"), False)))
    if pages is None:
        # windows of a document's rows, the whole document's first: its rows are dealt out once, and all later ones find them together
        rows = keyed.where("doc_id IS NOT NULL").withColumn("page_count", F.max("page").over(Window.partitionBy("doc_id")))
        seen = F.size(F.collect_set("page").over(Window.partitionBy("doc_id", "side", "key")))
        joined = rows.withColumn("pages", F.when(F.col("side").isNotNull() & F.col("key").isNotNull(), seen))
    else:
        counts = pages.groupBy("doc_id").agg(F.max("page").alias("page_count"))
        joined = keyed.join(margin_counts(tall), ["doc_id", "side", "key"], "left").join(counts, "doc_id")
    repeated = F.col("pages") >= F.greatest(F.lit(3.0), F.col("page_count") * 0.25)
    number = F.col("text").rlike(r"(?i)^(?:page\s*)?\p{Nd}+(?:\s*(?:of|/)\s*\p{Nd}+)?$")
    excluded = F.col("side").isNotNull() & F.coalesce(repeated | number, F.lit(False))
    kind = F.when(excluded, F.when(F.col("side") == "top", "header").otherwise("footer")).otherwise(F.col("kind"))
    return joined.select(*[c for c in elements.columns if c != "kind"], kind.alias("kind"), "page_count", excluded.alias("excluded"))


def fonts(elements: DataFrame, *keys: str) -> DataFrame:
    """(keys, font_size, chars, first): characters of paragraphs by size rounded to a tenth, and where the size comes first."""
    paragraphs = elements.where("kind = 'paragraph'").withColumn("font_size", F.bround("font_size", 1))
    return paragraphs.groupBy(*keys, "font_size").agg(F.sum(F.length("text")).alias("chars"), F.min("ordinal").alias("first"))


def body_sizes(elements: DataFrame, *keys: str) -> DataFrame:
    """(keys, body): the size of most characters; of equal ones the first to occur."""
    return fonts(elements, *keys).groupBy(*keys).agg(F.max_by("font_size", F.struct(F.col("chars"), -F.col("first"))).alias("body"))


def large_sizes(elements: DataFrame) -> DataFrame:
    """(doc_id, body, large): sizes over 1.08 of the body's that hold more than 30 characters, descending."""
    sizes = fonts(elements, "doc_id").join(body_sizes(elements, "doc_id"), "doc_id")
    large = F.sort_array(F.collect_list(F.when((F.col("font_size") > F.col("body") * 1.08) & (F.col("chars") > 30), F.col("font_size"))), asc=False)
    return sizes.groupBy("doc_id").agg(F.first("body").alias("body"), large.alias("large"))


def headings(elements: DataFrame, bookmarks: DataFrame | None = None) -> DataFrame:
    """elements (after boilerplate) with kind and level: headings by number, label, bookmark or style; lists; paragraphs.

    The sizes come from the elements as they were before boilerplate, as all paragraphs count. bookmarks: doc_id, page, key, level."""
    whole, page = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "page")
    plain = F.coalesce(F.col("kind").isin("header", "footer", "paragraph"), F.lit(False))
    joined = elements.withColumn("_all", F.count("*").over(whole)).withColumn("_plain", plain).withColumn("_size", F.when(plain, F.bround("font_size", 1)))
    most = lambda w: F.max_by("_size", F.when(F.col("_plain"), F.struct("_chars", -F.col("_first")))).over(w)
    for name, w, keys in (("body", whole, ["doc_id"]), ("local", page, ["doc_id", "page"])):
        of_size = Window.partitionBy(*keys, "_plain", "_size")
        joined = joined.withColumn("_chars", F.sum(F.length("text")).over(of_size)).withColumn("_first", F.min("ordinal").over(of_size)).withColumn(name, most(w))
        if name == "body":
            big = F.col("_plain") & (F.col("_size") > F.col("body") * 1.08) & (F.col("_chars") > 30)
            joined = joined.withColumn("large", F.sort_array(F.collect_set(F.when(big, F.col("_size"))).over(whole), asc=False))
    known = F.col("doc_id").isNotNull()
    joined = joined.withColumn("body", F.when(known, F.col("body"))).withColumn("large", F.when(known, F.col("large"))).withColumn("local", F.when(known & F.col("page").isNotNull(), F.col("local")))
    if bookmarks is None:
        joined = joined.withColumn("mark", F.lit(None).cast("int"))
    else:
        marks = bookmarks.select("doc_id", "page", F.col("key").alias("_key"), F.col("level").alias("mark"))
        joined = joined.withColumn("_key", normalized(F.col("text"))).join(marks, ["doc_id", "page", "_key"], "left").drop("_key")
    text, body = F.col("text"), F.coalesce("body", F.lit(11.0))
    short = (F.length(text) < 180) & (F.size(F.split(text, "\n")) <= 3)
    number = F.regexp_extract(text, r"(?s)^(\p{Nd}+(?:\.\p{Nd}+)*)(?:\.|\))?\s+[A-Za-z].*", 1)
    explicit = text.rlike(r"(?i)^(section|chapter|part|annexure|annex|appendix|schedule)\s*[-–:]?\s*([\p{Nd}IVXLC]+|[A-Z])(?:\b|:)")
    bullet = text.rlike(r"(?i)^(?:[•\x{f0b7}\x{fffd}]|\([a-zivx]+\))")
    upper = (F.upper(text) == text) & (F.lower(text) != text)
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    ratio = F.when(F.col("extraction") == "native", 1.08).otherwise(1.35) if "extraction" in elements.columns else F.lit(1.08)
    styled = F.col("bold") | (F.col("font_size") > F.greatest(body, F.coalesce("local", body)) * ratio)
    title_like = short & words.between(2, 20) & ~bullet & ~text.rlike(r"[.;,]$") & (styled | upper) & ~text.rlike(r"(?i)^(?:yours |\(signature|\(to be given)")
    open_ = ~F.col("kind").isin("table", "header", "footer")
    heading = open_ & short & (F.col("mark").isNotNull() | explicit | title_like)
    size = F.array_position(F.coalesce("large", F.array().cast("array<double>")), F.bround("font_size", 1))
    level = (
        F.when(number != "", F.least(F.lit(6), F.size(F.split(number, r"\."))))
        .when(explicit, 1)
        .when(F.col("mark").isNotNull(), F.least(F.lit(6), F.col("mark")))
        .when(upper & (words >= 3), 1)
        .when(size > 0, F.least(F.lit(6), size))
        .otherwise(2)
    )
    kind = F.when(heading, "heading").when(open_ & ((number != "") | bullet), "list_item").otherwise(F.col("kind"))
    return joined.select(*[c for c in elements.columns if c not in ("kind", "level")], kind.alias("kind"), F.when(heading, level).otherwise(0).cast("int").alias("level"))


def contents_pages(elements: DataFrame) -> DataFrame:
    """(doc_id, page, dotted, toc): pages with three dotted leaders or a title of contents."""
    dotted = F.count_if(F.col("text").rlike(r"\.{3,}\s*\p{Nd}+"))
    title = F.count_if(F.col("text").rlike(r"(?i)^(?:table of )?contents$"))
    return elements.groupBy("doc_id", "page").agg(dotted.alias("dotted"), ((dotted >= 3) | (title > 0)).alias("toc"))


def drop_contents(elements: DataFrame) -> DataFrame:
    """elements with those of contents pages excluded as well."""
    return elements.join(contents_pages(elements).select("doc_id", "page", "toc"), ["doc_id", "page"]).withColumn("excluded", F.col("excluded") | F.col("toc")).drop("toc")


def page_quality(elements: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, characters, tables, ocr_confidence, method, sparse, corrupt, needs_ocr, warnings): what a page holds, and what asks for a review.

    images: doc_id, page, region_ratio: a row for each page with images, and the largest one's share of the page. A page with an image needs
    OCR if it is sparse, or the image dominates it (0.65) and there are fewer than 300 characters; replacement characters don't
    make it need OCR, they are a warning of their own."""
    chars = F.sum(F.length("text"))
    bad = F.sum(F.length("text") - F.length(F.replace("text", F.lit("\ufffd"), F.lit(""))))
    method = F.coalesce(F.max(F.when(F.col("extraction") != "native", F.col("extraction"))), F.lit("native")) if "extraction" in elements.columns else F.lit("native")
    confidence = F.avg("confidence") if "confidence" in elements.columns else F.lit(None).cast("double")
    pages = elements.groupBy("doc_id", "page").agg(chars.alias("characters"), F.count_if(F.col("kind") == "table").alias("tables"), confidence.alias("ocr_confidence"), method.alias("method"), (chars < 80).alias("sparse"), (bad > 0.03 * F.greatest(chars, F.lit(1))).alias("corrupt"))
    ratio = F.lit(None).cast("double") if images is None else F.col("region_ratio")
    joined = pages if images is None else pages.join(images.select("doc_id", "page", "region_ratio"), ["doc_id", "page"], "left")
    needs = F.coalesce(ratio.isNotNull() & (F.col("sparse") | ((ratio > 0.65) & (F.col("characters") < 300))), F.lit(False))
    seen = F.coalesce(ratio > 0.2, F.lit(False))
    warnings = F.array_compact(F.array(F.when(needs, "needs_ocr").when(seen, "visual_content_requires_review"), F.when(F.col("corrupt"), "replacement_characters_in_native_text"), F.when(F.col("sparse"), "sparse_page")))
    return joined.select(*pages.columns, needs.alias("needs_ocr"), warnings.alias("warnings"))


def fragments(lines: DataFrame) -> DataFrame:
    """(doc_id, fragment, page, x0, y0, x1, y1, font_size, bold, n, text): runs of lines joined to a block. A new one begins at a page, at
    a block of the page where lines have one, a change of weight, a jump of more than one point in size, or a line that starts like an item of a list."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    item = F.col("text").rlike(r"(?i)^(?:\p{Nd}+(?:\.\p{Nd}+)*[.)]?\s|[•\x{f0b7}\x{fffd}]|\([a-zivx]+\))")
    block = (F.lag("block").over(w) != F.col("block")) if "block" in lines.columns else F.lit(False)
    change = (F.lag("page").over(w) != F.col("page")) | block | (F.lag("bold").over(w) != F.col("bold")) | (F.abs(F.lag("font_size").over(w) - F.col("font_size")) > 1) | item
    marked = lines.withColumn("_new", F.when(F.coalesce(change, F.lit(True)), 1).otherwise(0))
    marked = marked.withColumn("fragment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    chars = F.greatest(F.length("text"), F.lit(0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x.text), "\n")
    weight = F.greatest(F.lit(1), F.sum(chars))
    return marked.groupBy("doc_id", "fragment").agg(
        F.min("page").alias("page"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        (F.sum(F.col("font_size") * chars) / weight).alias("font_size"), (F.sum(F.when(F.col("bold"), chars).otherwise(0)) / weight > 0.6).alias("bold"), F.count("*").alias("n"), text.alias("text"),
    )


def order_boxes(boxes: list[tuple[float, float, float, float]], width: float) -> list[int]:
    """Reading order of boxes (x0, y0, x1, y1): a page is cut at its widest empty vertical strip, else at its topmost empty
    horizontal one, until nothing can be cut; what is left is read by rows of three points.

    Boxes are sorted by either axis once; a cut keeps both orders, so it takes time in proportion to what it cuts."""
    done: list[int] = []
    todo = [tuple(sorted(range(len(boxes)), key=lambda i: (boxes[i][k], boxes[i][k + 2])) for k in (0, 1))]
    column = max(18, width * 0.035)

    def widest(part: list[int]) -> float | None:
        """Middle of the widest empty vertical strip that parts columns; of equal ones the last."""
        best, at, reach = column, None, None
        for i in part:
            lo, _, hi, _ = boxes[i]
            if reach is not None and lo > reach:
                if (gap := lo - reach) > column and gap >= best:
                    best, at = gap, (lo + reach) / 2
            reach = hi if reach is None or hi > reach else reach
        return at

    def topmost(part: list[int]) -> float | None:
        reach = None
        for i in part:
            _, lo, _, hi = boxes[i]
            if reach is not None and lo - reach > 5:
                return (lo + reach) / 2
            reach = hi if reach is None or hi > reach else reach
        return None

    while todo:
        orders = todo.pop()
        axis, at = 0, widest(orders[0]) if len(orders[0]) > 1 else None
        if at is None and len(orders[0]) > 1:
            axis, at = 1, topmost(orders[1])
        if at is None:
            done += sorted(sorted(orders[0]), key=lambda i: (round(boxes[i][1] / 3), boxes[i][0]))
        else:
            todo.append(tuple([i for i in x if boxes[i][axis] >= at] for x in orders))
            todo.append(tuple([i for i in x if boxes[i][axis + 2] <= at] for x in orders))
    return done


def reading_order(elements: DataFrame, width: float = WIDTH, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, ordinal, place): each element's place in the reading order of its page.

    pages: doc_id, page, width where pages differ. Documents are sorted within partitions and cut by page in whole Arrow batches, so that no page is
    a group of its own; a page whose boxes leave no room for a second column needs no search."""
    import pyarrow as pa

    kinds = dict(elements.dtypes)
    rows = elements.select("doc_id", "page", "ordinal", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    if pages is None:
        rows = rows.withColumn("_width", F.lit(float(width)))
    else:
        rows = rows.join(pages.select("doc_id", "page", F.col("width").cast("double").alias("_width")), ["doc_id", "page"], "left").fillna(float(width), ["_width"])
    out = f"doc_id {kinds['doc_id']}, page {kinds['page']}, ordinal {kinds['ordinal']}, place int"

    def placed(table: pa.Table) -> pa.RecordBatch:
        doc, page = table.column("doc_id").to_pylist(), table.column("page").to_pylist()
        boxes = list(zip(*(table.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1"))))
        widths, order, places, lo = table.column("_width").to_pylist(), [], [], 0
        for hi in range(1, len(doc) + 1):
            if hi == len(doc) or (doc[hi], page[hi]) != (doc[lo], page[lo]):
                order += [lo + i for i in order_boxes(boxes[lo:hi], widths[lo])]
                places += range(hi - lo)
                lo = hi
        found = table.select(["doc_id", "page", "ordinal"]).take(pa.array(order, pa.int64()))
        return found.append_column("place", pa.array(places, pa.int32())).combine_chunks().to_batches()[0]

    def run(it):
        held = None
        for batch in it:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            doc, page = held.column("doc_id").to_pylist(), held.column("page").to_pylist()
            cut = len(doc) - 1
            while cut and (doc[cut - 1], page[cut - 1]) == (doc[-1], page[-1]):
                cut -= 1
            if cut:  # the last page may go on in the next batch
                yield placed(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield placed(held)

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "page", "ordinal").mapInArrow(run, out)


def page_boxes(boxes: DataFrame, transforms: DataFrame) -> DataFrame:
    """boxes (doc_id, page, x0, y0, x1, y1) of a page's picture as boxes of the page: around the four corners, mapped back.

    transforms: doc_id, page, a, b, c, d, e, f of the matrix that made the picture, x' = a x + c y + e, y' = b x + d y + f; a page without a row is as
    it was. A matrix without an inverse is an error of its rows: their boxes become null."""
    joined = boxes.join(transforms.select("doc_id", "page", *[F.col(c).alias(f"_{c}") for c in "abcdef"]), ["doc_id", "page"], "left")
    det = F.nullif(F.col("_a") * F.col("_d") - F.col("_b") * F.col("_c"), F.lit(0.0))

    def back(x: str, y: str) -> Column:
        u, v = F.col(x) - F.col("_e"), F.col(y) - F.col("_f")
        return F.struct(((F.col("_d") * u - F.col("_c") * v) / det).alias("x"), ((F.col("_a") * v - F.col("_b") * u) / det).alias("y"))

    corners = joined.withColumn("_at", F.array(back("x0", "y0"), back("x0", "y1"), back("x1", "y0"), back("x1", "y1")))
    around = {"x0": F.array_min("_at.x"), "y0": F.array_min("_at.y"), "x1": F.array_max("_at.x"), "y1": F.array_max("_at.y")}
    mapped = {c: F.when(F.col("_a").isNull(), F.col(c)).otherwise(edge) for c, edge in around.items()}
    return corners.select(*[mapped[c].alias(c) if c in mapped else F.col(c) for c in boxes.columns])


def centers(values: DataFrame, key: str, value: str, tolerance: float = 4.0, rows_a_task: int = 1_000_000) -> DataFrame:
    """(key, center, n): values of a key in groups of neighbours at most `tolerance` apart, their means in order.

    Keys are dealt to as many tasks as keep each at about rows_a_task rows, so that a task's sort and groups don't grow with the table."""
    spark = values.sparkSession
    values = values.repartition(max(spark.sparkContext.defaultParallelism, -(-values.count() // rows_a_task)), key)
    w = Window.partitionBy(key).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) <= tolerance, 0).otherwise(1)
    grouped = values.withColumn("_new", new).withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "_group").agg(F.avg(value).alias("center"), F.count("*").alias("n")).drop("_group")


def assign_cells(points: DataFrame, columns: list[float], rows: list[float]) -> DataFrame:
    """points (cx, cy, ...) with col and row of the grid whose ruling lines are given; points outside are left out, points on the last lines
    belong to the last cells."""

    def cell(v: Column, lines: list[float]) -> Column:
        at = F.size(F.filter(F.array(*map(F.lit, lines)), lambda x: x <= v)) - 1
        return F.least(at, F.lit(len(lines) - 2))

    inside = F.col("cx").between(columns[0], columns[-1]) & F.col("cy").between(rows[0], rows[-1])
    return points.where(inside).withColumn("col", cell(F.col("cx"), columns)).withColumn("row", cell(F.col("cy"), rows))


def cell_texts(assigned: DataFrame, *keys: str) -> DataFrame:
    """(keys, row, col, text, confidence): the lines of a cell by (cy, cx, text), a line each; the least confidence."""
    lines = F.array_sort(F.collect_list(F.struct("cy", "cx", "text")))
    return assigned.groupBy(*keys, "row", "col").agg(F.array_join(F.transform(lines, lambda x: x.text), "\n").alias("text"), F.coalesce(F.min("confidence"), F.lit(0.0)).alias("confidence"))


def outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """lines (doc_id, page, x0, y0, x1, y1) whose centre lies in no table's box of their page."""
    cx, cy = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.y0") + F.col("l.y1")) / 2
    inside = (F.col("l.doc_id") == F.col("t.doc_id")) & (F.col("l.page") == F.col("t.page")) & cx.between(F.col("t.x0"), F.col("t.x1")) & cy.between(F.col("t.y0"), F.col("t.y1"))
    return lines.alias("l").join(tables.alias("t"), inside, "left_anti")


def sound_tables(tables: DataFrame) -> DataFrame:
    """tables (rows) with two columns at least, and two rows (or all, of fewer) with two filled cells."""
    filled = F.size(F.filter("rows", lambda r: F.size(F.filter(r, lambda c: F.coalesce(F.trim(c), F.lit("")) != "")) >= 2))
    wide = F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(0)) >= 2
    return tables.where(wide & (filled >= F.least(F.lit(2), F.size("rows"))))


#: Words of which one at least stands in a table's header.
HEADER_WORDS = r"(?i)\b(item|description|particulars?|qty|quantity|specifications?|requirements?|criteria|parameter|unit|amount|rate|details|s\.?\s?no)\b"


def header_row(tables: DataFrame, keywords: str = HEADER_WORDS) -> DataFrame:
    """tables with header: the first row where all its cells are short and one is a telling word, else Column 1, Column 2, ..."""
    first = F.element_at("rows", 1)
    plausible = F.forall(first, lambda c: F.length(c) < 120) & F.exists(first, lambda c: c.rlike(keywords))
    names = F.transform(F.sequence(F.lit(1), F.size(first)), lambda i: F.concat(F.lit("Column "), i.cast("string")))
    return tables.withColumn("header", F.when(plausible, first).otherwise(names))
