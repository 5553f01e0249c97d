"""Adapters that turn tables into elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE_CLASS, stable_id


def read(spark, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def document_lines(docs: DataFrame) -> DataFrame:
    """An element for each line of text that isn't blank: doc_id, ordinal (place among all lines), text, category."""
    lines = docs.select("doc_id", F.col("source").alias("category"), F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "text"))
    return lines.where(F.col("text").rlike(rf"[^{SPACE_CLASS}]"))


def synthetic_layout(lines: DataFrame) -> DataFrame:
    """Lines placed on pages of 40: two columns, short lines large and bold, and a running header and footer on every page."""
    page = F.floor(F.col("ordinal") / 40).cast("int") + 1
    row = F.col("ordinal") % 40
    short = F.length("text") < 60
    body = lines.select(
        "doc_id", (F.col("ordinal") + 1).alias("ordinal"), page.alias("page"), F.when(row % 2 == 0, 50.0).otherwise(320.0).alias("x0"), (80 + 16 * row).cast("double").alias("y0"),
        F.when(row % 2 == 0, 290.0).otherwise(560.0).alias("x1"), (92 + 16 * row).cast("double").alias("y1"), F.when(short, 16.0).otherwise(11.0).alias("font_size"), short.alias("bold"), "text", F.lit("paragraph").alias("kind"),
    )
    pages = lines.groupBy("doc_id").agg(F.max(page).alias("last")).select("doc_id", F.explode(F.sequence(F.lit(1), "last")).alias("page"))
    margin = lambda place, y, text: pages.select("doc_id", ((F.col("page") - 1) * 40 + place).cast("int").alias("ordinal"), "page", F.lit(50.0).alias("x0"), F.lit(y).alias("y0"), F.lit(300.0).alias("x1"), F.lit(y + 12.0).alias("y1"), F.lit(9.0).alias("font_size"), F.lit(False).alias("bold"), text.alias("text"), F.lit("paragraph").alias("kind"))
    header = margin(0, 20.0, F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.lit(" page "), F.col("page").cast("string")))
    footer = margin(41, 760.0, F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" of 9")))
    # header first, then the page's lines, then the footer
    body = body.withColumn("ordinal", F.col("ordinal") * 3 + 1)
    header = header.withColumn("ordinal", ((F.col("page") - 1) * 120 + 3).cast("int"))
    footer = footer.withColumn("ordinal", (F.col("page") * 120 + 2).cast("int"))
    return body.unionByName(header).unionByName(footer)


def html_elements(pages: DataFrame) -> DataFrame:
    """Elements of raw pages by their tags, in order: h1-h6 headings with their level, p paragraphs, li list items; those inside nav, footer
    and ads are excluded. Scripts, styles and comments are dropped."""
    bare = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", "")
    marked = F.regexp_replace(bare, r"(?is)<(nav|footer)\b.*?</\1>|<div class=\"ad\">.*?</div>", "\x01$0\x02")
    found = F.regexp_extract_all(marked, F.lit(r"(?is)(\x01|\x02|<(?:h[1-6]|p|li)\b[^>]*>[^\x01\x02]*?(?=</?(?:h[1-6]|p|li|ul|ol|div|article|nav|footer|body|html)\b|\x01|\x02|$))"), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<piece:string,excluded:boolean>>").alias("out"))
    step = lambda s, x: F.when(x == "\x01", F.struct((s.depth + 1).alias("depth"), s.out.alias("out"))).when(x == "\x02", F.struct((s.depth - 1).alias("depth"), s.out.alias("out"))).otherwise(F.struct(s.depth.alias("depth"), F.concat(s.out, F.array(F.struct(x.alias("piece"), (s.depth > 0).alias("excluded")))).alias("out")))
    placed = pages.select("page_id", "url", F.posexplode(F.aggregate(found, start, step, lambda s: s.out)).alias("ordinal", "e"))
    tag = F.lower(F.regexp_extract("e.piece", r"^<(\w+)", 1))
    text = F.regexp_replace("e.piece", r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    kind = F.when(tag.startswith("h"), "heading").when(tag == "li", "list_item").otherwise("paragraph")
    level = F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int")).otherwise(0)
    return placed.select("page_id", "url", "ordinal", kind.alias("kind"), level.alias("level"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"), F.col("e.excluded").alias("excluded"))


def conversation_elements(turns: DataFrame) -> DataFrame:
    """A turn is an element of its conversation; a run of turns of one role is a section."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1)
    return turns.withColumn("_new", new).select("conv_id", "turn", "role", "text", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("section"))


def order_tables(lineitem: DataFrame) -> DataFrame:
    """A table for each order: doc_id, header, rows in the order of line numbers."""
    row = F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("decimal(12,0)").cast("string"), F.col("l_extendedprice").cast("decimal(14,2)").cast("string"))
    keyed = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), row.alias("row"))))
    return lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(keyed, lambda x: x.row).alias("body")).select("doc_id", F.array(*map(F.lit, ("Item", "Supplier", "Quantity", "Amount"))).alias("header"), F.concat(F.array(F.array(*map(F.lit, ("Item", "Supplier", "Quantity", "Amount")))), "body").alias("rows"))


__all__ = ["conversation_elements", "document_lines", "html_elements", "order_tables", "read", "stable_id", "synthetic_layout"]
