"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, scratch


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of every node that a link touches; component is the least node reachable.

    links: columns src, dst (longs), in any direction, repeats and loops allowed. Each round moves every
    link to the least neighbour of its ends (large star, then small star), so that long chains halve; minima
    are combined before the shuffle, and a hot node's links meet in joins that adaptive execution can split.
    Rounds are written to the shared folder, and the earlier one is removed.
    An empty table gives an empty table; links with a null end are left out."""
    spark = links.sparkSession
    held: list[str] = []

    def cut(df: DataFrame) -> DataFrame:
        held.append(scratch(spark, "links"))
        df.write.option("compression", "lz4").parquet(held[-1])
        return spark.read.schema("src long, dst long").parquet(held[-1])

    # src > dst
    now = cut(
        links.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").cast("long").alias("src"), F.least("src", "dst").cast("long").alias("dst"))
        .distinct()
    )
    if now.isEmpty():
        return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        large = cut(large)
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(F.col("dst").alias("a"), F.col("src").alias("b"), "m")
        now_ = cut(small.select(F.col("a").alias("src"), F.col("m").alias("dst")).unionByName(low.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct())
        seen = now_.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        for p in held[:-1]:
            drop_path(spark, p)
        del held[:-1]
        now = now_
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components: the links did not settle")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
