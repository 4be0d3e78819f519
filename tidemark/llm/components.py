"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every step is a join or an aggregation; no edge or label reaches the driver, only one count and one
checksum per round. ``min`` aggregates before the shuffle, so a hub node is no hot key there, and the
join against one row per node is one that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import forget, keep


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that isn't its component's smallest, which names it.

    Null ends and loops are ignored; an empty edge table gives an empty result.
    """
    e = keep(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v AND u IS NOT NULL AND v IS NOT NULL").distinct())
    seen = _state(e)
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = keep(pulled.union(low.select("u", F.col("m").alias("v"))).distinct())
        forget(e)
        e, now = after, _state(after)
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
