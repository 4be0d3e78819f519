"""Daily counts of a log that is still arriving: the batch breakdown, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.behavior import BROWSE, BUY, CART, FAVORITE, SCHEMA


def stream_log(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of the log's schema as they appear in ``folder``."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def daily_counts(log: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, total, browse, favorite, cart, buy); rows later than ``late`` behind the newest are left out.

    State is one row per open day, whatever the rate.
    """
    codes = {"browse": BROWSE, "favorite": FAVORITE, "cart": CART, "buy": BUY}
    days = log.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late).groupBy(F.window("time", "1 day").alias("w"))
    counts = days.agg(F.count("*").alias("total"), *[F.count_if(F.col("behavior_type") == c).alias(n) for n, c in codes.items()])
    return counts.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "total", *codes)
