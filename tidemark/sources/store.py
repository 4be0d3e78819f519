"""Tables by prediction day, and the small files beside them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_days(df: DataFrame, path: str) -> None:
    """Replace the days that ``df`` holds and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cutoff_date").parquet(path)


def read_days(spark: SparkSession, path: str, days: tuple[str, ...], columns: list[str] | None = None) -> DataFrame:
    """All of ``days``, stacked; an error names those that aren't there."""
    found = spark.read.option("basePath", path).parquet(path).withColumn("cutoff_date", F.col("cutoff_date").cast("string"))
    if absent := sorted(set(days) - stored_days(spark, path)):
        raise FileNotFoundError(f"{path} lacks {', '.join(absent)}")
    found = found.where(F.col("cutoff_date").isin(*days))
    return found.select(*columns) if columns else found


def stored_days(spark: SparkSession, path: str) -> set[str]:
    """Days with a partition, by the folder's listing alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(at) if "=" in s.getPath().getName()} if fs.exists(at) else set()


def missing_days(spark: SparkSession, path: str, days: tuple[str, ...]) -> list[str]:
    """Days still to build, for a build that resumes."""
    return [d for d in days if d not in stored_days(spark, path)]


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV with a header; for metric tables, whose size doesn't follow the log's."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(records: list[dict], path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(records, indent=2))
