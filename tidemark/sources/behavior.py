"""Behaviour logs: one row per action, with user, item, category, behaviour code and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROWSE, FAVORITE, CART, BUY = 1, 2, 3, 4

SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("behavior_type", T.IntegerType()),
    T.StructField("item_category", T.StringType()),
    T.StructField("time", T.TimestampNTZType()),
])
COLUMNS = [f.name for f in SCHEMA]
CODES = {"view": BROWSE, "click": FAVORITE, "signup": CART, "purchase": BUY}


def hour(c: Column) -> Column:
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV log with a header; hours as ``yyyy-MM-dd HH``, perhaps with a trailing carriage return.

    A time that can't be parsed becomes null, for ``missing_values`` to count; features never see it.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in SCHEMA])
    rows = spark.read.schema(text).option("header", True).csv(path)
    clean = F.expr("rtrim('\r', time)")
    return rows.select(
        "user_id", "item_id", F.col("behavior_type").try_cast("int").alias("behavior_type"), "item_category",
        F.try_to_timestamp(clean, F.lit("yyyy-MM-dd HH")).cast("timestamp_ntz").alias("time"),
    )


def load_csv(spark: SparkSession, path: str, out: str) -> int:
    """Reload the log kept at ``out`` from a CSV, whatever was there; the number of rows."""
    write_log(read_csv(spark, path), out)
    return spark.read.parquet(out).count()


def count_csv_rows(spark: SparkSession, path: str) -> int:
    """Lines less the header, never below 0."""
    return max(spark.read.text(path).count() - 1, 0)


def write_log(log: DataFrame, out: str) -> None:
    """Parquet by day, each day's rows in a file or a few, so that lookbacks read only their files."""
    log.withColumn("day", F.to_date("time")).repartition("day", F.pmod(F.xxhash64(*COLUMNS), F.lit(8))).write.mode("overwrite").partitionBy("day").parquet(out)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*COLUMNS)


def events_log(spark: SparkSession, sf_dir: str, before: str | None = None, since: str | None = None) -> DataFrame:
    """The ``events`` table as a log: 20 items in 4 categories from ``props.k``; errors are left out.

    ``before`` and ``since`` (days) are compared with the stored column, so that they reach the Parquet scan.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if before:
        events = events.where(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    if since:
        events = events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    k = F.get_json_object("props", "$.k").cast("int")
    code = F.coalesce(*[F.when(F.col("event_type") == name, F.lit(c)) for name, c in CODES.items()])
    return events.where(F.col("event_type").isin(*CODES)).select(
        F.col("user_id").cast("string").alias("user_id"),
        F.floor(k / 5).cast("string").alias("item_id"),
        code.alias("behavior_type"),
        F.floor(k / 25).cast("string").alias("item_category"),
        hour(F.col("ts")).alias("time"),
    )


def events_rows(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the ``events`` table, by its files' footers."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").count()


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, larger log: order lines as actions of customers on parts, dated within one month.

    The order's key gives the day of January 2024, the quantity the hour, the line number the
    behaviour. Lines aren't unique by key and stay apart.
    """
    read = spark.read.parquet
    lines = read(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    orders = read(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    parts = read(f"{sf_dir}/part.parquet").select("p_partkey", "p_type")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    at = F.col("l_orderkey") % 30 * 24 + F.floor(F.col("l_quantity")) % 24
    return joined.select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("item_id"),
        (F.col("l_linenumber") % 4 + 1).cast("int").alias("behavior_type"),
        F.col("p_type").alias("item_category"),
        F.timestamp_add("HOUR", at.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("time"),
    )
