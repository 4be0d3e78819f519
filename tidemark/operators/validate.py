"""Feature tables checked twice: their structure, and every value against a second definition.

The second definitions (``feature_tables``) read the log's rows, not the reduced counts that the builders
use: each row is taken to every later day and each feature is one aggregate over it. By default all keys
are compared; ``key_sample`` draws some, which bounds how much of the log is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.config import Settings
from tidemark.operators.feature_tables import PEAK, TABLES, any_null, out_of_range
from tidemark.operators.features import earlier
from tidemark.operators.labels import by_day


def structure(frame: DataFrame, name: str, days: int) -> DataFrame:
    """One row: columns missing or unexpected, repeated keys, nulls, days absent, values out of range, broken conditions."""
    table = TABLES[name]
    want, have = {*table["key"], *table["columns"]}, set(frame.columns)
    whole = want <= have
    count = lambda condition: F.count_if(F.expr(condition))
    # One row a key first: repeats, nulls and the rest are then sums over keys.
    each = frame.groupBy(*table["key"]).agg(
        F.count("*").alias("rows"), count(any_null(frame.columns)).alias("nulls"), count(out_of_range(name) if whole else "1 = 0").alias("outside"),
        *[count(f"NOT ({e})").alias(f"broken_{n}") for n, e in table["holds"].items() if whole],
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return each.agg(
        F.lit(name).alias("table_name"), total("rows").alias("n_rows"),
        F.lit(len(want - have)).cast("bigint").alias("missing_columns"), F.lit(len(have - want)).cast("bigint").alias("unexpected_columns"),
        F.count_if(F.col("rows") > 1).alias("repeated_keys"), total("nulls").alias("null_rows"),
        (F.lit(days) - F.countDistinct("cutoff_date")).cast("bigint").alias("absent_days"), total("outside").alias("out_of_range_rows"),
        *[total(c).alias(c) for c in each.columns if c.startswith("broken_")],
    )


def recompute(log: DataFrame, name: str, settings: Settings, keys: DataFrame) -> DataFrame:
    """The table's features of ``keys`` by their second definitions, from the log's rows."""
    table = TABLES[name]
    rows = by_day(log.where(F.col("time").isNotNull()).withColumn("day", F.to_date("time")), settings.prediction_days, earlier)
    for peak, of in (("user_peak_hour", "user_id"), ("item_peak_hour", "item_id")):
        if any(peak in d for d, _, _ in table["columns"].values() if "= " + peak in d):
            rows = rows.join(rows.groupBy(of, "cutoff_date").agg(F.expr(PEAK.format("true")).alias(peak)), [of, "cutoff_date"])
    rows = rows.join(keys.select(*table["key"]).distinct(), table["key"], "left_semi")
    return rows.groupBy(*table["key"]).agg(*[F.expr(d).alias(c) for c, (d, _, _) in table["columns"].items()])


def reconcile(frame: DataFrame, log: DataFrame, name: str, settings: Settings, keys: DataFrame | None = None, tolerance: float = 1e-9) -> DataFrame:
    """(column_name, n_keys, n_mismatches) over ``frame``, or its rows of ``keys``; a key found on one side only differs in all."""
    table, log_ = TABLES[name], log
    if keys is not None:
        frame = frame.join(keys, table["key"], "left_semi")
        of = [k for k in table["key"] if k != "cutoff_date"]
        if len(of) == 1:  # a pair's flags need all rows of its user and its item
            log_ = log.join(keys.select(*of).distinct(), of, "left_semi")
    both = frame.alias("a").join(recompute(log_, name, settings, frame).alias("b"), table["key"], "full")
    kinds = dict(frame.dtypes)

    def differs(c: str) -> Column:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        if kinds[c] == "string":
            return ~a.eqNullSafe(b)
        near = F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
        return ~F.coalesce(near, F.lit(False))

    wide = both.agg(F.count("*").alias("n_keys"), *[F.count_if(differs(c)).alias(c) for c in table["columns"]])
    return wide.unpivot("n_keys", list(table["columns"]), "column_name", "n_mismatches").select("column_name", "n_keys", "n_mismatches")


def key_sample(frame: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """One key of each day, then the next by keyed MD5, up to ``n`` or the number of days."""
    mark = F.md5(F.concat_ws("|", *keys, F.lit(seed)))
    rows = frame.select(*keys).distinct().withColumn("_md5", mark)
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy("cutoff_date").orderBy("_md5")))
    return first.orderBy(F.col("_r") > 1, "_md5").limit(n).select(*keys)
