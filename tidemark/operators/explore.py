"""A log's profile: quality checks, scale and activity. Each is one aggregation or two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.sources.behavior import BROWSE, BUY, CART, COLUMNS, FAVORITE


def _of(code: int):
    return F.count_if(F.col("behavior_type") == code)


def row_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n_rows"))


def missing_values(log: DataFrame) -> DataFrame:
    """Nulls, and empty strings, of each column."""
    empty = {c: F.col(c).isNull() | (F.col(c) == "") if t == "string" else F.col(c).isNull() for c, t in log.dtypes}
    return log.agg(*[F.count_if(empty[c]).alias(f"{c}_missing") for c in COLUMNS])


def behavior_domain(log: DataFrame) -> DataFrame:
    return log.groupBy("behavior_type").agg(F.count("*").alias("cnt")).orderBy("behavior_type")


def time_range(log: DataFrame) -> DataFrame:
    text = "yyyy-MM-dd HH:mm:ss"
    return log.agg(
        F.date_format(F.min("time"), text).alias("min_time"), F.date_format(F.max("time"), text).alias("max_time"),
        F.min(F.hour("time")).cast("bigint").alias("min_hour"), F.max(F.hour("time")).cast("bigint").alias("max_hour"),
        F.count_if(F.col("time").isNull()).alias("null_times"),
    )


def duplicate_rows(log: DataFrame) -> DataFrame:
    """Rows, distinct rows (rows with a null don't count as distinct) and the surplus; rows are kept.

    Grouping first leaves one row per distinct value for the count, however often it repeats.
    """
    whole = F.lit(True)
    for c in COLUMNS:
        whole = whole & F.col(c).isNotNull()
    groups = log.groupBy(*COLUMNS).agg(F.count("*").alias("_n"))
    counted = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), F.count_if(whole).alias("distinct_rows"))
    return counted.withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_rows"))


def item_category_consistency(log: DataFrame) -> DataFrame:
    """Items that appear in more than one category."""
    several = log.groupBy("item_id").agg(F.min("item_category").alias("a"), F.max("item_category").alias("b")).where("a <> b")
    return several.agg(F.count("*").alias("n_items"))


def scale(log: DataFrame) -> DataFrame:
    return log.agg(
        F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"),
        F.countDistinct("item_category").alias("n_categories"),
    )


def daily_breakdown(log: DataFrame) -> DataFrame:
    names = {"browse": BROWSE, "favorite": FAVORITE, "cart": CART, "buy": BUY}
    days = log.groupBy(F.date_format("time", "yyyy-MM-dd").alias("day"))
    return days.agg(F.count("*").alias("total"), *[_of(c).alias(n) for n, c in names.items()]).orderBy("day")


def peak_day(log: DataFrame) -> DataFrame:
    """The busiest day, the earliest of equals."""
    return daily_breakdown(log).orderBy(F.desc("total"), "day").limit(1).select("day", "total")


def target_prevalence(log: DataFrame) -> DataFrame:
    return log.where(F.col("behavior_type") == BUY).agg(F.count("*").alias("buy_events"), F.countDistinct("user_id", "item_id").alias("buy_pairs"))


def user_activity(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id").agg(F.count("*").alias("n_actions"))


def activity_percentiles(log: DataFrame) -> DataFrame:
    """Exact, linearly interpolated; the aggregate holds counts by value, not rows."""
    n = F.col("n_actions")
    return user_activity(log).agg(*[F.percentile(n, F.lit(p)).alias(name) for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))], F.max(n).alias("max_actions"))


def activity_histogram(log: DataFrame, bins: int = 50) -> DataFrame:
    """Users by equal-width bins of their action counts, the last bin closed."""
    per_user = user_activity(log)
    ends = per_user.agg(F.min("n_actions").alias("lo"), F.max("n_actions").alias("hi"))  # one row
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("n_actions") - F.col("lo")) * bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.lit(bins - 1)))
    return per_user.join(F.broadcast(ends)).groupBy(at.cast("bigint").alias("bin")).agg(F.count("*").alias("n_users")).orderBy("bin")


def buyers_and_cold_items(log: DataFrame) -> DataFrame:
    bought = F.col("behavior_type") == BUY
    found = log.agg(
        F.countDistinct(F.when(bought, F.col("user_id"))).alias("n_buyers"),
        F.countDistinct(F.when(bought, F.col("item_id"))).alias("n_items_bought"),
        F.countDistinct("item_id").alias("n_items"),
    )
    return found.select("n_buyers", "n_items_bought", (F.col("n_items") - F.col("n_items_bought")).alias("n_items_never_bought"))


def sparsity(log: DataFrame) -> DataFrame:
    """Distinct pairs per user; 0 without users."""
    found = log.agg(F.countDistinct("user_id", "item_id").alias("pairs"), F.countDistinct("user_id").alias("users"))
    return found.select(F.coalesce(F.try_divide("pairs", "users"), F.lit(0.0)).alias("items_per_user"))


def behavior_share(log: DataFrame) -> DataFrame:
    counts = behavior_domain(log)  # one row per behaviour
    return counts.select("behavior_type", "cnt", (F.col("cnt") * 100.0 / F.sum("cnt").over(W.partitionBy())).alias("pct"))


def positive_rate(log: DataFrame) -> DataFrame:
    """Bought pairs among all distinct pairs, in per cent."""
    bought = F.col("behavior_type") == BUY
    found = log.agg(
        F.countDistinct(F.when(bought, F.col("user_id")), F.when(bought, F.col("item_id"))).alias("buy_pairs"),
        F.countDistinct("user_id", "item_id").alias("all_pairs"),
    )
    return found.withColumn("pct", F.coalesce(F.try_divide(F.col("buy_pairs") * 100.0, F.col("all_pairs")), F.lit(0.0)))
