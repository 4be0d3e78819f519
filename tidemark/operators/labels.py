"""Candidate pairs of each prediction day and whether they were bought on it."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.config import Settings
from tidemark.sources.behavior import BUY

PAIR = ["user_id", "item_id"]


def day_list(days: tuple[str, ...]) -> Column:
    """The prediction days as an array literal."""
    return F.array(*[F.lit(d).cast("date") for d in days])


def by_day(df: DataFrame, days: tuple[str, ...], when, day: str = "day") -> DataFrame:
    """``df`` once for each prediction day that ``when(prediction day, row's day)`` holds for.

    The days are a literal, so this neither joins nor shuffles; pass aggregated rows.
    """
    held = F.filter(day_list(days), lambda d: when(d, F.col(day)))
    out = df.withColumn("cutoff", F.explode(held))
    return out.withColumn("cutoff_date", F.date_format("cutoff", "yyyy-MM-dd"))


def recent(lookback: int):
    return lambda d, day: (day >= F.date_sub(d, lookback)) & (day < d)


def within_reach(log: DataFrame, settings: Settings) -> DataFrame:
    """Rows from the first lookback to the last day's end: all that samples read, by the stored time."""
    first, last = min(settings.prediction_days), max(settings.prediction_days)
    day = lambda d, n: F.lit(str(date.fromisoformat(d) + timedelta(n))).cast("timestamp_ntz")
    return log.where((F.col("time") >= day(first, -settings.lookback_days)) & (F.col("time") < day(last, 1)))


def candidates(log: DataFrame, settings: Settings, key: list[str] = PAIR) -> DataFrame:
    """Distinct keys active in the lookback before each day."""
    days = within_reach(log, settings).select(*key, F.to_date("time").alias("day")).distinct()
    return by_day(days, settings.prediction_days, recent(settings.lookback_days)).select(*key, "cutoff_date").distinct()


def positives(log: DataFrame, settings: Settings) -> DataFrame:
    """Distinct pairs bought on each day."""
    bought = within_reach(log, settings).where(F.col("behavior_type") == BUY).select(*PAIR, F.date_format("time", "yyyy-MM-dd").alias("cutoff_date"))
    return bought.where(F.col("cutoff_date").isin(*settings.prediction_days)).distinct()


def sample_labels(log: DataFrame, settings: Settings) -> DataFrame:
    """(user_id, item_id, cutoff_date, label) for all days at once."""
    key = [*PAIR, "cutoff_date"]
    bought = positives(log, settings).withColumn("_hit", F.lit(1))
    return candidates(log, settings).join(bought, key, "left").select(*key, F.coalesce("_hit", F.lit(0)).cast("bigint").alias("label"))


def sample_summary(sample: DataFrame) -> DataFrame:
    found = sample.groupBy("cutoff_date").agg(F.count("*").alias("n_candidates"), F.sum("label").alias("n_positives"))
    return found.withColumn("positive_rate_pct", F.coalesce(F.try_divide(F.col("n_positives") * 100.0, F.col("n_candidates")), F.lit(0.0)))


def candidate_recall(log: DataFrame, settings: Settings) -> DataFrame:
    """Of the pairs bought on a day, those that were candidates; days without buys have a recall of 0."""
    bought = positives(log, settings).groupBy("cutoff_date").agg(F.count("*").alias("n_bought"))
    hit = sample_labels(log, settings).groupBy("cutoff_date").agg(F.sum("label").alias("n_hit"))
    both = bought.join(hit, "cutoff_date", "left").select("cutoff_date", "n_bought", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"))
    return both.withColumn("recall", F.try_divide("n_hit", "n_bought"))


def positive_recount(log: DataFrame, settings: Settings) -> DataFrame:
    """Positives counted again by an inner join of candidates and buyers."""
    return candidates(log, settings).join(positives(log, settings), [*PAIR, "cutoff_date"]).groupBy("cutoff_date").agg(F.count("*").alias("n_positives"))


def sample_checks(log: DataFrame, sample: DataFrame, settings: Settings) -> DataFrame:
    """A day's violations: nulls, labels outside 0 and 1, repeated pairs, counts that differ on recount."""
    key = [*PAIR, "cutoff_date"]
    null = F.lit(False)
    for c in sample.columns:
        null = null | F.col(c).isNull()
    per_pair = sample.groupBy(*key).agg(F.count("*").alias("_n"), F.max("label").alias("_y"), F.count_if(null).alias("_null"), F.count_if(~F.col("label").isin(0, 1)).alias("_odd"))
    found = per_pair.groupBy("cutoff_date").agg(
        F.sum("_null").alias("null_rows"), F.sum("_odd").alias("bad_labels"), F.count_if(F.col("_n") > 1).alias("repeated_pairs"),
        F.count("*").alias("_pairs"), F.count_if(F.col("_y") == 1).alias("_pos"),
    )
    again = candidates(log, settings).groupBy("cutoff_date").agg(F.count("*").alias("_pairs2"))
    pos = positive_recount(log, settings).withColumnRenamed("n_positives", "_pos2")
    both = found.join(again, "cutoff_date", "left").join(pos, "cutoff_date", "left")
    diff = lambda a, b: F.abs(F.col(a) - F.coalesce(b, F.lit(0)))
    return both.select("cutoff_date", "null_rows", "bad_labels", "repeated_pairs", diff("_pairs", "_pairs2").alias("candidate_diff"), diff("_pos", "_pos2").alias("positive_diff"))


def spot_check_history(log: DataFrame, sample: DataFrame, settings: Settings, pairs: int = 2, rows: int = 20) -> DataFrame:
    """The first actions, from the lookback to the day itself, of a few pairs of each label and day."""
    pick = W.partitionBy("cutoff_date", "label").orderBy(*PAIR)
    chosen = sample.withColumn("_r", F.row_number().over(pick)).where(F.col("_r") <= pairs).drop("_r")
    near = by_day(within_reach(log, settings).withColumn("day", F.to_date("time")), settings.prediction_days, lambda d, day: (day >= F.date_sub(d, settings.lookback_days)) & (day <= d))
    joined = near.join(chosen, [*PAIR, "cutoff_date"])
    order = W.partitionBy("cutoff_date", *PAIR).orderBy("time", "behavior_type")
    return joined.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= rows).select("cutoff_date", "label", *PAIR, "rank", F.date_format("time", "yyyy-MM-dd HH").alias("hour"), "behavior_type")
