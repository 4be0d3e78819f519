"""Point-in-time features of users, items, categories and their pairs, all prediction days in one pass.

The log is first reduced to counts per entity, day and hour, before any shuffle. These few rows, not
the log's, are then taken once for each later prediction day (a literal list, so no range join) and
summed. Every window is whole days, since prediction days begin at midnight; nothing at or after a
day's midnight enters its features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions.columns import AFTERNOON, MORNING, NIGHT, entropy, flag, peak, ratio, total, whole_hours, window_name
from tidemark.operators.labels import PAIR, by_day, candidates
from tidemark.sources.behavior import BROWSE, BUY, CART, FAVORITE

KINDS = {"n_browse": BROWSE, "n_favorite": FAVORITE, "n_cart": CART, "n_buy": BUY}


def earlier(d: Column, day: Column) -> Column:
    return day < d


def _counts(log: DataFrame) -> list[Column]:
    """Aggregates ``n`` and one count for each behaviour, of a log's rows or of those of ``reduced``."""
    if "n_browse" in log.columns:
        return [F.sum(n).alias(n) for n in ("n", *KINDS)]
    return [F.count("*").alias("n"), *[F.count_if(F.col("behavior_type") == c).alias(n) for n, c in KINDS.items()]]


def reduced(log: DataFrame) -> DataFrame:
    """The log by user, item, category and hour: counts, and the greatest behaviour code.

    Every builder here takes it in place of the log. Persist it where several do, as for ``assemble``:
    the log is then read and shuffled whole but once.
    """
    return log.where(F.col("time").isNotNull()).groupBy(*PAIR, "item_category", "time").agg(*_counts(log), F.max("behavior_type").alias("behavior_type"))


def daily(log: DataFrame, *key: str, hours: bool = True) -> DataFrame:
    """Counts by key, day and (with ``hours``) hour, and the last action's time."""
    parts = [F.to_date("time").alias("day")] + ([F.hour("time").cast("bigint").alias("hod")] if hours else [])
    return log.where(F.col("time").isNotNull()).groupBy(*key, *parts).agg(*_counts(log), F.max("time").alias("last_time"))


def _sum(n: str, name: str) -> Column:
    return F.sum(n).cast("bigint").alias(name)


def _within(n: str, days: int) -> Column:
    recent = F.col("day") >= F.date_sub("cutoff", days)
    return F.sum(F.when(recent, F.col(n)).otherwise(0) if days else F.col(n)).cast("bigint")


def _date() -> Column:
    return F.date_format("cutoff", "yyyy-MM-dd").alias("cutoff_date")


def _active(rows: DataFrame, key: list[str], settings: Settings) -> DataFrame:
    """Groups whose last ``_day`` is in the lookback before ``cutoff``: what ``labels.candidates`` has, without a join."""
    met = F.col("_day") >= F.date_sub("cutoff", settings.lookback_days)
    for c in key:
        met = met & F.col(c).isNotNull()
    return rows.where(met)


def user_hours(log: DataFrame, settings: Settings) -> DataFrame:
    """(user_id, cutoff_date, hod): total, browse and buy counts of all history."""
    return by_day(daily(log, "user_id"), settings.prediction_days, earlier).groupBy("user_id", "cutoff_date", "hod").agg(_sum("n", "total_cnt"), _sum("n_browse", "browse_cnt"), _sum("n_buy", "buy_cnt"))


def item_hours(log: DataFrame, settings: Settings) -> DataFrame:
    """The same of the items that are candidates of the day."""
    rows = by_day(daily(log, "item_id"), settings.prediction_days, earlier)
    rows = rows.join(candidates(log, settings, ["item_id"]), ["item_id", "cutoff_date"], "left_semi")
    return rows.groupBy("item_id", "cutoff_date", "hod").agg(_sum("n", "total_cnt"), _sum("n_browse", "browse_cnt"), _sum("n_buy", "buy_cnt"))


def user_features(log: DataFrame, settings: Settings) -> DataFrame:
    """Every user with a row before the day: 40 features."""
    # Dealt by user before days are taken: rows multiply, but none of them is shuffled.
    rows = by_day(daily(log, "user_id").repartition("user_id"), settings.prediction_days, earlier)
    # First by hour, so that peaks compare whole histograms; windows ride along.
    key = ["user_id", "cutoff"]
    by_hour = rows.groupBy(*key, "hod").agg(
        *[F.sum(c).alias(c) for c in ("n", *KINDS)], F.max("last_time").alias("last_time"),
        *[_within("n_browse", w).alias(f"w{w}") for w in settings.windows],
    )
    hours = [F.coalesce(F.sum(F.when(F.col("hod") == h, F.col("n"))), F.lit(0)).cast("bigint").alias(f"user_action_{h}") for h in range(24)]
    found = by_hour.groupBy(*key).agg(
        *[_sum(f"w{w}", window_name("user_browse", w)) for w in settings.windows],
        _sum("n_favorite", "user_favorite_all"), _sum("n_cart", "user_cart_all"), _sum("n_buy", "user_buy_all"),
        F.max("last_time").alias("_last"),
        peak(F.col("hod"), F.col("n")).alias("user_peak_hour"),
        peak(F.col("hod"), F.col("n_browse")).alias("user_browse_peak_hour"),
        peak(F.col("hod"), F.col("n_buy")).alias("user_buy_peak_hour"), *hours,
    )
    bins = [F.col(f"user_action_{h}") for h in range(24)]
    share = lambda part: total([bins[h] for h in part]) / total(bins)
    browse = window_name("user_browse", 0)
    return found.select(
        "user_id", _date(), *[window_name("user_browse", w) for w in settings.windows], "user_favorite_all", "user_cart_all", "user_buy_all",
        "user_peak_hour", "user_browse_peak_hour", "user_buy_peak_hour",
        share(MORNING).alias("user_morning_fraction"), share(AFTERNOON).alias("user_afternoon_fraction"), share(NIGHT).alias("user_night_fraction"),
        entropy(bins).alias("user_hour_entropy"), *bins,
        ratio(F.col("user_buy_all"), F.col(browse)).alias("user_conversion_browse_buy"),
        ratio(F.col("user_buy_all"), F.col("user_cart_all")).alias("user_conversion_cart_buy"),
        whole_hours(F.col("_last"), F.col("cutoff")).alias("user_since_last_hour"),
    )


def first_met(log: DataFrame, key: str, other: str, settings: Settings, name: str) -> DataFrame:
    """Exact distinct counts before each day: a value counts from the day it is first seen."""
    first = log.where(F.col("time").isNotNull() & F.col(other).isNotNull()).groupBy(key, other).agg(F.min(F.to_date("time")).alias("day"))
    new = first.groupBy(key, "day").agg(F.count("*").alias("_n"))
    return by_day(new, settings.prediction_days, earlier).groupBy(key, "cutoff_date").agg(_sum("_n", name))


def item_features(log: DataFrame, settings: Settings) -> DataFrame:
    """Items active in the lookback, counted over all history before the day."""
    rows = by_day(daily(log, "item_id", "item_category"), settings.prediction_days, earlier)
    rows = rows.join(candidates(log, settings, ["item_id"]), ["item_id", "cutoff_date"], "left_semi")
    key = ["item_id", "cutoff_date"]
    by_hour = rows.groupBy(*key, "hod").agg(*[F.sum(c).alias(c) for c in ("n", *KINDS)], F.min("item_category").alias("item_category"))
    found = by_hour.groupBy(*key).agg(
        F.min("item_category").alias("item_category"),
        *[_sum(f"n_{k}", f"item_{k}_all") for k in ("browse", "favorite", "cart", "buy")],
        *[peak(F.col("hod"), F.col(n)).alias(name) for n, name in (("n", "item_peak_hour"), ("n_browse", "item_browse_peak_hour"), ("n_buy", "item_buy_peak_hour"))],
    )
    found = found.join(first_met(log, "item_id", "user_id", settings, "item_distinct_user"), key, "left")
    return found.select(
        *key, "item_category", "item_browse_all", "item_favorite_all", "item_cart_all", "item_buy_all",
        F.coalesce("item_distinct_user", F.lit(0)).cast("bigint").alias("item_distinct_user"), "item_peak_hour", "item_browse_peak_hour", "item_buy_peak_hour",
        ratio(F.col("item_buy_all"), F.col("item_browse_all")).alias("item_conversion_browse_buy"), flag(F.col("item_buy_all") == 0).alias("item_is_cold"),
    )


def category_features(log: DataFrame, settings: Settings) -> DataFrame:
    """Every category with a row before the day."""
    key = ["item_category", "cutoff_date"]
    rows = by_day(daily(log, "item_category", hours=False), settings.prediction_days, earlier)
    found = rows.groupBy(*key).agg(_sum("n_browse", "category_browse_all"), _sum("n_buy", "category_buy_all"))
    found = found.join(first_met(log, "item_category", "item_id", settings, "category_distinct_item"), key, "left")
    return found.select(
        *key, "category_browse_all", "category_buy_all", F.coalesce("category_distinct_item", F.lit(0)).cast("bigint").alias("category_distinct_item"),
        ratio(F.col("category_buy_all"), F.col("category_browse_all")).alias("category_conversion_browse_buy"),
    )


def user_category_features(log: DataFrame, settings: Settings) -> DataFrame:
    """(user, category) active in the lookback, counted over all history."""
    key = ["user_id", "item_category"]
    rows = by_day(daily(log, *key, hours=False).repartition(*key), settings.prediction_days, earlier)
    found = rows.groupBy(*key, "cutoff").agg(_sum("n_browse", "user_category_browse_all"), _sum("n_buy", "user_category_buy_all"), F.max("day").alias("_day"))
    return _active(found, key, settings).select(*key, _date(), "user_category_browse_all", "user_category_buy_all")


def pair_days(log: DataFrame) -> DataFrame:
    """Counts per pair and day, the hours of the day in use as bits, and the last action."""
    by_hour = log.where(F.col("time").isNotNull()).groupBy(*PAIR, "time").agg(*_counts(log), F.max("behavior_type").alias("_code"))
    # Dealt by pair, so that neither days nor what is taken of them to later days is shuffled again.
    return by_hour.repartition(*PAIR).groupBy(*PAIR, F.to_date("time").alias("day")).agg(
        *[F.sum(n).alias(n) for n in KINDS], F.count_if(F.col("n_browse") > 0).alias("browse_hours"),
        F.bit_or(F.expr("shiftleft(1, hour(time))")).alias("hours"), F.max("time").alias("last_time"), F.max_by("_code", "time").alias("last_code"),
    )


def pair_hours(log: DataFrame, settings: Settings) -> DataFrame:
    """Distinct (pair, day, hour of the day) over all history, of the day's candidate pairs."""
    rows = by_day(log.where(F.col("time").isNotNull()).select(*PAIR, F.to_date("time").alias("day"), F.hour("time").cast("bigint").alias("hod")).distinct(), settings.prediction_days, earlier)
    return rows.join(candidates(log, settings), [*PAIR, "cutoff_date"], "left_semi").select(*PAIR, "cutoff_date", "hod").distinct()


def pair_counts(log: DataFrame, settings: Settings) -> DataFrame:
    """The sample's pairs, counted over all history, with the hours of the day in use as bits, ``_hours``."""
    rows = by_day(pair_days(log), settings.prediction_days, earlier)
    found = rows.groupBy(*PAIR, "cutoff").agg(
        *[_within("n_browse", w).alias(window_name("user_item_browse", w)) for w in settings.windows],
        _sum("browse_hours", "user_item_browse_distinct_hour"), _sum("n_cart", "user_item_cart_all"), _sum("n_buy", "user_item_buy_all"),
        F.sum("n_favorite").alias("_favorite"), F.bit_or("hours").alias("_hours"),
        F.max("last_time").alias("_last"), F.max_by("last_code", "last_time").alias("_code"), F.max("day").alias("_day"),
    )
    cart, buy = F.col("user_item_cart_all"), F.col("user_item_buy_all")
    return _active(found, PAIR, settings).select(
        *PAIR, _date(), *[window_name("user_item_browse", w) for w in settings.windows], "user_item_browse_distinct_hour", "user_item_cart_all",
        flag((cart > 0) & (buy == 0)).alias("user_item_cart_not_buy"), "user_item_buy_all", flag(F.col("_favorite") > 0).alias("user_item_is_favorited"),
        F.col("_code").cast("bigint").alias("user_item_last_behavior"),
        whole_hours(F.col("_last"), F.col("cutoff")).alias("user_item_since_last_hour"), "_hours",
    )


#: Flags of a pair that was active at the peak hour of its user or item.
AT_PEAK = {"user_item_is_user_peak_hour": "user_peak_hour", "user_item_is_item_peak_hour": "item_peak_hour"}


def peak_flags() -> dict[str, Column]:
    """From ``_hours`` and the peaks; null for a pair that has no ``_hours``."""
    at = lambda c: flag(F.expr(f"shiftright(_hours, cast({c} AS int)) & 1 = 1 AND {c} >= 0"))
    return {name: F.when(F.col("_hours").isNotNull(), at(c)) for name, c in AT_PEAK.items()}


def user_item_features(log: DataFrame, settings: Settings, users: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """The sample's pairs, counted over all history; ``users`` and ``items`` as built above."""
    users = user_features(log, settings) if users is None else users
    items = item_features(log, settings) if items is None else items
    found = pair_counts(log, settings)
    found = found.join(users.select("user_id", "cutoff_date", "user_peak_hour"), ["user_id", "cutoff_date"], "left")
    found = found.join(items.select("item_id", "cutoff_date", "item_peak_hour"), ["item_id", "cutoff_date"], "left")
    names = [c for c in found.columns if c not in (*PAIR, "cutoff_date", "_hours", *AT_PEAK.values())]
    return found.withColumns(peak_flags()).select(*PAIR, "cutoff_date", *names, *AT_PEAK)
