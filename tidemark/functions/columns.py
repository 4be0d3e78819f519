"""Column expressions that the feature tables share."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

MORNING, AFTERNOON = range(6, 12), range(12, 18)
NIGHT = [h for h in range(24) if h not in MORNING and h not in AFTERNOON]


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, 0 where ``den`` is 0 or null."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("bigint"), F.lit(0).cast("bigint"))


def whole_hours(since: Column, until: Column) -> Column:
    """Hours from ``since`` to ``until``, halves to the even hour."""
    seconds = F.timestamp_diff("SECOND", since.cast("timestamp_ntz"), until.cast("timestamp_ntz"))
    return F.bround(seconds / F.lit(3600.0)).cast("bigint")


def peak(hour: Column, n: Column) -> Column:
    """Aggregate: the hour (0 to 23) with most, the earliest of equals, -1 if all are 0.

    Ordered by one number: with a struct, Spark would sort the rows to aggregate them.
    """
    return F.coalesce(F.max_by(hour, F.when(n > 0, n * 24 - hour)), F.lit(-1)).cast("bigint")


def total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def entropy(counts: list[Column]) -> Column:
    """Base-2 entropy of a histogram; an empty bin adds nothing, one bin alone gives 0.0."""
    n = total(counts)
    parts = [F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(F.lit(0.0)) for c in counts]
    return total(parts) + F.lit(0.0)


def window_name(prefix: str, days: int) -> str:
    return f"{prefix}_{days}d" if days else f"{prefix}_all"
