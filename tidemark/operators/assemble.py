"""The training matrix: sample pairs with every feature, 77 columns in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import features as X
from tidemark.operators.labels import PAIR, sample_labels

CONTEXT = ("time_is_weekend", "time_is_before_sale_event", "time_is_on_sale_event", "time_is_after_sale_event")


def context_columns(settings: Settings, day: Column | None = None) -> dict[str, Column]:
    day = F.col("cutoff_date") if day is None else day
    sale = F.lit(settings.sale_day)
    values = (F.weekday(day.cast("date")) >= 5, day < sale, day == sale, day > sale)
    return {n: v.cast("bigint") for n, v in zip(CONTEXT, values, strict=True)}


def day_type(settings: Settings, day: Column) -> Column:
    return F.when(day < settings.sale_day, "before_sale").when(day == settings.sale_day, "on_sale").otherwise("after_sale")


def fill_value(name: str) -> int:
    """What stands for a feature that no join found: no peak, a cold item, or nothing counted."""
    if name.endswith("_peak_hour") and "_is_" not in name:
        return -1
    return 1 if name == "item_is_cold" else 0


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def _tables(log: DataFrame, settings: Settings) -> list[tuple[DataFrame, list[str]]]:
    """Each built once: the pairs' peak flags follow when users and items are joined."""
    return [
        (X.item_features(log, settings), ["item_id", "cutoff_date"]), (X.user_features(log, settings), ["user_id", "cutoff_date"]),
        (X.pair_counts(log, settings), [*PAIR, "cutoff_date"]), (X.category_features(log, settings), ["item_category", "cutoff_date"]),
        (X.user_category_features(log, settings), ["user_id", "item_category", "cutoff_date"]),
    ]


def joined(sample: DataFrame, tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left joins in order; the tables' keys are their groups, so each is unique and no row repeats."""
    for table, key in tables:
        sample = sample.join(table, key, "left")
    return sample


def check_keys(tables: list[tuple[DataFrame, list[str]]]) -> None:
    """For tables read from elsewhere: an error if a join could repeat rows."""
    for table, key in tables:
        if repeated_keys(table, key).limit(1).count():
            raise ValueError(f"keys {key} repeat")


def column_order(tables: list[tuple[DataFrame, list[str]]]) -> list[str]:
    items, users, pairs, categories, user_categories = ([c for c in t.columns if c not in k] for t, k in tables)
    if "_hours" in pairs:
        pairs = [*[c for c in pairs if c != "_hours"], *X.AT_PEAK]
    return [*PAIR, "cutoff_date", "label", *CONTEXT, *users, *items, *categories, *pairs, *user_categories]


def null_report(frame: DataFrame) -> DataFrame:
    """Nulls that the joins left, by column, before any is filled."""
    names = [c for c in frame.columns if c != "cutoff"]
    return frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])


def assemble(log: DataFrame, settings: Settings, sample: DataFrame | None = None, tables: list[tuple[DataFrame, list[str]]] | None = None, fill: bool = True) -> DataFrame:
    """The matrix of all prediction days; numeric misses are filled, a missing category raises.

    With a ``sample``, ``log`` may be what ``features.reduced`` made of it, persisted: nine counts read it.
    """
    if tables is None:
        tables = _tables(log, settings)
    else:
        check_keys(tables)
    sample = sample_labels(log, settings) if sample is None else sample
    order = column_order(tables)
    # The sample takes wide tables last, so that no later join shuffles and sorts what they add; categories need the items.
    frame = joined(sample, [tables[i] for i in (0, 3, 4, 2, 1)]).withColumns(context_columns(settings))
    if "_hours" in frame.columns:
        frame = frame.withColumns(X.peak_flags())
    frame = frame.select(*order)
    if not fill:
        return frame
    kinds = dict(frame.dtypes)
    frame = frame.na.fill({c: fill_value(c) for c in order if kinds[c] in ("bigint", "double", "int")})
    known = F.when(F.col("item_category").isNull(), F.raise_error(F.lit("a sample's item has no category"))).otherwise(F.col("item_category"))
    return frame.withColumn("item_category", known.cast("string")).select(*order)
