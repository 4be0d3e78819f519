"""Time splits: a held-out test, expanding-window folds and exact negative downsampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators.labels import PAIR


def kind_of_day(day: str, settings: Settings) -> str:
    return "before_sale" if day < settings.sale_day else "on_sale" if day == settings.sale_day else "after_sale"


def validation_days(settings: Settings, kinds: tuple[str, ...] = ("before_sale", "on_sale", "after_sale")) -> dict[int, str]:
    """Each fold's number and validation day; a fold is trained on all days before it."""
    later = [d for d in settings.trainval_days[1:] if d >= settings.first_validation_day]
    return {i: d for i, d in enumerate(later, 1) if kind_of_day(d, settings) in kinds}


def folds_frame(spark: SparkSession, settings: Settings) -> DataFrame:
    """(fold, cutoff_date, role, day_type): some dozen rows, however large the data."""
    rows = [(i, d, "val" if d == v else "train", kind_of_day(v, settings)) for i, v in validation_days(settings).items() for d in settings.trainval_days if d <= v]
    return spark.createDataFrame(rows, "fold int, cutoff_date string, role string, day_type string")


def split(matrix: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(test, trainval), complementary by day."""
    held = F.col("cutoff_date").isin(*settings.test_days)
    return matrix.where(held), matrix.where(~held)


def in_folds(trainval: DataFrame, settings: Settings) -> DataFrame:
    """Rows once per fold and role they take part in."""
    return trainval.join(F.broadcast(folds_frame(trainval.sparkSession, settings)), "cutoff_date")  # folds x days rows


def downsample(rows: DataFrame, ratio: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """All positives and the ``ratio`` x positives negatives whose keyed MD5s are smallest, per ``by``.

    Exact and repeatable on any cluster, and rows aren't shuffled: counts by digest bucket tell which
    buckets are kept whole, and only the one that the limit falls into is ranked. ``by`` has few groups
    (folds); those without positives keep every row.
    """
    own, by = rows.columns, by or ["_all"]
    mark = F.md5(F.concat_ws("|", *PAIR, "cutoff_date", *[b for b in by if b in own], F.lit(seed)))
    rows = rows.select("*", *[F.lit(0).alias(b) for b in by if b not in own], mark.alias("_md5")).withColumn("_b", F.substring("_md5", 1, 3))
    over = f"PARTITION BY {', '.join(by)}"
    counts = rows.groupBy(*by, "_b").agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos"))  # at most 4,096 rows a group
    upto = counts.selectExpr(*by, "_b", "neg", f"sum(neg) OVER ({over} ORDER BY _b) - neg AS before", f"{ratio} * sum(pos) OVER ({over}) AS most")
    # Where each group's limit falls: buckets below are whole, of this one so many negatives stay.
    limits = upto.groupBy(*by).agg(F.first("most").alias("_most"), F.min_by(F.struct("_b", (F.col("most") - F.col("before")).alias("n")), F.when((F.col("most") > 0) & (F.col("before") + F.col("neg") > F.col("most")), F.col("_b"))).alias("_at"))
    met = rows.join(F.broadcast(limits), by)  # one row a group
    whole = met.where("label = 1 OR _at IS NULL OR _b < _at._b").select(*own)
    rank = F.expr(f"row_number() OVER ({over} ORDER BY _md5, {', '.join(PAIR)})")
    last = met.where("label = 0 AND _b = _at._b").withColumn("_r", rank).where("_r <= _at.n")
    return whole.unionByName(last.select(*own))


def downsampled_train(trainval: DataFrame, settings: Settings, ratio: int, seed: int) -> DataFrame:
    """Every fold's training rows, negatives reduced; the fold's number is part of the digest."""
    return downsample(in_folds(trainval, settings).where("role = 'train'"), ratio, seed, ["fold"])


def fold_spec(trainval: DataFrame, settings: Settings, ratio: int) -> DataFrame:
    train = F.col("role") == "train"
    found = in_folds(trainval, settings).groupBy("fold", "day_type").agg(
        F.max(F.when(~train, F.col("cutoff_date"))).alias("val_date"),
        F.count_if(train).alias("train_rows_natural"), F.count_if(train & (F.col("label") == 1)).alias("train_positives"),
        F.count_if(~train).alias("val_rows"), F.count_if(~train & (F.col("label") == 1)).alias("val_positives"),
    )
    pos, n = F.col("train_positives"), F.col("train_rows_natural")
    return found.withColumn("train_rows_downsampled", pos + F.least(n - pos, pos * ratio))


def fold_records(trainval: DataFrame, settings: Settings, ratio: int) -> list[dict]:
    """What ``write_json`` keeps: one record per fold, its days and its counts."""
    days = {i: [d for d in settings.trainval_days if d < v] for i, v in validation_days(settings).items()}
    counts = {r["fold"]: r.asDict() for r in fold_spec(trainval, settings, ratio).collect()}
    return [{"fold": i, "val_day": v, "day_type": kind_of_day(v, settings), "train_days": days[i]} | counts.get(i, {}) for i, v in validation_days(settings).items()]
