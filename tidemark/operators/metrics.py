"""Ranking metrics, exact under ties.

Rows are first counted by distinct score; average precision and ROC area come from running sums over
those groups, never from row-by-row order. The sums run inside score ranges, from what the ranges above
add up to, so that no task sorts a model's scores whole. Precision at k orders equal scores by key; Spark keeps only
k rows of each task for it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.labels import PAIR

KS = (100, 500, 1000)
RULES = {"rule_cart": "user_item_cart_all", "rule_browse": "user_item_browse_all", "rule_cart_not_buy": "user_item_cart_not_buy", "rule_recency": "-user_item_since_last_hour"}


def rule_scores(rows: DataFrame, *keep: str) -> DataFrame:
    """(keys, label, model, score) once for each rule."""
    pairs = ", ".join(f"'{m}', cast({e} AS double)" for m, e in RULES.items())
    return rows.selectExpr(*keep, *PAIR, "label", f"stack({len(RULES)}, {pairs}) AS (model, score)")


def score_range(score: Column) -> Column:
    """A number that never falls as the score rises: 1,024 ranges for each doubling of its size.

    Null sorts below all and NaN above, as in ``ORDER BY``. Scores closer than 0.07 % share a range.
    """
    size = F.floor(F.least(F.log2(F.abs(score)), F.lit(1025.0)) * 1024) + 1100001
    number = F.when(score > 0, size).when(score < 0, -size).otherwise(0)
    return F.when(score.isNull(), -4000000).when(F.isnan(score), 4000000).otherwise(number).cast("bigint")


def curve_areas(scored: DataFrame, by: list[str]) -> DataFrame:
    """``n``, ``positives``, ``pr_auc`` (average precision) and ``roc_auc``; NaN where one class is absent."""
    return areas_of_counts(scored.withColumn("score", F.col("score").cast("double")).groupBy(*by, "score").agg(F.count("*").alias("c"), F.sum("label").alias("p")), by)


def areas_of_counts(groups: DataFrame, by: list[str]) -> DataFrame:
    """The same from rows already counted: of each distinct ``score``, all (``c``) and positive (``p``)."""
    groups = groups.withColumn("_range", score_range(F.col("score")))
    higher = W.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    ranges = groups.groupBy(*by, "_range").agg(F.sum("c").alias("_c"), F.sum("p").alias("_p"))
    above = ranges.select(*[F.col(c).alias(f"_of_{c}") for c in [*by, "_range"]], *[F.coalesce(F.sum(x).over(higher), F.lit(0)).alias(f"{x}_above") for x in ("_c", "_p")])
    upto = W.partitionBy(*by, "_range").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, "_range"]]
    run = groups.join(above, same).withColumns({"n_upto": F.col("_c_above") + F.sum("c").over(upto), "p_upto": F.col("_p_above") + F.sum("p").over(upto)})
    found = run.groupBy(*by).agg(
        F.sum("c").alias("n"), F.sum("p").cast("bigint").alias("positives"),
        F.sum(F.col("p") * (F.col("p_upto") / F.col("n_upto"))).alias("_ap"),
        # negatives above each positive, half of those it ties with
        F.sum(F.col("p") * ((F.col("n_upto") - F.col("p_upto")) - (F.col("c") - F.col("p")) / 2)).alias("_above"),
    )
    pos, neg = F.col("positives"), F.col("n") - F.col("positives")
    both = (pos > 0) & (neg > 0)
    nan = F.lit(float("nan"))
    return found.select(*by, "n", "positives", F.when(both, F.col("_ap") / pos).otherwise(nan).alias("pr_auc"), F.when(both, 1 - F.col("_above") / (pos * neg)).otherwise(nan).alias("roc_auc"))


def counted(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores, how many rows have each, and how many of them are positive."""
    distinct, at = np.unique(score + 0.0, return_inverse=True)  # no -0.0
    return distinct, np.bincount(at, minlength=len(distinct)), np.bincount(at, label, len(distinct)).astype(np.int64)


def areas(score: np.ndarray, label: np.ndarray) -> tuple[int, int, float, float]:
    """``curve_areas`` of rows at hand: rows, positives, average precision, ROC area."""
    _, c, p = (v[::-1] for v in counted(score, label))
    n, positives = len(score), int(p.sum())
    if not 0 < positives < n:
        return n, positives, float("nan"), float("nan")
    n_upto, p_upto = np.cumsum(c), np.cumsum(p)
    above = (p * ((n_upto - p_upto) - (c - p) / 2)).sum()
    return n, positives, float((p * (p_upto / n_upto)).sum() / positives), float(1 - above / (positives * (n - positives)))


def precision_at_k(scored: DataFrame, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """``p_at_k`` and ``r_at_k``, k clipped to the rows there are; 0 without positives."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), *PAIR)
    top = scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(ks))
    hits = top.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("_r") <= k, F.col("label"))), F.lit(0)).alias(f"_h{k}") for k in ks])
    totals = scored.groupBy(*by).agg(F.count("*").alias("_n"), F.sum("label").alias("_p"))
    both = totals.join(hits, by)
    cut = lambda k: F.least(F.col("_n"), F.lit(k))
    return both.select(*by, *[F.coalesce(F.try_divide(f"_h{k}", cut(k)), F.lit(0.0)).alias(f"p_at_{k}") for k in ks], *[F.coalesce(F.try_divide(F.col(f"_h{k}"), F.col("_p")), F.lit(0.0)).alias(f"r_at_{k}") for k in ks])


def evaluate(scored: DataFrame, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    return curve_areas(scored, by).join(precision_at_k(scored, by, ks), by)


def mean_by(metrics: DataFrame, *group: str, value: str = "pr_auc") -> DataFrame:
    """Means over folds; folds of one class (NaN) are left out, as are groups of nothing else."""
    known = metrics.where(~F.isnan(value))
    return known.groupBy(*group).agg(F.avg(value).alias(f"mean_{value}"), F.count("*").alias("n_folds"))


def by_day_type(metrics: DataFrame, value: str = "pr_auc") -> DataFrame:
    """Models by kind of day, side by side."""
    kinds = ["before_sale", "on_sale", "after_sale"]
    known = F.when(~F.isnan(value), F.col(value))
    pick = lambda k: F.avg(F.when(F.col("day_type") == k, known)).alias(k)
    return metrics.groupBy("model").agg(*[pick(k) for k in kinds], F.avg(known).alias("overall"))


def share(n: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(n, of), F.lit(0.0))
