"""The named queries of the behaviour-log engine and their SQL twins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from datetime import date, timedelta
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import assemble as A
from tidemark.operators import explore as E
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.operators import metrics as M
from tidemark.operators import split as P
from tidemark.operators import validate as V
from tidemark.operators.feature_tables import TABLES
from tidemark.plans.oracle import oracle
from tidemark.sources import behavior as B

Query = Callable[[SparkSession, str], DataFrame]
SETTINGS = Settings()
BUILDERS = {"feat_user": X.user_features, "feat_item": X.item_features, "feat_category": X.category_features, "feat_user_item": X.user_item_features, "feat_user_category": X.user_category_features}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sample_labels(_history(spark, sf_dir, keep_day=True), SETTINGS)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to so many digits, so that two engines' last bits don't matter."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _history(spark: SparkSession, sf_dir: str, keep_day: bool = False) -> DataFrame:
    """The log as far as the last prediction day needs it: labels read that day too."""
    last = max(SETTINGS.prediction_days)
    if keep_day:
        return B.events_log(spark, sf_dir)
    return B.events_log(spark, sf_dir, before=last)


def _reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as far as samples and labels need it: from the first lookback to the last day's end."""
    first, last = (date.fromisoformat(f(SETTINGS.prediction_days)) for f in (min, max))
    return B.events_log(spark, sf_dir, before=str(last + timedelta(1)), since=str(first - timedelta(SETTINGS.lookback_days)))


def _explore(f) -> Query:
    return lambda spark, sf: rounded(f(B.events_log(spark, sf)))


def _orders(f) -> Query:
    return lambda spark, sf: rounded(f(B.orders_log(spark, sf)))


def _labels(f) -> Query:
    return lambda spark, sf: rounded(f(_reach(spark, sf), SETTINGS))


def _features(f, *columns: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = f(_history(spark, sf), SETTINGS)
        return rounded(df.select(*columns) if columns else df)

    return run


def _sample_query(f) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        log = _reach(spark, sf)
        return rounded(f(log, L.sample_labels(log, SETTINGS)))

    return run


_held: dict[str, DataFrame] = {}


def _hold(role: str, df: DataFrame) -> DataFrame:
    """``df`` persisted; the one held before in that role is released, so queries don't pile them up."""
    if role in _held and _held[role].sparkSession.sparkContext._jsc is not None:
        _held[role].unpersist()
    _held[role] = df.persist()
    return df


_stored: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_stored() -> None:
    spark = SparkSession.getActiveSession()
    while _stored and spark is not None and spark.sparkContext._jsc is not None:
        _delete(spark, _stored.popitem()[1])


def _store(role: str, df: DataFrame) -> DataFrame:
    """``df`` as Parquet in ``spark.checkpoint.dir``, where its lineage ends; the one stored before in that role is deleted.

    What reads a persisted table has its whole plan compared with that table's, for each of some hundred jobs. In local
    mode a temporary folder does where that setting is missing; elsewhere ``df`` is persisted then.
    """
    spark = df.sparkSession
    shared, master = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir(), spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        return _hold(role, df)
    if not shared:
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shared = f"file://{folder}"
    path = f"{shared.rstrip('/')}/tidemark-{role}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if role in _stored:
        _delete(spark, _stored[role])
    _stored[role] = path
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task takes at least, unless cores would be idle.
TASK_ROWS = 200_000


def _parts(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: as many for each core, none much below ``TASK_ROWS`` once there is one a core."""
    cores = max(1, spark.sparkContext.defaultParallelism)
    return cores * max(1, -(-rows // (TASK_ROWS * cores)))


def matrix(spark: SparkSession, sf: str, fill: bool = True) -> DataFrame:
    """Features share one reduced table of what lies before the last day; the labels' day is read for the sample.

    What is persisted keeps its shuffle's partitions, however few rows they hold, so both tables are put together to
    parts that follow the stored rows: reduced there are no more, and each is in the lookback of so many days at most.
    The reduced table is filled while the frames on it are put together, which takes the driver as long.
    """
    log = _hold("reduced", X.reduced(_history(spark, sf)))
    with ThreadPool(1) as pool:
        filled = pool.apply_async(inheritable_thread_target(spark)(log.count))
        rows = B.events_rows(spark, sf)
        frame = A.assemble(log.coalesce(_parts(spark, rows)), SETTINGS, sample=L.sample_labels(_reach(spark, sf), SETTINGS), fill=fill)
        filled.get()
    return frame.coalesce(_parts(spark, rows * SETTINGS.lookback_days))


def _null_report(spark: SparkSession, sf: str) -> DataFrame:
    frame = matrix(spark, sf, fill=False)
    nulls = A.null_report(frame)
    return frame.agg(F.count("*").alias("n_rows"), sum((F.count_if(F.col(c).isNull()) for c in nulls.columns), F.lit(0).cast("bigint")).alias("n_nulls"))


def _days(columns) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        days = spark.createDataFrame([(d,) for d in SETTINGS.prediction_days], "cutoff_date string")
        return days.withColumns(columns())

    return run


def _split_counts(log: DataFrame, sample: DataFrame) -> DataFrame:
    part = F.when(F.col("cutoff_date").isin(*SETTINGS.test_days), "test").otherwise("trainval")
    return sample.groupBy(part.alias("part")).agg(F.count("*").alias("n_rows"), F.sum("label").alias("n_positives"))


def _trainval(f) -> Query:
    return _sample_query(lambda log, sample: f(P.split(sample, SETTINGS)[1]))


def scored_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rule scores of every validation row; the rules' columns come from the pair table alone."""
    _, trainval = P.split(L.sample_labels(_reach(spark, sf), SETTINGS), SETTINGS)
    val = P.in_folds(trainval, SETTINGS).where("role = 'val'")
    return M.rule_scores(val.join(X.user_item_features(_history(spark, sf), SETTINGS), [*L.PAIR, "cutoff_date"], "left"), "fold", "day_type", "cutoff_date")


def _rules(f) -> Query:
    return lambda spark, sf: rounded(f(scored_rules(spark, sf)))


def _by_day_type(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.by_day_type(M.curve_areas(scored_rules(spark, sf), ["fold", "model", "day_type"])), 6)


def _structural(table: str) -> Query:
    return lambda spark, sf: V.structure(BUILDERS[table](_history(spark, sf), SETTINGS), table, len(SETTINGS.prediction_days))


def _reconcile(table: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        log = _history(spark, sf)
        return V.reconcile(BUILDERS[table](log, SETTINGS), log, table, SETTINGS)

    return run


def _key_sample(table: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return V.key_sample(BUILDERS[table](_history(spark, sf), SETTINGS), TABLES[table]["key"], 16, SETTINGS.seed)

    return run


def _planted_structure(spark: SparkSession, sf: str) -> DataFrame:
    """The checks on a table with planted faults: nulls, repeats, odd hours, odd flags and a day that is absent."""
    items = X.item_features(_history(spark, sf), SETTINGS).where(F.col("cutoff_date") > min(SETTINGS.prediction_days))
    items = items.withColumns({
        "item_buy_all": F.expr("IF(item_id = '0', NULL, item_buy_all)"), "item_peak_hour": F.expr("IF(item_id = '2', 24, item_peak_hour)"),
        "item_is_cold": F.expr("IF(item_id = '3', 1 - item_is_cold, item_is_cold)"),
    })
    return V.structure(items.unionByName(items.where("item_id = '1'")), "feat_item", len(SETTINGS.prediction_days))


def _planted_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Against a table with one column changed in one category, and a key that the log doesn't have."""
    log = _history(spark, sf)
    frame = X.category_features(log, SETTINGS).withColumn("category_buy_all", F.expr("category_buy_all + IF(item_category = '0', 1, 0)"))
    more = spark.createDataFrame([("none", SETTINGS.prediction_days[0], 0, 0, 0, 0.0)], frame.select("item_category", "cutoff_date", "category_browse_all", "category_buy_all", "category_distinct_item", "category_conversion_browse_buy").schema)
    return V.reconcile(frame.unionByName(more), log, "feat_category", SETTINGS)


def _planted_sample(log: DataFrame, sample: DataFrame) -> DataFrame:
    """The sample's checks after labels, pairs and users were spoilt for some items."""
    bad = sample.where("item_id <> '3'").withColumns({"label": F.expr("IF(item_id = '0', 2, label)"), "user_id": F.expr("IF(item_id = '2', NULL, user_id)")})
    return L.sample_checks(log, bad.unionByName(bad.where("item_id = '1'")), SETTINGS)


def _peak_recipe(log: DataFrame, settings: Settings) -> DataFrame:
    """Peak hours from ranked histograms, the second definition of ``user_peak_hours``."""
    hist = X.user_hours(log, settings)
    out = None
    for name, n in (("user_peak_hour", "total_cnt"), ("user_browse_peak_hour", "browse_cnt"), ("user_buy_peak_hour", "buy_cnt")):
        rank = F.row_number().over(V.W.partitionBy("user_id", "cutoff_date").orderBy(F.desc(n), "hod"))
        top = hist.withColumn("_r", rank).where("_r = 1").select("user_id", "cutoff_date", F.when(F.col(n) > 0, F.col("hod")).otherwise(-1).cast("bigint").alias(name))
        out = top if out is None else out.join(top, ["user_id", "cutoff_date"])
    return out


def _semi(log: DataFrame, settings: Settings) -> DataFrame:
    rows = L.by_day(X.daily(log, "item_id"), settings.prediction_days, X.earlier)
    kept = rows.join(L.candidates(log, settings, ["item_id"]), ["item_id", "cutoff_date"], "left_semi")
    return kept.groupBy("item_id", "cutoff_date").agg(F.sum("n").alias("n_rows"))


#: The learners' parameters are those of conf/settings.yaml: ``trees`` bounds them, early stopping picks how many.
PARAMS = {"depth": 6, "rate": 0.1, "trees": 600, "rows": 0.8, "columns": 0.8, "min_rows": 1}


def _model(f) -> Query:
    """On the matrix of all days, stored while the folds read it again and again."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        from tidemark.operators import models

        whole = _store("matrix", matrix(spark, sf))
        test, trainval = P.split(whole, SETTINGS)
        return rounded(f(models, test, trainval, P.validation_days(SETTINGS)))

    return run


#: The set-ups and seeds that are compared, those of conf/settings.yaml: ratio of negatives, None for every row.
RATIOS, SEEDS = (5, 10, 20, 50, None), (42, 43)


def _sweep(m, tv: DataFrame, days: dict[int, str], *how) -> DataFrame:
    return m.run_sweep(tv, m.fit_jobs(days, RATIOS, SEEDS), SETTINGS, PARAMS, *how)


def _final(part: int) -> Query:
    """The sweep's best set-up with its number of trees, fitted once."""

    def run(m, test, tv, days):
        name, trees = m.best_config(_sweep(m, tv, days, 30, False))
        return m.train_final(tv, test, {m.set_up(r): r for r in RATIOS}[name], trees, PARAMS, SEEDS[0])[part]

    return _model(run)


MODELS = {
    "model_baselines": _model(lambda m, test, tv, days: m.run_baselines(tv, days, SETTINGS)),
    "model_sweep": _model(lambda m, test, tv, days: _sweep(m, tv, days)),
    "model_final_test": _final(1), "model_importances": _final(2),
    "model_permutation": _model(lambda m, test, tv, days: m.permutation_importance(tv, m.normal_folds(SETTINGS), 20, SETTINGS, PARAMS)),
    "model_ablation": _model(lambda m, test, tv, days: m.run_ablation(tv, m.normal_folds(SETTINGS), 20, SETTINGS, PARAMS)),
}
USER, ITEM, PAIRS = ("user_id", "cutoff_date"), ("item_id", "cutoff_date"), ("user_id", "item_id", "cutoff_date")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "row_count": _explore(E.row_count), "missing_values": _explore(E.missing_values), "behavior_domain": _explore(E.behavior_domain), "time_range": _explore(E.time_range),
        "duplicate_rows": _explore(E.duplicate_rows), "item_category_consistency": _explore(E.item_category_consistency), "scale": _explore(E.scale),
        "daily_breakdown": _explore(E.daily_breakdown), "peak_day": _explore(E.peak_day), "target_prevalence": _explore(E.target_prevalence), "user_activity": _explore(E.user_activity),
        "activity_percentiles": _explore(E.activity_percentiles), "user_activity_histogram": _explore(E.activity_histogram), "buyers_and_cold_items": _explore(E.buyers_and_cold_items),
        "sparsity": _explore(E.sparsity), "behavior_share": _explore(E.behavior_share), "positive_rate": _explore(E.positive_rate),
        "orders_daily": _orders(E.daily_breakdown), "orders_scale": _orders(E.scale),
        "sample_labels": _labels(L.sample_labels), "candidate_recall": _labels(L.candidate_recall), "positive_recount": _labels(L.positive_recount),
        "sample_summary": _sample_query(lambda log, s: L.sample_summary(s)), "sample_checks": _sample_query(lambda log, s: L.sample_checks(log, s, SETTINGS)),
        "spot_check_history": _sample_query(lambda log, s: L.spot_check_history(log, s, SETTINGS)), "candidate_item_semi_join": _features(_semi),
        "user_hour_histogram": _features(X.user_hours), "item_hour_histogram": _features(X.item_hours), "pair_hour_presence": _features(X.pair_hours), "peak_hour_recipe": _features(_peak_recipe),
        "user_counts": _features(X.user_features, *USER, "user_browse_1d", "user_browse_7d", "user_browse_all", "user_favorite_all", "user_cart_all", "user_buy_all"),
        "user_hour_pivot": _features(X.user_features, *USER, *[f"user_action_{h}" for h in range(24)]),
        "user_peak_hours": _features(X.user_features, *USER, "user_peak_hour", "user_browse_peak_hour", "user_buy_peak_hour"),
        "user_daypart_fractions": _features(X.user_features, *USER, "user_morning_fraction", "user_afternoon_fraction", "user_night_fraction"),
        "user_hour_entropy": _features(X.user_features, *USER, "user_hour_entropy"), "user_recency": _features(X.user_features, *USER, "user_since_last_hour"),
        "conversion_ratios": _features(X.user_features, *USER, "user_conversion_browse_buy", "user_conversion_cart_buy"),
        "item_counts": _features(X.item_features, *ITEM, "item_category", "item_browse_all", "item_favorite_all", "item_cart_all", "item_buy_all", "item_distinct_user"),
        "item_peak_hours": _features(X.item_features, *ITEM, "item_peak_hour", "item_browse_peak_hour", "item_buy_peak_hour"),
        "category_counts": _features(X.category_features, "item_category", "cutoff_date", "category_browse_all", "category_buy_all", "category_distinct_item"),
        "user_category_counts": _features(X.user_category_features),
        "user_item_counts": _features(X.user_item_features, *PAIRS, "user_item_browse_1d", "user_item_browse_7d", "user_item_browse_all", "user_item_browse_distinct_hour", "user_item_cart_all", "user_item_buy_all"),
        "user_item_last_behavior": _features(X.user_item_features, *PAIRS, "user_item_last_behavior"), "user_item_recency": _features(X.user_item_features, *PAIRS, "user_item_since_last_hour"),
        "user_item_peak_flags": _features(X.user_item_features, *PAIRS, "user_item_is_user_peak_hour", "user_item_is_item_peak_hour"),
        "combined_feat_category": _features(X.category_features),
        "context_features": _days(lambda: A.context_columns(SETTINGS)), "day_type": _days(lambda: {"day_type": A.day_type(SETTINGS, F.col("cutoff_date"))}),
        "assemble": lambda spark, sf: rounded(matrix(spark, sf)), "assembled_null_report": _null_report,
        "split_counts": _sample_query(_split_counts), "build_folds": lambda spark, sf: P.folds_frame(spark, SETTINGS),
        "fold_spec": _trainval(lambda t: P.fold_spec(t, SETTINGS, SETTINGS.negative_ratio)),
        "downsampled_train": _trainval(lambda t: P.downsampled_train(t, SETTINGS, SETTINGS.negative_ratio, SETTINGS.seed).select("fold", *PAIRS, "label")),
        "rule_pr_auc": _rules(lambda s: M.curve_areas(s, ["fold", "model"]).select("fold", "model", "pr_auc")),
        "rule_roc_auc": _rules(lambda s: M.curve_areas(s, ["fold", "model"]).select("fold", "model", "roc_auc")),
        "rule_precision_at_k": _rules(lambda s: M.precision_at_k(s, ["fold", "model"])), "metrics_by_day_type": _by_day_type,
    }
    found |= {t: _features(b) for t, b in BUILDERS.items()}
    for t in TABLES:
        found |= {f"structural_checks_{t}": _structural(t), f"reconcile_{t}": _reconcile(t), f"key_sample_{t}": _key_sample(t)}
    found |= {"structural_checks_planted": _planted_structure, "reconcile_planted": _planted_reconcile, "sample_checks_planted": _sample_query(_planted_sample)}
    return found | MODELS


def oracle_sql() -> dict[str, str]:
    return oracle()
