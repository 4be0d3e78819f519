"""Rankers on the assembled matrix: scaled logistic regression and boosted trees, fold by fold.

The fits of a sweep, an ablation or a permutation grow by the procedure of Spark's own learner in shared passes
(``boosting``), and so does a final fit, unless its model is to be saved. Differences from other libraries' learners:
boosting stops ``patience`` trees after the best average precision on the fold's day and keeps the best prefix; what
Spark's own learner fitted has its prefixes scored, some at a time; importances are Spark's (impurity decrease), not gain per split.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import boosting as G
from tidemark.operators import draws as D
from tidemark.operators import logistic as N
from tidemark.operators import metrics as M
from tidemark.operators.labels import PAIR
from tidemark.operators.split import downsample, kind_of_day, validation_days

KEYS = (*PAIR, "cutoff_date", "label", "item_category")
#: What the ablation named ``no_cart`` leaves out.
CART = ("user_item_cart_all", "user_item_cart_not_buy")
#: A split as a tree prints it.
SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")
NUMERIC = ("bigint", "int", "double", "float")
#: Rows of a block within which values are permuted.
PERMUTED = 100_000
#: Fits under way at a time: while one waits for its last tasks or its driver, others use the cores.
FITS = 8
AREAS = [("n", pa.int64()), ("positives", pa.int64()), ("pr_auc", pa.float64()), ("roc_auc", pa.float64())]
#: A day that all others are before.
AFTER = "9999-12-31"


def feature_names(frame: DataFrame, drop: tuple[str, ...] = ()) -> list[str]:
    """The matrix's numeric features; an error if another column isn't a number."""
    kinds = {c: t for c, t in frame.dtypes if c not in KEYS and c not in drop}
    if odd := [c for c, t in kinds.items() if t not in NUMERIC]:
        raise TypeError(f"not numeric: {', '.join(odd)}")
    return list(kinds)


def set_up(ratio: int | None) -> str:
    """The name of a training set-up: negatives reduced to a ratio, or every row."""
    return f"downsample_{ratio}" if ratio else "full"


def fit_jobs(days: dict[int, str], ratios: tuple[int | None, ...], seeds: tuple[int, ...]) -> list[dict]:
    """One record per fit. Every row (no ratio) is drawn by no seed, so it is fitted with the first alone."""
    return [{"config": set_up(r), "ratio": r, "seed": s, "fold": k, "day": d} for r, s, (k, d) in product(ratios, seeds, days.items()) if r or s == seeds[0]]


def weighed(rows: DataFrame, ratio: int | None, seed: int) -> DataFrame:
    """Rows to fit with their weights ``w``: negatives reduced, or positives weighing as much as the negatives."""
    if ratio:
        return downsample(rows, ratio, seed).withColumn("w", F.lit(1.0))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    return rows.withColumn("w", F.when(F.col("label") == 1, F.lit(n.get(0, 0) / max(n.get(1, 0), 1))).otherwise(F.lit(1.0)))


def before(trainval: DataFrame, day: str) -> DataFrame:
    return trainval.where(F.col("cutoff_date") < day)


def on(trainval: DataFrame, day: str) -> DataFrame:
    """A fold's validation rows, at their natural rate."""
    return trainval.where(F.col("cutoff_date") == day)


def drawn(trainval: DataFrame, jobs: list[dict]) -> DataFrame:
    """trainval with ``_jobs``, the positions of the jobs that a row is a training row of.

    The rows are those that ``downsample`` keeps of the days before the job's with seed + fold, by ``draws.limits``. A
    row's digests are taken once for each seed + fold, whatever the number of jobs that compare them.
    """
    last = D.limits(trainval, jobs)
    until: dict[int, str] = {}
    for seed, day, _ in last:
        until[seed] = max(day, until.get(seed, day))
    digest = {seed: F.when(F.col("cutoff_date") < day, F.md5(F.concat_ws("|", *PAIR, "cutoff_date", F.lit(seed)))) for seed, day in until.items()}
    marked, mark = trainval.withColumns({f"_md5_{seed}": c for seed, c in digest.items()}), lambda seed: F.col(f"_md5_{seed}")
    alike: dict[tuple, dict[str | None, list[int]]] = {}  # jobs of the same days and digests, by their limits
    for i, j in enumerate(jobs):
        limit = last.get((j["seed"] + j["fold"], j["day"], j["ratio"]))
        alike.setdefault((j["day"], limit and j["seed"] + j["fold"]), {}).setdefault(limit, []).append(i)
    places, found = lambda of: F.lit(of).cast("array<int>"), []
    for (day, seed), by_limit in alike.items():
        whole, stays = by_limit.get(None, []), F.when(F.col("cutoff_date") >= day, places([]))
        if limits := sorted(x for x in by_limit if x):
            every = [i for x in by_limit.values() for i in x]
            stays = stays.when(F.col("label") == 1, places(every))
            for at, x in enumerate(limits):  # what is below a limit is below all later ones
                stays = stays.when(mark(seed) <= x, places([*whole, *[i for y in limits[at:] for i in by_limit[y]]]))
        found.append(stays.otherwise(places(whole)))
    return marked.select(*trainval.columns, F.sort_array(F.concat(*found)).alias("_jobs"))


def at_once(run: Callable, of: list) -> list:
    """``run`` of each, ``FITS`` at a time; an error of one is raised."""
    with ThreadPool(max(1, min(FITS, len(of)))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(run), of, chunksize=1)


def _vectors(frame: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(frame)


def logistic_scores(train: DataFrame, val: DataFrame) -> DataFrame:
    """L2 with C = 1 and balanced classes on columns scaled to mean 0 and population deviation 1."""
    names = feature_names(train)
    fitted = N.fit_logistic(train.withColumn("_jobs", F.array(F.lit(0))), 1, len(names), _numbers(names))
    return val.select("cutoff_date", *PAIR, "label", N.probabilities({None: fitted[0]}, _numbers(names)).alias("score"))


def run_baselines(trainval: DataFrame, days: dict[int, str], settings: Settings) -> DataFrame:
    """Metrics of the rules and of logistic regression on each fold, whose fits share their passes."""
    jobs, names = fit_jobs(days, (settings.negative_ratio,), (settings.seed,)), feature_names(trainval)
    fitted = N.fit_logistic(drawn(trainval, jobs), len(jobs), len(names), _numbers(names))
    val = trainval.where(F.col("cutoff_date").isin(*days.values()))
    logistic = N.probabilities({jobs[j]["day"]: f for j, f in fitted.items()}, _numbers(names))
    scored = M.rule_scores(val, "cutoff_date").unionByName(val.select("cutoff_date", *PAIR, "label", F.lit("logistic").alias("model"), logistic.alias("score")))
    of = spread(days, "cutoff_date", settings)
    return M.evaluate(scored.withColumns(of).persist(), ["fold", "day_type", "model"])  # scored once, read by each metric


def spread(days: dict[int, str], day: str, settings: Settings) -> dict[str, Column]:
    """The columns ``fold`` and ``day_type`` of a validation day."""
    fold = F.coalesce(*[F.when(F.col(day) == d, F.lit(k)) for k, d in days.items()])
    kind = F.coalesce(*[F.when(F.col(day) == d, F.lit(kind_of_day(d, settings))) for d in days.values()])
    return {"fold": fold, "day_type": kind}


def boosted(rows: DataFrame | G.Binned, names: list[str], params: dict, seed: int | dict[int, int]) -> GBTClassificationModel | dict[int, list[tuple]]:
    """Fitted on rows with their weights ``w``; on binned rows, the trees of each fit that ``seed`` has one for."""
    if isinstance(rows, G.Binned):
        return G.grow(rows, names, params, seed)
    learner = GBTClassifier(
        labelCol="label", featuresCol="features", weightCol="w", maxDepth=params["depth"], stepSize=params["rate"], maxIter=params["trees"],
        subsamplingRate=params["rows"], featureSubsetStrategy=str(params["columns"]), minInstancesPerNode=params["min_rows"], seed=seed,
    )
    slim = _vectors(rows, names).select("features", F.col("label").cast("double"), "w").persist()  # the learner reads it four times
    model = learner.fit(slim)
    slim.unpersist()
    return model


def tree_nodes(text: str) -> tuple[np.ndarray, ...]:
    """A tree's printed form as arrays: feature (-1 at a leaf), threshold, the two children, prediction."""
    feature, threshold, left, right, value = [], [], [], [], []
    lines = (line.strip() for line in text.splitlines()[1:] if line.strip())

    def node() -> int:
        line, at = next(lines), len(feature)
        for column, empty in ((feature, -1), (threshold, 0.0), (left, at), (right, at), (value, 0.0)):
            column.append(empty)
        if line.startswith("Predict:"):
            value[at] = float(line.removeprefix("Predict:"))
            return at
        found = SPLIT.fullmatch(line)
        if not found:
            raise ValueError(f"not a split on a number: {line}")
        feature[at], threshold[at] = int(found[1]), float(found[2])
        left[at] = node()
        next(lines)  # the same split's other side
        right[at] = node()
        return at

    node()
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)


def ensemble(model: GBTClassificationModel, names: list[str], of: list[str], day: str | None = None) -> dict:
    """What tasks need of a model fitted on ``of``, to score rows of ``names``: those of its day, or all."""
    where = np.array([names.index(n) for n in of])
    trees = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        feature, *rest = tree_nodes(tree.toDebugString)
        trees.append((np.where(feature < 0, 0, where[feature]), feature >= 0, *rest, tree.depth, weight))
    return {"day": day, "trees": trees}


def run_trees(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    """(rows, trees): what each tree adds, a batch going down each at once."""
    every, out = np.arange(len(x)), np.empty((len(x), len(trees)))
    for i, (feature, _, threshold, left, right, value, depth, weight, *_) in enumerate(trees):
        at = np.zeros(len(x), np.int64)
        for _ in range(depth):
            at = np.where(x[every, feature[at]] <= threshold[at], left[at], right[at])  # a leaf leads to itself
        out[:, i] = value[at] * weight
    return out


def _numbers(names: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in names])


def _lists(width: np.ndarray, blocks: list[tuple], fields: tuple[str, ...]) -> pa.Array:
    """One list of structs a row, ``width`` long; a block: its rows, what all of them say of each place, their scores."""
    start = np.r_[0, np.cumsum(width)]
    ids = np.zeros((2, start[-1]), np.int32)
    score = np.zeros(start[-1])
    for rows, said, scores in blocks:
        place = start[rows][:, None] + np.arange(scores.shape[1])
        score[place], ids[0][place], ids[1][place] = scores, said[0], said[1]
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.StructArray.from_arrays([pa.array(ids[0]), pa.array(ids[1]), pa.array(score)], names=list(fields)))


def _scorer(ensembles: dict[int, dict], spans: dict[int, tuple[int, int]]) -> Callable:
    """Of a batch's days and values: (rows of a day, (their jobs, trees), (rows, jobs and trees) scores)."""
    spans = {j: (a, min(b, len(ensembles[j]["trees"]))) for j, (a, b) in spans.items()}
    parts = {j: {"day": ensembles[j]["day"], "trees": ensembles[j]["trees"][:b]} for j, (a, b) in spans.items()}

    def each(day: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        for d in set(day):
            mine, jobs = np.flatnonzero(day == d), [j for j, e in parts.items() if e["day"] in (None, d)]
            if not jobs:
                continue
            scores = [np.cumsum(run_trees(parts[j]["trees"], x[mine]), axis=1)[:, spans[j][0] - 1:] for j in jobs]
            job = np.concatenate([np.full(s.shape[1], j) for j, s in zip(jobs, scores, strict=True)])
            trees = np.concatenate([np.arange(spans[j][0], spans[j][1] + 1) for j in jobs])
            yield mine, (job, trees), np.concatenate(scores, axis=1)

    return each


def _counts(found: list[tuple], fields: tuple[str, ...]) -> pa.RecordBatch:
    """``found``: a value of each field, and what ``counted`` gave."""
    sizes = [len(f[-1][0]) for f in found]
    columns = [pa.array(np.repeat([f[i] for f in found], sizes).astype(np.int32)) for i in range(len(fields))]
    columns += [pa.array(np.concatenate([f[-1][i] for f in found])) for i in range(3)]
    return pa.RecordBatch.from_arrays(columns, names=[*fields, "score", "c", "p"])


def score_areas(ensembles: dict[int, dict], val: DataFrame, names: list[str], spans: dict[int, tuple[int, int]]) -> DataFrame:
    """``curve_areas`` of ``ensemble_scores`` by job and trees; equal scores are counted where they are computed."""
    each = _scorer(ensembles, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            found = [(j, t, M.counted(s, label[mine])) for mine, (job, trees), scores in each(b.column(0).to_numpy(zero_copy_only=False), G.matrix(b.column(2))) for j, t, s in zip(job, trees, scores.T, strict=True)]
            if found:
                yield _counts(found, ("job", "trees"))

    counts = val.select("cutoff_date", "label", _numbers(names)).mapInArrow(run, "job int, trees int, score double, c bigint, p bigint")
    return M.areas_of_counts(counts.groupBy("job", "trees", "score").agg(F.sum("c").alias("c"), F.sum("p").alias("p")), ["job", "trees"])


def ensemble_scores(ensembles: dict[int, dict], val: DataFrame, names: list[str], spans: dict[int, tuple[int, int]]) -> DataFrame:
    """Each model's day scored by its first ``spans[job]`` trees, from the one to the other: (keys, label, job, trees, score).

    One pass over the rows, whatever the number of models and trees.
    """
    each = _scorer(ensembles, spans)

    def run(days: pa.Array, rows: pa.Array) -> pa.Array:
        blocks, width = list(each(days.to_numpy(zero_copy_only=False), G.matrix(rows))), np.zeros(len(rows), np.int64)
        for mine, (job, _), _ in blocks:
            width[mine] = len(job)
        return _lists(width, blocks, ("job", "trees", "score"))

    scores = F.arrow_udf(run, "array<struct<job:int,trees:int,score:double>>")("cutoff_date", _numbers(names))
    return val.select("cutoff_date", *PAIR, "label", F.inline(scores))


def prefix_scores(model: GBTClassificationModel, val: DataFrame, names: list[str], first: int = 1, last: int | None = None) -> DataFrame:
    """Validation rows scored by the first ``first``, ..., ``last`` trees: (keys, label, trees, score)."""
    return ensemble_scores({0: ensemble(model, names, names)}, val, names, {0: (first, last or len(model.trees))}).drop("job")


def best_prefixes(ensembles: dict[int, dict], val: DataFrame, names: list[str], patience: int) -> dict[int, int]:
    """Each job's trees up to the best average precision, looking no further than ``patience`` trees beyond it."""
    return {j: trees for j, (trees, _) in best_areas(ensembles, val, names, patience).items()}


def best_areas(ensembles: dict[int, dict], val: DataFrame, names: list[str], patience: int) -> dict[int, tuple[int, Row | None]]:
    """Each job's best prefix and the areas it was chosen by; None for a job whose day has no rows.

    ``patience`` prefixes of all jobs not yet done are scored at a time; what leaves a task are counts of equal scores.
    Fits that stopped early know their best, and are scored by that alone.
    """
    if all("best" in e for e in ensembles.values()):
        known = {r.job: r for r in score_areas(ensembles, val, names, {j: (e["best"], e["best"]) for j, e in ensembles.items()}).collect()}
        return {j: (e["best"], known.get(j)) for j, e in ensembles.items()}
    judge = Judge(val, names, patience, {j: e["day"] for j, e in ensembles.items()})
    for upto in range(patience, max(len(e["trees"]) for e in ensembles.values()) + patience, patience):
        if len(judge.look({j: e["trees"][:upto] for j, e in ensembles.items()})) == len(ensembles):
            break
    return {j: (judge.at.get(j, 1), judge.found.get(j)) for j in ensembles}


class Judge:
    """The best prefix of fits that still grow, and which of them went ``patience`` trees beyond it."""

    def __init__(self, val: DataFrame, names: list[str], patience: int, days: dict[int, str | None]):
        self.val, self.names, self.patience, self.days = val, names, patience, days
        self.upto, self.best, self.at, self.found, self.settled = {}, {}, {}, {}, set()

    def look(self, trees: dict[int, list[tuple]]) -> set[int]:
        """Scores the prefixes not seen yet; the jobs that are settled."""
        new = {j: t for j, t in trees.items() if j not in self.settled and len(t) > self.upto.get(j, 0)}
        spans = {j: (self.upto.get(j, 0) + 1, len(t)) for j, t in new.items()}
        met = set()
        for r in sorted(score_areas({j: {"day": self.days[j], "trees": t} for j, t in new.items()}, self.val, self.names, spans).collect() if new else [], key=lambda r: (r.job, r.trees)):
            met.add(r.job)
            if r.job in self.settled:
                continue
            self.found.setdefault(r.job, r)
            if r.pr_auc > self.best.get(r.job, -1.0):  # never so for NaN
                self.best[r.job], self.at[r.job], self.found[r.job] = r.pr_auc, r.trees, r
            elif r.trees - self.at.get(r.job, 1) >= self.patience:
                self.settled.add(r.job)
        self.upto |= {j: len(t) for j, t in new.items()}
        self.settled |= set(new) - met  # no rows to judge by
        return self.settled


def best_prefix(model: GBTClassificationModel, val: DataFrame, names: list[str], patience: int) -> int:
    return best_prefixes({0: ensemble(model, names, names)}, val, names, patience)[0]


def fit_all(trainval: DataFrame, jobs: list[dict], names: list[str], params: dict, patience: int | None = None) -> dict[int, dict]:
    """The ensemble of each job, by its position; a job may ``drop`` features.

    With ``patience``, fits grow no more than so many trees beyond the best average precision on their day, and keep
    those up to it, whose number is their ``best``; without, they have all trees.
    """
    counts = trainval.groupBy("cutoff_date", "label").count().collect()  # two rows a day
    sums = {d: [sum(r["count"] for r in counts if r["cutoff_date"] < d and r["label"] == y) for y in (0, 1)] for d in sorted({j["day"] for j in jobs})}
    heavy = [1.0 if j["ratio"] else sums[j["day"]][0] / max(sums[j["day"]][1], 1) for j in jobs]
    two = (lambda: G.split_points(trainval, {d: sum(n) for d, n in sums.items()}, _numbers(names)), lambda: D.limits(trainval, jobs))
    cuts, last = at_once(lambda f: f(), list(two))
    rows, groups = G.binned(trainval, jobs, names, heavy, cuts, _numbers(names), last), {}
    rows.sizes = [sum(sums[j["day"]]) if not j["ratio"] or not sums[j["day"]][1] else sums[j["day"]][1] + min(sums[j["day"]][0], j["ratio"] * sums[j["day"]][1]) for j in jobs]
    if patience is not None:
        val = trainval.where(F.col("cutoff_date").isin(*sums))
        rows.patience, rows.judged = patience, G.judged(trainval, cuts, _numbers(names))
        rows.judge = lambda: Judge(val, names, patience, {i: j["day"] for i, j in enumerate(jobs)})
    rows.blocks.count()  # stored before several passes ask for it
    for i, j in enumerate(jobs):
        groups.setdefault(tuple(n for n in names if n not in j.get("drop", ())), {})[i] = j["seed"]
    found = at_once(lambda g: boosted(rows, list(g[0]), params, g[1]), list(groups.items()))
    rows.blocks.unpersist()
    return {i: {"day": jobs[i]["day"], "trees": own} | ({"best": rows.best[i]} if patience is not None else {}) for trees in found for i, own in sorted(trees.items())}


def run_sweep(trainval: DataFrame, jobs: list[dict], settings: Settings, params: dict, patience: int = 30, precision: bool = True) -> DataFrame:
    """Metrics of each job with the trees kept; a job's rows are those before its day, scored on the day.

    Areas are those that the trees were chosen by. Without ``precision``, which choosing a set-up doesn't read, no
    row is scored again.
    """
    names, days = feature_names(trainval), {j["fold"]: j["day"] for j in jobs}
    ensembles, val = fit_all(trainval, jobs, names, params, patience), trainval.where(F.col("cutoff_date").isin(*days.values()))
    found = best_areas(ensembles, val, names, patience)
    of = [(i, r.n, r.positives, r.pr_auc, r.roc_auc, j["config"], j["seed"], j["fold"], kind_of_day(j["day"], settings), t) for i, (j, (t, r)) in enumerate(zip(jobs, (found[i] for i in range(len(jobs))), strict=True)) if r]
    kinds = pa.schema([("job", pa.int32()), *AREAS, ("config", pa.string()), ("seed", pa.int32()), ("fold", pa.int32()), ("day_type", pa.string()), ("best_trees", pa.int32())])
    known = trainval.sparkSession.createDataFrame(pa.table([list(c) for c in zip(*of, strict=True)] or [[]] * len(kinds), schema=kinds))  # from rows, it would start Python workers
    if not precision:
        return known.drop("job")
    scored = ensemble_scores(ensembles, val, names, {j: (t, t) for j, (t, _) in found.items()}).select(*PAIR, "label", "job", "score")
    at_k = M.precision_at_k(scored.persist(), ["job"])
    return at_k.join(F.broadcast(known), "job").select(*known.columns[1:5], *at_k.columns[1:], *known.columns[5:])  # one row a job


def sweep_means(sweep: DataFrame, days: dict[int, str]) -> DataFrame:
    """Mean average precision by set-up: over all folds, by kind of day, and over weekends."""
    weekend = [k for k, d in days.items() if date.fromisoformat(d).weekday() >= 5]
    known = sweep.where(~F.isnan("pr_auc"))
    part = lambda c: F.avg(F.when(c, F.col("pr_auc")))
    kinds = {f"pr_auc_{k}": part(F.col("day_type") == k) for k in ("before_sale", "on_sale", "after_sale")}
    return known.groupBy("config").agg(F.avg("pr_auc").alias("pr_auc"), *[c.alias(n) for n, c in kinds.items()], part(F.col("fold").isin(*weekend)).alias("pr_auc_weekend"), F.median("best_trees").alias("best_trees"))


def best_config(sweep: DataFrame) -> tuple[str, int]:
    """The set-up of the best mean average precision, and the median of its trees."""
    means = sweep.where(~F.isnan("pr_auc")).groupBy("config").agg(F.avg("pr_auc").alias("m"), F.median("best_trees").alias("t"))
    row = means.orderBy(F.desc("m"), "config").first()
    return row["config"], int(row["t"])


def train_final(trainval: DataFrame, test: DataFrame, ratio: int | None, trees: int, params: dict, seed: int, spark_model: bool = False) -> tuple[GBTClassificationModel | dict, DataFrame, DataFrame]:
    """(model, test metrics, importances), fitted on all of trainval and evaluated once.

    By the learner that the sweep compared set-ups with, or by Spark's own, whose model can be saved.
    """
    names, params = feature_names(trainval), params | {"trees": trees}
    if spark_model:
        model = boosted(weighed(trainval, ratio, seed), names, params, seed)
        fitted = ensemble(model, names, names)
    else:
        job = {"config": set_up(ratio), "ratio": ratio, "seed": seed, "fold": 0, "day": AFTER}  # drawn as ``weighed`` draws
        model = fitted = {**fit_all(trainval, [job], names, params)[0], "day": None}
    scored = ensemble_scores({0: fitted}, test, names, {0: (trees, trees)}).drop("job").persist()  # each metric reads it
    return model, M.evaluate(scored, ["trees"]), importances(trainval.sparkSession, model, names)


def gained(trees: list[tuple], features: int) -> np.ndarray:
    """Shares of what all splits gain, each times the weight of its rows: Spark's ``featureImportances``."""
    out = np.zeros(features)
    for feature, splits, *_, gain in trees:
        np.add.at(out, feature[splits], gain[splits])
    return out / (out.sum() or 1.0)


def importances(spark: SparkSession, model: GBTClassificationModel | dict, names: list[str]) -> DataFrame:
    found = gained(model["trees"], len(names)) if isinstance(model, dict) else model.featureImportances.toArray()
    return spark.createDataFrame(pa.table({"feature": names, "importance": found})).orderBy(F.desc("importance"), "feature")


def _dealt(val: DataFrame, names: list[str], seed: int) -> tuple[DataFrame, int]:
    """Rows dealt at random into blocks of some ``PERMUTED`` a day, within which values are permuted, so that no task holds a longer day; blocks a day."""
    most = val.groupBy("cutoff_date").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // PERMUTED))
    block = F.pmod(F.xxhash64("cutoff_date", *PAIR, F.lit(seed + 1)), F.lit(blocks))
    return val.select("cutoff_date", *PAIR, "label", G.key_hash().alias("key"), _numbers(names).cast("array<double>").alias("own"), block.alias("_block")), blocks


def _orders(table: pa.Table, repeats: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A block's rows by key, and for each repeat the places from which they take values: a keyed hash's order."""
    key = table["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(key, kind="stable")
    return order, [np.argsort(G.mixed(key[order], seed, rep), kind="stable") for rep in range(repeats)]


def permuted(val: DataFrame, names: list[str], repeats: int, seed: int) -> DataFrame:
    """Each row once per repeat, with its own values and another row's: (keys, label, rep, own, other).

    The rows that ``permutation_areas`` scores, for those who want to see them.
    """

    def run(table: pa.Table) -> pa.Table:
        order, others = _orders(table, repeats, seed)
        rows = table.take(pa.array(order))
        parts = [rows.select(["cutoff_date", *PAIR, "label"]).append_column("rep", pa.array([rep] * len(order), pa.int64())).append_column("own", rows["own"]).append_column("other", rows["own"].take(pa.array(o))) for rep, o in enumerate(others)]
        return pa.concat_tables(parts)

    kinds = dict(val.dtypes)
    return _dealt(val, names, seed)[0].groupBy("cutoff_date", "_block").applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("cutoff_date", *PAIR, "label")) + ", rep bigint, own array<double>, other array<double>")


def _used(e: dict) -> list[int]:
    return sorted({int(v) for t in e["trees"] for v in t[0][t[1]]})


def _ways(tree: tuple) -> list[set[int]]:
    """The features that lead to each node of a tree."""
    feature, splits, _, left, right, *_ = tree
    out, open_ = [set() for _ in feature], [0]
    while open_:
        n = open_.pop()
        if splits[n]:
            for child in (left[n], right[n]):
                out[child] = out[n] | {int(feature[n])}
                open_.append(child)
    return out


def _leaves(tree: tuple, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    feature, _, threshold, left, right, _, depth, *_ = tree
    at = np.zeros(len(rows), np.int16 if len(feature) < 1 << 15 else np.int64)
    left, right = left.astype(at.dtype), right.astype(at.dtype)
    for _ in range(depth):
        at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])  # a leaf leads to itself
    return at


def _changed_scores(ensembles: dict[int, dict], day: str, x: np.ndarray, others: list[np.ndarray]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(job, feature, repeat, scores) of a day's rows ``x`` with one feature's values from other rows; feature -1 is none.

    A tree is run again for the rows alone whose value differs and that met the feature on their way.
    """
    every = np.arange(len(x))
    for j, e in ensembles.items():
        if e["day"] != day:
            continue
        leaf = [_leaves(t, x, every) for t in e["trees"]]
        each = np.stack([t[5][at] * t[7] for t, at in zip(e["trees"], leaf, strict=True)], axis=1)
        base, ways = each.sum(axis=1), [_ways(t) for t in e["trees"]]
        for rep in range(len(others)):
            yield j, -1, rep, base
        for f in _used(e):
            met = [(i, np.array([f in w for w in ways[i]])) for i, t in enumerate(e["trees"]) if (t[0][t[1]] == f).any()]
            met, own = [(i, np.flatnonzero(w[leaf[i]])) for i, w in met], x[:, f].copy()
            for rep, other in enumerate(others):
                moved = own[other] != own
                x[:, f] = own[other]
                part, touched = each.copy(), np.zeros(len(x), bool)
                for i, rows in met:
                    rows = rows[moved[rows]]
                    part[rows, i] = e["trees"][i][5][_leaves(e["trees"][i], x, rows)] * e["trees"][i][7]
                    touched[rows] = True
                scores = base.copy()
                scores[touched] = part[touched].sum(axis=1)
                yield j, f, rep, scores
            x[:, f] = own


def permutation_scores(ensembles: dict[int, dict], rows: DataFrame) -> DataFrame:
    """(label, rep, job, feature, score) of permuted rows; feature -1 is none, and a model's unused ones are left out."""

    def run(days: pa.Array, own: pa.Array, other: pa.Array) -> pa.Array:
        x, y, day, width, blocks = G.matrix(own), G.matrix(other), days.to_numpy(zero_copy_only=False), np.zeros(len(own), np.int64), []
        for d in set(day):
            mine = np.flatnonzero(day == d)
            both, n = np.concatenate([x[mine], y[mine]]), len(mine)  # the first take their values from the second
            found = [(j, f, s[:n]) for j, f, _, s in _changed_scores(ensembles, d, both, [np.r_[np.arange(n, 2 * n), np.arange(n)]])]
            if found:
                job, feature, scores = zip(*found, strict=True)
                width[mine] = len(job)
                blocks.append((mine, (np.array(job), np.array(feature)), np.stack(scores, axis=1)))
        return _lists(width, blocks, ("job", "feature", "score"))

    scores = F.arrow_udf(run, "array<struct<job:int,feature:int,score:double>>")("cutoff_date", "own", "other")
    return rows.select("label", "rep", F.inline(scores))


def permutation_areas(ensembles: dict[int, dict], val: DataFrame, names: list[str], repeats: int, seed: int) -> DataFrame:
    """``curve_areas`` of ``permutation_scores`` by job, feature and repeat.

    Each row is shuffled once, with the values that some tree uses; it is permuted and scored in its block. The areas of
    days of one block are taken there, those of longer days from the scores counted in all blocks.
    """
    used, days = sorted({f for e in ensembles.values() for f in _used(e)}), sorted({e["day"] for e in ensembles.values()})
    dealt, blocks = _dealt(val.where(F.col("cutoff_date").isin(*days)), [names[f] for f in used], seed)

    def found(table: pa.Table) -> Iterator[tuple]:
        order, others = _orders(table, repeats, seed)
        x = np.zeros((len(order), len(names)))
        x[:, used] = G.matrix(table["own"].combine_chunks())[order]
        label, day = table["label"].to_numpy()[order], table["cutoff_date"][0].as_py()
        for j, f, rep, s in _changed_scores(ensembles, day, x, others):
            yield j, f, rep, s, label

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held = list(batches)
        if held and (table := pa.Table.from_batches(held)).num_rows:
            for place in table["place"].unique():
                yield table.filter(pc.equal(table["place"], place))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches):
            columns = list(zip(*[(j, f, rep, *M.areas(s, label)) for j, f, rep, s, label in found(table)], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [t for _, t in AREAS], strict=True)], names=["job", "feature", "rep", *[n for n, _ in AREAS]])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches):
            for j, f, rep, s, label in found(table):
                yield _counts([(j, f, rep, M.counted(s, label))], ("job", "feature", "rep"))

    place = F.coalesce(*[F.when(F.col("cutoff_date") == d, F.lit(i * blocks)) for i, d in enumerate(days)]) + F.col("_block")
    dealt = dealt.withColumn("place", place.cast("int")).repartitionById(len(days) * blocks, F.col("place"))
    if blocks == 1:
        return dealt.mapInArrow(whole, "job int, feature int, rep int, n bigint, positives bigint, pr_auc double, roc_auc double")
    counts = dealt.mapInArrow(parts, "job int, feature int, rep int, score double, c bigint, p bigint")
    return M.areas_of_counts(counts.groupBy("job", "feature", "rep", "score").agg(F.sum("c").alias("c"), F.sum("p").alias("p")), ["job", "feature", "rep"])


def permutation_importance(trainval: DataFrame, days: dict[int, str], ratio: int, settings: Settings, params: dict, repeats: int = 5, patience: int = 30) -> DataFrame:
    """Mean and deviation over folds of the average precision that shuffling a feature costs; 0 where no tree uses it.

    A fold's model is that of its best prefix, as in a sweep.
    """
    names, jobs = feature_names(trainval), fit_jobs(days, (ratio,), (settings.seed,))
    ensembles = fit_all(trainval, jobs, names, params, patience)
    areas = permutation_areas(ensembles, trainval.where(F.col("cutoff_date").isin(*days.values())), names, repeats, settings.seed)
    areas = areas.groupBy("job", "feature").agg(F.avg("pr_auc").alias("a")).persist()  # at most a row for each fold and feature
    base = areas.where("feature = -1").select("job", F.col("a").alias("_base"))
    every = base.select("job", "_base", F.posexplode(F.array(*map(F.lit, names))).alias("feature", "name"))
    lost = every.join(areas, ["job", "feature"], "left").select(F.col("name").alias("feature"), (F.col("_base") - F.coalesce("a", "_base")).alias("d"))
    return lost.where(~F.isnan("d")).groupBy("feature").agg(F.avg("d").alias("importance_mean"), F.stddev_samp("d").alias("importance_std")).orderBy(F.desc("importance_mean"), "feature")


def ablations(names: list[str]) -> dict[str, tuple[str, ...]]:
    return {"full": (), "no_cart": CART, "no_user_item_table": tuple(n for n in names if n.startswith("user_item_"))}


def ablation_rows(trainval: DataFrame, days: dict[int, str], ratio: int, settings: Settings, params: dict, patience: int = 30) -> DataFrame:
    """Metrics of each fold, by group of features left out."""
    names = feature_names(trainval)
    groups = {name: tuple(d for d in drop if d in names) for name, drop in ablations(names).items()}
    jobs = [{**j, "config": name, "drop": drop} for name, drop in groups.items() for j in fit_jobs(days, (ratio,), (settings.seed,))]
    n = F.coalesce(*[F.when(F.col("config") == name, F.lit(len(names) - len(drop))) for name, drop in groups.items()])
    rows = run_sweep(trainval, jobs, settings, params, patience)
    return rows.select(F.col("config").alias("ablation"), n.alias("n_features"), "fold", "day_type", "pr_auc", "p_at_100", "p_at_500")


def run_ablation(trainval: DataFrame, days: dict[int, str], ratio: int, settings: Settings, params: dict) -> DataFrame:
    """Mean, sample deviation and loss against all features, by group of features left out."""
    return ablation_summary(ablation_rows(trainval, days, ratio, settings, params))


def ablation_summary(rows: DataFrame) -> DataFrame:
    known = rows.where(~F.isnan("pr_auc"))
    means = known.groupBy("ablation").agg(F.first("n_features").alias("n_features"), F.avg("pr_auc").alias("pr_auc_mean"), F.stddev_samp("pr_auc").alias("pr_auc_std"), F.avg("p_at_100").alias("p_at_100_mean"), F.avg("p_at_500").alias("p_at_500_mean"))
    full = means.where("ablation = 'full'").select(F.col("pr_auc_mean").alias("_full"), F.lit(1).alias("_one"))
    both = means.withColumn("_one", F.lit(1)).join(F.broadcast(full), "_one")
    loss = F.col("_full") - F.col("pr_auc_mean")
    return both.select("ablation", "n_features", "pr_auc_mean", "pr_auc_std", "p_at_100_mean", "p_at_500_mean", loss.alias("drop_vs_full"), (100 * F.try_divide(loss, F.col("_full"))).alias("pct_drop"))


def normal_folds(settings: Settings) -> dict[int, str]:
    return validation_days(settings, ("before_sale", "after_sale"))
