"""Learners on a separable matrix, reports and the streaming breakdown."""

import random
import threading
from pathlib import Path

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemark.config import Settings, load_settings
from tidemark.operators import explore as E
from tidemark.operators import models as M
from tidemark.operators import report
from tidemark.operators.split import validation_days
from tidemark.plans import registry
from tidemark.sources import behavior as B
from tidemark.streaming import counts

S = Settings()
PARAMS = {"depth": 2, "rate": 0.3, "trees": 3, "rows": 1.0, "columns": 1.0, "min_rows": 1}


@pytest.fixture(scope="module")
def matrix(spark):
    rng = random.Random(1)
    rows = []
    for d in range(18, 22):
        for i in range(60):
            y = int(i % 6 == 0)
            rows.append((f"u{i}", "i", f"2024-01-{d}", y, "c", y * 2 + rng.random(), float(rng.random()), rng.randrange(3), rng.randrange(3), int(y), rng.randrange(50)))
    return spark.createDataFrame(rows, "user_id string, item_id string, cutoff_date string, label bigint, item_category string, good double, noise double, user_item_cart_all bigint, user_item_browse_all bigint, user_item_cart_not_buy bigint, user_item_since_last_hour bigint").cache()


FOLD = {1: "2024-01-20"}


def test_baselines(matrix):
    found = {r.model: r for r in M.run_baselines(matrix, FOLD, S).collect()}
    assert found["logistic"].pr_auc == pytest.approx(1) and found["rule_cart_not_buy"].roc_auc == pytest.approx(1) and found["rule_browse"].roc_auc < 0.9


def test_boosting_and_importances(matrix, spark):
    sweep = M.run_sweep(matrix, M.fit_jobs(FOLD, (5, None), (1, 2)), S, PARAMS)
    assert sweep.count() == 3  # every row is fitted with one seed
    rows = {r.config: r for r in sweep.collect()}
    means = {r.config: r for r in M.sweep_means(sweep, FOLD).collect()}
    assert means["full"].pr_auc_weekend == pytest.approx(rows["full"].pr_auc) and means["full"].pr_auc_on_sale is None
    assert rows["downsample_5"].pr_auc == pytest.approx(1) and rows["full"].best_trees >= 1
    assert M.best_config(sweep)[1] >= 1
    _, metrics, importance = M.train_final(matrix.where("cutoff_date < '2024-01-21'"), matrix.where("cutoff_date = '2024-01-21'"), 5, 2, PARAMS, 1)
    assert metrics.first().roc_auc == pytest.approx(1) and importance.first().feature in ("good", "user_item_cart_not_buy")
    top = M.permutation_importance(matrix.drop("user_item_cart_not_buy"), FOLD, 5, S, PARAMS, 2).first()
    assert top.feature == "good" and top.importance_mean > 0.3


def test_prefixes_add_up_to_the_model(matrix):
    names = M.feature_names(matrix)
    model = M.boosted(M.weighed(matrix, None, 1), names, {**PARAMS, "trees": 12, "rows": 0.6, "depth": 4}, 1)
    val = matrix.where("cutoff_date = '2024-01-20'")
    found = {(r.user_id, r.trees): r.score for r in M.prefix_scores(model, val, names).collect()}
    assert len(found) == val.count() * 12
    # Each tree on its own, by its own predictions.
    rows = M._vectors(val, names)
    for i, tree in enumerate(model.trees):
        rows = tree.setPredictionCol(f"t{i}").transform(rows)
    for r in rows.collect():
        total = 0.0
        for i, w in enumerate(model.treeWeights):
            total += r[f"t{i}"] * w
            assert found[r.user_id, i + 1] == pytest.approx(total, abs=1e-12)
    some = {(r.user_id, r.trees): r.score for r in M.prefix_scores(model, val, names, 5, 7).collect()}
    assert some == {k: v for k, v in found.items() if 5 <= k[1] <= 7}


@pytest.mark.parametrize("patience", [1, 2, 5, 30])
def test_the_best_prefix_is_that_of_all_prefixes(matrix, patience):
    names = ["noise", "user_item_browse_all", "user_item_since_last_hour"]  # a poor model, whose areas go up and down
    model = M.boosted(M.weighed(matrix, None, 1), names, {**PARAMS, "trees": 9, "rows": 0.5}, 3)
    val = matrix.where("cutoff_date = '2024-01-21'")
    areas = {r.trees: r.pr_auc for r in M.M.curve_areas(M.prefix_scores(model, val, names), ["trees"]).collect()}
    best, at = -1.0, 1
    for i in range(1, 10):
        if areas[i] > best:
            best, at = areas[i], i
        elif i - at >= patience:
            break
    assert M.best_prefix(model, val, names, patience) == at


def test_model_queries_take_all_candidates_seeds_and_folds(spark, monkeypatch):
    """What the queries hand to the learners, against the project's settings."""
    want, frame, seen = load_settings(Path(__file__).parents[1] / "conf/settings.yaml").models, spark.createDataFrame([("2024-01-30",)], "cutoff_date string"), {}

    def sweep(tv, jobs, *rest):
        seen["sweep"] = {(j["fold"], j["ratio"], j["seed"]) for j in jobs}
        return spark.createDataFrame([("downsample_20", 0.1, 3), ("full", 0.3, 2), ("full", 0.3, 2)], "config string, pr_auc double, best_trees int")

    monkeypatch.setattr(registry, "matrix", lambda spark, sf: frame)
    monkeypatch.setattr(M, "run_sweep", sweep)
    monkeypatch.setattr(M, "train_final", lambda tv, test, ratio, trees, params, seed: seen.update(final=(ratio, trees)) or (None, frame, frame))
    for name in ("permutation_importance", "run_ablation"):
        monkeypatch.setattr(M, name, lambda tv, days, *rest, name=name: seen.update({name: len(days)}) or frame)
    for name in ("model_sweep", "model_final_test", "model_importances", "model_permutation", "model_ablation"):
        registry.queries()[name](spark, "")
    folds = validation_days(S)
    assert seen["sweep"] == {(f, r, s) for f in folds for r in want["negative_ratios"] for s in want["seeds"]} | {(f, None, want["seeds"][0]) for f in folds} and len(seen["sweep"]) == 72
    assert seen["final"] == (None, 2) and seen["permutation_importance"] == seen["run_ablation"] == len(M.normal_folds(S)) == 7


def test_ablation_drops_the_defined_columns(matrix, monkeypatch):
    assert M.ablations(["user_cart_all", "user_item_cart_all", "user_item_cart_not_buy"])["no_cart"] == ("user_item_cart_all", "user_item_cart_not_buy")
    seen, fit = {}, M.boosted
    monkeypatch.setattr(M, "boosted", lambda rows, names, params, seed: seen.update({len(names): names}) or fit(rows, names, params, seed))
    rows = M.ablation_rows(matrix, FOLD, 5, S, PARAMS).collect()
    assert {r.ablation: r.n_features for r in rows} == {"full": 6, "no_cart": 4, "no_user_item_table": 2} and set(seen) == {2, 4, 6}
    assert set(seen[6]) - set(seen[4]) == {"user_item_cart_all", "user_item_cart_not_buy"} and seen[2] == ["good", "noise"]
    assert {r.ablation: r.pr_auc for r in rows}["full"] == pytest.approx(1)


def test_all_jobs_are_drawn_as_one_by_one(matrix):
    days = {1: "2024-01-19", 2: "2024-01-20", 3: "2024-01-21"}
    rare = matrix.withColumn("label", F.expr("IF(cutoff_date = '2024-01-18' OR user_id > 'u30', 0, label)"))  # a first day without positives
    for table in (matrix, rare):
        jobs = M.fit_jobs(days, (1, 2, 3, 50, None), (1, 2))
        drawn = [(r.user_id, r.cutoff_date, set(r._jobs)) for r in M.drawn(table, jobs).collect()]
        assert len(drawn) == matrix.count()
        for i, j in enumerate(jobs):
            rows = M.weighed(M.before(table, j["day"]), j["ratio"], j["seed"] + j["fold"])
            assert {(r.user_id, r.cutoff_date) for r in rows.collect()} == {(u, d) for u, d, of in drawn if i in of}


def test_permutation_against_the_model_itself(matrix):
    """Scores of permuted rows by Spark's own transform."""
    names = M.feature_names(matrix)
    model = M.boosted(M.weighed(M.before(matrix, FOLD[1]), 5, 2), names, PARAMS, 1)
    rows, got = M.permuted(M.on(matrix, FOLD[1]), names, 2, 1), {}
    for r in M.permutation_scores({0: M.ensemble(model, names, names, FOLD[1])}, rows).collect():
        got.setdefault((r.feature, r.rep), []).append(r.score)
    used = {i for i, v in enumerate(model.featureImportances.toArray()) if v > 0}
    assert used | {-1} <= {f for f, _ in got}
    for (f, rep), scores in got.items():
        changed = []
        for r in rows.where(F.col("rep") == rep).collect():
            x = list(r.own)
            if f >= 0:
                x[f] = r.other[f]
            changed.append((Vectors.dense(x),))
        whole = model.transform(matrix.sparkSession.createDataFrame(changed, ["features"])).collect()
        assert sorted(scores) == pytest.approx(sorted(r.rawPrediction[1] for r in whole))


def test_permuted_values_are_the_days_own(matrix, monkeypatch):
    monkeypatch.setattr(M, "PERMUTED", 25)  # several blocks
    val = matrix.where("cutoff_date = '2024-01-20'")
    rows = M.permuted(val, ["good", "noise"], 2, 1).collect()
    whole = {r.user_id: [r.good, r.noise] for r in val.collect()}
    assert len(rows) == 60 * 2
    for rep in range(2):
        mine = [r for r in rows if r.rep == rep]
        assert {r.user_id: r.own for r in mine} == whole and sorted(r.other for r in mine) == sorted(whole.values())
        assert sum(r.own == r.other for r in mine) < 20


def test_logistic_is_newtons(matrix):
    """Against Newton steps on the same weighted, scaled problem."""
    import numpy as np

    train, val = matrix.where("cutoff_date < '2024-01-20'"), matrix.where("cutoff_date = '2024-01-20'")
    names = ["noise", "user_item_browse_all", "user_item_since_last_hour"]
    drop = [c for c in matrix.columns if c not in (*M.KEYS, *names)]
    got = {r.user_id: r.score for r in M.logistic_scores(train.drop(*drop), val.drop(*drop)).collect()}
    a = train.toPandas()
    x, y = a[names].to_numpy(float), a["label"].to_numpy(float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    x = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    b, ridge = np.zeros(x.shape[1]), np.r_[np.ones(len(names)), 0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag(ridge), x.T @ (w * (p - y)) + ridge * b)
    v = val.toPandas()
    want = 1 / (1 + np.exp(-(np.c_[(v[names].to_numpy(float) - mean) / scale, np.ones(len(v))] @ b)))
    assert max(abs(got[u] - p) for u, p in zip(v["user_id"], want, strict=True)) < 1e-3


def test_text_columns_are_refused(matrix):
    with pytest.raises(TypeError, match="extra"):
        M.feature_names(matrix.selectExpr("*", "'x' AS extra"))


def test_report(spark, tmp_path):
    log = B.events_log(spark, "/root/testdata/sf0.001")
    text = report.write_report(log, tmp_path / "r" / "report.md", log.count()).read_text()
    assert "equal" in text and "## Days" in text and "| behavior_type | cnt | pct |" in text


def test_stream_agrees_with_batch(spark, tmp_path):
    log = B.events_log(spark, "/root/testdata/sf0.001")
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    query = counts.daily_counts(counts.stream_log(spark, str(tmp_path / "in")), "60 days").writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, E.daily_breakdown(log).collect()))
    finally:
        query.stop()


@pytest.mark.parametrize("depth", [1, 2])
def test_shared_passes_grow_the_trees_of_sparks_own_learner(matrix, depth):
    """Without shares of rows and features nothing is random: fits grown together are those fitted one by one (deeper, small nodes have splits of equal gain, of which either learner takes another)."""
    names, days = [n for n in M.feature_names(matrix) if n not in ("good", "user_item_cart_not_buy")], {1: "2024-01-20", 2: "2024-01-21"}  # a poor model, whose trees differ
    params, jobs = {**PARAMS, "trees": 10, "depth": depth}, M.fit_jobs(days, (5,), (1,))  # 5 negatives a positive are all of them; 10 trees, so margins are stored once
    found = M.fit_all(matrix, jobs, names, params)
    for i, j in enumerate(jobs):
        model = M.boosted(M.weighed(M.before(matrix, j["day"]), 5, 2), names, params, 1)
        val = M.on(matrix, j["day"])
        want = {(r.user_id, r.trees): r.score for r in M.prefix_scores(model, val, names).collect()}
        got = {(r.user_id, r.trees): r.score for r in M.ensemble_scores({i: found[i]}, val, names, {i: (1, 10)}).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_a_sweep_runs_no_jobs_for_each_fit(matrix, spark):
    """Jobs follow the trees' levels, not the number of fits."""
    def jobs(seeds):
        spark.sparkContext.setJobGroup(f"fits {len(seeds)}", "")
        M.fit_all(matrix, M.fit_jobs(FOLD, (1, 2, 3, 5), seeds), M.feature_names(matrix), PARAMS)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fits {len(seeds)}"))

    few, many = jobs((1,)), jobs((1, 2, 3))
    assert many <= few + 4


def test_areas_of_counted_scores(matrix):
    names = M.feature_names(matrix)
    e = {0: M.ensemble(M.boosted(M.weighed(matrix, None, 1), names, PARAMS, 1), names, names)}
    want = {r.trees: r for r in M.M.curve_areas(M.ensemble_scores(e, matrix, names, {0: (1, 3)}), ["job", "trees"]).collect()}
    assert {r.trees: r for r in M.score_areas(e, matrix, names, {0: (1, 3)}).collect()} == want and len(want) == 3


def test_permutation_shuffles_each_row_once(matrix, spark, monkeypatch):
    """The areas are those of the permuted rows; what is shuffled doesn't grow with the repeats."""
    monkeypatch.setattr(M, "PERMUTED", 25)
    names, val = M.feature_names(matrix), M.on(matrix, FOLD[1])
    e = {0: M.ensemble(M.boosted(M.weighed(M.before(matrix, FOLD[1]), 5, 2), names, PARAMS, 1), names, names, FOLD[1])}
    want = {(r.feature, r.rep): r.pr_auc for r in M.M.curve_areas(M.permutation_scores(e, M.permuted(val, names, 3, 1)), ["job", "feature", "rep"]).collect()}
    got = {(r.feature, r.rep): r.pr_auc for r in M.permutation_areas(e, val, names, 3, 1).collect()}
    assert got == pytest.approx(want) and {rep for _, rep in got} == {0, 1, 2} and len({a for (f, _), a in got.items() if f < 0}) == 1
    plan = M.permuted(val, names, 5, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "Join" not in plan


def test_logistic_fits_together_as_alone(matrix, spark):
    days = {1: "2024-01-20", 2: "2024-01-21"}
    names, jobs = M.feature_names(matrix), M.fit_jobs(days, (2,), (1,))
    spark.sparkContext.setJobGroup("logistic", "")
    fitted = M.N.fit_logistic(M.drawn(matrix, jobs), 2, len(names), M._numbers(names))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("logistic")) < 80  # by gradients alone: hundreds
    for j, job in enumerate(jobs):
        val = M.on(matrix, job["day"])
        alone = {r.user_id: r.score for r in M.logistic_scores(M.weighed(M.before(matrix, job["day"]), 2, 1 + job["fold"]).drop("w"), val).collect()}
        both = {r.user_id: r.s for r in val.select("user_id", M.N.probabilities({job["day"]: fitted[j]}, M._numbers(names)).alias("s")).collect()}
        assert both == pytest.approx(alone, abs=1e-6)
    flat = M.logistic_scores(matrix.where("label = 1"), matrix).select("score").distinct().collect()
    assert [r.score for r in flat] == [1.0]


def test_a_sweep_scores_each_model_once_for_its_areas(matrix, monkeypatch):
    """The areas are those that the trees were chosen by; a set-up is chosen without precision at k."""
    names, jobs, passes, areas = M.feature_names(matrix), M.fit_jobs({**FOLD, 2: "2024-01-25"}, (2, None), (1,)), [], M.score_areas  # no rows on the second day
    monkeypatch.setattr(M, "score_areas", lambda *of: passes.append(of) or areas(*of))
    rows = {(r.config, r.fold): r for r in M.run_sweep(matrix, jobs, S, PARAMS).collect()}
    assert len(passes) == 1 and rows.keys() == {("downsample_2", 1), ("full", 1)}
    ensembles = M.fit_all(matrix, jobs, names, PARAMS)
    want = {(r.job, r.trees): r for r in areas(ensembles, M.on(matrix, FOLD[1]), names, {j: (1, 3) for j in ensembles}).collect()}
    for i, j in enumerate(jobs):
        if j["fold"] == 1:
            own = rows[j["config"], 1]
            assert [own[c] for c in ("n", "positives", "pr_auc", "roc_auc")] == pytest.approx([want[i, own.best_trees][c] for c in ("n", "positives", "pr_auc", "roc_auc")])
    monkeypatch.delattr(M.M, "precision_at_k")
    assert {(r.config, r.fold): r.pr_auc for r in M.run_sweep(matrix, jobs, S, PARAMS, 30, False).collect()} == pytest.approx({k: r.pr_auc for k, r in rows.items()})


def test_the_final_set_up_is_chosen_without_precision(spark, monkeypatch):
    frame, how = spark.createDataFrame([("2024-01-30",)], "cutoff_date string"), []

    def sweep(tv, jobs, settings, params, patience=30, precision=True):
        how.append((patience, precision))
        return spark.createDataFrame([("full", 0.3, 2)], "config string, pr_auc double, best_trees int")

    monkeypatch.setattr(registry, "matrix", lambda spark, sf: frame)
    monkeypatch.setattr(M, "run_sweep", sweep)
    monkeypatch.setattr(M, "train_final", lambda *of: (None, frame, frame))
    for name in ("model_sweep", "model_final_test", "model_importances"):
        registry.queries()[name](spark, "")
    assert how == [(30, True), (30, False), (30, False)]


def test_the_final_fit_is_the_sweeps_learner(matrix, monkeypatch):
    """It draws what ``weighed`` draws, and the rows' places don't change its trees; without random shares they are Spark's."""
    names, test = M.feature_names(matrix), matrix.where("cutoff_date = '2024-01-21'")
    rows, params = M.before(matrix, "2024-01-21"), {**PARAMS, "rows": 0.6, "columns": 0.6, "depth": 1}
    want = M.boosted(M.weighed(rows, 2, 3), names, {**PARAMS, "depth": 1}, 3)
    areas = M.M.evaluate(M.prefix_scores(want, test, names, 3, 3), ["trees"]).first()
    monkeypatch.delattr(M, "GBTClassifier")
    assert M.train_final(rows, test, 2, 3, {**PARAMS, "depth": 1}, 3)[1].first() == areas
    first, again = (M.train_final(r, test, 2, 3, params, 3) for r in (rows, rows.repartition(5, "user_id")))
    assert first[1].collect() == again[1].collect() and [t[0].tolist() for t in first[0]["trees"]] == [t[0].tolist() for t in again[0]["trees"]]


def test_members_are_the_rows_that_downsample_keeps(matrix):
    import numpy as np

    days = {1: "2024-01-19", 2: "2024-01-20", 3: "2024-01-21"}
    jobs = [*M.fit_jobs(days, (1, 2, 3, 50, None), (1, 2)), {"ratio": 2, "seed": 7, "fold": 0, "day": M.AFTER}]
    got = matrix.withColumn("text", M.D.text()).select("user_id", "cutoff_date", "label", "text").toArrow().combine_chunks()
    found = M.D.members(got["cutoff_date"].combine_chunks(), got["label"].to_numpy(), got["text"].to_numpy(), jobs, M.D.limits(matrix, jobs))
    for i, j in enumerate(jobs):
        rows = M.weighed(M.before(matrix, j["day"]), j["ratio"], j["seed"] + j["fold"]).select("user_id", "cutoff_date").collect()
        mine = got.take(np.flatnonzero(found[i]))
        assert set(map(tuple, rows)) == set(zip(mine["user_id"].to_pylist(), mine["cutoff_date"].to_pylist(), strict=True)) and len(rows) == len(mine)


@pytest.mark.parametrize("ratio", [5, None])
def test_importances_are_sparks(matrix, ratio):
    # A poor model, whose splits differ. Spark weighs rows for its split points too: with weights, only few values have the same.
    names = ["noise", "user_item_cart_all", "user_item_browse_all", "user_item_since_last_hour"] if ratio else ["user_item_cart_all", "user_item_browse_all"]
    frame = matrix.select("user_id", "item_id", "cutoff_date", "label", "item_category", *names)
    params = {**PARAMS, "depth": 2, "trees": 5}
    want = M.boosted(M.weighed(frame, ratio, 1), names, params, 1).featureImportances.toArray()
    model, _, found = M.train_final(frame, frame, ratio, 5, params, 1)
    assert isinstance(model, dict) and len({w for w in want if w > 0}) > 1
    assert {r.feature: r.importance for r in found.collect()} == pytest.approx(dict(zip(names, want, strict=True)), abs=1e-9)


def test_the_matrix_is_planned_while_the_log_is_reduced(spark, monkeypatch):
    planned, counted = threading.Event(), []

    class Log:
        def count(self):
            counted.append(planned.wait(20))

        def coalesce(self, n):
            return self

    frame = spark.range(3)
    monkeypatch.setattr(registry, "_hold", lambda role, df: Log())
    monkeypatch.setattr(registry.A, "assemble", lambda *of, **how: planned.set() or frame)
    assert registry.matrix(spark, "/root/testdata/sf0.001").count() == 3 and counted == [True]


def test_model_queries_take_the_projects_parameters(spark, monkeypatch):
    """Trees, depth and patience that reach the learners are those of conf/settings.yaml."""
    want, frame, seen = load_settings(Path(__file__).parents[1] / "conf/settings.yaml").models, spark.createDataFrame([("2024-01-30",)], "cutoff_date string"), []

    def fits(tv, jobs, names, params, patience=None):
        seen.append((params, patience))
        raise StopIteration

    monkeypatch.setattr(registry, "matrix", lambda spark, sf: frame)
    monkeypatch.setattr(M, "fit_all", fits)
    for name in ("model_sweep", "model_final_test", "model_importances", "model_permutation", "model_ablation"):
        with pytest.raises(StopIteration):
            registry.queries()[name](spark, "")
    assert seen == [(want["params"], want["patience"])] * 5 and want["params"]["trees"] == 600


NOISE = ("good", "user_item_cart_not_buy")


def same(found, want):
    return found.keys() == want.keys() and all(len(e["trees"]) == len(want[j]["trees"]) and all(a == pytest.approx(b) for t, u in zip(e["trees"], want[j]["trees"], strict=True) for a, b in zip(t, u, strict=True)) for j, e in found.items())


@pytest.mark.parametrize("patience", [None, 3])
def test_fits_grown_alone_are_those_of_the_shared_passes(matrix, monkeypatch, patience):
    days, names = {1: "2024-01-20", 2: "2024-01-21", 3: "2024-01-25"}, [n for n in M.feature_names(matrix) if n not in NOISE]  # no rows on the third day
    jobs, params = M.fit_jobs(days, (2, None), (1,)), {**PARAMS, "trees": 10, "rows": 0.7, "columns": 0.7, "min_rows": 3}
    jobs[0]["drop"] = ("noise",)
    monkeypatch.setattr(M.G, "_together", None)
    alone = M.fit_all(matrix, jobs, names, params, patience)
    monkeypatch.undo()
    monkeypatch.setattr(M.G, "ALONE", 0)
    together = M.fit_all(matrix, jobs, names, params, patience)
    assert same(alone, together) and [e.get("best") for e in alone.values()] == [e.get("best") for e in together.values()]
    if patience:  # what is kept is the best prefix of all trees
        every = M.fit_all(matrix, jobs, names, params)
        want = M.best_areas(every, matrix, names, patience)
        assert {j: e["best"] for j, e in alone.items()} == {j: t for j, (t, _) in want.items()} and any(1 < e["best"] < 10 for e in alone.values())
        assert M.best_areas(alone, matrix, names, patience) == want
        assert same(alone, {j: {**e, "trees": e["trees"][: want[j][0]]} for j, e in every.items()})


def test_a_fit_has_as_many_and_as_deep_trees_as_its_parameters_say(matrix):
    names, params = [n for n in M.feature_names(matrix) if n not in NOISE], {**PARAMS, "trees": 40, "depth": 6}
    trees = M.fit_all(matrix, M.fit_jobs(FOLD, (5,), (1,)), names, params)[0]["trees"]
    assert len(trees) == 40 and max(t[6] for t in trees) == 6
    model, _, _ = M.train_final(matrix, matrix, 5, 40, params, 1)
    assert len(model["trees"]) == 40


def test_areas_of_rows_at_hand(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(6) / 4 - 0.5, rng.randrange(2)) for _ in range(200)]
    import numpy as np

    for some in (rows, [(s, 1) for s, _ in rows], rows[:1]):
        want = M.M.curve_areas(spark.createDataFrame(some, "score double, label int"), []).first()
        assert M.M.areas(*(np.array(c) for c in zip(*some, strict=True))) == pytest.approx(tuple(want), nan_ok=True)


def test_areas_of_whole_days_are_those_of_counted_scores(matrix, monkeypatch):
    """A day of one block has its areas taken where it is permuted, without another shuffle; unused features cost nothing."""
    names, days = M.feature_names(matrix), {1: "2024-01-20", 2: "2024-01-21"}
    params = {**PARAMS, "trees": 12, "depth": 4}
    poor = [n for n in names if n not in NOISE]
    ensembles = M.fit_all(matrix, M.fit_jobs(days, (5,), (1,)), poor, params)
    val = matrix.where("cutoff_date >= '2024-01-20'")
    want = {(r.job, r.feature, r.rep): r for r in M.M.curve_areas(M.permutation_scores(ensembles, M.permuted(val, poor, 3, 1)), ["job", "feature", "rep"]).collect()}
    monkeypatch.setattr(M.M, "areas_of_counts", None)
    got = {(r.job, r.feature, r.rep): r for r in M.permutation_areas(ensembles, val, poor, 3, 1).collect()}
    assert got.keys() == want.keys() and len({j for j, _, _ in got}) == 2 and all(tuple(got[k]) == pytest.approx(tuple(want[k])) for k in want)


def test_permutation_takes_each_folds_best_prefix(matrix):
    """The model whose features are shuffled is the one that early stopping keeps."""
    poor, seen = matrix.drop(*NOISE), {}
    params, areas = {**PARAMS, "trees": 12, "depth": 4}, M.permutation_areas
    names = M.feature_names(poor)
    want = M.best_areas(M.fit_all(poor, M.fit_jobs(FOLD, (5,), (S.seed,)), names, params), M.on(poor, FOLD[1]), names, 4)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(M, "permutation_areas", lambda ensembles, *of: seen.update(ensembles) or areas(ensembles, *of))
        rows = M.permutation_importance(poor, FOLD, 5, S, params, 2, 4).collect()
    assert {j: len(e["trees"]) for j, e in seen.items()} == {j: t for j, (t, _) in want.items()} and {r.feature for r in rows} == set(names)


def test_the_best_prefix_may_be_long_and_importances_are_of_all_its_trees(matrix, spark, monkeypatch):
    """From the registered query: prefixes past the third are grown and scored, and the final fit has as many trees as were chosen."""
    poor, grown = matrix.drop(*NOISE), {}
    settings = Settings(prediction_days=("2024-01-18", "2024-01-19", "2024-01-20", "2024-01-21"), test_days=("2024-01-21",), first_validation_day="2024-01-20", sale_day="2024-01-20")
    best, fit = M.best_areas, M.fit_all
    monkeypatch.setattr(registry, "SETTINGS", settings)
    monkeypatch.setattr(registry, "matrix", lambda spark, sf: poor)
    monkeypatch.setattr(M, "best_areas", lambda *of: grown.update(best(*of)) or grown)
    monkeypatch.setattr(M, "fit_all", lambda tv, jobs, names, params, *how: grown.update(final=fit(tv, jobs, names, params, *how)) or grown["final"])
    rows = registry.queries()["model_importances"](spark, "").collect()
    trees = grown.pop("final")[0]["trees"]
    assert max(t for t, _ in grown.values()) > 3 and len(trees) > 3 and max(t[6] for t in trees) > 3
    assert {r.feature for r in rows} == set(M.feature_names(poor)) and sum(r.importance for r in rows) == pytest.approx(1, abs=1e-6)


def test_changed_scores_are_those_of_whole_runs():
    """A tree is run again only where its way met the shuffled feature; scores are, to the last bit, those of all trees run anew."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (300, 5)).astype(float)
    split = lambda f, t, lo, hi: [(f, t, lo, hi), (4, 1.5, lo * 2, hi / 3)]
    trees = []
    for k in range(9):
        (f, t, a, b), (g, u, c, d) = split(k % 4, k % 3 + 0.5, rng.normal(), rng.normal())
        trees.append((np.array([f, 0, g, 0, 0]), np.array([True, False, True, False, False]), np.array([t, 0, u, 0, 0]), np.array([1, 1, 3, 3, 4]), np.array([2, 1, 4, 3, 4]), np.array([0, a, b, c, d]), 2, 0.3))
    others, seen = [rng.permutation(300) for _ in range(2)], set()
    for _, f, rep, scores in M._changed_scores({0: {"day": "d", "trees": trees}, 1: {"day": "other", "trees": trees}}, "d", x.copy(), others):
        changed = x.copy()
        if f >= 0:
            changed[:, f] = x[others[rep], f]
        assert (scores == M.run_trees(trees, changed).sum(axis=1)).all()
        seen.add((f, rep))
    assert seen == {(f, rep) for f in range(-1, 5) for rep in range(2)}
