"""Folds, downsampling and metrics against brute force."""

import math
import random

import pytest

from tidemark.config import Settings, load_settings
from tidemark.operators import explore as E
from tidemark.operators import metrics as M
from tidemark.operators import split as P
from tidemark.sources import behavior as B
from tidemark.sources import store

S = Settings()
SAMPLE = "user_id string, item_id string, cutoff_date string, label bigint"


def sample(spark, pos, neg, day="2024-01-18"):
    return spark.createDataFrame([(f"u{i}", "i", day, int(i < pos)) for i in range(pos + neg)], SAMPLE)


def test_folds(spark):
    days = P.validation_days(S)
    assert days == {i: f"2024-01-{21 + i}" for i in range(1, 9)} and len(P.validation_days(S, ("before_sale", "after_sale"))) == 7
    rows = [tuple(r) for r in P.folds_frame(spark, S).collect()]
    assert all((d < days[f]) == (role == "train") and d <= days[f] and d != "2024-01-30" and kind == P.kind_of_day(days[f], S) for f, d, role, kind in rows)
    assert len(rows) == sum(len([d for d in S.trainval_days if d <= v]) for v in days.values()) and {k for *_, k in rows} == {"before_sale", "on_sale", "after_sale"}


@pytest.mark.parametrize("pos,neg,ratio,want", [(3, 100, 5, 18), (3, 4, 5, 7), (0, 9, 5, 9), (2, 0, 5, 2)])
def test_downsampling_is_exact_and_repeatable(spark, pos, neg, ratio, want):
    rows = sample(spark, pos, neg)
    once = {r.user_id for r in P.downsample(rows, ratio, 1).collect()}
    assert len(once) == want and once == {r.user_id for r in P.downsample(rows.repartition(7), ratio, 1).collect()}
    assert {f"u{i}" for i in range(pos)} <= once


def test_downsampling_ranks_one_bucket(spark):
    """By group, against sorting all digests."""
    import hashlib

    rows = [(f"u{i}", "i", "2024-01-18", int(i % 50 == 0 and g < 2), g) for g in range(3) for i in range(4000)]
    df = spark.createDataFrame(rows, f"{SAMPLE}, g int")
    found = {(r.g, r.user_id) for r in P.downsample(df, 7, 3, ["g"]).collect()}
    for g in range(3):
        own = [r for r in rows if r[4] == g]
        pos = sum(r[3] for r in own)
        neg = sorted((hashlib.md5(f"{u}|i|2024-01-18|{g}|3".encode()).hexdigest(), u) for u, *_, y, _ in own if not y)
        assert {u for h, u in found if h == g} == {r[0] for r in own if r[3]} | {u for _, u in (neg[: 7 * pos] if pos else neg)}
    assert "hashpartitioning(user_id" not in P.downsample(df, 7, 3, ["g"])._jdf.queryExecution().executedPlan().toString()


def areas(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    if not pos or not neg:
        return math.nan, math.nan
    ap = sum(y * sum(1 for t, z in pairs if z and t >= s) / sum(1 for t, _ in pairs if t >= s) for s, y in pairs) / len(pos)
    return ap, sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_areas_across_score_ranges(spark):
    """Scores of both signs and all sizes, zeros, infinities, NaN and null, and a group without a name."""
    random.seed(9)
    pick = lambda: random.choice([0.0, random.gauss(0, 1), random.gauss(0, 1e-9), random.gauss(0, 1e9), 0.5 + random.random() * 1e-5, math.inf, -math.inf, 5e-324, 1.7e308])
    cases = {g: [(pick(), random.randint(0, 1)) for _ in range(300)] for g in ("a", None)}
    rows = [(g, y, s) for g, c in cases.items() for s, y in c]
    df = spark.createDataFrame(rows, "g string, label bigint, score double")
    found = {r.g: r for r in M.curve_areas(df, ["g"]).collect()}
    for g, c in cases.items():
        ap, roc = areas(c)
        assert found[g].pr_auc == pytest.approx(ap, abs=1e-12) and found[g].roc_auc == pytest.approx(roc, abs=1e-12) and found[g].n == 300
    odd = spark.createDataFrame([("a", 1, math.nan), ("a", 0, 3.0), ("a", 1, None), ("a", 0, -7.0)], "g string, label bigint, score double")
    (r,) = M.curve_areas(odd, ["g"]).collect()
    assert r.pr_auc == pytest.approx((1 + 2 / 4) / 2) and r.roc_auc == pytest.approx(0.5)
    ordered = sorted({s for c in cases.values() for s, _ in c})
    ranks = [r.k for r in spark.createDataFrame([(s,) for s in ordered], "s double").coalesce(1).select(M.score_range(M.F.col("s")).alias("k")).collect()]
    assert ranks == sorted(ranks)


def test_areas_under_ties(spark):
    random.seed(4)
    cases = {g: [(random.randint(0, k), random.randint(0, 1)) for _ in range(n)] for g, (n, k) in enumerate([(30, 3), (50, 40), (10, 0), (6, 2)])}
    cases[99] = [(1, 1), (2, 1)]
    rows = [(g, f"u{i}", "i", y, float(s)) for g, c in cases.items() for i, (s, y) in enumerate(c)]
    df = spark.createDataFrame(rows, "g int, user_id string, item_id string, label bigint, score double")
    for r in M.evaluate(df, ["g"], (3, 1000)).collect():
        ap, roc = areas(cases[r.g])
        assert (math.isnan(ap) and math.isnan(r.pr_auc)) or (r.pr_auc == pytest.approx(ap) and r.roc_auc == pytest.approx(roc))
        top = sorted(((-s, f"u{i}", y) for i, (s, y) in enumerate(cases[r.g])))[:3]
        assert r.p_at_3 == pytest.approx(sum(y for *_, y in top) / len(top))


def test_csv_times(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_bytes(b"user_id,item_id,behavior_type,item_category,time\nu,i,1,c,2024-01-02 03\r\nu,,4,c,nonsense\n")
    assert B.load_csv(spark, str(path), str(tmp_path / "log")) == 2 and B.count_csv_rows(spark, str(path)) == 2
    missing = E.missing_values(B.read_log(spark, str(tmp_path / "log"))).first()
    assert (missing.time_missing, missing.item_id_missing, missing.user_id_missing) == (1, 1, 0)
    (tmp_path / "none.csv").write_text("")
    assert B.count_csv_rows(spark, str(tmp_path / "none.csv")) == 0


def test_days_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "sample")
    store.write_days(sample(spark, 1, 2), path)
    store.write_days(sample(spark, 0, 5, "2024-01-19"), path)
    store.write_days(sample(spark, 1, 3), path)
    assert store.read_days(spark, path, ("2024-01-18", "2024-01-19")).count() == 9
    assert store.missing_days(spark, path, ("2024-01-18", "2024-01-20")) == ["2024-01-20"]
    with pytest.raises(FileNotFoundError):
        store.read_days(spark, path, ("2024-01-20",))


def test_settings(tmp_path):
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    loaded = load_settings(f"{root}/conf/settings.yaml")
    assert loaded.prediction_days == S.prediction_days and str(loaded.resolve("interim")).endswith("build/interim")
    (tmp_path / "bad.yaml").write_text("paths: {}\n")
    with pytest.raises(ValueError, match="labels"):
        load_settings(tmp_path / "bad.yaml")
    with pytest.raises(ValueError):
        Settings(windows=(0, 7))


def test_statistics_ignore_order_and_nulls(spark):
    log = spark.createDataFrame([("u", "i", 1, "c", None), ("u", "i", 1, "c", None), (None, "i", 4, "c", None)], B.SCHEMA)
    d = E.duplicate_rows(log).first()
    assert (d.total_rows, d.distinct_rows) == (3, 0)
    assert E.sparsity(log.where("user_id IS NULL")).first()[0] == 0.0
