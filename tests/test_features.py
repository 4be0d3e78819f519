"""Edge cases of labels and features on a hand-written log."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import assemble as A
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.operators import validate as V
from tidemark.operators.feature_tables import TABLES
from tidemark.sources.behavior import SCHEMA

D = datetime(2024, 1, 18)
S = Settings(prediction_days=("2024-01-18", "2024-01-19"), test_days=("2024-01-19",), first_validation_day="2024-01-19", sale_day="2024-01-19")


def at(hours):
    return D + timedelta(hours=hours)


ROWS = [
    ("u1", "i1", 1, "c1", at(-5)), ("u1", "i1", 1, "c1", at(-5)),  # an exact duplicate counts twice
    ("u1", "i1", 3, "c1", at(-5)),  # two behaviours in the last hour: the higher code is last
    ("u1", "i2", 1, "c1", at(-72)),  # exactly at the lookback's start: inside
    ("u1", "i3", 1, "c2", at(-73)),  # an hour before it: outside
    ("u1", "i1", 4, "c1", at(0)),  # exactly at D: labels D, not a feature of D
    ("u2", "i2", 4, "c1", at(24)),  # exactly at D+1: not D's label
    ("u2", "i1", 4, "c1", at(5)),  # bought on D by a pair that is no candidate
    ("u2", "i4", 1, "c2", at(-30)), ("u2", "i4", 2, "c2", at(-20)),  # two hours with equal counts
    ("u3", "i5", 4, "c2", at(-10)),  # a buy without browsing
    ("u4", "i5", 1, "c3", None),  # no time
    ("u5", "i6", 1, "c9", at(-4)), ("u5", "i6", 1, "c8", at(-3)),  # an item in two categories
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def table(df, *key, day="2024-01-18"):
    return {tuple(r[k] for k in key): r.asDict() for r in df.collect() if r["cutoff_date"] == day}


def test_labels(log):
    found = table(L.sample_labels(log, S), "user_id", "item_id")
    assert {k: r["label"] for k, r in found.items()} == {("u1", "i1"): 1, ("u1", "i2"): 0, ("u2", "i4"): 0, ("u3", "i5"): 0, ("u5", "i6"): 0}
    recall = {r["cutoff_date"]: r for r in L.candidate_recall(log, S).collect()}
    assert recall["2024-01-18"]["n_bought"] == 2 and recall["2024-01-18"]["recall"] == 0.5


def test_sample_checks_find_nothing(log):
    for r in L.sample_checks(log, L.sample_labels(log, S), S).collect():
        assert (r.null_rows, r.bad_labels, r.repeated_pairs, r.candidate_diff, r.positive_diff) == (0, 0, 0, 0, 0)


def test_user_features(log):
    users = table(X.user_features(log, S), "user_id")
    u1, u2, u3 = users["u1",], users["u2",], users["u3",]
    assert (u1["user_browse_1d"], u1["user_browse_7d"], u1["user_browse_all"], u1["user_cart_all"], u1["user_buy_all"]) == (2, 4, 4, 1, 0)
    assert u1["user_buy_peak_hour"] == -1 and u1["user_peak_hour"] == 19 and u1["user_since_last_hour"] == 5
    assert u2["user_peak_hour"] == 4, "of equal hours the earlier"
    assert u3["user_conversion_browse_buy"] == 0.0 and u3["user_hour_entropy"] == 0.0 and str(u3["user_hour_entropy"]) == "0.0"
    assert ("u4",) not in users
    assert u1["user_morning_fraction"] + u1["user_afternoon_fraction"] + u1["user_night_fraction"] == pytest.approx(1)


def test_item_and_pair_features(log):
    items = table(X.item_features(log, S), "item_id")
    assert ("i3",) not in items and items["i6",]["item_category"] == "c8" and items["i1",]["item_distinct_user"] == 1
    assert items["i1",]["item_is_cold"] == 1 and items["i5",]["item_is_cold"] == 0
    pair = table(X.user_item_features(log, S), "user_id", "item_id")["u1", "i1"]
    assert pair["user_item_last_behavior"] == 3 and pair["user_item_cart_not_buy"] == 1 and pair["user_item_browse_distinct_hour"] == 1
    assert pair["user_item_is_user_peak_hour"] == 1 and pair["user_item_is_item_peak_hour"] == 1


def test_recency_halves_go_to_even(spark):
    rows = [("a", "i", 1, "c", D - timedelta(hours=1, minutes=30)), ("b", "i", 1, "c", D - timedelta(hours=2, minutes=30))]
    users = table(X.user_features(spark.createDataFrame(rows, SCHEMA), S), "user_id")
    assert [users[k,]["user_since_last_hour"] for k in "ab"] == [2, 2]


def test_assembled_matrix(log):
    frame = A.assemble(log, S)
    assert len(frame.columns) == 77 and frame.columns[:8] == ["user_id", "item_id", "cutoff_date", "label", *A.CONTEXT]
    rows = table(frame, "user_id", "item_id")
    assert len(rows) == 5 and all(v is not None for r in rows.values() for v in r.values())
    assert rows["u5", "i6"]["user_category_browse_all"] == 1
    assert rows["u1", "i1"]["time_is_before_sale_event"] == 1


def test_repeated_keys_are_refused(log, spark):
    items = X.item_features(log, S)
    with pytest.raises(ValueError, match="repeat"):
        A.check_keys([(items.union(items), ["item_id", "cutoff_date"])])


@pytest.mark.parametrize("name,build", [("feat_user", X.user_features), ("feat_item", X.item_features), ("feat_category", X.category_features), ("feat_user_item", X.user_item_features), ("feat_user_category", X.user_category_features)])
def test_tables_agree_with_their_second_definitions(log, name, build):
    frame = build(log, S)
    assert all(r.n_mismatches == 0 and r.n_keys > 0 for r in V.reconcile(frame, log, name, S).collect())
    some = V.key_sample(frame, TABLES[name]["key"], 3, 1)
    assert all(r.n_mismatches == 0 and r.n_keys == some.count() for r in V.reconcile(frame, log, name, S, some).collect())
    checks = V.structure(frame, name, 2).first().asDict()
    assert checks.pop("n_rows") > 0 and checks.pop("table_name") == name and not any(checks.values()), checks


def test_checks_see_planted_faults(log):
    from pyspark.sql import functions as F

    frame = X.category_features(log, S)
    off = frame.withColumn("category_buy_all", F.col("category_buy_all") + 1)
    assert {r.column_name for r in V.reconcile(off, log, "feat_category", S).where("n_mismatches > 0").collect()} == {"category_buy_all"}
    n = frame.count()
    found = V.structure(frame.union(frame).withColumn("more", F.lit(1)).drop("category_buy_all"), "feat_category", 3).first()
    assert (found.n_rows, found.repeated_keys, found.missing_columns, found.unexpected_columns, found.null_rows) == (2 * n, n, 1, 1, 0) and found.absent_days >= 1
    odd = V.structure(frame.withColumns({"category_browse_all": F.lit(None).cast("bigint"), "category_conversion_browse_buy": F.lit(-1.0)}), "feat_category", 2).first()
    assert (odd.null_rows, odd.out_of_range_rows, odd.broken_conversion_not_negative) == (n, n, n)


def test_empty_log(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert A.assemble(empty, S).count() == 0 and L.sample_summary(L.sample_labels(empty, S)).count() == 0


def test_days_are_taken_without_shuffles_sorts_or_joins(spark, log):
    """What each day needs of pairs, users and their categories is summed where the reduced rows lie."""
    for build, exchanges in ((X.pair_counts, 2), (X.user_features, 2), (X.user_category_features, 2)):
        plan = build(log, S)._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan and "SortAggregate" not in plan, plan
        done = build(log, S)._jdf.queryExecution().executedPlan().toString()
        assert done.count("Exchange hashpartitioning") <= exchanges, done


def test_counts_of_candidates_alone(spark, log):
    """The keys are those that a semi join with the day's candidates keeps, also where a key is null."""
    more = log.unionByName(spark.createDataFrame([(None, "i1", 1, "c1", at(-2)), ("u7", None, 3, "c1", at(-2)), ("u8", "i2", 1, None, at(-2)), ("u9", "i9", 2, "c1", at(-200))], SCHEMA))
    for build, key in ((X.pair_counts, L.PAIR), (X.user_category_features, ["user_id", "item_category"])):
        key_of = lambda df: sorted(tuple(r) for r in df.select(*key, "cutoff_date").collect())  # noqa: B023, E731
        rows = L.by_day(more.withColumn("day", F.to_date("time")), S.prediction_days, X.earlier)
        want = rows.join(L.candidates(more, S, key), [*key, "cutoff_date"], "left_semi").select(*key, "cutoff_date").distinct()
        assert key_of(build(more, S)) == key_of(want) and key_of(want)
