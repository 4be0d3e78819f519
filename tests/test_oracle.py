"""Every query with an SQL twin gives the same rows as DuckDB on the small tables."""

import os

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
SOME = ["time_range", "activity_percentiles", "orders_daily", "sample_labels", "spot_check_history", "user_counts", "user_item_peak_flags", "feat_item", "assemble", "fold_spec", "downsampled_train", "sample_checks", "sample_checks_planted", "structural_checks_planted", "structural_checks_feat_user_item", "reconcile_planted", "assembled_null_report", "candidate_recall", "rule_pr_auc", "rule_roc_auc", "rule_precision_at_k"]


def test_names_match():
    assert set(registry.oracle_sql()) == set(registry.queries()) - {n for n in registry.queries() if n.startswith("model_")}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = registry.queries()[name](spark, SF).toPandas()
    theirs = con.sql(registry.oracle_sql()[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)

    def rows(df):
        return sorted(tuple("nan" if v != v else repr(float(v)) if isinstance(v, int | float) or hasattr(v, "dtype") else str(v) for v in r) for r in df[cols].itertuples(index=False))

    assert rows(ours) == rows(theirs)
