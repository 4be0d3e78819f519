"""The stages of a project from a CSV to validated, split tables."""

import json

from tidemark.__main__ import main
from tidemark.sources import behavior as B
from tidemark.sources import store

YAML = """
paths: {interim: out, reports: reports}
labels: {prediction_days: ["2024-01-18", "2024-01-19", "2024-01-20"], lookback_days: 3, sale_day: "2024-01-19"}
features: {windows: [1, 7, 0]}
split: {test_days: ["2024-01-20"], first_validation_day: "2024-01-19", negative_ratio: 20, seed: 48}
"""


def test_stages(spark, tmp_path):
    (tmp_path / "conf").mkdir()
    settings = tmp_path / "conf" / "s.yaml"
    settings.write_text(YAML)
    log = B.events_log(spark, "/root/testdata/sf0.001")
    rows = log.selectExpr("user_id", "item_id", "behavior_type", "item_category", "date_format(time, 'yyyy-MM-dd HH')").collect()
    (tmp_path / "log.csv").write_text("user_id,item_id,behavior_type,item_category,time\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    run = lambda *a: main([*a, "--settings", str(settings)])
    assert run("load", "--csv", str(tmp_path / "log.csv")) == 0
    assert run("build") == 0 and run("build", "--resume") == 0 and run("validate") == 0 and run("split") == 0
    (fold,) = json.loads((tmp_path / "out" / "fold_spec.json").read_text())
    matrix = spark.read.parquet(str(tmp_path / "out" / "assembled"))
    assert fold["val_day"] == "2024-01-19" and fold["train_rows_natural"] == matrix.where("cutoff_date = '2024-01-18'").count() and len(matrix.columns) == 77
    # a changed value is found
    table = str(tmp_path / "out" / "feat_category")
    off = store.read_days(spark, table, ("2024-01-18",)).selectExpr("item_category", "category_browse_all + 1 AS category_browse_all", "category_buy_all", "category_distinct_item", "category_conversion_browse_buy", "cutoff_date")
    store.write_days(spark.createDataFrame(off.collect(), off.schema), table)
    assert run("validate") == 1
