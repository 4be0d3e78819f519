"""Runs the stages of a project: ``python -m tidemark STAGE --settings conf/settings.yaml``.

Stages: ``load`` a CSV, ``explore`` it, ``build`` sample, features and matrix by day, ``validate`` them,
``split``, then ``baselines``, ``sweep`` and ``importance``. Each reads what the ones before wrote under
the settings' ``interim`` folder; ``build`` replaces days, or with ``--resume`` builds only absent ones.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import Settings, load_settings
from tidemark.operators import assemble, features, labels, models, report, split, validate
from tidemark.operators.feature_tables import TABLES
from tidemark.sources import behavior, store

BUILDERS = {
    "feat_user": features.user_features, "feat_item": features.item_features, "feat_category": features.category_features,
    "feat_user_item": features.user_item_features, "feat_user_category": features.user_category_features,
}


class Project:
    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings

    def path(self, name: str) -> str:
        return str(self.settings.resolve("interim") / name)

    def log(self) -> DataFrame:
        return behavior.read_log(self.spark, self.path("log"))

    def days(self, name: str, days: tuple[str, ...] | None = None) -> DataFrame:
        return store.read_days(self.spark, self.path(name), days or self.settings.prediction_days)

    def load(self, csv: str) -> None:
        n = behavior.load_csv(self.spark, csv, self.path("log"))
        print(f"{n:,} rows loaded, {behavior.count_csv_rows(self.spark, csv):,} in the file")

    def explore(self) -> None:
        print(report.write_report(self.log(), self.settings.resolve("reports") / "exploration.md"))

    def build(self, resume: bool) -> None:
        log, all_days = self.log(), self.settings.prediction_days
        tables = {"sample": labels.sample_labels, **BUILDERS}
        for name, make in tables.items():
            days = tuple(store.missing_days(self.spark, self.path(name), all_days)) if resume else all_days
            if days:
                store.write_days(make(log, replace(self.settings, prediction_days=days)), self.path(name))
        order = ("feat_item", "feat_user", "feat_user_item", "feat_category", "feat_user_category")
        matrix = assemble.assemble(log, self.settings, self.days("sample"), [(self.days(n), TABLES[n]["key"]) for n in order])
        store.write_days(matrix, self.path("assembled"))
        labels.sample_summary(self.days("sample")).orderBy("cutoff_date").show(100, False)

    def validate(self) -> bool:
        """Whether structure and all values hold, day counts of the sample included."""
        good, log = True, self.log()
        for name in TABLES:
            frame = self.days(name)
            facts = validate.structure(frame, name, len(self.settings.prediction_days)).first().asDict()
            wrong = {k: v for k, v in facts.items() if k not in ("table_name", "n_rows") and v}
            wrong |= {r.column_name: r.n_mismatches for r in validate.reconcile(frame, log, name, self.settings).where("n_mismatches > 0").collect()}
            good &= not wrong
            print(f"{name}: {facts['n_rows']:,} rows, {wrong or 'as defined'}")
        for r in labels.sample_checks(log, self.days("sample"), self.settings).collect():
            good &= not any(v for k, v in r.asDict().items() if k != "cutoff_date")
        return good

    def parts(self) -> tuple[DataFrame, DataFrame]:
        return split.split(self.days("assembled"), self.settings)

    def split(self) -> None:
        store.write_json(split.fold_records(self.parts()[1], self.settings, self.settings.negative_ratio), self.path("fold_spec.json"))

    def baselines(self) -> None:
        trainval = self.parts()[1].persist()
        store.write_csv(models.run_baselines(trainval, split.validation_days(self.settings), self.settings), self.path("baselines"))
        trainval.unpersist()

    def sweep(self) -> None:
        test, trainval = self.parts()
        trainval.persist()
        m, days = self.settings.models, split.validation_days(self.settings)
        ratios = (*m["negative_ratios"], *([None] if m.get("include_full") else []))
        found = models.run_sweep(trainval, models.fit_jobs(days, ratios, tuple(m["seeds"])), self.settings, m["params"], m["patience"]).persist()
        store.write_csv(found, self.path("sweep"))
        store.write_csv(models.sweep_means(found, days), self.path("sweep_means"))
        name, trees = models.best_config(found)
        ratio = next(r for r in ratios if models.set_up(r) == name)
        model, metrics, importances = models.train_final(trainval, test, ratio, trees, m["params"], m["seeds"][0], spark_model=True)
        model.write().overwrite().save(self.path("model"))
        store.write_csv(importances, self.path("importances"))
        metrics.show(truncate=False)
        trainval.unpersist()

    def importance(self) -> None:
        trainval = self.parts()[1].persist()
        days, params = models.normal_folds(self.settings), self.settings.models["params"]
        store.write_csv(models.permutation_importance(trainval, days, 20, self.settings, params), self.path("permutation"))
        rows = models.ablation_rows(trainval, days, 20, self.settings, params).persist()
        store.write_csv(rows, self.path("ablation_folds"))
        store.write_csv(models.ablation_summary(rows), self.path("ablation"))
        trainval.unpersist()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__.split("\n")[0])
    parser.add_argument("stage", choices=["load", "explore", "build", "validate", "split", "baselines", "sweep", "importance"])
    parser.add_argument("--settings", default="conf/settings.yaml")
    parser.add_argument("--csv", help="the file that load reads")
    parser.add_argument("--resume", action="store_true")
    args = parser.parse_args(argv)
    if args.stage == "load" and not args.csv:
        parser.error("load needs --csv")
    project = Project(SparkSession.builder.appName("tidemark").getOrCreate(), load_settings(args.settings))
    extra = [args.csv] if args.stage == "load" else [args.resume] if args.stage == "build" else []
    return 1 if getattr(project, args.stage)(*extra) is False else 0


if __name__ == "__main__":
    sys.exit(main())
