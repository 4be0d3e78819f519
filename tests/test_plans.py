"""What the physical plans must and mustn't hold."""

import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["feat_user", "feat_item", "feat_category", "feat_user_item", "feat_user_category", "assemble", "reconcile_feat_user"])
def test_features_push_down_time_and_need_no_python(spark, name):
    text = plan(spark, name)
    assert "LessThan(ts," in text and "In(event_type" in text
    assert not any(x in text for x in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas", "ArrowEval"))
    assert "event_id" not in text and "value#" not in text, "unused columns are read"


def test_counts_are_reduced_before_the_shuffle(spark):
    text = plan(spark, "feat_user")
    assert "partial_count" in text or "partial_count_if" in text
    assert text.count("Exchange hashpartitioning") <= 3


def test_candidate_pruning_is_a_semi_join(spark):
    assert "LeftSemi" in plan(spark, "feat_item") and "LeftSemi" in plan(spark, "feat_user_item")


@pytest.mark.parametrize("name", ["sample_labels", "candidate_recall", "downsampled_train"])
def test_samples_read_only_their_days(spark, name):
    text = plan(spark, name)
    assert "GreaterThanOrEqual(ts,2024-01-15" in text and "LessThan(ts,2024-01-31" in text


def leaves(spark, name):
    found = registry.queries()[name](spark, SF)._jdf.queryExecution().withCachedData().collectLeaves()
    return [found.apply(i).nodeName() for i in range(found.size())]


def test_the_matrix_reads_the_log_three_times(spark):
    """Twice for the sample, once for the reduced table that all features share."""
    found = leaves(spark, "assemble")
    assert sum("InMemoryRelation" not in n for n in found) == 2 and sum("InMemoryRelation" in n for n in found) >= 9


def test_areas_sort_no_model_whole(spark):
    text = plan(spark, "rule_pr_auc")
    assert "_range" in text and "Window [sum(c" in text.replace("Window [sum(_c", "")
    assert not any("_range" not in line for line in text.splitlines() if "Window [" in line and "sum(c#" in line)
