"""What the physical plans may and may not hold."""

import pytest

from __spark_entry__ import entry
from sievemark.catalog.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WRITES = {
    "model_label_job",
    "text_encode_job",
    "csv_round_trip",
    "category_subsets_written",
    "manifest_written",
    "vector_append",
    "model_label_resume",
}


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_cross_join_and_no_single_task_window(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_dedup_limits_groups_before_the_exchange(spark):
    text = plan(spark, "dedup_title_desc")
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_scans_read_only_needed_columns(spark):
    text = plan(spark, "regex_entry_level")
    schema = text[text.index("ReadSchema") :]
    assert "text" not in schema and "n_chars" in schema


def test_cleaning_runs_once_under_a_later_filter(spark):
    text = plan(spark, "clean_postings")
    assert text.count("array_join") == 2  # references and lines, one each


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["model", "category", "k", "recall", "precision", "f1", "ndcg"]
    assert df.count() > 0
