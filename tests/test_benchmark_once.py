"""The benchmark queries extract once, and counts by key are those of joins."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__
from lodestone.operators.evaluation import evaluate

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["benchmark_field_accuracy", "benchmark_summary"])
def test_candidates_are_extracted_once(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "% ee" not in plan and r"%\s*ee" not in plan  # candidates are read from the table that was written


def test_counts_by_key(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), (None,)], "doc_id string")
    shape = "doc_id string, n int, values map<string,string>"
    expected = spark.createDataFrame([("a", 1, {"solvent": "x"}), ("b", 1, {"solvent": "x"}), (None, 1, {}), ("z", 1, {})], shape)
    predicted = spark.createDataFrame([("a", 1, {"solvent": "X"}), ("c", 1, {"solvent": "x"}), (None, 1, {}), (None, 2, {})], shape)
    r = evaluate(texts, expected, predicted).first()
    # right: both texts of a, d (nothing of either), the null key (never met)
    assert (r.examples, r.candidate_count_accuracy, r.macro_field_accuracy) == (6, 4 / 6, 1.0)
    r = evaluate(texts.limit(0), expected, predicted).first()
    assert (r.examples, r.candidate_count_accuracy) == (0, 0.0)
