"""Fields are counted beside each other, as they are counted row by row."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__
from lodestone.operators.evaluation import accuracy_by_field, field_accuracy, field_hits

SF = "/root/testdata/sf0.001"


def test_as_row_by_row(spark):
    shape = "doc_id string, n int, values map<string,string>"
    values = [None, {}, {"solvent": "THF", "ligand": None, "source": "x"}, {"solvent": " thf ", "ee_percent": "97"}, {"ee_percent": "97.00001", "solvent": None}, {"ee_percent": "97.0001", "ligand": "NaN"}, {"ee_percent": "high", "ligand": "nan"}]
    every = [(f"{i}-{j}", 1, v, w) for i, v in enumerate(values) for j, w in enumerate(values)] + [(None, 1, values[2], values[2]), ("a", None, values[2], values[2])]
    expected = spark.createDataFrame([(k, n, v) for k, n, v, _ in every] + [("alone", 1, {"tof": "1", "solvent": "x"})], shape)
    predicted = spark.createDataFrame([(k, n, w) for k, n, _, w in every], shape)
    rows = lambda d: sorted(tuple(r) for r in d.select("field", "total", "correct", "accuracy").collect())
    got = rows(accuracy_by_field(expected, predicted))
    assert got == rows(field_accuracy(field_hits(expected, predicted))) and [r[0] for r in got] == ["ee_percent", "ligand", "solvent"]
    assert rows(accuracy_by_field(expected.limit(0), predicted)) == []


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["benchmark_field_accuracy", "benchmark_summary"])
def test_maps_are_not_shuffled_nor_fields_exploded(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "explode(e#" not in plan
