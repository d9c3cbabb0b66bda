"""Logs that are replaced as a whole: old or new, wherever a writer stops."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import logs
from lodestone.sources import versioned

SCHEMA = "row long, status string"


def rows(spark, path):
    return sorted((r.row, r.status) for r in versioned.read(spark, path, SCHEMA).collect())


def test_old_or_new(spark, tmp_path):
    path = str(tmp_path / "log")
    assert rows(spark, path) == [] and versioned.version(spark, path) == 0
    first = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    assert versioned.replace(first, path, 0) == 1
    old = [(1, "a"), (2, "b")]
    new = logs.upsert(versioned.read(spark, path, SCHEMA), spark.createDataFrame([(2, "c"), (3, "d")], SCHEMA))
    name = versioned.write(new, path)  # and the writer stops
    assert rows(spark, path) == old
    open(f"{path}/commits/_draft", "w").close()  # or stops here
    os.makedirs(f"{path}/v-half/_temporary")  # or before, in the middle of a folder
    assert rows(spark, path) == old
    with pytest.raises(FileNotFoundError):
        versioned.commit(spark, path, "v-half", 1)
    with pytest.raises(versioned.Conflict):
        versioned.commit(spark, path, name, 0)
    assert rows(spark, path) == old
    assert versioned.commit(spark, path, name, 1) == 2
    assert rows(spark, path) == [(1, "a"), (2, "c"), (3, "d")]


def test_two_writers_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(4):
        versioned.replace(spark.range(k + 1).select(F.col("id").alias("row"), F.lit("s").alias("status")), path, k)
    with pytest.raises(versioned.Conflict):
        versioned.replace(spark.createDataFrame([(9, "late")], SCHEMA), path, 3)
    assert len(rows(spark, path)) == 4
    assert versioned.vacuum(spark, path, keep=1) == 4 and len(rows(spark, path)) == 4 and versioned.version(spark, path) == 4
    assert versioned.replace(versioned.read(spark, path, SCHEMA).where("row > 1"), path, 4) == 5 and rows(spark, path) == [(2, "s"), (3, "s")]
