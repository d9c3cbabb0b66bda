"""Global row numbers: none lost, none twice, in order, whatever the settings."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import numbering


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_three_million_rows(spark, tmp_path, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(3_000_000).select(F.when(F.col("id") % 10 != 0, F.xxhash64("id")).alias("k"), "id")
        d = numbering.numbered(df, [F.col("k").asc_nulls_first(), F.col("id").asc()], "n", str(tmp_path / "t"), 1)
        r = d.agg(F.count("*").alias("rows"), F.countDistinct("n").alias("numbers"), F.countDistinct("id").alias("ids"), F.min("n").alias("low"), F.max("n").alias("high")).first()
        assert r.asDict() == {"rows": 3_000_000, "numbers": 3_000_000, "ids": 3_000_000, "low": 1, "high": 3_000_000}
        near = d.select("n", "k", "id", F.lag(F.struct("k", "id")).over(Window.partitionBy(F.floor(F.col("n") / 1000)).orderBy("n")).alias("last"))
        assert near.where(F.struct("k", "id") <= F.col("last")).count() == 0
        assert d.where("k is null").agg(F.max("n")).first()[0] == 300_000
        assert d.where("n % 1000 = 0").agg(F.sum("id")).first() == d.where("n % 1000 = 0").agg(F.sum("id")).first()  # read twice
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_small(spark, tmp_path):
    d = spark.createDataFrame([(3, "a"), (None, "b"), (3, "a"), (1, None)], "k int, `a.b` string")
    rows = sorted(tuple(r) for r in numbering.numbered(d, [F.col("k").asc_nulls_first()], "row", str(tmp_path / "a")).select("row", "k", "`a.b`").collect())
    assert rows == [(0, None, "b"), (1, 1, None), (2, 3, "a"), (3, 3, "a")]
    assert numbering.numbered(d.limit(0), [F.col("k")], "row", str(tmp_path / "b")).count() == 0
    with pytest.raises(ValueError):
        numbering.by_files(spark, str(tmp_path / "a"), "k")


def test_several_files_a_task(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        d = numbering.numbered(spark.range(500).select((F.lit(1000) - F.col("id")).alias("k")), [F.col("k").asc()], "n", str(tmp_path / "t"))
        assert [r.n for r in d.orderBy("k").collect()] == list(range(500))
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
