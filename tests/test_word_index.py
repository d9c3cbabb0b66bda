"""An index of words is made inside the row: no shuffle of single words."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import __spark_entry__
from lodestone.functions.text import abstract_from_index, index_of_words


def test_index_equals_that_of_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice("abcdeé") * rng.choice((1, 1, 2)) for _ in range(n)]) for i, n in enumerate((0, 1, 2, 7, 40, 3_000))]
    got = spark.createDataFrame(rows, "i int, words array<string>").select("i", index_of_words(F.col("words")).alias("x")).withColumn("back", abstract_from_index(F.col("x"))).collect()
    for r in got:
        want: dict[str, list[int]] = {}
        for p, w in enumerate(rows[r.i][1]):
            want.setdefault(w, []).append(p)
        assert r.x == want
        assert r.back == " ".join(rows[r.i][1])


def test_query_shuffles_no_words(spark, tmp_path):
    rows = [(1, "a  b\na"), (2, None), (3, ""), (4, " \n "), (5, "\tx ")] + [(i, f"w {i} w") for i in range(6, 40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    d = __spark_entry__.queries()["abstract_from_index"](spark, str(tmp_path))
    assert "hashpartitioning" not in d._jdf.queryExecution().executedPlan().toString()
    want = spark.createDataFrame([(i, " ".join(t.split())) for i, t in rows if t and t.split()], "doc_id long, t string").select("doc_id", F.sha2("t", 256))
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, want.collect()))
