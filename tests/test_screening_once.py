"""Screening makes a row's text once, whatever is asked of it, and words are looked for as they are with what patterns would find."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions.regexes import found, py_regex
from lodestone.operators import screening
from lodestone.plans import screens

TEXTS = ["", "licensed under", "LICENSED UNDER it", "licenſed under", "lıcensed under", "LİCENSED under", "toKen", "Token é", "a to ken", "licensed  under", "ü licensed under, token", "rights reserved ſ", None]


def test_strict_filter_makes_the_text_once(spark):
    plan = screens.QUERIES["strict_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("split(") == 1 and "RLIKE" not in plan


@pytest.mark.parametrize("pattern", ["licensed under", "Token", "rights reserved", r"\btoken\b", "x-ray"])
def test_words_are_found_as_patterns_are(spark, pattern):
    t = F.lower("t")
    d = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, t string").repartition(2)
    for r in d.select("t", screening._has(t, pattern).alias("got"), found(t, pattern).alias("want"), screening._first(t, pattern).alias("first"), F.coalesce(F.regexp_substr(t, F.lit(py_regex(pattern))), F.lit("")).alias("match")).collect():
        assert (bool(r.got), r.first) == (r.want, r.match), r
