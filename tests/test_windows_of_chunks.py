"""Windows that are put together from a text's chunks are those of its sentences."""

from __future__ import annotations

import random

import pytest

from lodestone.operators import candidates


@pytest.mark.parametrize("context", [0, 1, 2])
def test_both_ways_agree(spark, monkeypatch, context):
    rng = random.Random(context)
    parts = ["a 5% ee", "B 7 % yield", ".", "! ", "?\n", "\n", "\n ", " ", "\t", ". ", "word", "1.5", "é 3% ee", "\x0b", " "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(600)] + [(1000, None), (1001, ""), (1002, "5% ee. " * 200), (1003, " 5% ee. x"), (1004, "x.\n\n5% ee\n \n")]
    d = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = {tuple(r) for r in candidates.windows(d, "text", context).collect()}
    monkeypatch.setattr(candidates, "FEW_CHUNKS", 0)
    plain = {tuple(r) for r in candidates.windows(d, "text", context).collect()}
    assert got == plain and len(got) > 300


def test_a_short_text_needs_no_sentences(spark, monkeypatch):
    """Sentences are made of other texts alone."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(candidates, "sentence_spans", lambda text: F.raise_error(F.lit("sentences")).cast(candidates.SPANS))
    d = spark.createDataFrame([(1, "One. It gave 5% ee and more. Two.\nThree")], "id long, text string")
    assert [tuple(r) for r in candidates.windows(d, "text", 1).collect()] == [(1, 1, 0, 33, "One. It gave 5% ee and more. Two.")]
