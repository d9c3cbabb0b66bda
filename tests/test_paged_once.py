"""Papers that a row may hold are shuffled once; larger ones go page by page with the same results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import paged, scans
from lodestone.operators.candidates import windows
from lodestone.sources.files import pages_to_text
from tests.test_paged import as_list, made_up


@pytest.mark.parametrize(("pages", "octets"), [(0, 0), (2, 1 << 20), (1_000, 60)])
def test_both_ways_equal_the_joined_text(spark, monkeypatch, pages, octets):
    monkeypatch.setattr(scans, "BLOCK", 3)
    monkeypatch.setattr(paged, "PAGES", pages)
    monkeypatch.setattr(paged, "OCTETS", octets)
    d = spark.createDataFrame(made_up(9), "paper long, page_no long, text string").repartition(5)
    assert as_list(paged.windows_of_pages(d, "paper", 2)) == as_list(windows(pages_to_text(d, "paper"), "text", 2))


def test_small_papers_are_shuffled_once(spark):
    d = spark.range(1_000).select((F.col("id") % 300).alias("doc_id"), F.col("id").alias("page_no"), F.lit("It gave 95% ee.").alias("text"))
    got = paged.windows_of_pages(d, context=2)
    assert str(got._jdf.queryExecution().executedPlan()).count("Exchange") == 1
    assert got.count() == 500
