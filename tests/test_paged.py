"""Candidates of pages equal those of the joined text, however a text is cut; running sums equal those of a list."""

from __future__ import annotations

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from lodestone.operators import paged, scans
from lodestone.operators.candidates import windows
from lodestone.sources.files import pages_to_text

SENTENCES = ("It gave 95% ee.", "A run gave 88% yield!", "Then it stopped.", "No result?", "THF was used", "Été à 20 °C.", "It gave 90% ee and 80% yield at 5 bar.", "", "   ", "\n\n", "\t", "x .", "iron.iron")


def made_up(seed: int, papers: int = 60):
    rng, rows = random.Random(seed), []
    for p in range(papers):
        for page in range(rng.choice((1, 1, 2, 3, 9))):
            glue = rng.choice((" ", "  ", "\n", "", " \n "))
            text = glue.join(rng.choice(SENTENCES) for _ in range(rng.choice((0, 1, 1, 2, 3, 8))))
            rows.append((p if p else None, page * rng.choice((1, 1, 3)), rng.choice((text, text, rng.choice(("", " ")) + text + rng.choice(("", " \n"))))))
    return [*rows, (7, 1, None), (7, 1, None), (8, None, "It gave 91% ee."), (9, 50, None), (9, 51, ""), (9, 52, "At the end 60% yield. "), *[(10, 100 + i, "") for i in range(40)], (10, 200, "It gave 77% ee."), (11, 2, "A run gave 10% ee.")]


def as_list(df):
    return sorted(repr((r.paper, int(r.ordinal), int(r.start), int(r.end), r.evidence)) for r in df.collect())


@pytest.mark.parametrize("context", [0, 1, 2, 5])
def test_pages_equal_the_joined_text(spark, monkeypatch, context):
    monkeypatch.setattr(scans, "BLOCK", 3)  # many blocks, and blocks of blocks
    pages = spark.createDataFrame(made_up(context), "paper long, page_no long, text string").withColumn("key", F.lit("another")).repartition(5)
    want = as_list(windows(pages_to_text(pages, "paper"), "text", context))
    assert len(want) > 50
    assert as_list(paged.windows_of_pages(pages, "paper", context)) == want


def test_equal_windows_of_a_short_paper_count_once_across_pages(spark):
    pages = spark.createDataFrame([("p", i, "It gave 9% ee.") for i in range(4)], "paper string, page_no int, text string")
    got = sorted((r.ordinal, r.start, r.end) for r in paged.windows_of_pages(pages, "paper", 3).collect())
    assert got == [(1, 0, 59)]
    assert [r.ordinal for r in paged.windows_of_pages(pages, "paper", 2).orderBy("ordinal").collect()] == [1, 2, 4]  # the third's window is the second's


def test_no_pages_and_a_wrong_context(spark):
    none = spark.createDataFrame([], "doc_id long, page_no int, text string")
    assert paged.extract_candidates_of_pages(none).count() == 0
    with pytest.raises(ValueError):
        paged.windows_of_pages(none, context=-1)


def test_one_paper_of_very_many_pages(spark):
    """A paper with nearly all pages: each page's last sentence is an anchor, so every window but the last goes over an edge."""
    n = 30_000
    pages = spark.range(n).select(F.lit("p").alias("doc_id"), F.col("id").alias("page_no"), F.concat(F.lit("Page "), F.col("id"), F.lit(". It gave 50% ee.")).alias("text"))
    d = paged.windows_of_pages(pages, context=1)
    r = d.agg(F.count("*").alias("n"), F.max("ordinal").alias("last"), F.sum(F.col("evidence").rlike(r"^Page \d+\. It gave 50% ee\.\nPage \d+\.$").cast("int")).alias("over"), F.max("end").alias("end")).first()
    assert (r.n, r.last, r.over) == (n, n, n - 1)
    assert r.end == sum(len(f"Page {i}. It gave 50% ee.") + 1 for i in range(n)) - 1


def test_running(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 4)
    rng = random.Random(1)
    rows = [(n, rng.randrange(9), rng.choice((None, rng.randrange(99)))) for n in sorted(rng.sample(range(400), 150))]
    d = scans.running(spark.createDataFrame(rows, "n long, a long, b long").repartition(4), "n", {"s": (F.sum, "a"), "m": (F.max, "b")})
    most = list(accumulate((r[2] for r in rows), lambda x, y: y if x is None else x if y is None else max(x, y)))
    assert [(r.n, r.s, r.m) for r in d.orderBy("n").collect()] == [(r[0], s, m) for r, s, m in zip(rows, accumulate(r[1] for r in rows), most, strict=True)]
