"""Cases that earlier versions got wrong: large benchmark items, pages with an open head."""

from __future__ import annotations

import random

import pytest

from lodestone.llm import decontaminate, html

STORY = "Words of a story, with more of them to come. " * 9


@pytest.mark.parametrize("limit", [40, 100, 1000, 10**6])
def test_pieces_hold_all_windows(limit):
    rng = random.Random(limit)
    for window, n in ((3, 200), (10, 40), (10, 7), (1, 30)):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(n)]
        text = " ".join(words)
        got = set()
        parts = list(decontaminate.pieces(text, window, limit))
        for p in parts:
            w = p.split()
            got |= {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))}
        assert got == {tuple(words[i : i + window]) for i in range(max(1, n - window + 1))}
        assert len(parts) > 1 or len(text) * 4 <= limit or n <= 2 * window
    assert list(decontaminate.pieces(None, 10, 5)) == [None]


def test_benchmark_item_larger_than_a_block(spark):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(3000)]
    items = [(1, " ".join(words)), (2, "some short item of ten words that stands in no text")]
    texts = [" ".join(["x"] * 5 + words[i : i + 14] + ["y"]) for i in range(0, 2900, 290)] + ["nothing of it", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in decontaminate.digest(decontaminate.find_benchmark(docs, b, block_bytes=4000)).collect()}
    assert [got[i] for i in range(len(texts))] == decontaminate.brute(texts, items)


def test_more_different_words_than_letters():
    """A block holds at most a million words, so each has a letter."""
    n = decontaminate.BLOCK_BYTES // 4 // 2
    assert n < 0x110000 - 0x800 - 1
    assert len(decontaminate._letter(n)) == 1
    text = " ".join(f"{i:x}" for i in range(1_200_000))
    parts = list(decontaminate.pieces(text, 10, decontaminate.BLOCK_BYTES))
    assert len(parts) > 1 and max(len(p) for p in parts) * 4 <= decontaminate.BLOCK_BYTES + 100


@pytest.mark.parametrize(
    "page",
    [
        "<head><title>T</title><body><article><p>{}</article>",
        "<html><head><title>T</title><meta charset=x><article><p>{}</p></article></html>",
        "<title>T</title><article><p>{}</article></body>",
        "<head><title>T</title><style>p {{}}</style><script>var a = '<p>';</script><div><article><p>{}</div>",
        "<html><head><title>T</title><body class=x><main><p>{}</main>",
        "<head><template><p>never</p></template><title>T</title></head><body><article><p>{}</article>",
        "<head><link rel=x><title>T</title>\n<article><p>{}</article>",
    ],
)
def test_open_head(spark, page):
    d = spark.createDataFrame([(1, page.format(STORY))], "page_id long, html string")
    root = html.parse(page.format(STORY))

    def shown(n):
        return "".join(c if isinstance(c, str) else "" if c.name in html.SILENT else shown(c) for c in n.children)

    assert " ".join(shown(root).split()) == STORY.strip() and d.count() == 1


def test_text_ends_a_head():
    root = html.parse("<head><title>T</title>Plain words after the title<p>more</p>")
    assert [c.name for c in root.children if not isinstance(c, str)] == ["head", "p"] and "Plain words after the title" in root.children
