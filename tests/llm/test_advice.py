"""What a review found missing, each with a case that the code before it failed."""

from __future__ import annotations

import random

import pytest

from lodestone.llm import decontaminate, html, minhash, pii

pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"


def invented(rng, n):
    return ["".join(rng.choice("abdeghilmnorst") for _ in range(9)) for _ in range(n)]


def test_pipeline_near_duplicates_from_80_percent(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng, rows = random.Random(80), []
    for _ in range(30):
        w = invented(rng, 220)
        rows.append(" ".join(w))
        for i in (20, 70, 120, 170)[: rng.randint(3, 4)] if len(rows) % 4 else (20, 60, 100, 140, 180):
            w[i] = "changed"
        rows.append(" ".join(w))
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, DOCS)
    kept = {p: {w[0] for w in minhash.brute(rows, p) if w[3]} for p in (80, 85)}
    assert len(kept[80]) < len(kept[85])
    left = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert {r.doc_id for r in left.collect()} == kept[80]
    assert {r.doc_id for r in minhash.keep_one(docs, minhash.OP6_PERCENT).collect()} == kept[85]


def test_pii_terms_far_off_and_in_other_documents(spark):
    far = "some plain words that say nothing at all " * 5
    texts = [f"Write to joe@corp.example today. {far}The zorblatt unit Li 77x4 number {i}." for i in range(6)]
    texts += [f"The zorblatt unit alone, {far}number {i}." for i in range(1)] + [f"The unit today. Write to number {i}, {far}as said." for i in range(220)]
    texts += [f"The unit today. Write to u{i}@mail.example, {far}as said." for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = {r.doc_id: [texts[r.doc_id][x.s : x.e] for x in r.terms] for r in pii.find(docs).collect()}
    assert [found[i] for i in range(6)] == [["zorblatt", "Li", "77x4"]] * 6
    assert found[6] == ["zorblatt"] and not any(found[i] for i in range(7, len(texts)))
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any("zorblatt" in t or "77x4" in t or "joe" in t for t in out.values())
    assert out[0] == f"Write to [EMAIL] today. {far}The [EMAIL TERM] unit [EMAIL TERM] [EMAIL TERM] number 0."


def test_html_only_real_hidden_attributes():
    for a in ('class="overflow-hidden"', 'style="overflow:hidden"', 'href="/hidden-lake"', 'title="Hidden costs"', "data-x='display:none'", "class=hidden", "aria-hidden=false", 'title="a hidden b"'):
        assert not html.is_hidden(" " + a), a
    for a in ("hidden", 'hidden=""', "HIDDEN class=x", 'style="color:red; Display : none"', "style=display:none", "aria-hidden=true", 'aria-hidden="true"'):
        assert html.is_hidden(" " + a), a
    text = "Long text of the story, with words. " * 6
    page = f"<body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><article style='overflow:hidden'><h1>Head</h1><p class='overflow-hidden'>{text}</p><p>By <a href='/hidden-lake' title='Hidden costs'>the lake</a> we let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> and <svg><title>t</title><text>axis</text></svg> of <object data=a>the chart</object>. {text}</p><p hidden>Not shown.</p><p style='display:none'>Nor this.</p></article><footer>x"
    assert html.extract(page) == f"Head\n{text.strip()}\nBy the lake we let x=2 and axis of the chart. {text.strip()}"


def test_decontaminate_blocks_keep_each_row(spark):
    rng = random.Random(7)
    items = [(i, " ".join(invented(rng, 10))) for i in range(6)]
    texts = [items[0][1] + " a", items[1][1] + " a", "x y z", "u v w", items[0][1] + " " + items[5][1]]
    rows = [(None, t) for t in texts] + [(5, t) for t in texts] * 2 + [(6, None), (6, ""), (6, None)]
    docs, bench = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, *b) for (i, _), b in zip(rows, decontaminate.brute([t for _, t in rows], items), strict=True)), key=repr)
    for limit in (decontaminate.BLOCK_BYTES, 900):
        got = decontaminate.digest(decontaminate.find_benchmark(docs, bench, block_bytes=limit)).collect()
        assert sorted(map(tuple, got), key=repr) == want
