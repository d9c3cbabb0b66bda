"""Each registered opN query over a small folder of tables with null ids, null, empty, long and repeated texts, ties and clashing names."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import decontaminate, jpeg, minhash, pii, queries, substrings, tokens

P = pytest.importorskip("public_tokenizers")
Q = queries.queries()


def invented(rng, n):
    return " ".join("".join(rng.choice("abdeghilmnorst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def talk(rng):
    """Turns with null numbers, roles, texts and ids, ties, repeated rows, missing openings and a conversation of 60 turns."""
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["", "hi", "é😀", "ok", invented(rng, 3)])) for c in range(40) if c % 7 for t in range(rng.randint(1, 12))]
    rows += [(10, t, "user", f"turn {t}") for t in range(60)] + [(11, 3, "user", "b"), (11, 3, "user", "a"), (11, 3, "user", "a"), (12, None, "x", "null first"), (13, 1, None, None), (None, 1, "user", "nobody"), (91, 0, "user", "alone"), (96, 0, "a", "no opening")]
    return rows + [(c, t, r, x) for c, k in ((100, 15), (105, 15), (-7, 15), (-5, 3)) for t, r, x in [(t, "user", f"copied {t}") for t in range(k)]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Path, document rows (doc_id, text), benchmark items."""
    path, rng = str(tmp_path_factory.mktemp("sf")), random.Random(1)
    passage, item = invented(rng, 60), invented(rng, 14)
    texts = ["", "   ", "x", "a b c", "\n\t\x0b", "é" * 50, "Ünïcode – dash 😀", "a  b ", invented(rng, 6000), f"{invented(rng, 20)} {passage}", f"{passage}\n{invented(rng, 9)}", f"{invented(rng, 5)}, {item.upper()}! {invented(rng, 9)}"]
    texts += ["Mail joe@corp.example, 10.0.0.1 or +1 (168) 555-5254; 4111 1111 1111 1111."]
    near = invented(rng, 300).split()
    for k in range(4):
        texts.append(" ".join([*near[:k], "new", *near[k + 1 :]]))
    texts += [invented(rng, rng.randint(1, 200)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(3, "a b c"), (9, texts[9]), (500, None), (None, "of nobody"), (None, None), (None, texts[13])]
    wide = [(i, t, "ab"[(i or 0) % 2], "s", len(t or ""), 1, "x", 0.5, True, "y") for i, t in rows]
    spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, k1 int, spans string, score double, kept boolean, start string").repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(1, item), (2, "x y"), (3, None), (None, ""), (1, item)]
    spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, n_words string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0, "q") for i in range(40)] + [(None, 1, 0, None), (5, None, 0, "q"), (3, 1, 0, "q")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{path}/labels.parquet")
    pages = [(1, "u", "<article><h1>A</h1><p>" + "Words of a story, with more. " * 9 + "</article>"), (1, "u", None), (None, None, ""), (2, "v", "<p"), (3, "w", "plain &amp; simple")]
    spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(*t, 1) for t in talk(rng)], "conv_id long, turn long, role string, text string, depth int").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path, rows, items


@pytest.fixture(scope="module")
def nothing(spark, folder, tmp_path_factory):
    """The same tables without rows."""
    path = str(tmp_path_factory.mktemp("sf-empty"))
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        spark.read.parquet(f"{folder[0]}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


COLUMNS = {
    "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2_token_store": "doc_id start n_tokens ids_crc32", "op3_sentencepiece": "doc_id n_ids ids exact", "op4_progressive_jpeg": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op5_quality": "doc_id held_out score predicted", "op6_minhash": "doc_id n_shingles component_id kept", "op7_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated", "op8_html_main_text": "page_id url text n_chars", "op9_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op10_language_id": "doc_id held_out lang_pred score", "op11_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", "op12_feistel_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op13_fill_in_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
}


@pytest.mark.parametrize("name", sorted(Q))
def test_columns_and_empty_tables(spark, nothing, name):
    found = Q[name](spark, nothing)
    assert set(COLUMNS[name].split()) <= set(found.columns) and found.count() == 0


def test_op1(spark, folder):
    path, rows, _ = folder
    got = Q["op1_pii"](spark, path).collect()
    assert key((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == key((i, *pii.brute(t)[:5]) for i, t in rows)
    assert all(r.n_spans == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_term == len(list(filter(None, r.spans.split(",")))) for r in got)


def test_op2(spark, folder):
    path, rows, _ = folder
    enc = tokens.Encoder(P.path("byte_bpe_50k.json"))
    ids = [(i, enc.plain(t or "") + b"\0\0\0\0") for i, t in rows]
    got = sorted(Q["op2_token_store"](spark, path).collect(), key=lambda r: r.start)
    assert key((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == key((i, len(b) // 4, zlib.crc32(b)) for i, b in ids)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_op3(spark, folder):
    import sentencepiece

    path, rows, _ = folder
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = Q["op3_sentencepiece"](spark, path).collect()
    assert key((r.doc_id, tuple(r.ids), r.n_ids, r.exact) for r in got) == key((i, tuple(sp.encode(t or "")), len(sp.encode(t or "")), True) for i, t in rows)


def test_op4(spark, folder):
    path, rows, _ = folder
    got = Q["op4_progressive_jpeg"](spark, path).collect()
    want = [(i, *jpeg.payload(t)) for i, t in rows]
    assert key((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == key((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, p, n in want)
    stored = {hashlib.sha256(jpeg.store(p)).hexdigest(): jpeg.store(p) for _, p, _ in want}
    for r in got:
        media = stored[r.media_sha256]
        assert r.media_bytes == len(media) and b"".join(x.rgb for x in r.images) == b"".join(t.tobytes() for t in jpeg.restore(media)[1])


def test_op5_and_op10(spark, folder):
    path, rows, _ = folder
    for name, fold, rest in (("op5_quality", 5, 0), ("op10_language_id", 3, 1)):
        got = Q[name](spark, path).collect()
        assert key((r.doc_id, r.held_out) for r in got) == key((i, i is not None and zlib.crc32(str(i).encode()) % fold == rest) for i, _ in rows)
        assert all(0 <= r.score <= 1 for r in got)
        if name == "op5_quality":
            assert all(r.predicted == (r.score >= 0.3) for r in got)
        else:
            lettered = {i for i, t in rows if i is not None and t and any(c.isalpha() for c in t)}
            assert all((r.lang_pred != "und") == (r.doc_id in lettered) for r in got if r.doc_id is not None) and {r.lang_pred for r in got} <= {"a", "b", "und"}


def test_op6(spark, folder):
    path, rows, _ = folder
    got = Q["op6_minhash"](spark, path).collect()
    with_id = [(i, t) for i, t in rows if i is not None]
    want = {w[0]: w for w in minhash.brute(with_id, 85)}
    assert key(r for r in got if r.doc_id is not None) == key(want[i] for i, _ in with_id)
    assert sum(r.doc_id is None and r.component_id is None and r.kept for r in got) == 3


def test_op7(spark, folder):
    path, rows, items = folder
    got = Q["op7_decontaminate"](spark, path).collect()
    assert key(got) == key((i, *b) for (i, _), b in zip(rows, decontaminate.brute([t for _, t in rows], items), strict=True))
    assert any(r.contaminated for r in got)


def test_op8(spark, folder):
    got = Q["op8_html_main_text"](spark, folder[0]).collect()
    story = "A\n" + ("Words of a story, with more. " * 9).strip()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert key((r.page_id, r.url, r.text) for r in got if r.page_id in (1, None)) == key([(1, "u", story), (1, "u", ""), (None, None, "")])


def test_op9(spark, folder):
    path, rows, _ = folder
    got = Q["op9_substring_dedup"](spark, path).collect()
    assert key(got) == key((i, *b) for (i, _), b in zip(rows, substrings.brute([t for _, t in rows]), strict=True))
    assert any(r.n_removed for r in got)


def test_pipeline(spark, folder, nothing):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, path)
        docs.write.parquet(f"{path}/stage-{name}")
        docs = spark.read.parquet(f"{path}/stage-{name}")
        assert docs.columns == before.columns and docs.count() <= before.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert sorted(r.text for r in last) == sorted(r.text or "" for r in docs.select("text").collect()) and all(len(r.ids) == r.n_ids for r in last)
    assert not any("joe@corp.example" in r.text for r in last)
    assert corpus_pipeline.run(spark, nothing).count() == 0
