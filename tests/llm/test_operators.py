"""Each operator against brute force, round trips and held-out accuracy, with nulls, empty texts, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import decontaminate, html, jpeg, language, minhash, pieces, pii, quality, substrings, tokens
from lodestone.llm.common import pick, shared_dir, words

P = pytest.importorskip("public_tokenizers")
ODD = ["", "   ", "x", "a b c", "\n\t", "é" * 50, "wort " * 700, "Ünïcode – dash", "a b c"]
DOCS = "doc_id long, text string, Text string, lang string, k1 int, c0 string"


def frame(spark, texts, start=0):
    """Documents with clashing extra columns, a null text, a null id and a repeated row."""
    rows = [(start + i, t, "other", "en", 1, "c") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (10_000, None, "o", None, None, None)], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def vocabulary(rng, n=300):
    return ["".join(rng.choice("abdeghilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_pick_and_words(spark):
    d = spark.createDataFrame([(1, "a", "b")], "doc_id int, text string, TEXT string")
    assert pick(d, "text").first().text == "a"
    with pytest.raises(ValueError):
        pick(d, "nothing")
    data = "  añ b\x0bc  d ".encode() * 300
    s, e, h = words(data)
    assert [data[i:j] for i, j in zip(s, e, strict=True)] == data.split()
    s2, e2, h2 = words(data, part=100)
    assert (s == s2).all() and (e == e2).all() and (h == h2).all()
    assert len({(data[i:j], x) for i, j, x in zip(s, e, h.tolist(), strict=True)}) == 4


# 1
def test_pii_base(spark):
    rng = random.Random(1)
    parts = ["a@b.c", "x.y+z@mail.example.org", "@", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (168) 555-5254", "+", " ", "-", "0", "12345678901234567", "_d@e.f", "é", "😀", "(", "55", "a@b", "00.0.0.0", "+12345678", "\n", "5500005555555559"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(1500)] + ["1 " * 3000, "a.b@c.d " * 700, "9" * 20000, "a" * 20000 + "@b.c"]
    got = pii.digest(pii.find(frame(spark, texts))).collect()
    want = [(i, *pii.brute(t)) for i, t in enumerate(texts)]
    want += [want[0], (10_000, *pii.brute(None))]
    assert by_id((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in got) == by_id(want)
    assert pii.digest(pii.find(empty(spark))).count() == 0


def test_pii_terms_and_masking(spark):
    texts = [f"The zorblatt office answers at joe@corp.example today number {i}." for i in range(6)] + [f"The office answers today and number {i} is fine." for i in range(60)]
    docs = frame(spark, texts)
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    terms = {texts[0][x.s : x.e] for x in found[0].terms}
    assert "zorblatt" in terms and "office" not in terms and not found[30].terms
    out = {r[0]: r[1] for r in pii.sanitise(docs).collect()}
    assert out[0] == "The [EMAIL TERM] office answers at [EMAIL] today number 0." and out[30] == texts[30] and out[10_000] is None
    assert pii.sanitise(docs).columns == docs.columns


def test_pii_identity_and_support(spark):
    """An entity of one document has no terms, one of two or three has; ways to write it are one entity; spans of equal start stay apart."""
    plain = lambda i: f"Plain words about the weather and the news of the day, number {i}."
    texts = [plain(i) for i in range(3000)]
    texts[10] = "Ask for quibblefax at 4111 1111 1111 1111 of the day."
    texts[11] = "The quibblefax has 4111-1111-1111-1111 and the news."
    texts[20] = "The snarkdom of the day is 10.20.30.40 and the news."
    texts[21] = "A snarkdom about 010.020.030.040 of the weather."
    texts[22] = "The weather and the snarkdom, 10.20.30.40."
    texts[30] = "Only once: flimflam and joe@corp.example of the day."
    texts[40] = "+1234567812345670 1.2.3.4"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}
    terms = {i: [texts[i][int(x.split(":")[1]) : int(x.split(":")[2])] for x in r.spans.split(",") if x.startswith("term")] for i, r in got.items()}
    assert {i: t for i, t in terms.items() if t} == {10: ["quibblefax"], 11: ["quibblefax"], 20: ["snarkdom"], 21: ["snarkdom"], 22: ["snarkdom"]}
    assert (got[10].n_card, got[10].n_term, got[10].n_spans) == (1, 1, 2) and (got[30].n_email, got[30].n_spans) == (1, 1)
    assert got[40].spans == pii.brute(texts[40])[-1] and got[40].n_spans == 1 + 1 + got[40].n_phone
    masked = {r.doc_id: r.text for r in pii.sanitise(docs).where("doc_id in (10, 21)").collect()}
    assert masked == {10: "Ask for [CARD TERM] at [CARD] of the day.", 21: "A [IP TERM] about [IP] of the weather."}


# 2
def test_tokens(spark):
    path = P.path("byte_bpe_50k.json")
    rng = random.Random(2)
    enc = tokens.Encoder(path, most=20_000)
    assert enc.apart
    odd = [" ", "  ", "\n", "a", "don't", "'s", "é", "ÿ", " ", " ", "!", "12", "<|endoftext|>", " \n", " x", "\x1c", "x" * 300, "\n\n", "–", "….", "©.", "\xa0", "\u3000", "ª", "\t", "\r\n", "A1b2", "中文", ". ", ".\n"]
    for _ in range(1500):
        ts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 9))) for _ in range(3)]
        ids, counts = enc.encode_array(pa.array(ts, pa.string()))
        for t, got in zip(ts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.astype("<u4").tobytes() == enc.plain(t), repr(t)
    texts = ODD + [" ".join(rng.choice(vocabulary(rng, 40)) for _ in range(3000))] * 2 + [" ".join(str(rng.random()) for _ in range(6000))]
    store = f"{shared_dir(spark)}/tokens-test"
    none_id = spark.createDataFrame([(None, "of nobody"), (None, None)], "doc_id long, text string")
    docs = pick(frame(spark, texts), "doc_id", "text").unionByName(none_id)
    tokens.write_store(docs, path, store)
    got = tokens.read_store(spark, store).collect()
    at, want, all_ids = 0, [], []
    rows = sorted([*enumerate(texts), (0, texts[0]), (10_000, "")])
    both = [("of nobody", ""), ("", "of nobody")]  # rows of one id are in any order
    first = next(r.n_tokens for r in got if r.doc_id is None and r.start == 0)
    for i, t in [(None, x) for x in both[first == 1]] + rows:
        ids = [*np.frombuffer(enc.plain(t), "<u4").tolist(), 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        all_ids.append((i, ids))
        at += len(ids)
    assert by_id(got) == by_id(want)
    chunks = spark.read.parquet(f"{store}/objects").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count() > 5
    whole = dict(all_ids)
    back = tokens.decode_store(spark, store, [7, len(texts) - 1])
    assert all(back[i].tolist() == whole[i] for i in back) and len(back) == 2
    tokens.write_store(empty(spark), path, store + "-empty")
    assert tokens.read_store(spark, store + "-empty").count() == 0


def test_tokens_cuts_and_crc():
    rng = np.random.default_rng(2)
    streams = [rng.integers(0, 50_000, n).astype("<u4") for n in (1, 15, 16, 17, 63, 700, 20_000)] + [np.zeros(9_000, "<u4"), rng.integers(0, 50_000, 700).astype("<u4")]
    ends = np.cumsum([len(s) for s in streams])
    joined = [[e - z + len(s) for e in c] for s, z, c in zip(streams, ends, tokens.cuts(np.concatenate(streams), ends), strict=True)]
    alone = [next(tokens.cuts(s, np.array([len(s)]))) for s in streams]
    assert joined == alone and all(c[-1] == len(s) for c, s in zip(alone, streams, strict=True))
    assert all(tokens.MIN_IDS <= z - a <= tokens.MAX_IDS for c in alone for a, z in zip([0, *c[:-2]], c[:-1], strict=False))
    lists = [[b"ab", b"", b"cde"], [b"x"], [bytes([i % 256]) * (i % 9) for i in range(200)], [b""]]
    flat, ends = [x for y in lists for x in y], np.cumsum([len(x) for x in lists])
    got = tokens.crc_join_many(np.array([zlib.crc32(x) for x in flat], np.uint64), np.array([len(x) for x in flat]), ends)
    assert got.tolist() == [zlib.crc32(b"".join(x)) for x in lists] == [tokens.crc_join([(zlib.crc32(p), len(p)) for p in x]) for x in lists]


def test_tokens_store_verifies(spark):
    import shutil

    path, store = P.path("byte_bpe_50k.json"), f"{shared_dir(spark)}/tokens-broken"
    tokens.write_store(frame(spark, [f"some words and number {i} of them" for i in range(40)]), path, store)

    def broken(folder, change):
        shutil.copytree(store, f"{store}-{change.__name__}")
        at = f"{store}-{change.__name__}/{folder}"
        rows = spark.createDataFrame(change(spark.read.parquet(at).collect()), spark.read.parquet(at).schema)
        rows.write.mode("overwrite").parquet(at + "-new")
        shutil.rmtree(at)
        shutil.move(at + "-new", at)
        with pytest.raises(Exception, match="match|not there"):
            tokens.read_store(spark, f"{store}-{change.__name__}").collect()

    def other_manifest_root(rows):
        return [r.asDict() | {"root": b"0" * 16} for r in rows]

    def recipe_gone(rows):
        return rows[1:]

    def other_data(rows):
        return [r.asDict() | {"data": rows[0].data} for r in rows]

    def chunk_gone(rows):
        return rows[1:]

    broken("manifest", other_manifest_root)
    broken("recipes", recipe_gone)
    broken("objects/kind=chunk", other_data)
    broken("objects/kind=chunk", chunk_gone)


# 3
def ids_of(coder, texts):
    ids, counts = coder.encode_array(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_pieces(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, coder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Coder(pieces.compile_model(path), most=20_000)
    rng = random.Random(3)
    odd = [*"abehlotnri ", "  ", "\n", "the", "ing", "▁", "é", "😀", "ﬁ", "中", "aaaa", "é", "\t", "1"]
    for _ in range(1500):
        ts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 14))) for _ in range(3)]
        for t, ids in zip(ts, ids_of(coder, ts), strict=True):
            assert ids == sp.encode(t), repr(t)
            assert coder.decode(ids) == sp.decode(ids)
    long = ["x" * 3000, "ab" * 2000 + " " + "ing" * 1000, " ".join(rng.choice(vocabulary(rng)) for _ in range(30_000))]
    assert ids_of(coder, long) == [sp.encode(t) for t in long]
    docs = pick(frame(spark, ODD), "doc_id", "text").unionByName(spark.createDataFrame([(None, "a  b"), (None, None)], "doc_id long, text string"))
    got = by_id((r.doc_id, r.n_ids, r.ids, r.exact) for r in pieces.round_trip(docs, path).collect())
    want = [(i, len(sp.encode(t)), sp.encode(t), True) for i, t in [*enumerate(ODD), (0, ODD[0]), (10_000, ""), (None, "a  b"), (None, "")]]
    assert got == by_id(want)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(frame(spark, ODD), path), path).collect()}
    assert [back[i] for i in range(len(ODD))] == ODD
    assert not pieces.round_trip(spark.createDataFrame([(1, "a▁b")], "doc_id long, text string"), path).first().exact
    assert pieces.round_trip(empty(spark), path).count() == 0


def proto(number, value):
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("with_bytes", [True, False])
def test_pieces_unigram_and_normaliser(rule, with_bytes):
    """A made-up vocabulary with made-up scores, under the library's normalisers."""
    import struct

    import sentencepiece

    rng = random.Random(4)
    names = ["▁", *"abcdeﬁxé1", "▁a", "▁the", "the", "▁ab", "ab", "abc", "bc", "cd", "▁cde", "fi", "▁fi", "aa", "aaa", "▁▁"]
    piece = lambda name, score, kind: proto(1, proto(1, name.encode()) + b"\x15" + struct.pack("<f", score) + proto(3, kind))
    data = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    if with_bytes:
        data += b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256))
    data += b"".join(piece(n, -rng.uniform(1, 9), 1) for n in names)
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
    trainer = proto(3, 1) + (proto(35, 1) if with_bytes else b"")
    m = pieces.compile_proto(data + proto(2, trainer) + proto(3, spec))
    sp, coder = sentencepiece.SentencePieceProcessor(model_proto=data + proto(2, trainer) + proto(3, spec)), pieces.Coder(m)
    odd = [*"abcdex1 ", " ", "  ", "é", "é", "ﬁ", "Ａ", "ｱﾞ", "²", "\u3000", "\t", "the", "中", "中中", "Ⅷ", "½"]
    ts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    for t, ids in zip(ts, ids_of(coder, ts), strict=True):
        assert ids == sp.encode(t), repr(t)
    assert m.normaliser.rules or rule == "identity"


# 4
def test_jpeg(spark):
    rng = np.random.default_rng(4)
    for n in (1, 12, 13, 500):
        p = rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes()
        back, images = jpeg.restore(jpeg.store(p))
        assert back == p and all(t.dtype == np.uint8 and t.shape[2] == 3 for t in images)
    even, jpeg._even_scan = jpeg._even_scan, lambda *a: False  # the general reader gives the same
    try:
        slow = jpeg.restore(jpeg.store(p[: 64 * 20]))
    finally:
        jpeg._even_scan = even
    fast = jpeg.restore(jpeg.store(p[: 64 * 20]))
    assert slow[0] == fast[0] and all((a == b).all() for a, b in zip(slow[1], fast[1], strict=True))
    blocks = np.zeros((1, 1, 64), np.int32)
    blocks[0, 0, 0] = 80
    assert (jpeg.samples(blocks, np.ones(64, np.int64)) == 138).all()
    got = jpeg.describe(jpeg.to_media(frame(spark, ODD))).collect()
    for r in got:
        t = ODD[r.doc_id] if r.doc_id < len(ODD) else ""
        p, n = jpeg.payload(t)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len(got) == len(ODD) + 2 and len({r.feature for r in got if r.doc_id in (3, 8)}) == 1
    assert jpeg.describe(jpeg.to_media(empty(spark))).count() == 0
    one = jpeg.describe(jpeg.to_media(frame(spark, ["abc"]))).first().images[0]
    assert one.width == 16 * jpeg.MCU_COLUMNS and len(one.rgb) == 3 * one.width * one.height
    big = rng.integers(0, 256, 64 * 100_000, dtype=np.uint8).tobytes()  # several images
    back, images = jpeg.restore(jpeg.store(big))
    assert back == big and len(images) == 3


class _Scans:
    """A plain encoder of progressive scans as the standard has them, with runs of ended bands, of 16 zeros, and new coefficients in refinements."""

    def __init__(self, blocks):
        self.blocks = blocks  # n x 64 in zigzag order

    def first(self, lo, hi, low):
        out, run = [], 0

        def ended():
            nonlocal run
            if run:
                n = run.bit_length() - 1
                out.append((n << 4, run - (1 << n), n))
                run = 0

        for b in self.blocks:
            r, any_ = 0, False
            for k in range(lo, hi + 1):
                v = abs(int(b[k])) >> low
                if not v:
                    r += 1
                    continue
                ended()
                while r > 15:
                    out.append((0xF0, 0, 0))
                    r -= 16
                n = v.bit_length()
                out.append((r << 4 | n, v if b[k] > 0 else (1 << n) - 1 - v, n))
                r = 0
            if r:
                run += 1
                if run == 0x7FFF:
                    ended()
        ended()
        return out

    def refine(self, lo, hi, low):
        out, run, kept = [], 0, []

        def ended():
            nonlocal run
            if run:
                n = run.bit_length() - 1
                out.append((n << 4, run - (1 << n), n))
                out.extend((None, x, 1) for x in kept)
                kept.clear()
                run = 0

        for b in self.blocks:
            v = [abs(int(x)) >> low for x in b]
            last = max((k for k in range(lo, hi + 1) if v[k] == 1), default=-1)
            r, fixes = 0, []
            for k in range(lo, hi + 1):
                if not v[k]:
                    r += 1
                    continue
                while r > 15 and k <= last:
                    ended()
                    out.append((0xF0, 0, 0))
                    out.extend((None, x, 1) for x in fixes)
                    fixes, r = [], r - 16
                if v[k] > 1:
                    fixes.append(v[k] & 1)
                    continue
                ended()
                out.append((r << 4 | 1, int(b[k] > 0), 1))
                out.extend((None, x, 1) for x in fixes)
                fixes, r = [], 0
            if r or fixes:
                run += 1
                kept += fixes
        ended()
        return out


def _scan_bytes(spec, symbols):
    """A table of 8-bit codes and the scan."""
    used = sorted({s for s, _, _ in symbols if s is not None})
    bits = "".join((f"{used.index(s):08b}" if s is not None else "") + (f"{x:0{n}b}" if n else "") for s, x, n in symbols)
    bits += "1" * (-len(bits) % 8)
    raw = int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""
    return jpeg._huffman(0x10, {8: used}) + jpeg._segment(0xDA, spec) + jpeg._stuff(raw)


def test_jpeg_of_a_general_encoder():
    import struct

    rng = np.random.default_rng(44)
    for dense in (0.02, 0.2, 0.7):
        blocks = (rng.integers(-90, 91, (12, 64)) * (rng.random((12, 64)) < dense)).astype(np.int64)
        blocks[3:7, 1:] = 0
        blocks[:, 0] = rng.integers(-200, 200, 12)
        scans = _Scans(blocks)
        data = b"\xff\xd8" + jpeg._segment(0xDB, b"\x00" + b"\x01" * 64) + jpeg._segment(0xC2, struct.pack(">BHHB", 8, 24, 32, 1) + bytes([1, 0x11, 0]))
        data += jpeg._huffman(0x00, jpeg._DC_CODES) + jpeg._segment(0xDA, bytes([1, 1, 0, 0, 0, 0])) + jpeg._stuff(jpeg._pad(jpeg._dc_bits(blocks[:, 0])))
        for lo, hi in ((1, 5), (6, 63)):
            data += _scan_bytes(bytes([1, 1, 0, lo, hi, 0x02]), scans.first(lo, hi, 2))
            data += _scan_bytes(bytes([1, 1, 0, lo, hi, 0x21]), scans.refine(lo, hi, 1))
            data += _scan_bytes(bytes([1, 1, 0, lo, hi, 0x10]), scans.refine(lo, hi, 0))
        width, height, comps, _, _ = jpeg.decode(data + b"\xff\xd9")
        assert (width, height) == (32, 24) and (comps[0].reshape(-1, 64)[:, jpeg.ZIGZAG] == blocks).all()
        assert jpeg.rgb(data + b"\xff\xd9").shape == (24, 32, 3)


# 5
def test_quality(spark):
    rng = random.Random(5)
    v = vocabulary(rng)
    good = [" ".join(rng.choice(v) for _ in range(rng.randint(20, 200))) + "." for _ in range(300)]
    bad = [" | ".join(rng.choice(v).upper() for _ in range(rng.randint(20, 200))) for _ in range(150)]
    texts = [t for p in zip(good[:150], bad, strict=True) for t in p] + good[150:]
    label = [0 if "|" in t else 1 for t in texts]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(label)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r[-1] for r in quality.score(docs, model).select("doc_id", "quality_score").collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(label[i]) for i in held]) > 0.97 and all(0 <= s <= 1 for s in got.values())
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, s in got.items() if s >= 0.3}
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert none is None and quality.score(empty(spark), none).count() == 0
    one = quality.train(docs, spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int"))
    assert one is None and {r.quality_score for r in quality.score(docs, one).select("quality_score").collect()} == {0.5}
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (1, None), (2, 7), (77_777, 0)], "doc_id long, quality int"))
    again = quality.train(docs.repartition(5), twice)
    assert np.array_equal(again.vectors, model.vectors) and np.allclose(again.w1, model.w1)
    odd = {r.doc_id: r[-1] for r in quality.score(frame(spark, ODD), model).select("doc_id", "quality_score").collect()}
    assert odd[0] == odd[1] == odd[4] == odd[10_000]  # null, empty and blank texts have no tokens


def test_quality_neighbours():
    rng = np.random.default_rng(5)
    parts = [tuple(rng.integers(0, 40, n) for _ in range(3)) for n in (0, 1, 2, 3, 50, 5, 40_000, 70_000)] + [tuple(rng.integers(0, 40, 3) for _ in range(3))] * 300
    index, want = quality.index_vectors().astype(np.int64), np.zeros((quality.BUCKETS, quality.DIM), np.int64)
    for p in parts:
        for row in p[:2]:
            for k in (1, 2):
                np.add.at(want, row[:-k], index[row[k:]])
                np.add.at(want, row[k:], index[row[:-k]])
    assert (quality.neighbour_sums(parts) == want).all()


# 6
def test_skip_merging_loses_no_pair():
    rng, match = np.random.default_rng(4), minhash.least_equal(85)
    base = rng.integers(0, 2**31, (40, minhash.K)).astype(np.int32)
    for share in (0.0, 0.4, 0.7, 0.9):
        sig = np.repeat(base, 8, axis=0)
        sig = np.where(rng.random(sig.shape) < share, sig, rng.integers(0, 2**31, sig.shape)).astype(np.int32)
        sig[:, 7] = 5  # the posting's own coordinate
        met = minhash._met(minhash._lists(sig), np.arange(len(sig)), match)
        equal = (sig[:, None] == sig).sum(axis=2)
        assert met[equal >= match].all()
        assert share > 0.5 or met.mean() < 0.1  # who shares the posting alone is not compared
    sig[:] = 1
    assert minhash._met(minhash._lists(sig), np.arange(9), match).all()


def test_blocks_of_a_posting_find_the_same_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**31, (30, minhash.K)).astype(np.int32)
    sig = np.repeat(base, 6, axis=0)
    sig = np.where(rng.random(sig.shape) < 0.93, sig, rng.integers(0, 2**31, sig.shape)).astype(np.int32)
    sig[:, 0] = 9
    n = len(sig)
    low = [bytes([1 + i // 6]) * minhash.BINS for i in range(n)]
    columns = {"at": [9] * n, "x": [0] * n, "y": [0] * n, "own": [0] * n, "rep": list(range(n)), "mask": [1] * n, "component": [i // 2 for i in range(n)], "n_shingles": [100] * n, "sig": sig.tolist(), "bins": low}
    found = []
    for small in (10**6, 1):
        monkeypatch.setattr(minhash, "SMALL", small)
        t = minhash._apart(pa.table(columns), 85)
        found.append(sorted(zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True)))
    match = minhash.least_equal(85)
    want = [(a, b) for b in range(n) for a in range(b) if a // 2 != b // 2 and a // 6 == b // 6 and (sig[a] == sig[b]).sum() >= match]
    assert found[0] == found[1] == sorted(want) and len(want) > 100


def test_minhash_with_blocks_of_the_largest_component(spark, monkeypatch):
    """One passage in many texts: a large component, small ones and lone texts in the same postings, in blocks of four."""
    rng = random.Random(6)
    hot = [rng.choice(vocabulary(rng)) for _ in range(60)]
    texts = [" ".join(hot[:k] + ["new"] + hot[k + 1 :]) for k in range(0, 60, 3)]
    for size in (12, 25, 40, 55):
        tail = [rng.choice(vocabulary(rng)) for _ in range(size)]
        texts += [" ".join(hot + tail), " ".join(hot + tail[:-1] + ["other"]), " ".join(["first"] + hot + tail)]
    want = minhash.brute([*enumerate(texts)])
    monkeypatch.setattr(minhash, "BLOCK", 4)
    got = minhash.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert by_id((r.doc_id, r.component_id) for r in got) == by_id((w[0], w[2]) for w in want)
    assert len({w[2] for w in want}) > 3


def test_minhash(spark):
    rng = random.Random(6)
    v = vocabulary(rng)
    base = [" ".join(rng.choice(v) for _ in range(rng.randint(3, 150))) for _ in range(60)]
    texts = ODD + base + base[:10]
    for t in base[:25]:
        for _ in range(4):
            w = t.split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(v)
            texts.append(" ".join(w).upper())
    hub = " ".join(rng.choice(v) for _ in range(200)).split()  # a large group of copies whose ends are no copies of each other
    for _ in range(80):
        w = list(hub)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(200)] = rng.choice(v)
        texts.append(" ".join(w))
    want = minhash.brute([*enumerate(texts), (10_000, None)])
    got = minhash.near_duplicates(frame(spark, texts)).collect()
    assert by_id((r.doc_id, r.n_shingles, r.component_id) for r in got) == by_id([*(w[:3] for w in want), want[0][:3]])
    left = minhash.keep_one(frame(spark, texts))
    assert left.columns == empty(spark).columns
    assert {r.doc_id for r in left.select("doc_id").collect()} == {w[0] for w in want if w[3]}
    assert minhash.near_duplicates(empty(spark)).count() == 0


# 7
@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 300])
def test_decontaminate(spark, block):
    rng = random.Random(7)
    v = vocabulary(rng, 6)
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([0, 1, 2, 5, 10, 11, 14])))) for i in range(12)] + [(99, None), (100, "Ü,ß!")]
    texts = ODD + [rng.choice([" ", ", "]).join(rng.choice([*v, "Ü", "ß", "é"]) for _ in range(rng.randint(1, 60))).upper() for _ in range(150)] + [items[6][1] + " x " + items[6][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, *r) for i, r in enumerate(decontaminate.brute(texts, items))]
    got = decontaminate.digest(decontaminate.find_benchmark(frame(spark, texts), bench, block_bytes=block)).collect()
    want = [*rows, (10_000, *decontaminate.brute([None], items)[0])]
    assert by_id(map(tuple, got)) == by_id([*want, want[0]])
    kept = {r.doc_id for r in decontaminate.remove_contaminated(frame(spark, texts), bench).select("doc_id").collect()}
    assert kept == {r[0] for r in want if not r[-1]}
    assert decontaminate.find_benchmark(empty(spark), bench).count() == 0
    assert not decontaminate.digest(decontaminate.find_benchmark(frame(spark, texts), bench.limit(0))).where("contaminated").count()


def test_decontaminate_offsets():
    text = "Ä one, TWO-three é four"
    n, ranges, items = decontaminate.Finder([(1, "two three É"), (2, "two three é")], 10).scan(text)
    assert (n, items) == (6, ["2"]) and [text[s:e] for s, e in decontaminate.offsets(text, ranges)] == ["TWO-three é"]


# 8
def test_html(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class='ad'>Buy now!</div><article><h1>A &amp; B</h1><p><b>One  two\n three.<br><p>" + "Long text of the story, with words. " * 6 + "</p></article><section class=comments><h3>Comments</h3><div class=comment><p>I liked it.</p></div></section><form><label>Mail</label></form><footer>&copy; x"
    want = "A & B\nOne two three.\n" + ("Long text of the story, with words. " * 6).strip()
    assert html.extract(page) == want
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (1, "u", page), (3, "u", "<<<>>> plain & text </p></div>"), (4, "u", "<p>" * 3000)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and sum(r.text == want for r in got) == 2
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    rng, forest, right, total = np.random.default_rng(123), html.default_forest(), 0.0, 0.0
    for _ in range(60):
        d = html.describe(html._made_page(rng), forest.tokens)
        mark = np.array(['data-k="1"' in n.attrs for n in d.nodes])
        right += (d.own * (html.decode(d, forest.log_odds(d.x)) == mark)).sum()
        total += d.own.sum()
    assert right / total > 0.98


def test_html_broken_markup():
    import time

    began = time.time()
    n = 30_000
    for page in ("<div>" * n + "</x>" * n, "<x><table>" + "<span>" * n + "</x>" * n, "<li><ul>" + "<span>" * n + "<dt>" * n, "<ul>" + "<li><p>" * n, "<p title='" * n):
        html.parse(page)
    assert time.time() - began < 30
    text = "Some text of the story, with words. And some more of it, as is usual here."
    assert html.extract(f'<body><article><h1>Head</h1><p title="abc>{text}</article>') == f"Head\n{text}"
    assert html.extract(f"<body><article><h1>Head</h1></nope><p>{text}</b></article></div>") == f"Head\n{text}"


def test_html_decoding_is_the_best_labelling():
    import itertools

    rng = np.random.default_rng(8)
    for _ in range(60):
        k = int(rng.integers(1, 8))
        parent = np.array([-1, *(int(rng.integers(0, i)) for i in range(1, k))])
        d = html.Page([None] * k, parent, rng.choice([0.0, 3.0, 40.0, 400.0], k), None)
        odds = rng.normal(0, 2, k)

        def cost(s, d=d, odds=odds, parent=parent):
            if any(s[i] < s[parent[i]] for i in range(1, len(s))):
                return -1e9
            changes = (s[0] > 0) + sum(s[i] != s[parent[i]] for i in range(1, len(s)))
            return sum(np.clip(odds[i], -6, 6) * np.log1p(d.own[i]) for i in range(len(s)) if s[i] == 1) - html.CHANGE * changes

        best = max((s for s in itertools.product(range(3), repeat=k) if s[0] < 2), key=cost)
        found = html.decode(d, odds)
        full = [0] * k  # the states that go with what is in
        for i in range(k):
            full[i] = 1 if found[i] else 2 if i and full[parent[i]] else 0
        assert abs(cost(tuple(full)) - cost(best)) < 1e-9


def other_page(rng, v):
    """Another kind of page than those that the trees learn from: a table of columns, or nested boxes with telling names."""
    line = lambda a, b: " ".join(rng.choice(v) for _ in range(rng.randint(a, b))).capitalize() + "."
    article = [line(3, 7), *(" ".join(line(6, 18) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(3, 9)))]
    inner = f"<h2>{article[0]}</h2>" + "".join(f"<p>{a}</p>\n" for a in article[1:])
    links = "".join(f"<li><a href='/{rng.choice(v)}'>{rng.choice(v)} {rng.choice(v)}</a>" for _ in range(8))
    comments = "".join(f"<div class='user-comment'><span>{rng.choice(v)}</span><p>{line(4, 12)}</p></div>" for _ in range(4))
    top, foot = f"<div id='top-menu'><ul>{links}</ul></div>", f"<div id='page-footer'><p>&copy; {line(3, 6)}</p><ul>{links}</ul></div>"
    if rng.random() < 0.5:
        page = f"<table><tr><td colspan=2>{top}</td></tr><tr><td class='sidebar'><ul>{links}</ul></td><td><div class='post-body'>{inner}</div></td></tr></table><div id='comments'>{comments}</div>{foot}"
    else:
        page = f"<div id='outer'><div>{top}</div><div class='cookie-notice'>{line(5, 9)}</div><div><div class='storyText'>{inner}</div><div class='widget related'><ul>{links}</ul></div></div><div class='comment-list'>{comments}</div></div>{foot}"
    return f"<!doctype html><html><head><title>{line(2, 4)}</title></head><body>{page}</body></html>", "\n".join(article)


def test_html_other_pages():
    rng = random.Random(88)
    v = vocabulary(rng)
    right = found = wanted = 0
    for _ in range(60):
        page, want = other_page(rng, v)
        got = Counter(html.extract(page).split())
        right += (got & Counter(want.split())).total()
        found += got.total()
        wanted += len(want.split())
    assert right / found > 0.9 and right / wanted > 0.9


# 9
def test_substrings(spark):
    rng = random.Random(9)
    v = vocabulary(rng)
    long = [" ".join(rng.choice(v) for _ in range(300)) for _ in range(12)]
    passage = " ".join(rng.choice(v) for _ in range(90))
    texts = ODD + long
    for k in (33, 34, 35, 36, 52, 90):
        w = passage.split()[:k]
        texts += [" ".join(rng.choice(v) for _ in range(rng.randint(0, 40))) + " " + " ".join(w) + "\n" + " ".join(rng.choice(v) for _ in range(20)) for _ in range(2)]
    texts += [long[0], "a " * 100, "b " * 35, "c " * 36]
    for size in (substrings.BATCH_BYTES, 2000):
        substrings.BATCH_BYTES = size
        want = [(i, *r) for i, r in zip([*range(len(texts)), 0, 10_000], substrings.brute([*texts, texts[0], None]), strict=True)]
        got = substrings.remove_repeats(frame(spark, texts)).collect()
        assert by_id((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got) == by_id(want)
    assert substrings.remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        substrings.find_repeats(empty(spark), window=20)


# 10
def test_language(spark):
    rng = random.Random(10)
    syll = {"aa": ["the", "ing", "tion", "an", "er"], "bb": ["ung", "sch", "keit", "ver", "ei"], "cc": ["que", "ment", "eau", "oi", "é"]}
    docs = []
    for i in range(240):
        lang = "aabbcc"[2 * (i % 3) : 2 * (i % 3) + 2]
        docs.append((i, " ".join("".join(rng.choice(syll[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), lang))
    d = spark.createDataFrame([*docs, (500, None, "aa"), (501, "12 34 !", None), (502, "", "bb")], "doc_id long, text string, lang string")
    samples = language.sample(d.where(~language.held_out()).select("lang", "text"))
    got = {r.doc_id: r for r in language.identify(d, samples).collect()}
    held = [x for x in docs if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (500, 501, 502))
    assert language.identify(d, {}).where("lang_pred <> 'und'").count() == 0
    few = language.sample(d.select("lang", "text"), docs=10**9, lexicon=5)
    count = Counter(w for t in {t for _, t, lang in docs if lang == "aa"} for w in t.split())
    assert few["aa"].split() == [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:5]]

    clash = frame(spark, [docs[0][1], docs[1][1], "12", "\u0301", " ".join(docs[0][1] for _ in range(3000))]).union(spark.createDataFrame([(None, docs[0][1], "o", "xx", 1, "c")], DOCS))
    odd = language.identify(clash, samples).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.lang_pred) for r in odd if r.doc_id is not None) == [(False, 0, "aa"), (False, 0, "aa"), (False, 1, "bb"), (False, 2, "und"), (False, 3, "und"), (False, 4, "aa"), (False, 10_000, "und")]
    assert language.identify(empty(spark), samples).count() == 0 and language.sample(pick(empty(spark), "lang", "text")) == {}
    tied = language.Parser({"b": " ab ", "a": " ab "}).predict(pa.array(["ab", None]))
    assert tied[0] == ["a", "und"] and tied[1].tolist() == [0.5, 0.0]

    def brute(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        rate = {k: sum(greedy(t, f" {w} ") for w in words) * np.log2(len(t)) / sum(map(len, words)) for k, t in samples.items()}
        return min(sorted(rate), key=rate.get)

    parser = language.Parser(samples, most=2000)
    some = [t for _, t, _ in docs[:40]]
    assert parser.predict(pa.array(some))[0] == parser.predict(pa.array(some))[0]
    def greedy(t, x):
        n = i = 0
        while i < len(x):
            k = 1
            while i + k <= len(x) and x[i : i + k] in t:
                k += 1
            i, n = i + max(1, k - 1), n + 1
        return n

    for _ in range(500):
        t, x = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert language.SuffixAutomaton(t).phrases(x + "d") == greedy(t, x + "d")
    assert parser.predict(pa.array(some))[0] == [brute(t) for t in some]
