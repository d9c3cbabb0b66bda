"""op4: images of short texts share their work, with the results of images that are made and read one by one."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pytest

from lodestone.llm import jpeg

SIZES = [*(1, 2, 5, 11, 12, 13, 24, 25, 36, 49) * 6, 700, 48_000, 48_001]


def payloads(seed, sizes):
    rng = np.random.default_rng(seed)
    some = [rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in sizes]
    return [*some, b"\xff" * 64 * 7, b"\x00" * 64 * 7, b"\x80\x7f" * 32 * 13]


def test_equal_sizes_share_scans(monkeypatch):
    """Before, 200 images took 2,800 scans."""
    calls = []
    scan = jpeg._scan
    monkeypatch.setattr(jpeg, "_scan", lambda *a: (calls.append(1), scan(*a))[1])
    many = payloads(1, [30] * 200)[:200]
    assert [p for p, _ in jpeg.restore_all(jpeg.store_all(many))] == many
    assert len(calls) == 14


def test_together_as_alone():
    many = payloads(2, SIZES)
    order = np.random.default_rng(3).permutation(len(many)).tolist()
    many = [many[i] for i in order]
    stored = jpeg.store_all(many)
    assert stored == [jpeg.store(p) for p in many]
    for p, (back, images), m in zip(many, jpeg.restore_all(stored), stored, strict=True):
        alone = jpeg.restore(m)[1]
        assert back == p and len(images) == len(alone) and all((a == b).all() for a, b in zip(images, alone, strict=True))
        assert jpeg.feature(images) == jpeg.feature(alone)


def test_bounded_groups(monkeypatch):
    many = payloads(4, [30] * 50)
    want = [(p, [t.tolist() for t in ts]) for p, ts in jpeg.restore_all(jpeg.store_all(many))]
    monkeypatch.setattr(jpeg, "TOGETHER", 5000)
    sizes = []
    whole = jpeg.decode_all
    monkeypatch.setattr(jpeg, "decode_all", lambda s, raws: (sizes.append(len(raws)), whole(s, raws))[1])
    assert [(p, [t.tolist() for t in ts]) for p, ts in jpeg.restore_all(jpeg.store_all(many))] == want
    assert max(sizes) <= 2 and sum(sizes) == len(many)


def test_whole_arrays_as_bit_by_bit(monkeypatch):
    """The readers of whole scans against the general one, a bit at a time."""
    stored = jpeg.store_all(payloads(5, [1, 13, 13, 40]))
    fast = jpeg.restore_all(stored)
    monkeypatch.setattr(jpeg, "_even_scan", lambda *a: False)
    monkeypatch.setattr(jpeg, "_dc_first", lambda *a: False)
    for (p, images), (q, others) in zip(fast, jpeg.restore_all(stored), strict=True):
        assert p == q and all((a == b).all() for a, b in zip(images, others, strict=True))


def test_colours_of_two_ways():
    """Samples and colours against sums of whole numbers, also of coefficients too large for float32, and with chroma of two sizes."""
    rng = np.random.default_rng(6)
    assert 255 <= jpeg._EXACT32 < 2000
    for most in (255, jpeg._EXACT32, 30_000):
        blocks = rng.integers(-most, most + 1, (3, 2, 2, 64)).astype(np.int32)
        blocks[0, 0, 0] = np.where(jpeg._IDCT[:, 9] < 0, -most, most)
        exact = blocks.reshape(-1, 64).astype(np.int64) @ jpeg._IDCT.astype(np.int64)
        want = np.clip((exact + 526_336) >> 12, 0, 255).reshape(3, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(3, 16, 16)
        assert (jpeg.samples(blocks, np.ones(64, np.int64)) == want).all()
    for sampling in ([(2, 2), (1, 1), (1, 1)], [(2, 2), (2, 1), (1, 2)], [(1, 1), (1, 1), (1, 1)]):
        comps = [rng.integers(-255, 256, (2, v, h, 64)).astype(np.int32) for h, v in sampling]
        hmax, vmax = sampling[0]
        height, width = 8 * vmax - 3, 8 * hmax - 5
        got = jpeg.to_rgb(width, height, comps, sampling, [np.ones(64, np.int64)] * 3)
        y, cb, cr = (np.repeat(np.repeat(jpeg.samples(c, np.ones(64, np.int64)).astype(np.int64), vmax // v, 1), hmax // h, 2)[:, :height, :width] for c, (h, v) in zip(comps, sampling, strict=True))
        want = [y + ((x + 32768) >> 16) for x in (91881 * (cr - 128), -22554 * (cb - 128) - 46802 * (cr - 128), 116130 * (cb - 128))]
        assert (got == np.clip(np.stack(want, -1), 0, 255)).all()


def test_broken_scans_are_errors():
    media = jpeg.store(payloads(7, [40])[0])
    starts = [i for i in range(len(media) - 1) if media[i : i + 2] == b"\xff\xda"]
    assert len(starts) == 14
    for k, at in enumerate(starts):
        data = at + 2 + struct.unpack_from(">H", media, at + 2)[0]
        end = starts[k + 1] if k + 1 < len(starts) else len(media) - 2
        with pytest.raises(ValueError):
            jpeg.decode(media[:data] + media[end:])


def test_rows_keep_their_own(spark):
    """Texts of mixed lengths, copies and empty ones among them, through the query's two steps."""
    texts = ["wort " * (i % 37) + "é" * (i % 5) for i in range(700)] + [None, "x" * 3_200_000, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in jpeg.describe(jpeg.to_media(docs)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        (p, n), r = jpeg.payload(t), got[i]
        media = jpeg.store(p)
        images = jpeg.restore(media)[1]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.media_bytes, r.media_sha256) == (n, len(p), hashlib.sha256(p).hexdigest(), len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == jpeg.feature(images) and [(x.height, x.width, bytes(x.rgb)) for x in r.images] == [(*x.shape[:2], x.tobytes()) for x in images]
