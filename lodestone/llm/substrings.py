"""Removal of repeated word windows by fixed-block anchors.

Each text's words are cut into non-overlapping blocks of BLOCK words; these are the index. Every rolling
window of BLOCK words of every text probes it. A repeated window of WINDOW >= 2 BLOCK - 1 words holds a whole
block of either of its occurrences, so its other occurrence has a hit there. Around the hits the exact
repeats are then built up from WINDOW-word fingerprints of 96 bits (two hashes of its words in order): a window is a
repeat if its fingerprint starts at two places or more, and overlapping repeats merge to maximal ones.

Index and probes meet in buckets of their hash, as packed arrays: within one batch of documents a
hash is sent once however often it occurs, so a passage that a third of all documents share puts one
entry a batch into its bucket. Hits go back to the batch, from there to its documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents, mix, read, released, windows, words

WINDOW, BLOCK = 35, 18
#: Bytes of text that are worked off together.
BATCH_BYTES = 8 << 20


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[tuple]]:
    """Rows in lists of about BATCH_BYTES of text."""
    rows, size = [], 0
    for b in batches:
        for i in range(0, b.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in b.slice(i, 256).columns), strict=True):
                rows.append(row)
                size += len(row[text])
                if size >= BATCH_BYTES:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


#: Added to words' hashes for the second hash of a window.
_SECOND = np.uint64(0x5851F42D4C957F2D)

_SENT = "bucket int, batch long, kind int, body binary"
_BACK = "batch long, kind int, body binary"
_FOUND = "k1 long, k2 long, starts binary"


def _batch(table: pa.Table | pa.RecordBatch, names: list[str]) -> list:
    return [table.column(n).to_pylist() for n in names]


def _send(rows: list[tuple], buckets: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """rows: (k1, k2, hashes, starts, is_block, second hashes if wide) of each document. Yields packed entries by bucket, and the batch's own table."""
    lens = [len(r[2]) for r in rows]
    total = sum(lens)
    batch = int(np.frombuffer(hashlib.blake2b(repr([(r[0], r[1], n) for r, n in zip(rows, lens, strict=True)]).encode(), digest_size=8).digest(), np.int64)[0])
    if not total:
        return
    h = np.concatenate([r[2] for r in rows])
    block = np.concatenate([r[4] for r in rows])
    second = np.concatenate([r[5] for r in rows]) if wide else None
    order = np.lexsort((second, h)) if wide else np.argsort(h, kind="stable")
    sorted_h = h[order]
    new = np.ones(total, bool)
    new[1:] = sorted_h[1:] != sorted_h[:-1]
    if wide:
        new[1:] |= second[order[1:]] != second[order[:-1]]
    first = np.flatnonzero(new)
    lead = order[first]
    count = np.diff(np.append(first, total))
    flags = np.bitwise_or.reduceat(block[order].astype(np.uint8), first) | ((count > 1).astype(np.uint8) << 1)
    owner = np.repeat(lead, count)
    again = ~new
    table = np.array([[r[0], r[1], n] for r, n in zip(rows, lens, strict=True)], np.int64)
    starts = b"" if not wide else zlib.compress(np.diff(np.concatenate([r[3] for r in rows]).astype(np.int32), prepend=np.int32(0)).tobytes(), 1)
    pairs = zlib.compress(np.concatenate([owner[again], order[again]]).astype(np.uint32).tobytes(), 1)
    body = np.array([len(rows), len(starts), len(pairs)], np.int64).tobytes() + table.tobytes() + starts + pairs
    bucket = (sorted_h[first] >> np.uint64(33)) % np.uint64(buckets)
    at = np.lexsort((lead, bucket))
    edges = np.flatnonzero(np.diff(bucket[at].astype(np.int64), prepend=-1))
    out: list[tuple[int, int, bytes]] = [(batch % buckets, 1, body)]
    kept = sorted_h[first] if wide else (sorted_h[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for a, z in zip(edges, np.append(edges[1:], len(at)), strict=True):
        i = at[a:z]
        step = np.diff(lead[i], prepend=0)  # places rise, so their steps are short
        step = step.astype(np.uint16 if step.max() < 65536 else np.uint32)
        out.append((int(bucket[at[a]]), 0, np.array([len(i), step.itemsize], np.int64).tobytes() + kept[i].tobytes() + (second[lead[i]].tobytes() if wide else b"") + step.tobytes() + np.packbits(flags[i] & 1).tobytes() + np.packbits(flags[i] >> 1).tobytes()))
    for i in range(0, len(out), 512):
        o = out[i : i + 512]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in o], pa.int32()), pa.array([batch] * len(o), pa.int64()), pa.array([x[1] for x in o], pa.int32()), pa.array([x[2] for x in o], pa.binary())], names=["bucket", "batch", "kind", "body"])


def _meet(wide: bool):
    """Of one bucket: the entries whose hash occurs twice or more, with a block among them, back to their batches; tables pass."""
    kind_of = np.uint64 if wide else np.uint32

    def run(table: pa.Table) -> pa.Table:
        batch, kind, body = _batch(table, ["batch", "kind", "body"])
        out, hs, seconds, leads, blocks, multi, who = [], [], [], [], [], [], []
        for b, k, x in zip(batch, kind, body, strict=True):
            if k:
                out.append((b, 1, x))
                continue
            n, wide_step = np.frombuffer(x, np.int64, 2).tolist()
            at = 16
            hs.append(np.frombuffer(x, kind_of, n, at))
            at += n * np.dtype(kind_of).itemsize
            if wide:
                seconds.append(np.frombuffer(x, np.uint32, n, at))
                at += 4 * n
            leads.append(np.cumsum(np.frombuffer(x, np.uint16 if wide_step == 2 else np.uint32, n, at), dtype=np.uint32))
            at += wide_step * n
            bits = -(-n // 8)
            blocks.append(np.unpackbits(np.frombuffer(x, np.uint8, bits, at))[:n])
            multi.append(np.unpackbits(np.frombuffer(x, np.uint8, bits, at + bits))[:n])
            who.append(b)
        if hs:
            h, src = np.concatenate(hs), np.repeat(np.arange(len(hs)), [len(x) for x in hs])
            second = np.concatenate(seconds) if wide else None
            order = np.lexsort((second, h)) if wide else np.argsort(h, kind="stable")
            s = h[order]
            other = s[1:] != s[:-1]
            if wide:
                other |= second[order[1:]] != second[order[:-1]]
            first = np.flatnonzero(np.concatenate([[True], other]))
            count = np.add.reduceat(1 + np.concatenate(multi)[order].astype(np.int64), first)
            block = np.bitwise_or.reduceat(np.concatenate(blocks)[order], first)
            hit = order[np.repeat((count > 1) & (block > 0), np.diff(np.append(first, len(s))))]
            lead = np.concatenate(leads)[hit]
            by = np.argsort(src[hit], kind="stable")
            for i, part in zip(*_groups(src[hit][by], lead[by]), strict=True):
                out.append((who[i], 0, zlib.compress(part.tobytes(), 1)))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["batch", "kind", "body"])

    return run


def _groups(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(keys):
        return [], []
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at].tolist(), np.split(values, at[1:])


def _home(table: pa.Table) -> pa.Table:
    """Of one batch: its table and its hits, as starts of hits for each document that has some."""
    kind, body = _batch(table, ["kind", "body"])
    hits = [np.frombuffer(zlib.decompress(x), np.uint32) for k, x in zip(kind, body, strict=True) if not k]
    rows: list[tuple] = []
    if hits and not any(kind):
        raise ValueError("hits of a batch without its table: a lost part was not made again as it was")
    tables = list(dict.fromkeys(x for k, x in zip(kind, body, strict=True) if k))  # a batch of equal rows may occur twice, with equal tables
    for x in tables if hits else []:
        n, packed, pairs = np.frombuffer(x, np.int64, 3).tolist()
        t = np.frombuffer(x, np.int64, 3 * n, 24).reshape(-1, 3)
        total, at = int(t[:, 2].sum()), 24 + 24 * n
        # without starts of their own, entries are all windows of a document in turn
        starts = np.cumsum(np.frombuffer(zlib.decompress(x[at : at + packed]), np.int32), dtype=np.int32).astype(np.uint32) if packed else None
        owner, other = np.frombuffer(zlib.decompress(x[at + packed : at + packed + pairs]), np.uint32).reshape(2, -1)
        mark = np.zeros(total, bool)
        mark[np.concatenate(hits)] = True
        mark[other[mark[owner]]] = True
        ends = np.cumsum(t[:, 2])
        for (k1, k2, m), e in zip(t.tolist(), ends.tolist(), strict=True):
            mine = np.flatnonzero(mark[e - m : e])
            if (got := (starts[e - m : e][mine] if starts is not None else mine.astype(np.uint32))).size:
                rows.append((k1, k2, got.tobytes()))
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["k1", "k2", "starts"])


def _repeats(entries: DataFrame, wide: bool) -> DataFrame:
    """entries (_SENT) to k1, k2, starts: the starts of each document whose hash also is elsewhere."""
    back = entries.groupBy("bucket").applyInArrow(_meet(wide), _BACK)
    return back.groupBy("batch").applyInArrow(_home, _FOUND).groupBy("k1", "k2").agg(F.first("starts").alias("starts"))


def _anchors(buckets: int, block: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches, 2):
            found = []
            for k1, k2, text in rows:
                h = windows(words(text.encode("utf-8", "surrogatepass"))[2], block)
                at = np.arange(len(h))
                found.append((k1, k2, h, at, at % block == 0))
            yield from _send(found, buckets, False)

    return run


def _extend(buckets: int, window: int, block: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches, 2):
            found = []
            for k1, k2, text, starts, _ in rows:
                by_word = words(text.encode("utf-8", "surrogatepass"))[2]
                h = windows(by_word, window)
                # candidate windows: those that hold a hit block
                step = np.zeros(len(h) + window + 1, np.int64)
                p = np.frombuffer(starts, np.uint32).astype(np.int64)
                np.add.at(step, np.maximum(p - (window - block), 0), 1)
                np.add.at(step, np.minimum(p + 1, len(step) - 1), -1)
                at = np.flatnonzero(np.cumsum(step)[: len(h)])
                second = (windows(mix(by_word + _SECOND), window)[at] >> np.uint64(32)).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
                found.append((k1, k2, h[at], at, np.ones(len(at), bool), second))
            yield from _send(found, buckets, True)

    return run


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + window, n), -1)
    return np.cumsum(step)[:n] > 0


def kept_text(text: str, starts: bytes | None, window: int) -> tuple[int, int, bytes]:
    data = text.encode("utf-8", "surrogatepass")
    if not starts:
        w = data.split()
        return len(w), 0, b" ".join(w)
    a, z, _ = words(data)
    gone = covered(len(a), np.frombuffer(starts, np.uint32).astype(np.int64), window)
    return len(a), int(gone.sum()), b" ".join([data[s:e] for s, e in zip(a[~gone].tolist(), z[~gone].tolist(), strict=True)])


def find_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, text and starts (packed uint32 word numbers of the repeated windows, null if none) of each row.

    A window is repeated if its word sequence starts at another place too, in the same or another row; a
    row that occurs twice repeats itself. Null and empty texts and texts of fewer than `window` words have
    none. Rows keep their (null or equal) ids.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    spark = docs.sparkSession
    d = documents(docs).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k1"), F.xxhash64("text", F.lit(9)).alias("k2"), "text", "doc_id")
    buckets = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), d.rdd.getNumPartitions())
    keyed = d.select("k1", "k2", "text")
    hits = _repeats(keyed.mapInArrow(_anchors(buckets, block), _SENT), False)
    # with doc_id, so that this join and the last one share one exchange of the texts
    held = d.join(hits, ["k1", "k2"]).select("k1", "k2", "text", "starts", "doc_id")
    held = held.sortWithinPartitions("k1", "k2")  # free after a merge join: the same batches come out if a part is made again
    found = _repeats(held.mapInArrow(_extend(buckets, window, block), _SENT), True)
    return d.join(found, ["k1", "k2"], "left").select("doc_id", "text", "starts")


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: the words outside repeated windows, joined by one space."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                rows = [kept_text(t, s, window) for t, s in zip(c.column(1).to_pylist(), c.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    found = find_repeats(docs, window, block).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document; rows keep null and equal ids, and equal rows repeat each other."""
    d = remove_repeats(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """The contract by counting word tuples, for tests."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out
