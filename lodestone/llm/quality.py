"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Tokens are the words [^\\x20\\x09-\\x0D]+, their shapes (runs of lower, upper, digits and other marks) and two
events (a word like the one before it, a word seen before in the document), hashed into BUCKETS rows. Each
row has a sparse ternary index vector made from its number; a row's word vector is the sum of its own index
vector and those of its neighbours in all documents, scaled to length 1. A document is the mean of
its tokens' vectors over its whole text. Probabilities are calibrated by a temperature on a part of the
sample that the network has not seen.

The vectors need no labels: each task adds up its documents' neighbours in integers, and the sums are added up
block of rows by block of rows, so they are the same however the table is dealt out. The network is fitted on at
most FIT_ROWS labelled documents, those with the smallest hashes of their ids (a documented bound on rows), with
their whole texts; they are pooled where they lie, and only their pooled vectors come to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import map_whole, pick, read, released, words

FIT_ROWS = 6_000
DIM, NONZERO, BUCKETS, HIDDEN, SEED = 64, 6, 1 << 15, 32, 7
THRESHOLD = 0.3

#: Byte classes of shapes: a lower, A upper, 0 digit, others themselves, bytes from 128 count as lower.
_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers of words, shapes and events of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    h = words(data)[2]
    b = np.frombuffer(data.translate(_SHAPE), np.uint8)
    keep = np.ones(len(b), bool)
    keep[1:] = b[1:] != b[:-1]
    shape = words(b[keep].tobytes())[2]
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    seen = np.ones(len(h), bool)
    seen[np.unique(h, return_index=True)[1]] = False
    top = np.uint64(BUCKETS // 2)
    return (h % top).astype(np.int64), (shape % (top - np.uint64(4)) + top).astype(np.int64), BUCKETS - 4 + again + 2 * seen


@lru_cache(1)
def index_vectors() -> np.ndarray:
    """The ternary index vectors, and one row of zeros."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS + 1, DIM), np.int8)
    at = np.argsort(rng.random((BUCKETS, DIM), np.float32), axis=1)[:, :NONZERO]
    np.put_along_axis(out[:-1], at, rng.choice(np.array([-1, 1], np.int8), (BUCKETS, NONZERO)), axis=1)
    return out


#: Tokens of one step of random indexing, and rows of a block of sums.
_STEP, BLOCK = 1 << 15, 1 << 11


def neighbour_sums(docs: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each row the sum of the index vectors of its neighbours, two words to both sides, words and shapes apart; BUCKETS x DIM integers."""
    index, out = index_vectors(), np.zeros((BUCKETS + 1, DIM), np.int64)
    gap = np.full(2, BUCKETS, np.uint16)  # between documents: the row of zeros
    kept: list[np.ndarray] = []

    def add(row: np.ndarray) -> None:
        """Places 2 to -2 get their neighbours."""
        v = index[row]
        near = v[1:-3] + v[:-4] + v[3:-1] + v[4:]
        own = row[2:-2]
        order = np.argsort(own, kind="stable")
        own = own[order]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[start]] += np.add.reduceat(near[order], start, axis=0, dtype=np.int32)

    def flush() -> None:
        if kept:
            row = np.concatenate([gap, *kept])
            for i in range(2, len(row) - 2, _STEP):
                add(row[i - 2 : i + _STEP + 2])
            kept.clear()

    size = 0
    for parts in docs:
        for row in parts[:2]:
            kept.extend((row.astype(np.uint16), gap))
            size += len(row) + 2
        if size > _STEP:
            flush()
            size = 0
    flush()
    return out[:-1]


def word_vectors(sums: np.ndarray) -> np.ndarray:
    out = index_vectors()[:-1] / np.sqrt(NONZERO) + sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)
    return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def corpus_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors from all texts of docs: a task's sums go out by blocks of rows, are added up block by block, and BUCKETS x DIM numbers come to the driver."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (t for b in batches for i in range(0, b.num_rows, 256) for t in b.column(0).slice(i, 256).to_pylist())
        sums = neighbour_sums(tokens(t) for t in texts)
        blocks = [i for i in range(0, BUCKETS, BLOCK) if sums[i : i + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([zlib.compress(sums[i : i + BLOCK].tobytes(), 1) for i in blocks], pa.binary())], names=["block", "sums"])

    def total(table: pa.Table) -> pa.Table:
        sums = np.zeros(BLOCK * DIM, np.int64)
        for x in table.column("sums"):
            sums += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        return pa.table([table.column("block")[:1], pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())], names=["block", "sums"])

    partial = pick(docs, "text").select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, "block int, sums binary")
    # salted, as all tasks have the same few blocks
    some = partial.withColumn("salt", F.pmod(F.xxhash64("sums"), F.lit(64)).cast("int"))
    some = some.groupBy("block", "salt").applyInArrow(total, "block int, sums binary").groupBy("block").applyInArrow(total, "block int, sums binary")
    out = np.zeros((BUCKETS, DIM), np.int64)
    for r in some.collect():  # BUCKETS x DIM numbers
        out[r.block : r.block + BLOCK] = np.frombuffer(zlib.decompress(r.sums), np.int64).reshape(-1, DIM)
    return word_vectors(out)


def pool(parts: tuple[np.ndarray, np.ndarray, np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Means of words, of shapes, of events; zeros for an empty text."""
    out = np.zeros(3 * DIM, np.float64)
    for i, row in enumerate(parts):
        if len(row):
            total = np.zeros(DIM)
            for k in range(0, len(row), 8192):
                total += vectors[row[k : k + 8192]].sum(axis=0, dtype=np.float64)
            out[i * DIM : (i + 1) * DIM] = total / len(row)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        x = np.array([pool(tokens(t), self.vectors) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, labels: list[int], vectors: np.ndarray, epochs: int = 400) -> Model | None:
    """On pooled documents; None if one class only is there."""
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return None
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    mean, scale = x[~held].mean(0), x[~held].std(0) + 1e-3
    rng = np.random.default_rng(SEED)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    z, t = (x[~held] - mean) / scale, y[~held]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, epochs + 1):
        hid = np.tanh(z @ p[0] + p[1])
        d = (_sigmoid(hid @ p[2] + p[3]) - t) / len(t)
        back = np.outer(d, p[2]) * (1 - hid**2)
        grads = [z.T @ back + 1e-3 * p[0], back.sum(0), hid.T @ d + 1e-3 * p[2], d.sum()]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3]), 1.0)
    if held.any():
        logit, t = model.logits(x[held]), y[held]

        def loss(temp: float) -> float:
            q = np.clip(_sigmoid(logit / temp), 1e-9, 1 - 1e-9)
            return -float(np.mean(t * np.log(q) + (1 - t) * np.log(1 - q)))

        model.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Fits on at most `rows` labelled rows outside the held-out fold. docs: doc_id, text; labels: doc_id, quality (0 or 1; others are left out).

    Of several labels of one id the smallest counts, of several texts the one that hashes lowest; a null text is
    empty. None, a model that gives 0.5, if no row or one class only is labelled.
    """
    spark = docs.sparkSession
    known = pick(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows)
    chosen = chosen.select("doc_id", "quality", "h").collect()  # at most `rows` small rows
    if len({r.quality for r in chosen}) < 2:
        return None
    vectors = corpus_vectors(docs)
    sent = spark.sparkContext.broadcast(vectors)  # BUCKETS x DIM floats
    small = spark.createDataFrame([(r.doc_id, r.quality, r.h) for r in chosen], "doc_id long, quality int, h long")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                texts = c.column(3).to_pylist()
                pooled = [pool(tokens(t), sent.value).tobytes() for t in texts]
                keys = [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([*c.columns[:3], pa.array(keys, pa.int64()), pa.array(pooled, pa.binary())], names=["doc_id", "quality", "h", "key", "x"])

    found = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(small), "doc_id").select("doc_id", "quality", "h", "text")
    found = found.mapInArrow(run, "doc_id long, quality int, h long, key long, x binary").groupBy("doc_id", "quality", "h").agg(F.min(F.struct("key", "x")).alias("x")).collect()  # 3 DIM numbers a row
    found.sort(key=lambda r: (r.h, r.doc_id))
    return fit(np.array([np.frombuffer(r.x.x, np.float64) for r in found]).reshape(-1, 3 * DIM), [int(r.quality) for r in found], vectors)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs and `quality_score`, from the column text alone. Null and empty texts get the score of a text without tokens; without a model all get 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS x DIM floats
    at = docs.columns.index("text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                texts = c.column(at).to_pylist()
                s = m.score(texts) if m else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(s, pa.float64())], names=[*c.schema.names, "score"])

    return map_whole(docs, run, "quality_score double")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns kept, that score at least the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                texts = c.column(at).to_pylist()
                yield c.filter(pa.array((m.score(texts) if m else np.full(len(texts), 0.5)) >= threshold, pa.bool_()))

    return map_whole(docs, run)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; a null id is not held out, an empty text has the score of a text without tokens."""
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    s = F.col("quality_score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"))
