"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows, read word by word."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents, kept, map_whole, pick, read, released

#: Lower case for A-Z, a space for what [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ leaves out (after lowering); other bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of benchmark text in one automaton (about 350,000 windows, some 200 MB in a worker). A larger benchmark is scanned in several blocks of this size.
BLOCK_BYTES = 8 << 20


def normalise(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def _letter(n: int) -> str:
    """The n-th character, surrogates left out. A block of BLOCK_BYTES has at most a million words, fewer than there are."""
    return chr(n if n < 0xD800 else n + 0x800)


class Finder:
    """One automaton over benchmark windows in which each word is one letter; a word of no window is the letter 0, which no window holds."""

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int) -> None:
        self.letters: dict[bytes, str] = {}
        self.ids: list[str] = []
        keys: dict[str, list[int]] = {}
        for item_id, text in items:
            w = "".join([self.letters.get(x) or self.letters.setdefault(x, _letter(len(self.letters) + 1)) for x in normalise(text)])
            own = len(self.ids)
            self.ids.append(str(item_id))
            for i in range(max(1, len(w) - window + 1) if w else 0):
                found = keys.setdefault(w[i : i + window], [])
                if not found or found[-1] != own:
                    found.append(own)
        self.automaton = ahocorasick.Automaton()
        for k, own in keys.items():
            self.automaton.add_word(k, (len(k), own))
        self.empty = not keys
        if keys:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Words of the text, the merged hit word ranges [start, end), and the items found."""
        w = normalise(text)
        if not w or self.empty:
            return len(w), [], []
        found = list(self.automaton.iter("".join(map(self.letters.get, w, repeat("\0")))))
        if not found:
            return len(w), [], []
        ranges: list[tuple[int, int]] = []
        for s, e in sorted((e + 1 - n, e + 1) for e, (n, _) in found):
            if ranges and s <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(e, ranges[-1][1]))
            else:
                ranges.append((s, e))
        return len(w), ranges, sorted({self.ids[i] for _, (_, own) in found for i in own})


def finder_of(key: str, sent: Broadcast, window: int) -> Finder:
    """The finder of a broadcast block, kept by the worker between tasks under the block's key."""
    return kept(("finder", key), lambda: Finder(sent.value, window))


def offsets(text: str | None, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hit word ranges as code-point offsets of the original text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(data.translate(FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8)))
    point = np.cumsum((np.frombuffer(data + b" ", np.uint8) & 0xC0) != 0x80) - 1
    return [(int(point[edge[2 * s]]), int(point[edge[2 * e - 1]])) for s, e in ranges]


SCHEMA = "doc_id long, n_words long, ranges array<struct<s:long,e:long>>, items array<string>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("ranges", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _hits(docs: DataFrame, block: list[tuple[object, str | None]], window: int) -> DataFrame:
    """SCHEMA and text_key, a hash of the text, of each row."""
    sent, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex  # at most BLOCK_BYTES

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = finder_of(key, sent, window)
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            texts = b.column(1).to_pylist()
            rows = [finder.scan(t) for t in texts]
            keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([[{"s": s, "e": e} for s, e in r[1]] for r in rows], _ARROW.field("ranges").type), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array(keys, pa.binary())], schema=_ARROW.append(pa.field("text_key", pa.binary())))

    return docs.mapInArrow(run, f"{SCHEMA}, text_key binary")


def pieces(text: str | None, window: int, limit: int) -> Iterator[str | None]:
    """The text, or if it has more than `limit` bytes at four a character, pieces of its words with all its windows among them: each goes on `window` - 1 words before the last one's end."""
    if len(text or "") * 4 <= limit:
        yield text
        return
    held, size, fresh = [], 0, 0
    for w in normalise(text):
        if fresh and len(held) >= window and (size + len(w)) * 4 > limit:
            yield b" ".join(held).decode("utf-8", "surrogatepass")
            held = held[len(held) - window + 1 :]
            size, fresh = sum(map(len, held)) + len(held), 0
        held.append(w)
        size, fresh = size + len(w) + 1, fresh + 1
    yield b" ".join(held).decode("utf-8", "surrogatepass")


def blocks(benchmark: DataFrame, window: int, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark in blocks of at most `limit` bytes of text (and a few words), one in memory at a time. A larger item goes into several blocks, under its own id in each."""
    block, size = [], 0
    for r in benchmark.toLocalIterator():
        for text in pieces(r[1], window, limit):
            n = len(text or "") * 4
            if block and size + n > limit:
                yield block
                block, size = [], 0
            block.append((r[0], text))
            size += n
    yield block


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, ranges (merged hit word ranges), items (ids found) for each document.

    The benchmark is the query set: it goes out in blocks of bounded size, each one automaton, and
    each document is read once a block. A null or empty text has no words and no hits; an empty
    benchmark hits nothing. Each row stays a row, however many blocks there are: results of blocks are merged by
    id and text, and rows that are equal in both, which have equal hits, are given out as often as they came. Null
    item ids are named 'None'.
    """
    d, b = documents(docs), pick(benchmark, "item_id", "text")
    parts = [_hits(d, block, window) for block in blocks(b, window, block_bytes)]
    if len(parts) == 1:
        return parts[0].drop("text_key")
    merged = None
    for p in parts:
        # equal rows are one from here on, with their number
        p = p.groupBy("doc_id", "n_words", "text_key").agg(F.first("ranges").alias("ranges"), F.first("items").alias("items"), F.count("*").alias("copies"))
        merged = p if merged is None else merged.unionByName(p)
    spans = F.array_sort(F.flatten(F.collect_list("ranges")))
    fold = F.aggregate(
        spans,
        F.lit(None).cast("array<struct<s:long,e:long>>"),
        lambda acc, x: F.when(acc.isNull(), F.array(x))
        .when(x["s"] <= F.element_at(acc, -1)["e"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(x["e"], F.element_at(acc, -1)["e"]).alias("e")))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    one = merged.groupBy("doc_id", "n_words", "text_key").agg(
        F.coalesce(fold, F.array().cast("array<struct<s:long,e:long>>")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.first("copies").alias("copies")
    )
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "n_words", "ranges", "items")


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs, all columns kept, without those that hold a benchmark window."""
    d, at = docs, docs.columns.index("text")
    for block in blocks(pick(benchmark, "item_id", "text"), window):
        sent, key = d.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        @released
        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            finder = finder_of(key, sent, window)
            for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
                yield b.filter(pa.array([not finder.scan(t)[1] for t in b.column(at).to_pylist()], pa.bool_()))

        d = map_whole(d, run)
    return d


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest() of all documents against the whole benchmark; rows keep null and equal ids."""
    return digest(find_benchmark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def brute(texts: list[str | None], items: list[tuple[object, str | None]], window: int = 10) -> list[tuple]:
    """The contract by nested loops, for tests."""
    out = []
    for t in texts:
        w, hit, got = normalise(t), set(), set()
        for i, it in items:
            q = normalise(it)
            for k in range(max(1, len(q) - window + 1) if q else 0):
                p = q[k : k + window]
                for s in range(len(w) - len(p) + 1):
                    if w[s : s + len(p)] == p:
                        hit |= set(range(s, s + len(p)))
                        got.add(str(i))
        out.append((len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out
