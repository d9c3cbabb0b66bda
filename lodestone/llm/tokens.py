"""Byte-level BPE ids into a content-addressed store, and back.

Encoding is by the tokenizers library. A text falls apart at single spaces before non-space, where the
byte-level pre-tokeniser always starts a new token, so ids of equal pieces are remembered by the worker
(in bounded memory) and only new pieces go to the library: ordinary ones, many at a time, straight to its BPE model
(where the vocabulary allows it, see ``Encoder``), the rest through the whole tokenizer.

Store (folder): ``objects/kind=chunk`` (key, the chunk's hash, n, data: each different chunk once), ``recipes`` (a
row for each document in ascending doc_id order: its chunk hashes and Merkle root; part and pos number the files
and their rows) and ``manifest`` (documents, tokens and the Merkle root of each recipe file, over document
roots in blocks of FAN). A reader holds each chunk against its hash, each document against its root, and all roots of a
file against the manifest.

A document's chunks go by hash to the task that stores them, but its recipe goes its own way, so a chunk that a
third of all documents share is one row a task (SEEN hashes are remembered by one), without a list of who refers to it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import documents, mix, read, released, shared_dir, windows
from lodestone.llm.wordcodes import WordCodes, parts

END_ID = 0
MIN_IDS, MASK, MAX_IDS, ROLL = 64, 511, 4096, 16
#: Hashes that a task remembers to have sent, and roots of one block of a manifest.
SEEN, FAN = 1 << 18, 4096

#: A space before white space of any kind, where a text must not be cut: RE2's dialect, and Python's.
_RISK_RE2 = " [\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_WHITE = re.compile(r"\s")
#: Pieces whose pre-tokens are their runs of letters, digits, marks and single line ends.
_ORDINARY = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]|(?<=[^\n])\n(?=[^\n]))+")
_GROUP = 64


def _byte_names() -> list[str]:
    """The character that byte-level vocabularies use for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


def _kind(byte: int) -> str:
    return "L" if 65 <= byte <= 90 or 97 <= byte <= 122 or byte >= 128 else "N" if 48 <= byte <= 57 else "S" if byte in (10, 32) else "P"


class Encoder:
    """Ids of texts, equal to the library's on the whole text.

    An ordinary piece may go to the model without the pre-tokeniser, and many of them at once, if no merge of the model
    that could apply inside them joins characters of two pre-tokens: that is looked up in the model's own merges when
    the encoder is made, and where one does, all pieces take the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 24 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.words = WordCodes(self.learn, most)
        spec = json.loads(self.t.to_str())
        self.names = _byte_names()
        self.table = {b: c for b, c in enumerate(self.names)}
        self.apart = self._apart(spec)
        if self.apart:
            vocabulary = self.t.get_vocab(with_added_tokens=False)
            self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
            self.starts[[i for s, i in vocabulary.items() if s[0] == self.names[32]]] = True

    def _apart(self, spec: dict) -> bool:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "unk_token")):
            return False
        byte = {c: b for b, c in enumerate(self.names)}
        ours = {10, 32, 0xC3, *range(33, 127), *range(0x80, 0xC0)} - {39}
        for m in model["merges"]:
            a, b = ([byte[c] for c in x] for x in (m if isinstance(m, list) else m.split(" ")))
            if a != [32] and ours.issuperset(a + b) and (b[0] == 32 or _kind(a[-1]) != _kind(b[0])):
                return False
        return True

    def plain(self, text: str) -> bytes:
        return array("I", self.t.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces; a key with a space in front is the start of a text, any other has a space before it there."""
        ordinary = np.fromiter(map(bool, map(_ORDINARY.fullmatch, keys)), bool, len(keys)) & self.apart
        fast = list(compress(keys, ordinary.tolist()))
        slow = [k[1:] if k[:1] == " " else " " + k for k in compress(keys, (~ordinary).tolist())]
        counts, ids = np.zeros(len(keys), np.int64), array("i")
        if fast:
            tokenize, number = self.t.model.tokenize, attrgetter("id")
            for i in range(0, len(fast), _GROUP):
                joined = " " + " ".join(fast[i : i + _GROUP])
                ids.extend(map(number, tokenize(joined.encode().decode("latin-1").translate(self.table))))
            begin = np.flatnonzero(self.starts[np.frombuffer(ids, np.int32)])
            counts[ordinary] = np.diff(begin, append=len(ids))
        if not slow:
            return np.frombuffer(ids, np.int32), counts
        found = [e.ids for e in self.t.encode_batch_fast(slow, add_special_tokens=False)]
        counts[~ordinary] = list(map(len, found))
        whole = np.zeros(counts.sum(), np.int32)
        of_fast = np.repeat(ordinary, counts)
        whole[of_fast] = np.frombuffer(ids, np.int32)
        whole[~of_fast] = [i for x in found for i in x]
        return whole, counts

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (int32) of all texts in turn, and how many each has. No text may be null."""
        odd = pc.match_substring_regex(texts, _RISK_RE2)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        if not pc.any(odd).as_py():
            return self._simple(texts)
        odd = odd.to_numpy(zero_copy_only=False)
        ids, counts = self._simple(texts.filter(pa.array(~odd)))
        ends, total = np.cumsum(counts), np.zeros(len(texts), np.int64)
        own = iter(np.split(ids, ends[:-1]) if len(ends) else [])
        out = []
        for i, (t, is_odd) in enumerate(zip(texts.to_pylist(), odd.tolist(), strict=True)):
            if not is_odd:
                out.append(next(own))
            elif any(s in t for s in self.special):
                out.append(np.frombuffer(self.plain(t), np.int32))
            else:
                out.append(self.words.of(pa.array(_pieces(t), texts.type))[0])
            total[i] = len(out[-1])
        return np.concatenate(out), total

    def _simple(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        cut = pc.split_pattern(texts, " ")
        ends = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        words, first = cut.flatten(), np.zeros(ends[-1], bool)
        first[ends[:-1]] = True
        words = pc.replace_with_mask(words, pa.array(first), pc.binary_join_element_wise("", words.filter(pa.array(first)), " "))
        ids, counts = self.words.of(words)
        return ids, np.add.reduceat(counts, ends[:-1])

    def encode(self, text: str) -> bytes:
        return self.encode_array(pa.array([text], pa.string()))[0].tobytes()


def _pieces(text: str) -> list[str]:
    """The keys of a text with white space after a space, which stays with the piece before."""
    first, *more = text.split(" ")
    out: list[str] = [" " + first]
    for p in more:
        if p and not _WHITE.match(p):
            out.append(p)
        else:
            out[-1] += " " + p
    return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(ids: np.ndarray, ends: np.ndarray) -> Iterator[list[int]]:
    """Ends of the chunks of each stream, for streams one after the other that end at `ends`.

    A chunk ends where a rolling hash of ROLL ids of its stream says so, MIN_IDS to MAX_IDS after the one before; the
    last one ends with the stream. A stream's cuts depend on its ids alone.
    """
    found = np.concatenate([np.zeros(0, np.int64), *(np.flatnonzero((windows(mix(ids[i : i + _ROLLED + ROLL - 1].astype(np.uint64)), ROLL) & np.uint64(MASK)) == 0) + (i + ROLL) for i in range(0, len(ids), _ROLLED))])
    begin = np.concatenate([[0], ends[:-1]])
    lo, hi = np.searchsorted(found, begin + ROLL), np.searchsorted(found, ends)  # a cut at the very end is the end's own
    found = found.tolist()
    for start, end, a, z in zip(begin.tolist(), ends.tolist(), lo.tolist(), hi.tolist(), strict=True):
        out, last = [], start
        for e in found[a:z]:
            while e - last > MAX_IDS:
                last += MAX_IDS
                out.append(last)
            if e - last >= MIN_IDS:
                out.append(last := e)
        while end - last > MAX_IDS:
            last += MAX_IDS
            out.append(last)
        out.append(end)
        yield out


#: Places that are hashed at once.
_ROLLED = 1 << 16


def chunk_hash(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _narrow(ids: np.ndarray) -> bytes:
    """A width byte and the ids, 16 bits each if they fit."""
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def _wide(data: bytes) -> bytes:
    return np.frombuffer(data, "<u2", offset=1).astype("<u4").tobytes() if data[0] == 2 else data[1:]


def _root(parts: list[bytes]) -> bytes:
    """Merkle root: pairs are hashed until one is left; an odd one moves up."""
    level = [hashlib.blake2b(b"\x00" + p, digest_size=16).digest() for p in parts] or [b"\x00" * 16]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\x01" + b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


CHUNK, RECIPE = "chunk", "recipe"
_OBJECT = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("n", pa.int64()), ("data", pa.binary()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("hashes", pa.list_(pa.binary()))])
_OBJECT_SQL = "kind string, key binary, n long, data binary, doc_id long, rid long, hashes array<binary>"


def _objects(path: str, end_id: int):
    """Rows of new chunks, and a recipe for each document."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, z, sent = encoder(path), zstandard.ZstdCompressor(1), set()
        for b in batches:
            for first, texts in parts(b.column(2)):
                ids, counts = enc.encode_array(texts)
                ends = np.cumsum(counts)
                stream = np.insert(ids, ends, end_id).astype("<u4")
                ends += np.arange(1, len(ends) + 1)
                raw, start = memoryview(stream.tobytes()), 0
                keys, sizes, data, recipes = [], [], [], []
                for stops in cuts(stream, ends):
                    mine = []
                    for stop in stops:
                        h = chunk_hash(raw[4 * start : 4 * stop])
                        mine.append(h)
                        if h not in sent:
                            if len(sent) >= SEEN:
                                sent.clear()
                            sent.add(h)
                            keys.append(h)
                            sizes.append(stop - start)
                            data.append(z.compress(_narrow(stream[start:stop])))
                        start = stop
                    recipes.append(mine)
                n, m = len(keys), len(recipes)
                doc_id, rid = b.column(0).slice(first, m), b.column(1).slice(first, m)
                own = [b"r" + x.to_bytes(8, "little") for x in rid.to_pylist()]
                none = lambda kind: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([CHUNK] * n + [RECIPE] * m), pa.array(keys + own, pa.binary()), pa.array(np.concatenate([np.array(sizes, np.int64), counts + 1])), pa.array(data + [None] * m, pa.binary()),
                        pa.concat_arrays([none(pa.int64()), doc_id]), pa.concat_arrays([none(pa.int64()), rid]), pa.array([None] * n + recipes, pa.list_(pa.binary())),
                    ],
                    schema=_OBJECT,
                )

    return run


_RECIPE_SQL = "part int, pos long, doc_id long, start long, n_tokens long, hashes array<binary>, root binary"


@released
def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted partition: part, pos, doc_id, start within the part, n_tokens, hashes, root."""
    from pyspark import TaskContext

    part, pos, at = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b.column(1).to_numpy()
        ends = at + np.cumsum(n)
        roots = [_root(h) for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(np.arange(pos, pos + len(n))), b.column(0), pa.array(ends - n), b.column(1), b.column(2), pa.array(roots, pa.binary())], names=[x.split()[0] for x in _RECIPE_SQL.split(", ")])
        pos += len(n)
        at = int(ends[-1]) if len(n) else at


def _part_roots(recipes: DataFrame) -> DataFrame:
    """part, documents, tokens, root of each recipe file: roots of blocks of FAN documents, then of the blocks' roots."""

    def fold(d: DataFrame, *keys: str) -> DataFrame:
        roots = F.transform(F.array_sort(F.collect_list(F.struct("pos", "root"))), lambda x: x["root"])
        whole = d.groupBy(*keys).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), roots.alias("roots"))

        @released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([_root(x) for x in b.columns[-1].to_pylist()], pa.binary())], names=[*b.schema.names[:-1], "root"])

        return whole.mapInArrow(run, ", ".join([*(f"{k} {'int' if k == 'part' else 'long'}" for k in keys), "documents long, tokens long, root binary"]))

    d = recipes.select("part", F.floor(F.col("pos") / FAN).alias("block"), "pos", F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("tokens"), "root")
    return fold(fold(d, "part", "block").withColumnRenamed("block", "pos"), "part")


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encodes docs and writes the store. A null text is empty (the end id alone); rows with equal ids stay separate, in any order among themselves."""
    spark = docs.sparkSession
    d = documents(docs).select("doc_id", F.monotonically_increasing_id().alias("rid"), "text")
    found = d.mapInArrow(_objects(tokenizer, end_id), _OBJECT_SQL).repartition(F.col("key"))
    once = found.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("rid"))).where("copy = 1").drop("copy")
    once.write.partitionBy("kind").option("compression", "uncompressed").parquet(f"{path}/objects")
    recipes = _of_kind(spark, path, RECIPE).select("doc_id", "n", "hashes", "rid").repartitionByRange(F.col("doc_id").asc_nulls_first(), "rid").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "rid")
    recipes.select("doc_id", "n", "hashes").mapInArrow(_number, _RECIPE_SQL).write.parquet(f"{path}/recipes")
    _part_roots(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def _of_kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_OBJECT_SQL).parquet(f"{path}/objects").where(F.col("kind") == kind)


# crc32 of joined parts from the parts' own: polynomials over GF(2), bits reversed as crc32 has them.
_CRC_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    out, m = 0, 1 << 31
    while m:
        if a & m:
            out ^= b
        b = (b >> 1) ^ _CRC_POLY if b & 1 else b >> 1
        m >>= 1
    return out


@lru_cache(1 << 16)
def _shift(n: int) -> int:
    """x to the power 8n."""
    out, square = 1 << 31, 1 << 23
    while n:
        if n & 1:
            out = _times(out, square)
        square, n = _times(square, square), n >> 1
    return out


def crc_join(parts: list[tuple[int, int]]) -> int:
    """crc32 of the concatenation of parts given as (crc32, bytes)."""
    crc = 0
    for c, n in parts:
        crc = _times(_shift(n), crc) ^ c if crc else c
    return crc


def crc_join_many(crcs: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc_join of each of many lists, which end at `ends`: the k-th parts of all lists at once, and what long lists have beyond 64 parts one by one."""
    begin = np.concatenate([[0], ends[:-1]])
    count, out = ends - begin, np.zeros(len(ends), np.uint64)
    for k in range(min(64, int(count.max(initial=0)))):
        mine = np.flatnonzero(count > k)
        at = begin[mine] + k
        size, back = np.unique(sizes[at], return_inverse=True)
        a, b = np.array([_shift(int(n)) for n in size], np.uint64)[back], out[mine]
        sum_ = np.zeros(len(mine), np.uint64)
        for bit in range(31, -1, -1):
            sum_ ^= np.where((a >> np.uint64(bit)) & np.uint64(1) == 1, b, np.uint64(0))
            b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1) == 1, np.uint64(_CRC_POLY), np.uint64(0))
        out[mine] = sum_ ^ crcs[at]
    for i in np.flatnonzero(count > 64).tolist():
        rest = slice(begin[i] + 64, ends[i])
        out[i] = crc_join([(int(out[i]), 0), *zip(crcs[rest].tolist(), sizes[rest].tolist(), strict=True)])
    return out


@released
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for b in batches:
        hashes, sizes, crcs = b.column(0).to_pylist(), [], []
        for h, data in zip(hashes, b.column(1).to_pylist(), strict=True):
            raw = _wide(z.decompress(data))
            if chunk_hash(raw) != h:
                raise ValueError(f"chunk {h.hex()} does not match its hash")
            sizes.append(len(raw))
            crcs.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["hash", "size", "crc"])


_LINE_SQL = "part int, pos long, doc_id long, start long, seq int, hash binary"


@released
def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of recipes (part, pos, doc_id, start, hashes, root), which are held against their roots."""
    for b in batches:
        lists = b.column(4).to_pylist()
        for doc_id, hashes, root in zip(b.column(2).to_pylist(), lists, b.column(5).to_pylist(), strict=True):
            if _root(hashes) != root:
                raise ValueError(f"document {doc_id} does not match its root")
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        row = pa.array(np.repeat(np.arange(len(lists)), count))
        seq = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield pa.RecordBatch.from_arrays([*(c.take(row) for c in b.columns[:4]), pa.array(seq, pa.int32()), b.column(4).flatten()], names=[x.split()[0] for x in _LINE_SQL.split(", ")])


@released
def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        chunks = b.column(3)
        ends = chunks.offsets.to_numpy().astype(np.int64) - chunks.offsets[0].as_py()
        _, size, crc = chunks.flatten().flatten()
        if crc.null_count:
            raise ValueError("a recipe names a chunk that is not there")
        size = size.to_numpy()
        total = np.add.reduceat(size, ends[:-1]) // 4 if len(b.column(0)) else size
        found = crc_join_many(crc.to_numpy().astype(np.uint64), size, ends[1:])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(total), pa.array(found.astype(np.int64))], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def _befores(spark: SparkSession, path: str, recipes: DataFrame) -> DataFrame:
    """part, before (ids of all parts before it), a row for each recipe file, held against the manifest."""
    held = _part_roots(recipes).join(spark.read.parquet(f"{path}/manifest").toDF("part", "said_documents", "said_tokens", "said_root"), "part", "full")
    fits: Column = F.col("root").eqNullSafe(F.col("said_root")) & F.col("documents").eqNullSafe(F.col("said_documents")) & F.col("tokens").eqNullSafe(F.col("said_tokens"))
    tokens = F.when(fits, F.col("tokens")).otherwise(F.raise_error(F.concat(F.lit("recipes do not match the manifest: part "), F.col("part").cast("string"))).cast("long"))
    return held.select("part", tokens.alias("tokens")).select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files alone.

    Each chunk's bytes are read and held against its hash once; a document's crc32 is that of its chunks' bytes joined,
    worked out from theirs. Chunks, roots or a manifest that do not match raise.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    crcs = _of_kind(spark, path, CHUNK).select("key", "data").mapInArrow(_verify, "hash binary, size long, crc long")
    lines = recipes.select("part", "pos", "doc_id", "start", "hashes", "root").mapInArrow(_lines, _LINE_SQL)
    # an outer join of lines to chunks: a hash of very many lines is split by adaptive execution
    rebuilt = (
        lines.join(crcs, "hash", "left")
        .groupBy("part", "pos", "doc_id", "start")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "size", "crc"))).alias("chunks"))
        .select("part", "doc_id", "start", "chunks")
        .mapInArrow(_rebuild, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    )
    return rebuilt.join(_befores(spark, path, recipes), "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def decode_store(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of some documents, from the files."""
    recipes = spark.read.parquet(f"{path}/recipes").where(F.col("doc_id").isin(doc_ids)).select("part", "pos", "doc_id", F.posexplode("hashes").alias("seq", "key"))
    data = _of_kind(spark, path, CHUNK).select("key", "data")
    out: dict[int, list] = {}
    for r in recipes.join(data, "key").orderBy("part", "pos", "seq").toLocalIterator():
        out.setdefault(r.doc_id, []).append(np.frombuffer(_wide(zstandard.ZstdDecompressor().decompress(bytes(r.data))), "<u4"))
    return {k: np.concatenate(v) for k, v in out.items()}


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store is written to the shared folder and read back; it is the query's product and stays there."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_store(spark, path)
