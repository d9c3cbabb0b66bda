"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``compile_model`` reads a .model file and builds the machine: the normaliser (the rules of the file's character map
read out of its double array, white space, spaces to U+2581, a dummy one in front) as a transducer that takes the
longest rule at each place, a trie whose final states emit pieces, and byte-fallback arcs for characters
without a piece. An input is composed with it position by position, and the path of least weight in the
tropical semiring (sums along a path, the minimum over paths) gives the ids.

For unigram models an arc's weight is minus its score. For BPE models the machine's states are the
last pieces: an arc from piece u to piece v weighs nothing if byte-pair merging of their joined text ends in
u, v, and infinitely much if not. A sequence of pieces is the merged form of its text exactly if this holds for
each neighbouring pair, so one path at most to each position weighs less than infinity and it equals what merging
gives. The pair test looks at how both pieces came about: it fails if, at some step, a merge across the
border would have come first.

No piece goes on with U+2581 after another character, so the path of a text is that of its words in turn,
and those of equal words are remembered by the worker (in memory bounded in bytes).
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import documents, kept, read, released
from lodestone.llm.wordcodes import WordCodes, parts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffers message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            n = number()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


INF = float("inf")


class Normaliser:
    """Rules of text to text, longest first at each place, then white space; identity without rules."""

    def __init__(self, charsmap: bytes, extra_space: bool) -> None:
        self.rules: dict[str, str] = {}
        self.extra_space = extra_space
        if charsmap:
            n = struct.unpack_from("<I", charsmap)[0]
            units, strings = np.frombuffer(charsmap, "<u4", n // 4, 4).tolist(), charsmap[4 + n :]
            for key, value in self._entries(units):
                self.rules[key.decode()] = strings[value : strings.index(b"\0", value)].decode()
        self.longest = max(map(len, self.rules), default=0)
        first = {k[0] for k in self.rules}
        self.may = re.compile("[" + "".join(map(re.escape, sorted(first))) + "]") if first else None

    @staticmethod
    def _entries(units: list[int]) -> Iterator[tuple[bytes, int]]:
        """Keys and values of a double-array trie: a unit holds a label, whether a value follows, and an offset."""

        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & 512) >> 6)

        stack = [(offset(units[0]), b"")]
        while stack:
            at, key = stack.pop()
            for label in range(1, 256):
                to = at ^ label
                if to >= len(units) or units[to] & 0x800000FF != label:
                    continue
                below = to ^ offset(units[to])
                if units[to] >> 8 & 1:
                    yield key + bytes([label]), units[below] & 0x7FFFFFFF
                stack.append((below, key + bytes([label])))

    @property
    def identity(self) -> bool:
        return not self.rules and not self.extra_space

    def __call__(self, text: str) -> str:
        if self.may is not None and self.may.search(text):
            out, i = [], 0
            while i < len(text):
                for j in range(min(len(text), i + self.longest), i, -1):
                    if (to := self.rules.get(text[i:j])) is not None:
                        out.append(to)
                        i = j
                        break
                else:
                    out.append(text[i])
                    i += 1
            text = "".join(out)
        return re.sub(" +", " ", text).strip(" ") if self.extra_space else text


@dataclass
class Machine:
    kind: int
    names: list[str]
    types: list[int]
    scores: list[float]
    ids: dict[str, int]
    bytes_: list[int]
    unknown: int
    dummy: bool
    normaliser: Normaliser
    rank: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    trie: dict = field(default_factory=dict)
    weights: dict[int, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"weights": {}, "trie": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.grow()

    def grow(self) -> None:
        """The trie of all pieces: a state maps a character to (state, piece that ends there or -1)."""
        self.trie = {}
        for name, i in self.ids.items():
            state = self.trie
            for ch in name[:-1]:
                state = state.setdefault(ch, ({}, -1))[0]
            below = state.get(name[-1])
            state[name[-1]] = (below[0] if below else {}, i)

    # --- composition and shortest path

    def fallback(self, ch: str) -> list[int]:
        return [self.bytes_[b] for b in ch.encode("utf-8", "surrogatepass")] if self.bytes_ else [self.unknown]

    def path(self, text: str) -> list[int]:
        """Ids on the path of least weight for normalised text. Neighbouring characters without a piece are one unknown."""
        n = len(text)
        best, back = [0.0] + [INF] * n, [(0, -1)] * (n + 1)
        (self._scored if self.kind == UNIGRAM else self._merged)(text, best, back)
        out: list[int] = []
        while n:
            i, k = back[n]
            if k >= 0:
                out.append(k)
            elif self.bytes_ or not out or out[-1] != self.unknown:
                out += self.fallback(text[i:n])[::-1]
            n = i
        return out[::-1]

    def _scored(self, text: str, best: list[float], back: list[tuple[int, int]]) -> None:
        n, scores = len(text), self.scores
        lowest = 10.0 - min(scores[k] for k in self.ids.values())  # the weight of a character without a piece
        for i in range(n):
            here, state = best[i], self.trie
            for j in range(i, n):
                found = state.get(text[j])
                if found is None:
                    break
                state, k = found
                if k >= 0 and (w := here - scores[k]) < best[j + 1]:
                    best[j + 1], back[j + 1] = w, (i, k)
            if text[i] not in self.ids and (w := here + lowest) < best[i + 1]:
                best[i + 1], back[i + 1] = w, (i, -1)

    def _merged(self, text: str, best: list[float], back: list[tuple[int, int]]) -> None:
        n, size, weights, trie = len(text), len(self.names), self.weights, self.trie
        if len(weights) > 400_000:
            weights.clear()
        for i in range(n):
            here = best[i]
            if here == INF:
                continue
            u, state = back[i][1], trie
            for j in range(i, n):
                found = state.get(text[j])
                if found is None:
                    break
                state, v = found
                if v >= 0:
                    if u < 0:  # a border: the start, or a character that nothing merges with
                        w = here
                    else:
                        w = weights.get(u * size + v)
                        if w is None:
                            w = weights[u * size + v] = 0.0 if self.pair(u, v) else INF
                        w += here
                    if w < best[j + 1]:
                        best[j + 1], back[j + 1] = w, (i, v)
            if text[i] not in trie or trie[text[i]][1] < 0:
                best[i + 1], back[i + 1] = here, (i, -1)

    def pair(self, u: int, v: int) -> bool:
        """Whether merging the text of u and v ends in u, v.

        Going back in the order of merges, the border has an outer right part of u and an outer left part of v at each
        time. The pair fails if those two make a piece that is merged before either of them is merged further
        (of equal pieces the left one is merged first).
        """
        rank, names = self.rank, self.names
        limit = (float("inf"), 0)  # the merge that ended the time looked at: its rank, and 1 if it is right of the border
        while True:
            joined = self.ids.get(names[u] + names[v])
            if joined is not None and self._comes_first(rank[joined], limit):
                return False
            a, b = (rank[u], 0), (rank[v], 1)
            if self.left[u] < 0 and self.left[v] < 0:
                return True
            # undo the later of the two merges; of equal ones the right one is later
            if self.left[v] < 0 or (self.left[u] >= 0 and a > b):
                limit, u = a, self.right[u]
            else:
                limit, v = b, self.left[v]

    @staticmethod
    def _comes_first(rank: int, limit: tuple[float, int]) -> bool:
        """A merge across the border against the merge `limit`: a lower rank comes first; of equal ranks the one further left, which is the one across the border if the other is right of it."""
        return rank < limit[0] or (rank == limit[0] and limit[1] == 1)


def compile_model(path: str) -> Machine:
    with open(path, "rb") as f:
        return compile_proto(f.read())


def compile_proto(data: bytes) -> Machine:
    names, types, scores = [], [], []
    kind, dummy, byte_fallback, normaliser = UNIGRAM, True, False, Normaliser(b"", True)
    for k, v in _fields(data):
        if k == 1:
            piece = dict(_fields(v))
            names.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            types.append(piece.get(3, NORMAL))
        elif k == 2:
            spec = dict(_fields(v))
            kind, byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif k == 3:
            spec = dict(_fields(v))
            dummy = bool(spec.get(3, 1))
            if not spec.get(5, 1):
                raise ValueError("only models that escape spaces are compiled")
            normaliser = Normaliser(spec.get(2, b""), bool(spec.get(4, 1)))
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are compiled")
    if USER in types:
        raise ValueError("models with user-defined pieces are not compiled")
    ids = {n: i for i, (n, t) in enumerate(zip(names, types, strict=True)) if t == NORMAL}
    if any(MARK in n.lstrip(MARK) for n in ids):
        raise ValueError("a piece spans words")
    byte_ids = [i for i, t in enumerate(types) if t == BYTE] if byte_fallback else []
    if byte_ids and [names[i] for i in byte_ids] != [f"<0x{b:02X}>" for b in range(256)]:
        raise ValueError("byte pieces are out of order")
    if not byte_ids and MARK not in ids:
        raise ValueError("without byte pieces U+2581 must be a piece")
    m = Machine(kind, names, types, scores, ids, byte_ids, types.index(UNKNOWN) if UNKNOWN in types else 0, dummy, normaliser)
    if kind == BPE:
        _history(m)
    m.grow()
    return m


def _history(m: Machine) -> None:
    """Rank of each piece in merging order and the two parts it comes from; pieces that merging cannot reach are left out."""
    n = len(m.names)
    order = sorted((i for i in m.ids.values() if len(m.names[i]) > 1), key=lambda i: (-m.scores[i], i))
    m.rank, m.left, m.right = [0] * n, [-1] * n, [-1] * n
    for r, i in enumerate(order, 1):
        m.rank[i] = r
    reached = {k: i for k, i in m.ids.items() if len(k) == 1}
    for i in order:
        parts = _merge(m, m.names[i])
        if len(parts) == 2:
            m.left[i], m.right[i] = parts
            reached[m.names[i]] = i
    m.ids = reached


def _merge(m: Machine, text: str) -> list[int]:
    """Byte-pair merging of a piece's text up to its last step but one, by definition."""
    parts = list(text)
    while len(parts) > 2:
        best = min(((m.rank[k], j) for j in range(len(parts) - 1) if (k := m.ids.get(parts[j] + parts[j + 1])) is not None), default=None)
        if best is None:
            return []
        j = best[1]
        parts[j : j + 2] = [parts[j] + parts[j + 1]]
    return [m.ids[p] for p in parts] if all(p in m.ids for p in parts) else []


_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Coder:
    """Keys of words: a word alone stands for U+2581 and it, a key with a space in front for what follows the space."""

    def __init__(self, machine: Machine, most: int = 24 << 20) -> None:
        self.m, self.words = machine, WordCodes(self.learn, most)
        out = [self._bytes(i) for i in range(len(machine.names))]
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_size = np.array(list(map(len, out)), np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size

    def _bytes(self, i: int) -> bytes:
        kind = self.m.types[i]
        if kind == BYTE:
            return bytes([int(self.m.names[i][3:5], 16)])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return self.m.names[i].replace(MARK, " ").encode()

    def learn(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.m.path(k[1:] if k[:1] == " " else MARK + k) for k in keys]
        return np.array([i for x in found for i in x], np.int32), np.array(list(map(len, found)), np.int64)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (int32) of all texts in turn, and how many each has; an empty text has none. No text may be null."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if not self.m.normaliser.identity:
            texts = pa.array(list(map(self.m.normaliser, texts.to_pylist())), texts.type)
        texts = pc.replace_substring(texts, MARK, " ")
        odd = pc.match_substring_regex(texts, "  |^ | $|^$").to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._simple(texts)
        ids, counts = self._simple(texts.filter(pa.array(~odd)))
        total = np.zeros(len(texts), np.int64)
        total[~odd] = counts
        keys = [self._segments(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        more, each = self.words.of(pa.array([k for x in keys for k in x], texts.type))
        ends = np.cumsum([0, *map(len, keys)])
        sums = np.concatenate([[0], np.cumsum(each)])
        total[odd] = sums[ends[1:]] - sums[ends[:-1]]
        out = np.zeros(total.sum(), np.int32)
        of_odd = np.repeat(odd, total)
        out[of_odd], out[~of_odd] = more, ids
        return out, total

    def _simple(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of texts that are words with one space between them."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        cut = pc.split_pattern(texts, " ")
        ends = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        words = cut.flatten()
        if not self.m.dummy:
            first = np.zeros(ends[-1], bool)
            first[ends[:-1]] = True
            words = pc.replace_with_mask(words, pa.array(first), pc.binary_join_element_wise("", words.filter(pa.array(first)), " "))
        ids, counts = self.words.of(words)
        return ids, np.add.reduceat(counts, ends[:-1])

    def _segments(self, text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        return [s[1:] if s[0] == MARK and s[1:2] not in ("", MARK) else " " + s for s in _SEGMENT.findall(MARK + marked if self.m.dummy else marked)]

    def decode_bytes(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text; the dummy space goes."""
        size = self.out_size[ids]
        ends = np.cumsum(size)
        place = np.repeat(self.out_start[ids] - (ends - size), size)
        place += np.arange(len(place))
        raw = self.out[place].tobytes()
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        dummy = self.m.dummy
        return [raw[a + 1 : z] if dummy and raw[a : a + 1] == b" " and z > a else raw[a:z] for a, z in zip(stops[:-1], stops[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(np.array(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")


def coder_of(machine: Machine, key: str) -> Coder:
    return kept(("coder", key), lambda: Coder(machine))


def _list(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array<int>) of each row. Null and empty texts have no ids; rows keep null and equal ids."""
    sent = docs.sparkSession.sparkContext.broadcast(compile_model(model))  # the size of the vocabulary

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(sent.value, model)
        for b in batches:
            for first, texts in parts(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), _list(*coder.encode_array(texts))], names=["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and text of each row of doc_id, ids; null ids give a null text."""
    sent = coded.sparkSession.sparkContext.broadcast(compile_model(model))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(sent.value, model)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                c = b.slice(i, 1024)
                text = [None if x is None else coder.decode(x) for x in c.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(text, pa.string())], names=["doc_id", "ids", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


_TRIP_SQL = "doc_id long, n_ids long, n_bytes long, ids_crc32 long, decoded_sha256 string, exact boolean, ids array<int>"


def round_trip(docs: DataFrame, model: str, texts_too: bool = False) -> DataFrame:
    """doc_id, n_ids, n_bytes (ids of byte fallback), ids_crc32, decoded_sha256, exact, ids: the ids are decoded again and held against the text.

    `exact` is false where the text holds U+2581 itself, which reads back as a space, or what the model's normaliser
    changes. With texts_too the text comes after them. Null and empty texts have no ids, and a null text is empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(compile_model(model))
    schema = _TRIP_SQL + (", text string" if texts_too else "")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(sent.value, model)
        lo, hi = (min(coder.m.bytes_), max(coder.m.bytes_)) if coder.m.bytes_ else (1, 0)
        for b in batches:
            for first, texts in parts(b.column(1)):
                ids, counts = coder.encode_array(texts)
                ends = np.cumsum(counts)
                raw, of_bytes = memoryview(ids.astype("<i4").tobytes()), np.concatenate([[0], np.cumsum((ids >= lo) & (ids <= hi))])
                back = coder.decode_bytes(ids, counts)
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                sha = [hashlib.sha256(x).hexdigest() for x in back]
                exact = [x == t for x, t in zip(back, texts.cast(pa.binary()).to_pylist(), strict=True)]
                columns = [b.column(0).slice(first, len(texts)), pa.array(counts), pa.array(of_bytes[ends] - of_bytes[ends - counts]), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(exact, pa.bool_()), _list(ids, counts)]
                yield pa.RecordBatch.from_arrays([*columns, *[texts] * texts_too], names=[x.split()[0] for x in schema.split(", ")])

    return documents(docs).mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
