"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

A document is posted under each (coordinate, value) of its signature of K values. Two sets with a
similarity of at least the threshold agree in at least least_equal() of K coordinates (up to a chance of LOSS
at the threshold itself, less above), so any K - least_equal() + 1 coordinates of one hold a collision: a document
enters the join with its rarest ones only (prefix), values that no second document has are skipped, and the
collisions of a candidate pair are counted over the whole signatures. Pairs that keep as many or more are
confirmed on the full shingle sets.

Equal sets are one class from the start. Within a posting every class is first compared only with the one
whose coordinates are the commonest (the least edited copy, as a rule). When components are known, classes of a
posting that are still apart meet in blocks of bounded size: those outside the posting's largest component meet each
other and the largest, whose own classes need not meet. In a block, collisions are counted by skip merging (_met),
then both signatures are compared, and only pairs that may be similar leave the block. So no group of near copies is
expanded into all its pairs, and no link between components is lost.

The second signature, BINS values of one byte, has the smallest shingle hash of each of BINS ranges. The share
of equal ones among those that are not empty in both estimates the similarity; a pair must come within
SLACK standard deviations (and two values) of the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, documents, mix, read, released, scratch, windows, words

K, SHINGLE = 64, 5
#: Least similarity where no contract says otherwise, and that of op6.
PERCENT, OP6_PERCENT = 80, 85
#: Chance that a pair at the threshold itself agrees in fewer coordinates than are asked for.
LOSS = 3e-5
BINS, SLACK = 512, 4.2
#: Classes of one posting that are compared at once.
BLOCK = 2048
#: Collisions in the lists that skip merging does not skip, from which on a pair is compared.
MET = 4
#: Blocks of fewer classes are compared without merging, which finds the same pairs.
SMALL = 64
_rng = np.random.default_rng(99)
_XOR, _MUL = _rng.integers(0, 2**63, (2, K), dtype=np.uint64)
_MUL = _MUL | np.uint64(1)


def least_equal(percent: int) -> int:
    """Coordinates of K that a pair must share: the most that a pair at the threshold falls short of with a chance of LOSS at most."""
    t, m, tail = percent / 100, 0, 0.0
    while (tail := tail + math.comb(K, m) * t**m * (1 - t) ** (K - m)) <= LOSS:
        m += 1
    return m


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text in lower case (A-Z); of fewer words, the sequence as one; none without words."""
    h = words((text or "").encode("utf-8", "surrogatepass").translate(LOWER))[2]
    if not len(h):
        return h
    return np.unique(windows(h, k)) if len(h) >= k else mix(windows(h, len(h)) + np.uint64(len(h)))


def signature(s: np.ndarray) -> np.ndarray:
    best = np.full(K, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 1024):
        part = (s[i : i + 1024, None] ^ _XOR) * _MUL
        np.minimum(best, (part ^ (part >> np.uint64(29))).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def bins(s: np.ndarray) -> bytes:
    """One byte of the smallest hash in each of BINS ranges of sorted hashes, from 1; 0 for an empty range."""
    out = np.zeros(BINS, np.uint8)
    where, first = np.unique(s >> np.uint64(64 - 9), return_index=True)
    out[where.astype(np.int64)] = 1 + mix(s[first]) % np.uint64(255)
    return out.tobytes()


@released
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 512):
            c = b.slice(i, 512)
            n, key, sig, low = [], [], [], []
            for t in c.column(1).to_pylist():
                s = shingles(t)
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s).view(np.int32) if len(s) else None)
                low.append(bins(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([c.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int32())), pa.array(low, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig", "bins"])


def _similar(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a, b, text_a, text_b: the pairs with a similarity of at least percent, on full sets."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                keep = []
                for ta, tb in zip(c.column(2).to_pylist(), c.column(3).to_pylist(), strict=True):
                    if last[0] != ta:
                        last = (ta, shingles(ta))
                    sa, sb = last[1], shingles(tb)
                    both = len(np.intersect1d(sa, sb, assume_unique=True))
                    keep.append(100 * both >= percent * (len(sa) + len(sb) - both) and both > 0)
                c = c.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1)], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b), those whose texts (doc_id, text) are similar enough."""
    ta, tb = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "text_a", "text_b").mapInArrow(_similar(percent), "a long, b long")


def _lists(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted lists of a block's signatures: members by coordinate and value, and of each class and coordinate where its list begins and how long it is."""
    by = sig.T
    order = np.argsort(by, axis=1, kind="stable").astype(np.int32)
    value = np.take_along_axis(by, order, 1)
    new = np.ones(by.shape, bool)
    new[:, 1:] = value[:, 1:] != value[:, :-1]
    first = np.flatnonzero(new)
    long = np.diff(np.append(first, new.size))
    begin, size = np.empty(by.shape, np.int64), np.empty(by.shape, np.int64)
    np.put_along_axis(begin, order, np.repeat(first, long).reshape(by.shape), 1)
    np.put_along_axis(size, order, np.repeat(long, long).reshape(by.shape), 1)
    return order.ravel(), begin.T, size.T


def _met(lists: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray, match: int) -> np.ndarray:
    """For each of rows, which classes of the block may agree with it in `match` coordinates.

    Of a row's K lists the match - MET longest are skipped. Who is in `match` of all is in MET of the
    others at least; these are merged and counted. A row whose short lists hold more than the signatures it would
    save is not merged: it may agree with all.
    """
    order, begin, size = lists
    m = len(size)
    short = np.argsort(size[rows], axis=1, kind="stable")[:, : K - match + MET]
    n = np.take_along_axis(size[rows], short, 1)
    dense = n.sum(axis=1) > 4 * m
    n[dense] = 0
    owner = np.repeat(np.arange(len(rows)), n.sum(axis=1))
    n, at = n.ravel(), np.take_along_axis(begin[rows], short, 1).ravel()
    member = order[np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)]
    count = np.bincount(owner * m + member, minlength=len(rows) * m).reshape(len(rows), m)
    return (count >= MET) | dense[:, None]


def _apart(table: pa.Table, percent: int) -> pa.Table:
    """Of one block of a posting: pairs (a, b) of different components that may be similar and whose first common posting is this one."""
    match = least_equal(percent)
    at = table.column("at")[0].as_py() >> 32
    rep, comp, own, n, mask = (np.array(table.column(c).to_pylist()) for c in ("rep", "component", "own", "n_shingles", "mask"))
    sig = np.array(table.column("sig").to_pylist(), np.int32)
    low = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
    mask = mask.astype(np.int64).view(np.uint64)
    names, count = np.unique(comp, return_counts=True)
    main = comp == names[np.argmax(count)]
    two = table.column("x")[0].as_py() != table.column("y")[0].as_py()
    found_a, found_b = [], []
    rest = np.flatnonzero(~main)
    lists = _lists(sig) if len(rest) and len(rep) > SMALL else None
    for k in range(0, len(rest), 32):
        i = rest[k : k + 32]
        ok = (comp[i, None] != comp) & (main | (rep[i, None] < rep)) & (100 * np.minimum(n[i, None], n) >= percent * np.maximum(n[i, None], n))
        if two:
            ok &= own[i, None] != own
        if lists:
            ok &= _met(lists, i, match)
        r, c = np.nonzero(ok)
        for z in range(0, len(r), 1 << 15):
            a, b = i[r[z : z + (1 << 15)]], c[z : z + (1 << 15)]
            same = sig[a] == sig[b]
            bits = np.packbits(same, axis=1, bitorder="little").view(np.uint64).ravel()
            shared = bits & mask[a] & mask[b]
            keep = (same.sum(axis=1) >= match) & ((shared & (~shared + np.uint64(1))) == np.uint64(1 << at))
            a, b = a[keep], b[keep]
            there = ((low[a] | low[b]) != 0).sum(axis=1)
            equal = ((low[a] == low[b]) & (low[a] != 0)).sum(axis=1)
            # the smallest hashes are a sample of the union without repeats: hypergeometric
            t, union = percent / 100, (n[a] + n[b]) / (1 + percent / 100)
            keep = equal >= t * there - SLACK * np.sqrt(t * (1 - t) * there * np.clip((union - there) / np.maximum(union - 1, 1), 0, 1)) - 2
            found_a.append(rep[a[keep]])
            found_b.append(rep[b[keep]])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
    return pa.table([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of each node of links (a, b), by large-star and small-star steps."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = small.checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _matches(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _candidates(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that agree in least_equal() coordinates, whose sizes allow the similarity."""
    s = classes.select("rep", "n_shingles", "sig")
    both = pairs.join(s.toDF("a", "na", "sa"), "a").join(s.toDF("b", "nb", "sb"), "b")
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return both.where(fits & (_matches("sa", "sb") >= least_equal(percent))).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; texts with a similarity of percent or more are linked.

    Null texts and texts without words have no shingles and are alone. Equal rows are one class. A row with
    a null id is alone, with a null component. An empty table gives no rows. Ids should differ between texts: a class
    goes by its smallest id, so different texts with the same smallest id share their links, and as they also share
    a prefix a link of theirs may be missed.
    """
    spark, match = docs.sparkSession, least_equal(percent)
    base = scratch(spark, "minhash")
    d = documents(docs)
    d.mapInArrow(_sign, "doc_id long, n_shingles long, set_key binary, sig array<int>, bins binary").write.parquet(f"{base}/signed")
    signed = spark.read.parquet(f"{base}/signed")
    of_class = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bins").alias("bins"))
    of_class.write.parquet(f"{base}/classes")
    classes = spark.read.parquet(f"{base}/classes")

    posted = classes.select("rep", F.posexplode("sig").alias("i", "v")).select("rep", F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("at"))
    shared = posted.groupBy("at").agg(F.count("*").alias("df")).where("df > 1")
    prefix = (
        posted.join(shared, "at")
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct("df", "at"))).alias("p"))
        .where(F.size("p") >= match)
        .withColumn("weight", F.aggregate("p", F.lit(0).cast("long"), lambda t, x: t + x["df"]))
        # of K coordinates those that nobody shares come first; what is left of the prefix are the rarest shared ones
        .withColumn("p", F.slice("p", 1, F.greatest(F.lit(0), F.size("p") - match + 1)))
        .withColumn("mask", F.aggregate("p", F.lit(0).cast("long"), lambda t, x: t.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x["at"], 32).cast("int")))))
        .select("rep", "weight", "mask", F.explode("p").alias("x"))
        .select("rep", "weight", "mask", F.col("x.at").alias("at"))
    )
    prefix.write.parquet(f"{base}/prefix")
    prefix = spark.read.parquet(f"{base}/prefix")

    texts = d.where("doc_id is not null").join(classes.select(F.col("rep").alias("doc_id"), "set_key"), "doc_id", "left_semi")
    heads = prefix.groupBy("at").agg(F.min(F.struct(-F.col("weight"), "rep")).alias("h"), F.count("*").alias("c")).where("c > 1").select("at", F.col("h.rep").alias("a"))
    stars = _candidates(prefix.join(heads, "at").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), classes, percent)
    stars.write.parquet(f"{base}/stars")
    tested = spark.read.parquet(f"{base}/stars")
    confirm(tested, texts, percent).distinct().write.parquet(f"{base}/links")
    links = spark.read.parquet(f"{base}/links")
    comp = components(links)

    placed = prefix.join(comp, prefix.rep == comp.node, "left").select("at", "rep", "mask", F.coalesce("component", "rep").alias("component"))
    by_component = placed.groupBy("at", "component").agg(F.count("*").alias("c")).groupBy("at").agg(F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("c"), F.count("*").alias("kinds"))
    few, blocks = F.col("c") <= BLOCK, lambda n: F.ceil(n / BLOCK).cast("int")
    # blocks 0 to inner - 1 are of classes outside the largest component, outer more of those in it; a small posting is one block
    apart = by_component.where("kinds > 1").select("at", F.col("most.component").alias("main"), F.when(few, 1).otherwise(blocks(F.col("c") - F.col("most.c"))).alias("inner"), F.when(few, 0).otherwise(blocks(F.col("most.c"))).alias("outer"))
    outside = (F.col("component") == F.col("main")) & (F.col("outer") > 0)
    within = F.pmod(F.xxhash64("rep"), F.when(outside, F.col("outer")).otherwise(F.col("inner"))).cast("int")
    own = F.when(outside, F.col("inner") + within).otherwise(within)
    meets = F.col("inner") + F.when(outside, 0).otherwise(F.col("outer"))
    open_ = placed.join(apart, "at").withColumn("own", own).select("at", "rep", "mask", "component", "own", F.explode(F.sequence(F.lit(0), meets - 1)).alias("k"))
    open_ = open_.join(classes.select("rep", "n_shingles", "sig", "bins"), "rep").select("at", F.least("own", "k").alias("x"), F.greatest("own", "k").alias("y"), "own", "rep", "mask", "component", "n_shingles", "sig", "bins")
    rest = open_.groupBy("at", "x", "y").applyInArrow(lambda t: _apart(t, percent), "a long, b long").distinct()
    tested = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    confirm(rest.join(tested, ["a", "b"], "left_anti"), texts, percent).distinct().write.parquet(f"{base}/links2")
    more = spark.read.parquet(f"{base}/links2")
    if more.take(1):
        comp = components(links.unionByName(more))
    to = classes.join(comp, classes.rep == comp.node, "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    return signed.select("doc_id", "n_shingles", "set_key").join(to, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns kept, whose id is the smallest of its component; rows with null ids stay."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = f"c{docs.columns.index('doc_id')}"
    gone = near_duplicates(docs, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return plain.join(gone, F.col(at).cast("long") == F.col("gone"), "left_anti").toDF(*docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), OP6_PERCENT)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def brute(rows: list[tuple[int, str | None]], percent: int = PERCENT) -> list[tuple[int, int, int, bool]]:
    """The contract by comparing all pairs of sets that share a shingle, for tests."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        sets[i] = {tuple(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    by: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for ids in by.values():
        for n, i in enumerate(ids):
            for j in ids[:n]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and (a := root(i)) != (b := root(j)):
                        parent[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), root(i), root(i) == i) for i, _ in rows]
