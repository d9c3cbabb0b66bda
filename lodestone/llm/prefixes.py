"""Prefix trie of conversations: partial tries of each task, merged by the hashes of their nodes, then rolled up.

A conversation is rebuilt first: its opening turns are those of the conversation that its group of five shares. A node
is a sequence of turns from the start; its key is the XOR of two 64-bit hashes of (SHA-256 of the turn, depth) over
these turns, so keys come from running sums, and no task needs the turns of a whole conversation: conversations longer
than BLOCK turns are worked off in blocks, whose sums are carried on. Tasks combine the nodes of their rows in tables of
bounded size; these are merged FAN parts at a time, keyed by node, until one table is left. What a subtree saves and
how many leaves it has is added up along each conversation from its end to the root, and merged the same way: a member
adds the bytes of its turns up to where it becomes the smallest member, as all others but the smallest save theirs.

Lists of the conversations that end in a node are sorted by ranges over all tasks; whole short lists are hashed where
they are, others are packed in pieces of PIECE bytes that are hashed in order as they stream by. SHA-256 of one list is
one chain, so a node where very many conversations end takes one task the time to hash the text of its ids, in bounded memory.

Rows without conv_id belong to no conversation. Turns go by `turn`, null first, those of equal number by the SHA-256 of
role and text; repeated rows are turns of their own. A null role or text is empty. Negative ids group as SQL's % says
(toward zero). A table without rows gives none, not even a root. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import if_few, pick, released, scratch, small_batches
from lodestone.operators import numbering

#: Conversations that share an opening, and the most turns of it plus one.
GROUP, OPENINGS = 5, 9

#: Turns of a conversation that one task sees in one piece.
BLOCK = 1 << 16

#: Partial tries that are merged into one.
FAN = 64

#: Nodes that a task holds before it passes its partial trie on.
HELD = 1 << 17

#: Bytes of a list of ids that are hashed or passed on at once.
PIECE = 1 << 20

#: Nodes with more than a 2,000th of all nodes (and more than 10,000) as children are 2,000 at most, so they may be sent everywhere.
HOT_PARENTS, FEW_CHILDREN = 2_000, 10_000


def _xor(a: str | Column, b: str | Column) -> Column:
    return (F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b)


def _block(d: str, n: int) -> Column:
    return F.floor(F.col(d) / n).cast("long")


def _turns(conversations: DataFrame, base: str) -> DataFrame:
    """c, g (number among all turns, by conversation and turn), turn_hash, bytes."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    d = pick(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    d.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.unhex(whole).alias("turn_hash"), F.octet_length(text).cast("long").alias("bytes")).write.parquet(f"{base}/turns")
    d = spark.read.parquet(f"{base}/turns").withColumn("tie", F.monotonically_increasing_id())
    return numbering.numbered(d, [F.col("c").asc(), F.col("turn").asc_nulls_first(), F.col("turn_hash").asc(), F.col("tie").asc()], "g", f"{base}/sorted").drop("turn", "tie")


def _conversations(turns: DataFrame) -> DataFrame:
    """c, start (number of its first turn), n, h, k (turns of the opening), length (rebuilt), members of the group as (c, k) for the conversation whose opening is shared."""
    n = turns.groupBy("c").agg(F.min("g").alias("start"), F.count("*").alias("n"))
    first = F.col("c") - F.col("c") % GROUP
    shared = n.where(F.col("c") % GROUP == 0).select(F.col("c").alias("first"), F.col("n").alias("n0"))
    d = n.withColumns({"first": first, "h": F.crc32(F.col("c").cast("string").cast("binary")) % OPENINGS}).join(shared, "first", "left")
    d = d.withColumn("k", F.least("h", F.coalesce("n0", F.lit(0)))).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    groups = d.groupBy("first").agg(F.collect_list(F.struct("c", "k")).alias("members"))  # nine rows at most
    return d.drop("n0").join(groups.withColumnRenamed("first", "c"), "c", "left").drop("first")


def _rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """c, d (from 1), turn_hash, bytes of rebuilt conversations. A long conversation meets its facts in blocks of BLOCK turns."""
    facts = convs.select("c", "start", "h", "k", "members", F.explode(F.sequence(_block("start", BLOCK), F.floor((F.col("start") + F.col("n") - 1) / BLOCK).cast("long"))).alias("block"))
    d = turns.withColumn("block", _block("g", BLOCK)).join(facts, ["c", "block"]).withColumn("pos", F.col("g") - F.col("start"))
    own = F.filter(F.array(F.struct(F.col("c").alias("c"), (F.col("pos") - F.col("h") + F.col("k") + 1).alias("d"))), lambda _: F.col("pos") >= F.col("h"))
    given = F.transform(F.filter(F.coalesce("members", F.array().cast("array<struct<c:long,k:long>>")), lambda m: m["k"] > F.col("pos")), lambda m: F.struct(m["c"].alias("c"), (F.col("pos") + 1).alias("d")))
    return d.select(F.explode(F.concat(own, given)).alias("x"), "turn_hash", "bytes").select("x.c", "x.d", "turn_hash", "bytes")


def _paths(rebuilt: DataFrame, convs: DataFrame, base: str) -> DataFrame:
    """c, d, a, b (key), pa, pb (parent's key), before (bytes before its last text), bytes, length: a row for each conversation and depth, the root's too."""
    spark = rebuilt.sparkSession
    d = rebuilt.select("c", "d", "bytes", F.xxhash64("turn_hash", "d").alias("ma"), F.xxhash64("d", "turn_hash").alias("mb"), F.floor((F.col("d") - 1) / BLOCK).cast("long").alias("block"))
    w = Window.partitionBy("c", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d.withColumns({"a": F.bit_xor("ma").over(w), "b": F.bit_xor("mb").over(w), "before": F.sum("bytes").over(w) - F.col("bytes")}).write.parquet(f"{base}/blocks")
    blocks = spark.read.parquet(f"{base}/blocks")
    full = blocks.where(F.col("d") % BLOCK == 0)  # the last turns of full blocks, whose sums go to the blocks after them
    w = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full.select("c", (F.col("block") + 1).alias("block"), F.bit_xor("a").over(w).alias("ca"), F.bit_xor("b").over(w).alias("cb"), F.sum(F.col("before") + F.col("bytes")).over(w).alias("cn")).write.parquet(f"{base}/carried")
    carried = spark.read.parquet(f"{base}/carried")
    d = blocks.join(if_few(carried), ["c", "block"], "left").na.fill(0, ["ca", "cb", "cn"]).withColumns({"a": _xor("a", "ca"), "b": _xor("b", "cb"), "before": F.col("before") + F.col("cn")})
    nothing = F.lit(0).cast("long")
    root = convs.select("c", *[nothing.alias(x) for x in ("d", "a", "b", "pa", "pb", "before", "bytes")])
    return d.select("c", "d", "a", "b", _xor("a", "ma").alias("pa"), _xor("b", "mb").alias("pb"), "before", "bytes").unionByName(root)


def _partial(mins: list[str], sums: list[str]):
    """Over Arrow batches of a, b, mins, sums: rows of equal (a, b) combined; held up to HELD nodes, then passed on with the task's number."""
    names = ["a", "b", *mins, *sums]
    how = [*((x, "min") for x in mins), *((x, "sum") for x in sums)]

    def combined(batches: list[pa.RecordBatch | pa.Table]) -> pa.Table:
        t = pa.concat_tables([x if isinstance(x, pa.Table) else pa.Table.from_batches([x]) for x in batches])
        return t.group_by(["a", "b"], use_threads=False).aggregate(how).select(["a", "b", *(f"{n}_{f}" for n, f in how)]).rename_columns(names)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, rows = [], 0

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from t.append_column("part", pa.array([part] * t.num_rows, pa.int32())).to_batches()

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 2 * HELD:
                t = combined(held)
                held, rows = [t], t.num_rows
                if rows >= HELD:
                    yield from out(t)
                    held, rows = [], 0
        if held:
            yield from out(combined(held))

    return run, ", ".join([*(f"{n} long" for n in names), "part int"])


def _merged(rows: DataFrame, mins: list[str], sums: list[str], path: str) -> DataFrame:
    """One row for each node of rows (a, b, mins, sums): partial tries of the tasks, written, then merged FAN of them at a time."""
    run, schema = _partial(mins, sums)
    rows.select("a", "b", *mins, *sums).mapInArrow(run, schema).write.parquet(path)
    tries = rows.sparkSession.read.parquet(path)
    parts = (tries.agg(F.max("part")).first()[0] or 0) + 1
    how = [*(F.min(x).alias(x) for x in mins), *(F.sum(x).alias(x) for x in sums)]
    while parts > FAN:
        tries = tries.groupBy("a", "b", F.floor(F.col("part") / FAN).cast("int").alias("part")).agg(*how)
        parts = -(-parts // FAN)
    return tries.groupBy("a", "b").agg(*how)


def _with_parents(nodes: DataFrame) -> DataFrame:
    """nodes (written, with n_children) with parent_conv_id. Parents of very many nodes, few by their count, are sent to all tasks; others are joined."""
    limit = max(FEW_CHILDREN, nodes.count() // HOT_PARENTS)
    parents = nodes.where("n_children > 0").select(F.col("a").alias("ja"), F.col("b").alias("jb"), F.col("conv_id").alias("up"), "n_children")
    hot = parents.where(F.col("n_children") > limit).select(F.col("ja").alias("pa"), F.col("jb").alias("pb"), F.col("up").alias("hot"))
    cold = parents.where(F.col("n_children") <= limit).drop("n_children")
    d = nodes.join(F.broadcast(hot), ["pa", "pb"], "left")
    d = d.withColumns({"ja": F.when(F.col("hot").isNull(), F.col("pa")).otherwise(F.col("a")), "jb": F.when(F.col("hot").isNull(), F.col("pb")).otherwise(F.col("b"))})
    return d.join(cold, ["ja", "jb"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("hot", "up"))).drop("ja", "jb", "hot", "up")


_PIECES = "a long, b long, first long, ids string, sha string"


@released
def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows a, b, c: the hash of each list that lies within the task and is short, and pieces of the others."""
    names = [x.split()[0] for x in _PIECES.split(", ")]
    key, ids, size, first, cut = None, [], 0, None, True  # cut: the list may begin before the task, or pieces of it have gone
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i > 2 else pa.int64()) for i in range(5)], names=names)
        out.clear()
        return b

    for batch in batches:
        for a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (a, b) != key:
                if key is not None:
                    joined = ",".join(ids)
                    out.append((*key, first, joined, None) if cut else (*key, first, None, hashlib.sha256(joined.encode()).hexdigest()))
                    cut = False
                key, ids, size, first = (a, b), [], 0, c
            elif size >= PIECE:
                out.append((*key, first, ",".join(ids), None))
                ids, size, first, cut = [], 0, c, True
            ids.append(str(c))
            size += len(ids[-1]) + 1
            if len(out) >= 10_000:
                yield flush()
        if out:
            yield flush()
    if key is not None:
        out.append((*key, first, ",".join(ids), None))  # the list may go on in the next task
        yield flush()


@released
def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces a, b, ids in order: the hash of each list."""
    key, sha = None, None
    names = ["a", "b", "sha"]
    for batch in batches:
        done = []
        for a, b, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (a, b) == key:
                sha.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, sha.hexdigest()))
            key, sha = (a, b), hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([sha.hexdigest()])], names=names)


def _ends(ends: DataFrame, base: str) -> DataFrame:
    """a, b, ends_sha256 of the nodes where conversations end. ends: a, b, c."""
    order = [F.col("a").asc(), F.col("b").asc(), F.col("c").asc()]
    ends.select("a", "b", "c").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_lists, _PIECES).write.parquet(f"{base}/ends")
    lists = ends.sparkSession.read.parquet(f"{base}/ends")
    pieces = lists.where("sha is null").repartition("a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "ids").mapInArrow(_chained, "a long, b long, sha string")
    return lists.where("sha is not null").select("a", "b", "sha").unionByName(pieces).withColumnRenamed("sha", "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, bytes (of its last text), a row for each node. conversations: conv_id, turn, role, text."""
    spark = conversations.sparkSession
    small_batches(spark)
    base = scratch(spark, "prefixes")
    turns = _turns(conversations, base)
    _conversations(turns).write.parquet(f"{base}/conversations")
    convs = spark.read.parquet(f"{base}/conversations")
    _paths(_rebuilt(turns, convs), convs, base).write.parquet(f"{base}/paths")
    paths = spark.read.parquet(f"{base}/paths")

    mins = ["pa", "pb", "depth", "conv_id", "bytes", "before"]
    _merged(paths.select("a", "b", "pa", "pb", F.col("d").alias("depth"), F.col("c").alias("conv_id"), "bytes", "before", F.lit(1).cast("long").alias("n_convs")), mins, ["n_convs"], f"{base}/tries").write.parquet(f"{base}/merged")
    merged = spark.read.parquet(f"{base}/merged")
    children = merged.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    merged.join(children, ["a", "b"], "left").na.fill(0, ["n_children"]).write.parquet(f"{base}/nodes")
    nodes = spark.read.parquet(f"{base}/nodes")

    # where each conversation becomes the smallest member (never, for a copy), and whether it ends in a leaf as that
    smallest = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.min("before").alias("from"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    facts = convs.select("c", "length").join(smallest, "c", "left").select("c", "from", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.explode(F.sequence(F.lit(0).cast("long"), _block("length", BLOCK))).alias("block"))
    total = paths.join(convs.select("c", F.col("length").alias("d")), ["c", "d"]).select("c", "a", "b", (F.col("before") + F.col("bytes")).alias("total"))
    total.write.parquet(f"{base}/whole")
    total = spark.read.parquet(f"{base}/whole")
    facts = facts.join(total.select("c", "total"), "c").select("c", "block", "leaf", F.coalesce("from", "total").alias("until"))
    rolled = paths.select("c", "a", "b", "before", _block("d", BLOCK).alias("block")).join(facts, ["c", "block"]).select("a", "b", F.greatest(F.col("until") - F.col("before"), F.lit(0)).alias("saved"), "leaf")
    rolled = _merged(rolled.where("saved > 0 or leaf > 0"), [], ["saved", "leaf"], f"{base}/rolled")

    d = _with_parents(nodes).join(rolled, ["a", "b"], "left").join(_ends(total, base), ["a", "b"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return d.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaf", F.lit(0)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"), "bytes")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def rebuild(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    """Rebuilt conversations of rows (conv_id, turn, role, text), one by one."""
    import zlib

    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % OPENINGS
        out[c] = turns.get(c - (abs(c) % GROUP) * (1 if c >= 0 else -1), [])[:h] + mine[h:]
    return out


def brute(rows: list[tuple]) -> list[tuple]:
    """The columns of prefix_trie from a trie of dicts, node by node."""
    members: dict[tuple, list[int]] = {}
    ends: dict[tuple, list[int]] = {}
    for c, turns in rebuild(rows).items():
        path = tuple(turns)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children: dict[tuple, int] = {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    saved, leaves = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += p not in children
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], sha(ends.get(p, [])), len(p[-1][1].encode()) if p else 0) for p, m in members.items()]


#: Nodes as lists of turns; subtrees by each node's prefixes.
ORACLE_SQL = f"""
with crc as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as steps from range(256) t(i)),
t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos from conversations where conv_id is not null),
n as (select c, count(*) as n from t group by 1),
h as (select n.c, n.n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(n.c as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda v, x: xor(v >> 8, steps[(xor(v, x) & 255) + 1])), 4294967295) % {OPENINGS} as h from n, crc),
k as (select h.*, least(h.h, coalesce(o.n, 0)) as k from h left join n o on o.c = h.c - h.c % {GROUP}),
r as (select k.c, t.pos as d, role, text from k join t on t.c = k.c - k.c % {GROUP} and t.pos < k.k union all select k.c, t.pos - k.h + k.k, role, text from k join t on t.c = k.c and t.pos >= k.h),
s as (select k.c, coalesce(list({{'role': role, 'text': text}} order by d) filter (d is not null), []) as s from k left join r on r.c = k.c group by 1),
p as (select c, s[1:d] as node, d, d = len(s) as ends from (select c, s, unnest(range(0, len(s) + 1)) as d from s) q),
v as (select node, d as depth, min(c) as conv_id, count(*) as n_convs, coalesce(string_agg(cast(c as varchar), ',' order by c) filter (ends), '') as ends from p group by 1, 2),
e as (select node[1:depth - 1] as node, count(*) as n_children from v where depth > 0 group by 1),
f as (select v.*, coalesce(n_children, 0) as n_children, coalesce(octet_length(encode(v.node[-1].text)), 0) as bytes from v left join e on e.node = v.node),
u as (select node[1:d] as node, sum((n_convs - 1) * bytes) as saved, count(*) filter (n_children = 0) as leaves from (select f.*, unnest(range(0, depth + 1)) as d from f) q group by 1)
select f.conv_id, f.depth, o.conv_id as parent_conv_id, f.n_convs, f.n_children, u.leaves as n_leaves, cast(u.saved as bigint) as saved_tokens, sha256(f.ends) as ends_sha256, cast(f.bytes as bigint) as bytes
from f join u on u.node = f.node left join v o on f.depth > 0 and o.node = f.node[1:f.depth - 1]"""
