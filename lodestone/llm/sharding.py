"""Shards by a keyed permutation of global row numbers: a reproducible shuffle whose shard and slot anyone can compute.

Rows get their numbers 0 to n - 1 in the order of doc_id (null first), then size, CRC-32 and hash of the text. A Feistel
network permutes the numbers; shard and slot are remainder and quotient of what a number becomes (law ``rows``: counts
are at most one apart). The network works on pairs of digits in the base a, the least number with a * a >= n; what
falls outside 0 to n - 1 is sent through it again until it falls inside (cycle walking), so the whole is a permutation
of 0 to n - 1. Place and row lead to each other without a table: :func:`place_of` and :func:`row_of`.

Rows with null ids, null texts (no bytes) or equal texts are rows like others; rows that agree in id and text are told
apart by where they lie and may swap their places. Other columns, whatever their names, are not looked at. A table
without rows gives none.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import pick, scratch
from lodestone.operators import numbering

SHARDS, SEED, ROUNDS = 24, 20240611, 6

#: Bytes that a document has besides its text.
PER_DOCUMENT = 8

#: Modulus of the round function x ** 5, a permutation of the residues as 5 does not divide PRIME - 1.
PRIME = 2**31 - 1

#: Numbers that can be permuted: digits stay under PRIME, products under 2 ** 63.
MOST_ROWS = 2**60

#: Steps of cycle walking. At most 2 * sqrt(n) + 1 numbers lie outside and no walk meets one of them twice, so a walk among
#: 900 rows or fewer is never longer; among more, a step stays outside with a chance under 0.07. A longer walk would raise.
WALK = 64


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """Keys of the rounds from the seed, by the steps of splitmix64."""
    out, state, mask = [], seed, 2**64 - 1
    for _ in range(rounds):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append((z ^ (z >> 31)) % PRIME)
    return out


def base_of(n: int) -> int:
    """The least a of 1 or more with a * a >= n."""
    if not 0 <= n <= MOST_ROWS:
        raise ValueError(f"{n} rows; there may be 0 to {MOST_ROWS}")
    return isqrt(n - 1) + 1 if n else 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _network(x: Column, a: int, keys: list[int], back: bool) -> Column:
    """The permutation of 0 to a * a - 1, or its inverse."""

    def mixed(v: Column, key: Column) -> Column:
        power5 = lambda t: _let((t * t) % PRIME, lambda s: (((s * s) % PRIME) * t) % PRIME)
        return _let((v + key) % PRIME, power5) % a

    def forth(s: Column, key: Column) -> Column:
        return F.struct(s["r"].alias("l"), ((s["l"] + mixed(s["r"], key)) % a).alias("r"))

    def undone(s: Column, key: Column) -> Column:
        return F.struct(F.pmod(s["r"] - mixed(s["l"], key), _long(a)).alias("l"), s["l"].alias("r"))

    digits = _let(x % a, lambda r: F.struct(F.round((x - r) / a).cast("long").alias("l"), r.alias("r")))  # the quotient is a whole number under 2 ** 30
    return F.aggregate(F.array(*map(_long, keys[::-1] if back else keys)), digits, undone if back else forth, lambda s: s["l"] * a + s["r"])


def _walked(x: Column, n: int, seed: int, back: bool) -> Column:
    a, keys = base_of(n), round_keys(seed)
    once = lambda v: _network(v, a, keys, back)
    more = lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), v, lambda s, _: F.when(s < n, s).otherwise(once(s)))
    inside = lambda v: F.when(v < n, v).otherwise(_let(more(v), lambda w: F.when(w < n, w).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))))
    return _let(once(x.cast("long")), inside)


def place_of(row: Column, n: int, seed: int = SEED) -> Column:
    """Where the row of a number of 0 to n - 1 goes; its shard is that modulo the shards, its slot the quotient."""
    return _walked(row, n, seed, back=False)


def row_of(place: Column, n: int, seed: int = SEED) -> Column:
    """The number of the row that went to a place: of a shard's slot, slot * shards + shard."""
    return _walked(place, n, seed, back=True)


def _dealt(numbered: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    """With place, shard and slot."""
    d = numbered.withColumn("place", place_of(F.col("row"), n, seed))
    return d.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.round((F.col("place") - F.col("place") % shards) / shards).cast("long")})


def _order() -> list[Column]:
    return [F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc(), F.col("hash").asc(), F.col("tie").asc()]


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row (its number), place, shard, slot of each row of docs.

    Texts are read once and never shuffled: their sizes and sums are written, then sorted by ranges and numbered.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    spark, base = docs.sparkSession, scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sums = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), (F.octet_length(text) + PER_DOCUMENT).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"))
    sums.write.parquet(f"{base}/sums")
    known = spark.read.parquet(f"{base}/sums").withColumn("tie", F.monotonically_increasing_id())
    rows = numbering.numbered(known, _order(), "row", f"{base}/sorted")
    return _dealt(rows.drop("hash", "tie"), rows.count(), shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, rows_per_file: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows of docs, in folders shard=0, shard=1, .. of Parquet files, by slot: file k of a shard has its slots k * rows_per_file on.

    The columns are docs' own and row, place and slot; of docs' names none may be one of these or be there twice. A
    shard is written by as many tasks as it has files, so that no task holds a whole shard.
    """
    spark, base = docs.sparkSession, scratch(docs.sparkSession, "write-shards")
    taken = sorted({"row", "place", "slot", "shard", "tie", "hash", "size", "text_crc32"} & {c.lower() for c in docs.columns} - {id_col, text_col})
    if taken or len({c.lower() for c in docs.columns}) < len(docs.columns):
        raise ValueError(f"columns that are taken or doubled: {taken or docs.columns}")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    helpers = {"tie": F.monotonically_increasing_id(), "size": F.octet_length(text), "text_crc32": F.crc32(text.cast("binary")), "hash": F.xxhash64(text)}
    own = F.col(f"`{id_col}`").cast("long")
    rows = numbering.numbered(docs.withColumns(helpers), [own.asc_nulls_first(), *_order()[1:]], "row", f"{base}/sorted").drop(*helpers)
    n = rows.count()
    files = sum(-(-((n - s + shards - 1) // shards) // rows_per_file) for s in range(min(shards, n))) if n else 1
    d = _dealt(rows, n, shards, seed).withColumn("_file", F.floor(F.col("slot") / rows_per_file).cast("long"))
    d = d.repartition(max(files, 1), "shard", "_file").sortWithinPartitions("shard", "slot").drop("_file")
    d.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row", "place")


#: CRC-32 byte by byte by its table; the network step by step, sent on while a number is outside.
ORACLE_SQL = f"""
with recursive crc as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as steps from range(256) t(i)),
d as (select doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, ''))) + {PER_DOCUMENT} as size from documents),
s as (select doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as bigint))), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32 from d, crc),
m as (select s.*, row_number() over (order by doc_id nulls first, size, text_crc32) - 1 as "row" from s),
n as (select count(*) as n, cast(ceil(sqrt(count(*))) as bigint) as a, {round_keys(SEED)} as keys from documents),
w as (select "row", 0 as step, "row" // a as l, "row" % a as r from m, n union all
 select "row", step + 1, r, (l + (t * t % {PRIME}) * (t * t % {PRIME}) % {PRIME} * t % {PRIME} % a) % a
 from (select w.*, n.*, (r + keys[step % {ROUNDS} + 1]) % {PRIME} as t from w, n) q where step = 0 or step % {ROUNDS} <> 0 or l * a + r >= n),
p as (select "row", l * a + r as place from w, n where step > 0 and step % {ROUNDS} = 0 and l * a + r < n)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'rows' as law, cast(place % {SHARDS} as int) as shard, place // {SHARDS} as slot, cast(null as int) as grown_shard, "row", place from m join p using ("row")"""
