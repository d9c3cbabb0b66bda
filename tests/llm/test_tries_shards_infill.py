"""Prefix tries, shards and fill-in-middle over the folder of odd tables, and their parts by themselves."""

from __future__ import annotations

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import infill, prefixes, queries, sharding
from tests.llm.test_op_queries import folder, invented, key, talk  # noqa: F401

Q = queries.queries()


def conversations(spark, path):
    return [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def test_op11(spark, folder):  # noqa: F811
    path = folder[0]
    got = Q["op11_prefix_trie"](spark, path).collect()
    assert key(got) == key(prefixes.brute(conversations(spark, path)))
    root = next(r for r in got if r.depth == 0)
    assert root.parent_conv_id is None and root.n_convs == len({c for c, *_ in conversations(spark, path)} - {None})


@pytest.mark.parametrize("block,fan,held", [(4, 2, 3), (1, 64, 1), (16, 3, 50)])
def test_op11_in_blocks_and_levels(spark, folder, monkeypatch, block, fan, held):  # noqa: F811
    monkeypatch.setattr(prefixes, "BLOCK", block)
    monkeypatch.setattr(prefixes, "FAN", fan)
    monkeypatch.setattr(prefixes, "HELD", held)
    monkeypatch.setattr(prefixes, "FEW_CHILDREN", 1)
    monkeypatch.setattr(prefixes, "HOT_PARENTS", 40)
    d = spark.read.parquet(f"{folder[0]}/conversations.parquet").repartition(7)
    assert key(prefixes.prefix_trie(d).collect()) == key(prefixes.brute(conversations(spark, folder[0])))


def test_op11_extra_columns_and_one_conversation_of_all_rows(spark):
    rows = [(5, t, "user", str(t)) for t in range(250)] + [(6, 0, "user", "x")]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, Turn int, a int")
    assert key(prefixes.prefix_trie(d).collect()) == key(prefixes.brute(rows))


def test_op11_many_copies(spark):
    rng = random.Random(3)
    rows = [(c, t, "user", f"s{t}") for c in range(0, 3000, 5) for t in range(3)] + talk(rng)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert key(prefixes.prefix_trie(d).collect()) == key(prefixes.brute(rows))


def batches(rows, width, names):
    return [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + width]]) for i in range(0, len(rows), width)]


@pytest.mark.parametrize("piece", [1, 7, 60, 1 << 20])
def test_lists_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(prefixes, "PIECE", piece)
    rng = random.Random(piece)
    rows = sorted({(rng.randint(0, 6), rng.randint(0, 1), rng.randint(-50, 10**6)) for _ in range(400)} | {(9, 0, 3)})
    want = {}
    for a, b, c in rows:
        want.setdefault((a, b), []).append(str(c))
    want = {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}
    got, pieces = {}, []
    for part in (rows[:90], rows[90:91], rows[91:300], rows[300:]):
        for b in prefixes._lists(iter(batches(part, 17, "abc"))):
            for a, k, first, ids, sha in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if sha is None:
                    pieces.append((a, k, first, ids))
                else:
                    assert (a, k) not in got
                    got[a, k] = sha
    pieces = [(a, b, ids) for a, b, _, ids in sorted(pieces)]
    for b in prefixes._chained(iter(batches(pieces, 5, ("a", "b", "ids")))):
        got |= {(a, k): sha for a, k, sha in zip(*(x.to_pylist() for x in b.columns), strict=True)}
    assert got == want


def network(x, a, keys):
    l, r = divmod(x, a)  # noqa: E741
    for k in keys:
        l, r = r, (l + pow(r + k, 5, sharding.PRIME) % a) % a  # noqa: E741
    return l * a + r


def places(n, seed):
    a, keys, out = sharding.base_of(n), sharding.round_keys(seed), []
    for x in range(n):
        x = network(x, a, keys)
        while x >= n:
            x = network(x, a, keys)
        out.append(x)
    return out


def test_op12(spark, folder):  # noqa: F811
    path, rows, _ = folder
    got = Q["op12_feistel_shards"](spark, path).collect()
    n = len(rows)
    assert key((r.doc_id, r.size, r.text_crc32) for r in got) == key((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None} and all(0 <= r.shard < 24 for r in got)
    order = sorted(got, key=lambda r: r.row)
    assert [r.row for r in order] == list(range(n)) and [r.place for r in order] == places(n, sharding.SEED)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in order] == sorted((i is not None, i or 0) for i, _ in rows)
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(len(range(s, n, 24))))
    assert key(Q["op12_feistel_shards"](spark, path).collect()) == key(got)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 24, 900, 5001])
def test_permutation_and_its_inverse(spark, n):
    d = spark.range(n).select("id", sharding.place_of(F.col("id"), n, 99).alias("place"))
    got = {r.id: r.place for r in d.collect()}
    assert [got[i] for i in range(n)] == places(n, 99) and sorted(got.values()) == list(range(n))
    back = d.select("id", sharding.row_of(F.col("place"), n, 99).alias("row")).where("id <> row")
    assert back.count() == 0
    assert n < 17 or places(n, 98) != places(n, 99)


def test_large_permutation(spark):
    n = sharding.MOST_ROWS
    rows = [0, 1, 2**31, 2**53 + 1, 10**18, n - 1]
    d = spark.createDataFrame([(x,) for x in rows], "id long").select("id", sharding.place_of(F.col("id"), n).alias("place"))
    d = d.select("id", "place", sharding.row_of(F.col("place"), n).alias("row"))
    for r in d.collect():
        assert r.row == r.id and r.place == network(r.id, sharding.base_of(n), sharding.round_keys(sharding.SEED))
    with pytest.raises(ValueError):
        sharding.base_of(n + 1)


def test_written_shards(spark, folder, tmp_path):  # noqa: F811
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang")
    sharding.write_shards(docs, str(tmp_path / "s"), shards=5, rows_per_file=4)
    d = spark.read.parquet(str(tmp_path / "s"))
    want = {r.row: (r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs, 5).collect()}
    got = {r.row: (r.doc_id, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in d.collect()}
    assert got == want and len(got) == len(rows)
    files = d.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high")).collect()
    assert all(r.n <= 4 and r.low // 4 == r.high // 4 for r in files)
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("Row", F.lit(1)), str(tmp_path / "t"))


def test_op13(spark, folder):  # noqa: F811
    path, rows, _ = folder
    assert key(Q["op13_fill_in_middle"](spark, path).collect()) == key(infill.brute(i, t) for i, t in rows)


def test_infill_of_odd_texts(spark):
    rng = random.Random(5)
    texts = ["\n", "\n\n\n", "a\x00b\nc", "́accent\né\r\nx y\n", "<P", "<S>", "x<M>y", "<\n<P\n>P>\n<<", "tail\n<", "é" * 100_000 + "\n" + "z" * 300_000, "\n".join(invented(rng, 4) for _ in range(20_000)), "> starts\ń<"]
    rows = [(i * 7919 + j, t) for i, t in enumerate(texts) for j in range(6)] + [(None, "a\nb\n"), (1, None)]
    d = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, Text int")
    made = infill.fill_in_middle(d)
    got = made.collect()
    assert key((r.doc_id, r.restored) for r in got) == key((i, t or "") for i, t in rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert key((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output), sha(r.restored)) for r in got) == key(infill.brute(i, t) for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert key(infill.restore(made).collect()) == key((i, t or "") for i, t in rows)


def test_infill_parameters(spark):
    rows = [(i, "one two three four five") for i in range(300)]
    d = spark.createDataFrame(rows, "id long, body string")
    got = infill.fill_in_middle(d, "id", "body", seed=1, unit=r"\S*\s|\S+", markers=("[pre]", "{suf}", "(mid)"), infill_percent=60, spm_percent=0).collect()
    plain = sum(r.form == "plain" for r in got)
    assert {r.form for r in got} == {"plain", "psm"} and 80 < plain < 160 and all(r.restored == rows[0][1] and r.n == 5 for r in got)
    assert all(r.output.startswith("[pre]") and "{suf}" in r.output and "(mid)" in r.output for r in got if r.form == "psm")
    with pytest.raises(Exception, match="do not cover"):
        infill.fill_in_middle(d, "id", "body", unit=r"\S+").collect()
    for bad in (("a", "a", "b"), ("", "x", "y"), ("<a<", "x", "y"), ("<", "<b", "c"), ("x", "y")):
        with pytest.raises(ValueError):
            infill.infill_sql(markers=bad)
