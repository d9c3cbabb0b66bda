"""Streams with state against the same rows in one batch: any split, a restart, late rows."""

from __future__ import annotations

import json
import os
import random

import pytest

from lodestone.operators import linkage, logs
from lodestone.sources import versioned
from lodestone.streaming import stateful

SCHEMA = "row long, seq long, status string"


def drop_files(folder, rows, split):
    folder.mkdir(exist_ok=True)
    n = len(list(folder.iterdir()))
    for k in range(0, len(rows), split):
        file = folder / f"{n + k:05d}.json"
        file.write_text("\n".join(json.dumps(r) for r in rows[k : k + split]))
        os.utime(file, (1.7e9 + n + k,) * 2)  # files are read in the order of their times


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


@pytest.mark.parametrize("split", [7, 60])
def test_log_upserts_equal_the_batch(spark, tmp_path, split):
    rng = random.Random(split)
    seqs = rng.sample(range(1000), 60)
    rows = [{"row": rng.randint(0, 9), "seq": s, "status": f"s{s}"} for s in seqs]
    src, log, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "check")
    drop_files(src, rows[:35], split)
    stateful.upsert_log(stream(spark, src, SCHEMA), log, "row", SCHEMA, check, "seq").awaitTermination()
    drop_files(src, rows[35:], split)
    stateful.upsert_log(stream(spark, src, SCHEMA), log, "row", SCHEMA, check, "seq").awaitTermination()  # started again
    want = {(r["row"], r["seq"], r["status"]) for r in rows if r["seq"] == max(x["seq"] for x in rows if x["row"] == r["row"])}
    assert {tuple(r) for r in stateful.read_log(spark, log, SCHEMA).collect()} == want
    before = versioned.version(spark, log)
    stateful.upsert_log(stream(spark, src, SCHEMA), log, "row", SCHEMA, str(tmp_path / "check2"), "seq").awaitTermination()  # progress lost
    assert {tuple(r) for r in stateful.read_log(spark, log, SCHEMA).collect()} == want and versioned.version(spark, log) == before


def collected(spark, df, check):
    out = []
    df.writeStream.foreachBatch(lambda b, n: out.extend(tuple(r) for r in b.collect())).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return out


def test_latest_states_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = [{"row": rng.randint(0, 5), "seq": s, "status": rng.choice("abc")} for s in rng.sample(range(500), 40)]
    src, check = tmp_path / "in", str(tmp_path / "check")
    seen = {}
    for part in (rows[:17], rows[17:18], rows[18:]):
        drop_files(src, part, 9)
        for row, status, seq in collected(spark, stateful.latest_states(stream(spark, src, SCHEMA), ["row"], "seq", "status"), check):
            seen[row] = (status, seq)
    batch = logs.latest(spark.createDataFrame([(r["row"], r["seq"], r["status"]) for r in rows], SCHEMA), ["row"], "seq", "status")
    assert seen == {r.row: (r.status, r.seq) for r in batch.collect()}


def test_first_of_key_equals_the_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [{"ord": o, "doi": rng.choice(["", "a", "b", "c", None, "d"])} for o in rng.sample(range(100), 50)]
    src, check = tmp_path / "in", str(tmp_path / "check")
    firsts = {}
    for part in (rows[:20], rows[20:]):
        drop_files(src, part, 6)
        for key, first, closed in collected(spark, stateful.first_of_key(stream(spark, src, "ord long, doi string"), "doi", "ord"), check):
            assert not closed and first < firsts.get(key, 10**9)
            firsts[key] = first
    d = spark.createDataFrame([(r["ord"], r["doi"] or "") for r in rows], "ord long, doi_key string")
    want = {r.ord: r.cluster for r in linkage.by_key(d, "doi_key").collect()}
    assert {r["ord"]: firsts.get(r["doi"], r["ord"]) if r["doi"] else r["ord"] for r in rows} == want


def test_first_of_key_is_given_up(spark, tmp_path):
    src, check = tmp_path / "in", str(tmp_path / "check")
    at = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    rows = [(5, "a", 0), (4, "a", 20), (9, "b", 200), (3, "a", 1), (8, "b", 205), (2, "a", 300), (1, "z", 900)]
    drop_files(src, [{"ord": o, "doi": k, "t": at(s)} for o, k, s in rows], 1)
    out = collected(spark, stateful.first_of_key(stream(spark, src, "ord long, doi string, t timestamp"), "doi", "ord", "t", "30 seconds"), check)
    assert ("a", 4, True) in out and ("a", 3, False) not in out  # given up at 200; the row of second 1 came too late
    assert out.index(("a", 4, True)) < out.index(("a", 2, False)) and ("b", 8, True) in out
