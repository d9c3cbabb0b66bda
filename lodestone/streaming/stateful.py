"""Streams that remember: the latest state of a key, the first record of a key, and logs that are kept up to date.

Each gives what its batch counterpart gives for the same rows, however they are split into micro-batches and whether or
not the query is stopped and started again in between: state and progress are in the checkpoint, results that are written
carry the number of their micro-batch, so that one that is run again is not counted twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators import logs
from lodestone.sources import versioned


def latest_states(events: DataFrame, by: list[str], seq: str, value: str) -> DataFrame:
    """The value with the highest seq of each key, as :func:`lodestone.operators.logs.latest` gives it; a row each time a key changes (output mode update)."""
    return logs.latest(events, by, seq, value)


def first_of_key(records: DataFrame, key: str, ord_col: str, time: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """key, first, closed: the least ord of a key, a row when it is first known and when a smaller one comes (output mode update).

    Blank and null keys have no first. With `time`, a key is given up when the watermark (the latest time less `delay`) has
    passed its last record's: it then has one more row, closed, and records that come later than that start it anew; records
    later than the watermark are left out.
    """
    d = records.where(F.col(key).isNotNull() & (F.col(key) != "")).select(F.col(key).cast("string").alias("key"), F.col(ord_col).cast("long").alias("ord"), *([F.col(time).cast("timestamp").alias("time")] if time else []))
    d = d.withWatermark("time", delay) if time else d

    def run(keys: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first = state.get[0]
            state.remove()
            yield pd.DataFrame({"key": [keys[0]], "first": [first], "closed": [True]})
            return
        known, last = state.get if state.exists else (None, 0)
        mark = state.getCurrentWatermarkMs() if time else 0
        if time and known is not None and last < mark:  # its time was over before these rows came
            yield pd.DataFrame({"key": [keys[0]], "first": [known], "closed": [True]})
            known, last = None, 0
        first = known
        for p in parts:
            at = p["time"].map(lambda x: int(x.timestamp() * 1000)) if time else None
            p = p[at >= mark] if time else p
            if len(p):
                low = int(p["ord"].min())
                first = low if first is None else min(first, low)
                last = max(last, int(at[at >= mark].max())) if time else last
        if first is None:
            if state.exists:
                state.remove()
            return
        state.update((first, last))
        if time:
            state.setTimeoutTimestamp(max(last, mark) + 1)
        if first != known:
            yield pd.DataFrame({"key": [keys[0]], "first": [first], "closed": [False]})

    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return d.groupBy("key").applyInPandasWithState(run, "key string, first long, closed boolean", "first long, last long", "update", timeout)


_BATCH = "_batch"


def upsert_log(rows: DataFrame, path: str, key: str, schema: str, checkpoint: str, order: str, once: bool = True) -> StreamingQuery:
    """A stream of log lines into a versioned table (see :mod:`lodestone.sources.versioned`): of each key the line with the highest `order`.

    The table keeps, in a column of its own, the number of the micro-batch that wrote it last; one that is there already is
    passed over when the query is started again after it stopped between writing and noting its progress. `order` tells
    lines of one key apart, so lines may come in any order.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = versioned.version(spark, path)
        old = versioned.read(spark, path, f"{schema}, {_BATCH} long")
        done = old.agg(F.max(_BATCH)).first()[0]
        if done is not None and done >= number:
            return
        names = [c for c in old.columns if c != _BATCH]
        both = old.select(*names).unionByName(batch.select(*names))
        newest = both.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_line")).select("_line.*")
        versioned.replace(newest.withColumn(_BATCH, F.lit(number).cast("long")), path, base)

    w = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that :func:`upsert_log` keeps."""
    return versioned.read(spark, path, f"{schema}, {_BATCH} long").drop(_BATCH)
