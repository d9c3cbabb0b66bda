"""Joins to a table with one row a key, where some keys may be those of very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with more than a 2,000th of all rows (and more than 10,000) are 2,000 at most, so they may be sent everywhere.
SHARE, FEW_ROWS = 2_000, 10_000


def lookup(left: DataFrame, right: DataFrame, key: str, n: str, spread: Column) -> DataFrame:
    """left, joined (left outer) to right on `key`, which is unique there; `n` of right, which goes, is the number of rows of left with the key, or more.

    Keys of very many rows are few by their counts and are broadcast; their rows are dealt out by `spread`, a column of
    left, and all others meet by the key. Neither table may have columns that begin with an underscore.
    """
    limit = right.agg(F.sum(n).alias("_all")).select(F.greatest(F.floor(F.coalesce("_all", F.lit(0)) / SHARE), F.lit(FEW_ROWS)).alias("_limit"))  # one row
    counted = right.crossJoin(F.broadcast(limit))
    values = [c for c in right.columns if c not in (key, n)]
    hot = counted.where(F.col(n) > F.col("_limit")).select(key, F.struct(*values).alias("_hot"))
    cold = counted.where(F.col(n) <= F.col("_limit")).select(key, F.struct(*values).alias("_cold"), F.lit(-1).alias("_salt"))
    d = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), -1).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 20))).cast("int"))
    d = d.join(cold, [key, "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return d.select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values])
