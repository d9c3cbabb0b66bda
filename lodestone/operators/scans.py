"""Running sums and maxima over numbered rows: by blocks, and blocks of blocks, so that no task reads more than a block's rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and blocks of a block of blocks: one row is left of BLOCK * BLOCK, and only those are put in order by one task.
BLOCK = 4096


def running(df: DataFrame, n: str, values: dict[str, tuple[Callable[[Column], Column], str]]) -> DataFrame:
    """df with a column for each of `values`, name: (F.sum or F.max, column), over all rows up to and with the row, in the order of its number `n`.

    Numbers are unique and not negative, gaps do no harm. A max over nothing but nulls is null, a sum 0.
    """
    tops = [*values]

    def scan(d: DataFrame, over: Window, source: Callable[[str], str], name: str) -> DataFrame:
        return d.withColumns({name + v: values[v][0](F.col(source(v))).over(over) for v in tops})

    def up_to(d: DataFrame, totals: DataFrame, on: str, within: str, before: str, out: str) -> DataFrame:
        joined = d.join(totals, on, "left")
        both = {v: F.coalesce(F.col(within + v), F.lit(0)) + F.coalesce(F.col(before + v), F.lit(0)) if values[v][0] is F.sum else F.greatest(within + v, before + v) for v in tops}
        return joined.withColumns({out + v: c for v, c in both.items()})

    def earlier(over: Window) -> Window:
        return over.rowsBetween(Window.unboundedPreceding, -1)

    rows = df.withColumn("_b", F.floor(F.col(n) / BLOCK))
    blocks = rows.groupBy("_b").agg(*[values[v][0](values[v][1]).alias("t_" + v) for v in tops]).withColumn("_c", F.floor(F.col("_b") / BLOCK))
    tallest = blocks.groupBy("_c").agg(*[values[v][0]("t_" + v).alias("t_" + v) for v in tops])
    tallest = scan(tallest, earlier(Window.orderBy("_c")), lambda v: "t_" + v, "u_").select("_c", *["u_" + v for v in tops])
    blocks = up_to(scan(blocks, earlier(Window.partitionBy("_c").orderBy("_b")), lambda v: "t_" + v, "w_"), tallest, "_c", "w_", "u_", "p_").select("_b", *["p_" + v for v in tops])
    own = scan(rows, Window.partitionBy("_b").orderBy(n).rowsBetween(Window.unboundedPreceding, 0), lambda v: values[v][1], "o_")
    return up_to(own, blocks, "_b", "o_", "p_", "").select(*df.columns, *tops)
