"""Global row numbers: a table is sorted by range and written once, and its rows are numbered where they lie in its files.

A range sort samples its borders, so a plan that is evaluated twice may deal the same rows out in two ways. Here the
sorted table is written before anything is counted: counts and numbers come from the same files, whatever the borders
were, with or without adaptive execution and however often a task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The order of part files: the number of the task, then that of the file within it.
_TASK, _FILE = r"part-(\d+)-", r"-c(\d+)\."


def write_sorted(df: DataFrame, order: list[Column], path: str, mode: str = "error") -> None:
    """Rows in the order of `order` over all part files of a new Parquet table; rows that are equal in it stand in any order among themselves.

    Rows are dealt out by ranges of `order`, so no task gets all of them unless they are all equal in it; where very many
    may be, give a column that tells them apart as the last key.
    """
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).parquet(path)


def by_files(spark: SparkSession, path: str, name: str, first: int = 0) -> DataFrame:
    """The rows of a Parquet table with numbers `first`, `first` + 1, .. in the order of its part files; name must not be one of its columns.

    A file's number of rows comes from its footer, and a row's place from its file: nothing is sorted, shuffled or gathered but one row for each file.
    """
    table = spark.read.parquet(path)
    if name in table.columns:
        raise ValueError(f"there is a column {name} already")
    sizes = table.groupBy(F.col("_metadata.file_name").alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    place = [F.regexp_extract("_file", _TASK, 1).cast("long"), F.regexp_extract("_file", _FILE, 1).cast("long"), F.col("_file")]
    starts = sizes.select("_file", (F.sum("_n").over(Window.orderBy(*place)) - F.col("_n") + first).alias("_start"))
    rows = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return rows.join(F.broadcast(starts), "_file").select(*[F.col(f"`{c}`") for c in table.columns], (F.col("_start") + F.col("_row")).alias(name))


def numbered(df: DataFrame, order: list[Column], name: str, path: str, first: int = 0) -> DataFrame:
    """df with its rows' numbers in the order of `order`, from a sorted table written to `path`, which has to stay as long as the result is used."""
    write_sorted(df, order, path)
    return by_files(df.sparkSession, path, name, first)
