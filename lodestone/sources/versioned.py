"""Tables that are replaced as a whole: a reader sees the old one or the new one, wherever a writer stopped.

Each version is written to a folder of its own; what makes it the table is one small file, commits/<number>, that names
the folder and is renamed into place when the folder is complete. The highest number counts. A writer names the version
that it read; if another has been committed since, it fails and leaves the table as it is. Folders without a commit are
left-overs of writers that stopped: no reader looks at them, and :func:`vacuum` takes them away with old versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """The table has another version than the writer read."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _names(spark: SparkSession, path: str) -> list[str]:
    system, place = _files(spark, path)
    return [x.getPath().getName() for x in system.listStatus(place(path))] if system.exists(place(path)) else []


def version(spark: SparkSession, path: str) -> int:
    """Number of the version that counts, 0 where there is none."""
    return max((int(n) for n in _names(spark, f"{path}/commits") if n.isdigit()), default=0)


def folder(spark: SparkSession, path: str, number: int) -> str:
    system, place = _files(spark, path)
    stream = system.open(place(f"{path}/commits/{number}"))
    try:
        return f"{path}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The version that counts; an empty table where there is none yet."""
    number = version(spark, path)
    if not number:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder(spark, path, number))


def write(df: DataFrame, path: str) -> str:
    """Writes df to a folder of its own, which no reader looks at yet; its name."""
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    return name


def commit(spark: SparkSession, path: str, name: str, base: int) -> int:
    """Makes a written folder the version after `base`; its number. Raises Conflict if `base` is not the one that counts."""
    system, place = _files(spark, path)
    target, draft = place(f"{path}/commits/{base + 1}"), place(f"{path}/commits/_{uuid.uuid4().hex}")
    if not system.exists(place(f"{path}/{name}/_SUCCESS")):
        raise FileNotFoundError(f"{path}/{name} is not complete")
    stream = system.create(draft, False)
    stream.write(bytearray(name.encode()))
    stream.close()
    if version(spark, path) != base or system.exists(target) or not system.rename(draft, target):
        system.delete(draft, False)
        raise Conflict(f"{path} has version {version(spark, path)}, not {base}")
    return base + 1


def replace(df: DataFrame, path: str, base: int) -> int:
    """df as the version after `base`, which it may have been made from."""
    return commit(df.sparkSession, path, write(df, path), base)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes the folders of all but the last `keep` versions and those without a commit; to be run while no one writes. Their number."""
    system, place = _files(spark, path)
    numbers = sorted(int(n) for n in _names(spark, f"{path}/commits") if n.isdigit())
    kept = {folder(spark, path, n).rsplit("/", 1)[1] for n in numbers[-keep:]}
    gone = [n for n in _names(spark, path) if n.startswith("v-") and n not in kept]
    for n in numbers[:-keep]:
        system.delete(place(f"{path}/commits/{n}"), False)
    for n in gone:
        system.delete(place(f"{path}/{n}"), True)
    return len(gone)
