"""What several operators of this subpackage share: column picking, the shared folder, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name.

    Other columns may have any name, also one that differs in case only or occurs twice
    (the first of equal names counts); a missing one raises ValueError.
    """
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long and text string, with an empty string for a null text."""
    d = pick(df, id_col, text_col).toDF("doc_id", "text")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def map_whole(df: DataFrame, run: Callable, extra: str = "") -> DataFrame:
    """mapInArrow over all columns of df, whatever their names, with the columns of `extra` ("name type, ..") after them.

    `run` gets and gives record batches by position; names that the extra columns share with df's stay as they are.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    more = [x.strip().split(" ", 1) for x in extra.split(",") if x.strip()]
    schema = StructType(plain.schema.fields)
    for i, (_, kind) in enumerate(more):
        schema = StructType([*schema.fields, StructField(f"e{i}", kind_of(kind))])
    names = schema.fieldNames()

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=names)

    return plain.mapInArrow(renamed, schema).toDF(*df.columns, *[n for n, _ in more])


def kind_of(name: str):
    return {"double": DoubleType(), "long": LongType(), "string": StringType(), "binary": BinaryType()}[name]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is missing, as in tests, a local session gets a folder of its own;
    a cluster without the setting is an error, as a machine-local folder would lose data.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="lodestone-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for tables between steps; it goes when the driver ends, as results may be read from it until then."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


#: Rows of a table of short rows that may be sent to every executor: some MB.
FEW = 100_000


def if_few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """A written table, marked to be sent to every executor if it has few rows, which are counted here; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of a batch that goes to a Python worker, unless the session says another number than Spark's default.
BATCH_BYTES = 8 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker and its JVM side hold at once, whatever the texts' lengths: 10,000 rows of long texts would be up to 64 MB on both sides."""
    try:
        if spark.conf.get(_SETTING) in ("67108864b", "64MB", "64m"):
            spark.conf.set(_SETTING, str(BATCH_BYTES))
    except Exception as e:  # a Spark without the setting
        if "SQL_CONF_NOT_FOUND" not in str(e):
            raise


def release() -> None:
    """Gives memory that is free back to the system, as workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Of a function over batches: what it has taken goes back at its end."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


_KEPT: list = [None, None]


def kept(key: object, build: Callable[[], object]) -> object:
    """What a worker keeps between tasks, one thing at a time: whatever another operator kept before goes first, as workers serve one operator after the other."""
    if _KEPT[0] != key:
        _KEPT[:] = [None, None]
        release()
        _KEPT[:] = [key, build()]
    return _KEPT[1]


def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


_TRIM = _trim()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder, dealt out over all cores where its files fall into fewer parts than there are cores; a large table stays as its files lie."""
    small_batches(spark)
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


#: Lower-cases A-Z in UTF-8 bytes and leaves all else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = {"p": _powers(_P, 1 << 12), "i": _powers(_P_INV, 1 << 12)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_POW[kind]) <= n:
        _POW[kind] = _powers(_P if kind == "p" else _P_INV, 2 * n)
    return _POW[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: White space of the word definition [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: bytes, space: np.ndarray = SPACE, part: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte offsets) and 64-bit hashes of the words of one UTF-8 text.

    A word's hash depends on its bytes alone, so equal words have equal hashes in any document.
    A long text is worked off in parts that end at white space, to bound memory.
    """
    if len(data) <= part:
        return _words(data, space)
    b, at, found = np.frombuffer(data, np.uint8), 0, []
    while at < len(data):
        to = min(at + part, len(data))
        while to < len(data):
            gap = np.flatnonzero(space[b[to : to + part]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(to + part, len(data))
        s, e, h = _words(data[at:to], space)
        found.append((s + at, e + at, h))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _words(data: bytes, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    sep = np.empty(len(b) + 2, bool)
    sep[0] = sep[-1] = True
    sep[1:-1] = space[b]
    edge = np.flatnonzero(sep[1:] != sep[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _power("p", len(b))[: len(b)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * _power("i", len(b))[starts] + (ends - starts).astype(np.uint64))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words: one for each start, none when there are fewer words."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power("p", len(h))[: len(h)], out=sums[1:])
    n = len(h) - k + 1
    return mix((sums[k:] - sums[:n]) * _power("i", n)[:n])


