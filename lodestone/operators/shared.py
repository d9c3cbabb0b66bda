"""The folder that driver and executors share, for tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is not set, as in tests, a local session gets a folder of its own; a cluster without it is an error, as a folder of one machine would lose data.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or (known.get() if known.isDefined() else None)
    if not found and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = found or tempfile.mkdtemp(prefix="lodestone-")
    if not known.isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the driver ends, as results may be read from it until then."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


#: Bytes of a batch that goes to a Python worker, unless the session says another number than Spark's default.
BATCH_BYTES = 8 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, whatever the rows' lengths: 10,000 long pages would be up to 64 MB before they are strings and tags."""
    try:
        if spark.conf.get(_SETTING) in ("67108864b", "64MB", "64m"):
            spark.conf.set(_SETTING, str(BATCH_BYTES))
    except Exception as e:  # a Spark without the setting
        if "SQL_CONF_NOT_FOUND" not in str(e):
            raise
