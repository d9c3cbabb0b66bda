"""The row-wise operators over streams: the same functions, the same results as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.rules import IRON, ScreenPack
from lodestone.operators.candidates import extract_candidates
from lodestone.operators.screening import screen


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


def stream_candidates(texts: DataFrame, key: str = "doc_id", text: str = "text", context: int = 2) -> DataFrame:
    return extract_candidates(texts, key, text, context)


def stream_screen(records: DataFrame, pack: ScreenPack = IRON) -> DataFrame:
    return screen(records, pack)


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to parquet; with `once`, what is there now, and then it ends."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
