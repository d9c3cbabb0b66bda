"""Files: whole texts, JSON and JSON lines, pages, logs; and sinks for tables, sheets, events and states."""

from __future__ import annotations

from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.logs import STAGES, latest


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), text: each file one document."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def pages_to_text(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: pages in order, joined by line ends. pages: key, page_no, text (extracted before)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return pages.groupBy(key).agg(F.array_join(parts, "\n").alias("text"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log that earlier runs wrote; an empty one where there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), page_no (from 1), text, error (null if the file was read) of PDF files.

    Text comes from the library pypdf, where it is installed; without it this raises, and pages that were extracted before
    can be read as a table instead.
    """
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf; read pages that were extracted before with read_lines()") from e

    def run(batches):
        import io

        import pyarrow as pa
        import pypdf

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    pages, error = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages], None
                except Exception as e:  # a broken file is a row of its own, as one file must not end the run
                    pages, error = [""], str(e)
                n = len(pages)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(1, n + 1), pa.int32()), pa.array(pages), pa.array([error] * n, pa.string())], names=["doc_id", "page_no", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "doc_id string, page_no int, text string, error string")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document, an array of the rows; written row by row from the driver, so for results that a person reads."""
    rows = df.toJSON().toLocalIterator()
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(rows):
            f.write((",\n " if i else "\n ") + row)
        f.write("\n]\n")


def write_workbook(sheets: dict[str, DataFrame], path: str, columns: list[str] | None = None) -> None:
    """One .xlsx file with a sheet for each table, where openpyxl is installed; write_sheets() needs nothing."""
    try:
        from openpyxl import Workbook
    except ImportError as e:
        raise RuntimeError("workbooks need openpyxl; write_sheets() writes a folder a sheet") from e
    book = Workbook(write_only=True)
    for name, df in sheets.items():
        names, sheet = columns or df.columns, book.create_sheet(name)
        sheet.append(names)
        for r in df.toLocalIterator():
            sheet.append([str(r[c]) if c in df.columns and r[c] not in (None, "") else "" for c in names])
    book.save(path)


def write_sheets(sheets: dict[str, DataFrame], path: str, columns: list[str] | None = None) -> None:
    """A folder a sheet; every cell a string, nothing for what is missing."""
    for name, df in sheets.items():
        names = columns or df.columns
        df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in names]).write.mode("overwrite").json(f"{path}/{name}")


def append_event(spark: SparkSession, path: str, event: str, **fields: Any) -> None:
    """One event into a log of JSON lines: time, event, fields."""
    row = [(datetime.now(UTC), event, {k: str(v) for k, v in fields.items()})]
    spark.createDataFrame(row, "time timestamp, event string, fields map<string,string>").coalesce(1).write.mode("append").json(path)


class RunLog:
    """States of stages as appended events; the latest one counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _put(self, run_id: str, stage: str, status: str, extras: dict[str, Any]) -> None:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage}; there are {STAGES}")
        row = [(run_id, stage, status, datetime.now(UTC), {k: str(v) for k, v in extras.items()})]
        self.spark.createDataFrame(row, "run_id string, stage string, status string, time timestamp, extras map<string,string>").coalesce(1).write.mode("append").parquet(self.path)

    def start(self, run_id: str, stage: str, **extras: Any) -> None:
        self._put(run_id, stage, "running", extras)

    def finish(self, run_id: str, stage: str, **extras: Any) -> None:
        self._put(run_id, stage, "done", extras)

    def fail(self, run_id: str, stage: str, error: str) -> None:
        self._put(run_id, stage, "failed", {"error": error})

    def states(self) -> DataFrame:
        return latest(self.spark.read.parquet(self.path), ["run_id", "stage"], "time", "status")

    def is_done(self, run_id: str, stage: str) -> bool:
        return bool(self.states().where((F.col("run_id") == run_id) & (F.col("stage") == stage) & (F.col("status") == "done")).take(1))
