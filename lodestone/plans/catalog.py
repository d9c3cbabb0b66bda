"""All queries of the engine's own operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import extraction, records, rows, screens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**extraction.QUERIES, **records.QUERIES, **screens.QUERIES, **rows.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**extraction.ORACLES, **records.ORACLES, **screens.ORACLES, **rows.ORACLES}
