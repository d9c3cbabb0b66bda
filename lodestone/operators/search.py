"""Search: what is kept of each query's results, and the log of the search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Columns of the search log, and the search modes.
LOG_COLUMNS = ("timestamp_utc", "source_database", "search_query", "search_group", "search_mode", "results_returned", "status", "notes")
KEYWORD, OK, FAILED, SKIPPED = "keyword search", "OK", "ERROR", "SKIPPED"
REFUSED, REFUSED_NOTE, GIVES_UP = "RATE LIMITED", "Set SEMANTIC_SCHOLAR_API_KEY for improved coverage.", "Semantic Scholar"


def first_per_query(records: DataFrame, n: int, by: tuple[str, ...] = ("source_database", "search_query"), order: str = "ord") -> DataFrame:
    """The first n records of each source and query."""
    w = Window.partitionBy(*by).orderBy(order)
    return records.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def search_log(queries: DataFrame, results: DataFrame, sources: tuple[str, ...], errors: DataFrame | None = None, mode: str = KEYWORD, now: Column | None = None) -> DataFrame:
    """LOG_COLUMNS, all strings: a row for each source and query, with the number of its results.

    queries: group, query; results: source_database, search_query (a row for each record found); errors:
    source_database, search_query, error, for calls that failed.
    """
    asked = queries.select(F.explode(F.array(*map(F.lit, sources))).alias("source_database"), F.col("query").alias("search_query"), F.col("group").alias("search_group"))
    key = ["source_database", "search_query"]
    found = results.groupBy(*key).agg(F.count("*").alias("n"))
    d = asked.join(found, key, "left")
    d = d.join(errors.select(*key, "error"), key, "left") if errors is not None else d.withColumn("error", F.lit(None).cast("string"))
    failed = F.col("error").isNotNull()
    return d.select(
        F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp_utc"), *key, "search_group", F.lit(mode).alias("search_mode"),
        F.when(failed, "0").otherwise(F.coalesce("n", F.lit(0)).cast("string")).alias("results_returned"), F.when(failed, FAILED).otherwise(OK).alias("status"), F.coalesce("error", F.lit("")).alias("notes"),
    )


def stop_after_refusal(calls: DataFrame, status: str = "http_status", order: str = "ord") -> DataFrame:
    """calls (one service's, in order) with outcome: OK, ERROR, or SKIPPED after a call that was refused for too many requests (429); that call itself is an ERROR.

    The calls of one service are as many as there are queries.
    """
    refused = calls.where(F.col(status) == 429).agg(F.min(order).alias("_first"))
    d = calls.crossJoin(F.broadcast(refused))  # one row
    late = F.coalesce(F.col(order) > F.col("_first"), F.lit(False))
    return d.withColumn("outcome", F.when(late, SKIPPED).when(F.col(status).between(200, 299), OK).otherwise(FAILED)).drop("_first")


def with_refusals(log: DataFrame, calls: DataFrame, source: str = GIVES_UP) -> DataFrame:
    """The log of a service that gives up at the first call that is refused for too many requests: that call's line says so, later ones have none.

    calls: source_database, search_query, ord (of the queries), http_status (null for calls that went well). Lines of other services stay.
    """
    mine = calls.where(F.col("source_database") == source)
    first = mine.where("http_status = 429").agg(F.min("ord").alias("_first"))
    at = mine.select(F.col("search_query").alias("_query"), F.col("ord").alias("_ord")).crossJoin(F.broadcast(first))  # one row
    d = log.join(at, (F.col("search_query") == F.col("_query")) & (F.col("source_database") == source), "left").where("_first is null or _ord <= _first")
    here = F.coalesce(F.col("_ord") == F.col("_first"), F.lit(False))
    return d.withColumns({"results_returned": F.when(here, "0").otherwise(F.col("results_returned")), "status": F.when(here, REFUSED).otherwise(F.col("status")), "notes": F.when(here, REFUSED_NOTE).otherwise(F.col("notes"))}).select(*log.columns)
