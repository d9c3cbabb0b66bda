"""The stages from search to extraction over saved payloads and pages: each reads what the one before wrote, writes its tables, a log event and returns its statistics.

Nothing is fetched: search reads payload files (``search.payloads`` of the config names one file for each service), download
reads what attempts gave (``pdf_download.attempts``: row, ordinal, source, url, content, content_type), full-text screening
reads pages (``fulltext.pages``: row, page_no, text).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import paper_filename, safe_filename
from lodestone.operators import acquisition, citations, fulltext, linkage, logs, numbering, papers, screening, search
from lodestone.sources import config as configs
from lodestone.sources import files, payloads, versioned

Config = dict[str, Any]


def _place(cfg: Config, name: str) -> str:
    return f"{cfg['output']['data_subdir']}/{name}"


def _load(spark: SparkSession, cfg: Config, name: str) -> DataFrame:
    path = _place(cfg, name)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(f"output of an earlier stage not found: {path}")
    return spark.read.parquet(path)


def _save(df: DataFrame, cfg: Config, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(_place(cfg, name))
    return df.sparkSession.read.parquet(_place(cfg, name))


def _done(spark: SparkSession, cfg: Config, event: str, stats: dict[str, Any]) -> dict[str, Any]:
    files.append_event(spark, f"{cfg['output']['logs_dir']}/pipeline", event, prefix=cfg["output"].get("prefix", ""), **stats)
    return stats


def _numbered(df: DataFrame, cfg: Config, order: str, key: str, first: int, name: str) -> DataFrame:
    """The table `name`: df in the order of a column, with places from `first` on."""
    place = _place(cfg, f"{name}_sorted")
    numbering.write_sorted(df, [F.col(order).asc_nulls_first()], place, "overwrite")
    return _save(numbering.by_files(df.sparkSession, place, key, first), cfg, name)


def _works(spark: SparkSession, cfg: Config, merged: DataFrame) -> DataFrame:
    """What citations are looked up in: the saved works that the configuration names, numbered, else the records themselves."""
    path = cfg["search"].get("works")
    if path:
        found = payloads.openalex_records(payloads.read_payloads(spark, path, "openalex"), F.coalesce("type", F.lit("")).alias("type")).withColumn("read_no", F.monotonically_increasing_id())
        works = _numbered(found, cfg, "read_no", "ord", 0, "works").drop("read_no")
    else:
        works = merged.withColumn("type", F.when(F.col("record_type") == "primary", "article").otherwise(""))
    return works.where("openalex_id <> ''").dropDuplicates(["openalex_id"]).withColumn("id", F.col("openalex_id"))


def literature_search(spark: SparkSession, cfg: Config) -> dict[str, Any]:
    """Records of all services, at most `per_query` a query, duplicates merged; then what the best of them cite and what cites them, and duplicates merged again.

    `search.payloads` names a file for each service, `search.works` saved works that citations are looked up in, `search.errors`
    calls that failed (source_database, search_query, error, http_status). A service whose file cannot be read is logged and left out.
    """
    own, limit = cfg["search"], cfg["search"].get("per_query", 12)
    threshold = cfg.get("screening", {}).get("title_threshold", linkage.THRESHOLD)
    parts = {}
    for s in own.get("sources", payloads.READERS):
        if s in own["payloads"]:
            try:
                parts[s] = payloads.read_payloads(spark, own["payloads"][s], s)
            except AnalysisException as e:
                files.append_event(spark, f"{cfg['output']['logs_dir']}/pipeline", "search_source_error", source=_SERVICES[s], error=str(e))
    found = payloads.union_sources(parts, tuple(parts)).withColumn("read_no", F.monotonically_increasing_id())  # by service, then as the files lie
    found = _numbered(found, cfg, "read_no", "ord", 0, "raw_records").drop("read_no", "source_no")
    raw = search.first_per_query(found, limit)
    merged = _save(linkage.deduplicate(raw, threshold), cfg, "merged_records")
    works = _works(spark, cfg, merged)
    best = merged.withColumns({"id": F.col("openalex_id"), "cited_by": F.col("cited_by_count")})
    cited, calls = citations.expand(best, works, own.get("max_reviews", citations.MAX_REVIEWS), own.get("max_primary", citations.MAX_PRIMARY), own.get("reference_prefix", citations.OPENALEX_PREFIX))
    after = Window.orderBy("place", "n", "id")  # a few thousand rows at most
    cited = cited.withColumn("ord", F.row_number().over(after) - 1 + F.lit(found.count())).select("ord", *payloads.RECORD)
    cited = _save(cited, cfg, "citation_records")
    calls = _save(calls, cfg, "citation_log")
    queries = payloads.queries_of(spark, own.get("query_groups", {}))
    errors = spark.read.schema("source_database string, search_query string, error string, http_status int").json(own["errors"]) if "errors" in own else None
    log = search.search_log(queries.select("group", "query"), raw, tuple(_SERVICES[s] for s in parts), errors)
    if errors is not None:
        order = queries.select(F.col("query").alias("search_query"), (F.col("group_no") * 1_000_000 + F.col("query_no")).alias("ord"))
        asked = order.crossJoin(spark.createDataFrame([(_SERVICES[s],) for s in parts], "source_database string"))  # three rows
        log = search.with_refusals(log, asked.join(errors.drop("error"), ["source_database", "search_query"], "left"))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    chased = calls.select(stamp.alias("timestamp_utc"), F.lit("OpenAlex").alias("source_database"), F.col("query").alias("search_query"), F.col("mode").alias("search_group"), F.lit(citations.CHASING).alias("search_mode"), "results_returned", "status", "notes")
    _save(log.unionByName(chased), cfg, "search_log")
    master = _save(linkage.deduplicate(merged.select("ord", *payloads.RECORD).unionByName(cited), threshold), cfg, "master_records")
    stats = {"raw_records": raw.count(), "citation_records": cited.count(), "deduplicated_records": master.count(), "output": _place(cfg, "master_records")}
    return _done(spark, cfg, "literature_search_complete", stats)


_SERVICES = {"openalex": "OpenAlex", "crossref": "Crossref", "semantic_scholar": "Semantic Scholar"}


def title_abstract_screening(spark: SparkSession, cfg: Config) -> dict[str, Any]:
    screened = _save(screening.screen(_load(spark, cfg, "master_records"), configs.screen_pack(cfg)), cfg, "screened_records")
    kept = screened.where(F.col("inclusion_decision") != "Exclude")
    strict = _numbered(screening.strict(screened), cfg, "ord", "row", 1, "strict_records")
    files.write_sheets({"all_screened": screened, **screening.sheets(screened), "strict": strict}, f"{cfg['output']['outputs_dir']}/screened")
    stats = {"total": screened.count(), "included": kept.count(), "excluded": screened.where(F.col("inclusion_decision") == "Exclude").count(), "strict_h2": strict.count(), "output": _place(cfg, "strict_records")}
    return _done(spark, cfg, "screening_complete", stats)


def pdf_download(spark: SparkSession, cfg: Config, row: int | None = None) -> dict[str, Any]:
    """How saved attempts ended, row by row: the first valid file counts, and the log keeps one line a row."""
    own = cfg.get("pdf_download", {})
    records = acquisition.pick_row(_load(spark, cfg, "strict_records"), row)
    tried = spark.read.parquet(own["attempts"]).join(records.select("row"), "row")
    ok = acquisition.valid_file(F.col("content"), F.coalesce("content_type", F.lit("")), own.get("min_pdf_bytes", acquisition.MIN_BYTES))
    place = f"{cfg['output']['logs_dir']}/downloads"
    base = versioned.version(spark, place)
    before = versioned.read(spark, place, _DOWNLOADS)
    exists = records.join(before.where("status in ('SUCCESS', 'REUSED')").select("row", F.lit(True).alias("exists")), "row", "left").select("row", F.coalesce("exists", F.lit(False)).alias("exists"))
    status = acquisition.attempt_status(exists, tried.select("row", "ordinal", "url", ok.alias("ok")))
    named = records.select("row", "doi", "title", "year", F.when(F.col("doi") != "", safe_filename(F.translate("doi", "/", "_"))).otherwise(paper_filename(F.col("year"), F.col("authors"), F.col("title"))).alias("file"))
    lines = named.join(status, "row").select("row", "doi", F.substring("title", 1, 60).alias("title"), "year", "status", F.when(F.col("status").isin("SUCCESS", "REUSED"), F.col("file")).otherwise("").alias("pdf_path"), "url")
    versioned.replace(logs.upsert_sorted(before, lines), place, base)
    log = versioned.read(spark, place, _DOWNLOADS)
    n = {r.status: r["count"] for r in log.join(records.select("row"), "row").groupBy("status").count().collect()}
    good, reused = n.get("SUCCESS", 0), n.get("REUSED", 0)
    return _done(spark, cfg, "pdf_download_complete", {"success": good, "failed": sum(n.values()) - good - reused, "reused": reused})


_DOWNLOADS = "row long, doi string, title string, year string, status string, pdf_path string, url string"


def fulltext_screening(spark: SparkSession, cfg: Config) -> dict[str, Any]:
    records = _load(spark, cfg, "strict_records")
    log = versioned.read(spark, f"{cfg['output']['logs_dir']}/downloads", _DOWNLOADS).select("row", F.col("status").isin("SUCCESS", "REUSED").alias("has_pdf"))
    pages = spark.read.parquet(cfg["fulltext"]["pages"])
    errors = pages.groupBy("row").agg(F.max("error").alias("error")) if "error" in pages.columns else pages.select("row", F.lit(None).cast("string").alias("error")).distinct()
    d = records.join(log, "row", "left").join(errors, "row", "left").withColumn("has_pdf", F.coalesce("has_pdf", F.lit(False)))
    found = _save(fulltext.classify(d, pages.select("row", "page_no", "text"), key="row"), cfg, "fulltext_screening")
    files.write_sheets({"fulltext": found}, f"{cfg['output']['outputs_dir']}/fulltext")
    n = {r.classification: r["count"] for r in found.groupBy("classification").count().collect()}
    return _done(spark, cfg, "fulltext_screening_complete", {"screened": sum(n.values()), "confirmed": n.get(papers.CONFIRMED, 0), "by_class": n})


def reaction_data_extraction(spark: SparkSession, cfg: Config) -> dict[str, Any]:
    """Values of confirmed papers, in the columns that the config names."""
    kept = papers.confirmed(_load(spark, cfg, "fulltext_screening"))
    texts = files.pages_to_text(spark.read.parquet(cfg["fulltext"]["pages"]), "row")
    paths = versioned.read(spark, f"{cfg['output']['logs_dir']}/downloads", _DOWNLOADS).select("row", "pdf_path")
    d = kept.select("row", "doi", "title", "authors", "year", "journal", "has_pdf").join(paths, "row", "left").join(texts, "row", "left")
    found = papers.extract_papers(d, configs.screen_pack(cfg), has_pdf="has_pdf")
    found = _save(papers.with_columns(found, cfg.get("extraction", {}).get("columns")), cfg, "reaction_data")
    files.write_sheets({"reaction_data": found, "all_confirmed_metadata": kept}, f"{cfg['output']['outputs_dir']}/reactions")
    return _done(spark, cfg, "extraction_complete", {"records_extracted": found.count(), "output": _place(cfg, "reaction_data")})


RUN: dict[str, Callable[..., dict[str, Any]]] = {
    "literature_search": literature_search, "title_abstract_screening": title_abstract_screening, "pdf_download": pdf_download, "fulltext_screening": fulltext_screening, "reaction_data_extraction": reaction_data_extraction,
}


def run_id(name: str, now: datetime | None = None) -> str:
    for c in " /\\":
        name = name.replace(c, "_")
    return f"{name}_{(now or datetime.now(UTC)):%Y%m%d_%H%M%S}"


def run(spark: SparkSession, stage: str, cfg: Config, **options: Any) -> dict[str, Any]:
    """One stage, its states kept in the run log: running, then done with its statistics, or failed with the error."""
    if stage not in RUN:
        raise ValueError(f"unknown stage {stage}; there are {tuple(RUN)}")
    state = files.RunLog(spark, f"{cfg['output']['logs_dir']}/states")
    name = run_id(cfg.get("project", {}).get("name", "run"))
    state.start(name, stage, **options)
    try:
        stats = RUN[stage](spark, cfg, **options)
    except Exception as e:
        state.fail(name, stage, str(e))
        raise
    state.finish(name, stage, **stats)
    return stats


def load_config(path: str, base: str | None = None) -> Config:
    return configs.load_project(path, base, Path(path).parent)
