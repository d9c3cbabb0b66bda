"""Bibliographic records from saved API payloads: nested JSON with a fixed schema, no inference, no network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import abstract_from_index, clean_text, normalize_doi
from lodestone.operators.acquisition import oa_urls
from lodestone.operators.screening import record_type

# The fields that are read of each service's payload.
OPENALEX = (
    "id string, title string, doi string, type string, publication_year int, cited_by_count int, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<landing_page_url:string,source:struct<display_name:string>>,"
    " abstract_inverted_index map<string,array<int>>, referenced_works array<string>, best_oa_location struct<pdf_url:string>, locations array<struct<pdf_url:string>>"
)
CROSSREF = (
    "title array<string>, author array<struct<given:string,family:string>>, published struct<`date-parts`:array<array<int>>>, `container-title` array<string>, DOI string, URL string, type string, reference array<struct<DOI:string>>,"
    " link array<struct<URL:string,`content-type`:string>>"
)
SEMANTIC_SCHOLAR = "title string, authors array<struct<name:string>>, year int, venue string, url string, externalIds struct<DOI:string>, abstract string, citationCount int"
UNPAYWALL = "best_oa_location struct<url_for_pdf:string>, oa_locations array<struct<url_for_pdf:string>>"
SCHEMAS = {"openalex": OPENALEX, "crossref": CROSSREF, "semantic_scholar": SEMANTIC_SCHOLAR, "unpaywall": UNPAYWALL}

RECORD = ("title", "authors", "year", "journal", "doi", "url", "source_database", "search_query", "record_type", "inclusion_decision", "exclusion_reason", "confidence_score", "abstract", "openalex_id", "referenced_works", "cited_by_count", "notes")


def read_payloads(spark: SparkSession, path: str, service: str) -> DataFrame:
    """One payload a line, with the query that found it in the column `query` if the file has it."""
    return spark.read.schema(SCHEMAS[service] + ", query string").json(path)


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _record(values: dict[str, Column]) -> list[Column]:
    return [_blank(values.get(n, F.lit(""))).alias(n) for n in RECORD]


def _first(c: str) -> Column:
    return F.coalesce(F.get(F.col(c), 0), F.lit(""))


def openalex_records(payloads: DataFrame, *more: Column) -> DataFrame:
    """RECORD, and what more of a payload is asked for."""
    title = clean_text(F.col("title"))
    return payloads.select(
        *_record(
            {
                "title": title, "authors": F.array_join(F.transform("authorships", lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))), "; "), "year": F.col("publication_year"), "journal": F.col("primary_location.source.display_name"),
                "doi": normalize_doi(F.col("doi")), "url": F.coalesce("primary_location.landing_page_url", "id"), "source_database": F.lit("OpenAlex"), "search_query": F.col("query"), "record_type": record_type(title, F.coalesce("type", F.lit(""))),
                "abstract": abstract_from_index(F.col("abstract_inverted_index")), "openalex_id": F.col("id"), "referenced_works": F.array_join("referenced_works", "|"), "cited_by_count": F.coalesce("cited_by_count", F.lit(0)),
            }
        ),
        *more,
    )


def crossref_records(payloads: DataFrame) -> DataFrame:
    title = clean_text(_first("title"))
    names = F.filter(F.transform("author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), lambda x: x != "")
    refs = F.transform(F.filter(F.transform("reference", lambda r: r["DOI"]), lambda x: x.isNotNull() & (x != "")), lambda x: F.concat(F.lit("https://doi.org/"), x))
    return payloads.select(
        *_record(
            {
                "title": title, "authors": F.array_join(names, "; "), "year": F.get(F.get("published.date-parts", 0), 0), "journal": _first("container-title"), "doi": normalize_doi(F.col("DOI")), "url": F.col("URL"),
                "source_database": F.lit("Crossref"), "search_query": F.col("query"), "record_type": record_type(title, F.coalesce("type", F.lit(""))), "referenced_works": F.array_join(refs, "|"),
            }
        )
    )


def semantic_scholar_records(payloads: DataFrame) -> DataFrame:
    title = clean_text(F.col("title"))
    return payloads.select(
        *_record(
            {
                "title": title, "authors": F.array_join(F.transform("authors", lambda a: a["name"]), "; "), "year": F.col("year"), "journal": F.col("venue"), "doi": normalize_doi(F.col("externalIds.DOI")), "url": F.col("url"),
                "source_database": F.lit("Semantic Scholar"), "search_query": F.col("query"), "record_type": record_type(title, F.lit("")), "abstract": clean_text(F.col("abstract")), "cited_by_count": F.coalesce("citationCount", F.lit(0)),
            }
        )
    )


READERS = {"openalex": openalex_records, "crossref": crossref_records, "semantic_scholar": semantic_scholar_records}


def union_sources(parts: dict[str, DataFrame], sources: tuple[str, ...] = tuple(READERS)) -> DataFrame:
    """Records of the named services under one another, `source_no` their place in the list."""
    out = None
    for i, name in enumerate(sources):
        if name in parts:
            one = READERS[name](parts[name]).withColumn("source_no", F.lit(i))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no source has payloads")
    return out


def pdf_urls(payloads: DataFrame, service: str) -> DataFrame:
    """payloads with pdf_urls: distinct, the best first; within one service only."""
    if service == "openalex":
        urls = oa_urls(F.col("best_oa_location.pdf_url"), F.transform("locations", lambda x: x["pdf_url"]))
    elif service == "unpaywall":
        urls = oa_urls(F.col("best_oa_location.url_for_pdf"), F.transform("oa_locations", lambda x: x["url_for_pdf"]))
    elif service == "crossref":
        urls = oa_urls(F.lit(None).cast("string"), F.transform(F.filter("link", lambda x: x["content-type"].contains("pdf")), lambda x: x["URL"]))
    else:
        raise ValueError(f"{service} has no file locations")
    return payloads.withColumn("pdf_urls", urls)


def queries_of(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    """group_no, query_no, group, query of a config's query groups, in order."""
    rows = [(i, j, g, q) for i, (g, qs) in enumerate(groups.items()) for j, q in enumerate(qs)]
    return spark.createDataFrame(rows, "group_no int, query_no int, group string, query string")
