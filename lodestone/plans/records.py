"""Queries over bibliographic records made from documents: keys, duplicates, merging, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import abstract_from_index, index_of_words, normalize_doi, normalize_title, paper_filename, safe_filename
from lodestone.operators import citations, linkage, screening
from lodestone.plans.corpus import table, texts

QUERIES, ORACLES = {}, {}

#: DuckDB: records with ord, doi, title and so on.
RECORDS = r"""
select doc_id as ord, cast(doc_id as varchar) as id, array_to_string(list_slice(string_split(text, ' '), 1, 8), ' ') as title,
 case doc_id % 5 when 0 then 'https://doi.org/10.1/' || n_chars % 400 when 1 then 'doi:10.1/' || n_chars % 400 when 2 then ' HTTP://DX.DOI.ORG/10.1/' || n_chars % 400 when 3 then '10.1/' || n_chars % 400 else '' end as doi,
 case doc_id % 3 when 0 then 'OpenAlex' when 1 then 'Crossref; OpenAlex' else 'Semantic Scholar' end as source_database, lang as search_query,
 case when doc_id % 4 = 0 then 'review' when doc_id % 4 = 3 then 'unknown' else 'primary' end as record_type, n_chars as cited_by,
 (doc_id * 7 + 1) % 1000 || '|' || (doc_id * 13 + 5) % 1000 || '||' || (doc_id * 3) % 1000 as referenced_works, text as abstract from documents"""


def records(spark: SparkSession, d: str) -> DataFrame:
    key = (F.col("n_chars") % 400).cast("string")
    m = F.col("doc_id") % 5
    doi = F.when(m == 0, F.concat(F.lit("https://doi.org/10.1/"), key)).when(m == 1, F.concat(F.lit("doi:10.1/"), key)).when(m == 2, F.concat(F.lit(" HTTP://DX.DOI.ORG/10.1/"), key)).when(m == 3, F.concat(F.lit("10.1/"), key)).otherwise("")
    t, q = F.col("doc_id") % 3, F.col("doc_id") % 4
    refs = F.concat_ws("|", (F.col("doc_id") * 7 + 1) % 1000, (F.col("doc_id") * 13 + 5) % 1000, F.lit(""), (F.col("doc_id") * 3) % 1000)
    return texts(spark, d, "documents").select(
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.array_join(F.slice(F.split("text", " ", 9), 1, 8), " ").alias("title"), doi.alias("doi"),
        F.when(t == 0, "OpenAlex").when(t == 1, "Crossref; OpenAlex").otherwise("Semantic Scholar").alias("source_database"), F.col("lang").alias("search_query"),
        F.when(q == 0, "review").when(q == 3, "unknown").otherwise("primary").alias("record_type"), F.col("n_chars").alias("cited_by"), refs.alias("referenced_works"), F.col("text").alias("abstract"),
    )


_DOI = r"trim(regexp_replace(regexp_replace(lower(trim(doi)), '^https?://(?:dx\.)?doi\.org/', ''), '^doi:', ''))"
_TITLE = "trim(regexp_replace(lower(trim(regexp_replace(title, '<[^>]+>', '', 'g'))), '[^a-z0-9]+', ' ', 'g'))"
KEYED = f"select *, {_DOI} as doi_key, {_TITLE} as title_key from ({RECORDS}) r"

QUERIES["normalize_doi"] = lambda spark, d: records(spark, d).select("ord", normalize_doi(F.col("doi")).alias("doi_key"))
ORACLES["normalize_doi"] = f"select ord, {_DOI} as doi_key from ({RECORDS}) r"
QUERIES["normalize_title"] = lambda spark, d: records(spark, d).select("ord", normalize_title(F.col("title")).alias("title_key"))
ORACLES["normalize_title"] = f"select ord, {_TITLE} as title_key from ({RECORDS}) r"
QUERIES["safe_filename"] = lambda spark, d: texts(spark, d, "pages").select("page_id", safe_filename(F.col("url")).alias("name"))
ORACLES["safe_filename"] = r"select page_id, coalesce(nullif(substr(trim(regexp_replace(url, '[^\w.-]+', '_', 'g'), '._'), 1, 140), ''), 'paper') || '.pdf' as name from pages"
QUERIES["paper_filename"] = lambda spark, d: table(spark, d, "part").select("p_partkey", paper_filename(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat("p_brand", F.lit(" Mc-"), "p_type", F.lit("; B"))), F.col("p_name")).alias("name"))
ORACLES["paper_filename"] = r"""
select p_partkey, case when p_size % 3 = 0 then 'XXXX' else cast(p_size as varchar) end || '_' || case when p_partkey % 4 = 0 then 'Unknown' else coalesce(nullif(substr(regexp_replace(list_extract(regexp_split_to_array(trim(p_brand || ' Mc-' || p_type), '\s+'), -1), '[^\w-]', '', 'g'), 1, 20), ''), 'Unknown') end || '_' ||
 coalesce(nullif(trim(substr(array_to_string(list_slice(list_filter(regexp_split_to_array(regexp_replace(p_name, '[^\w\s-]', '', 'g'), '\s+'), lambda x: x <> ''), 1, 4), '_'), 1, 45), '_'), ''), 'paper') || '.pdf' as name from part"""


def abstract_round_trip(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    index = texts(spark, d, "documents").select("doc_id", words.alias("words")).where(F.size("words") > 0).select("doc_id", index_of_words(F.col("words")).alias("index"))
    return index.select("doc_id", F.sha2(abstract_from_index(F.col("index")), 256).alias("sha"))


QUERIES["abstract_from_index"] = abstract_round_trip
ORACLES["abstract_from_index"] = r"select doc_id, sha256(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), ' ')) as sha from documents where trim(text) <> ''"

QUERIES["dedup_doi"] = lambda spark, d: linkage.by_key(linkage.keys(records(spark, d)), "doi_key")
ORACLES["dedup_doi"] = f"select ord, case when doi_key = '' then ord else min(ord) over (partition by doi_key) end as cluster from ({KEYED}) k"
QUERIES["dedup_title"] = lambda spark, d: linkage.by_key(linkage.keys(records(spark, d)), "title_key")
ORACLES["dedup_title"] = f"select ord, case when title_key = '' then ord else min(ord) over (partition by title_key) end as cluster from ({KEYED}) k"
QUERIES["dedup_bucket_pairs"] = lambda spark, d: linkage.block_pairs(linkage.keys(records(spark, d)))
ORACLES["dedup_bucket_pairs"] = f"""
with t as (select distinct title_key as t, array_to_string(list_slice(string_split(title_key, ' '), 1, 4), ' ') as b from ({KEYED}) k where length(title_key) >= 24)
select x.t as a, y.t as b from t x join t y on x.b = y.b and x.t < y.t"""


def dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    r = linkage.keys(records(spark, d))
    return linkage.merge(r.select("ord", "title", "source_database", "search_query", "referenced_works"), linkage.by_key(r, "title_key"))


QUERIES["dedup_merge"] = dedup_merge


def _brought_sql(column: str, sep: str) -> str:
    """DuckDB: cluster, l: the different tokens that later records of a cluster bring, by first place."""
    return f"""(select cluster, list(tok order by k) as l from (select cluster, tok, min(o * 1000 + i) as k from
 (select cluster, ord as o, generate_subscripts(string_split({column}, '{sep}'), 1) as i, trim(unnest(string_split({column}, '{sep}'))) as tok from c where ord <> cluster) u where tok <> '' group by 1, 2) v group by 1)"""


def _merged_sql(column: str, sep: str, brought: str) -> str:
    have = f"list_filter(list_transform(string_split(f.{column}, '{sep}'), lambda x: trim(x)), lambda x: x <> '')"
    return f"case when {brought}.l is null then f.{column} else array_to_string(list_concat({have}, list_filter({brought}.l, lambda y: not list_contains({have}, y))), '{sep}') end as {column}"


ORACLES["dedup_merge"] = f"""
with c as (select *, case when title_key = '' then ord else min(ord) over (partition by title_key) end as cluster from ({KEYED}) k),
 t as (select cluster, arg_min(trim(title), ord) as title from c where ord <> cluster and trim(title) <> '' group by 1)
select f.ord, case when f.title = '' then coalesce(t.title, f.title) else f.title end as title, {_merged_sql("source_database", "; ", "s")}, {_merged_sql("search_query", "; ", "q")}, {_merged_sql("referenced_works", "|", "w")}
from (select * from c where ord = cluster) f left join t using (cluster)
 left join {_brought_sql("source_database", "; ")} s using (cluster) left join {_brought_sql("search_query", "; ")} q using (cluster) left join {_brought_sql("referenced_works", "|")} w using (cluster)"""

QUERIES["dedup_greedy_fuzzy"] = lambda spark, d: linkage.greedy_clusters(linkage.keys(records(spark, d)))

#: Pairs of similar titles; without SQL, as it has no matching blocks. A test holds it against all pairs.
QUERIES["dedup_similar_titles"] = lambda spark, d: linkage.similar_titles(linkage.keys(records(spark, d)))

_KEEP = ["id", "cited_by"]
QUERIES["top_reviews"] = lambda spark, d: citations.seeds(records(spark, d), 12, 12)[0].select(*_KEEP)
ORACLES["top_reviews"] = f"select id, cited_by from ({RECORDS}) r where record_type = 'review' order by cited_by desc, ord limit 12"
_SEED = "(" + " or ".join(f"lower(title || ' ' || abstract) like '%{w}%'" for w in ("iron", " fe ", "cobalt", " co ", "manganese", " mn ", "nickel", " ni ", "enantioselective", "asymmetric")) + ")"
QUERIES["top_primaries"] = lambda spark, d: citations.seeds(records(spark, d), 12, 12)[1].select(*_KEEP)
ORACLES["top_primaries"] = f"select id, cited_by from ({RECORDS}) r where record_type = 'primary' and {_SEED} order by cited_by desc, ord limit 12"

_EDGES = f"(select ord, id as src, trim(unnest(list_filter(string_split(referenced_works, '|'), lambda x: x <> ''))) as dst from ({RECORDS}) r)"
_REV, _PRI = f"({ORACLES['top_reviews']})", f"(select id, cited_by from ({RECORDS}) r where record_type = 'primary' order by cited_by desc, ord limit 12)"


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = records(spark, d)
    return r, *citations.seeds(r, words=False)


def citation_backward(spark: SparkSession, d: str) -> DataFrame:
    r, reviews, _ = _both(spark, d)
    return citations.backward(reviews, r, citations.REVIEW_CAP).select("seed_id", "id")


def citation_forward(spark: SparkSession, d: str) -> DataFrame:
    r, _, primary = _both(spark, d)
    return citations.forward(primary, r)


_BACK = "select e.src as seed_id, e.dst as id from {0} s join " + _EDGES + f" e on e.src = s.id where e.dst in (select id from ({RECORDS}) r)"
_FORE = "select seed_id, id from (select s.id as seed_id, e.src as id, row_number() over (partition by s.id order by e.ord) as k from {0} s join (select distinct ord, src, dst from " + _EDGES + " x) e on e.dst = s.id) q where k <= 50"
QUERIES["citation_backward"], ORACLES["citation_backward"] = citation_backward, _BACK.format(_REV)
QUERIES["citation_forward"], ORACLES["citation_forward"] = citation_forward, _FORE.format(_PRI)
QUERIES["citation_chase"] = lambda spark, d: citations.chase(records(spark, d), records(spark, d), words=False)
ORACLES["citation_chase"] = f"select 'review reference list' as mode, * from ({_BACK.format(_REV)}) a union all select 'backward citations', * from ({_BACK.format(_PRI)}) b union all select 'forward citations', * from ({_FORE.format(_PRI)}) c"


def source_union_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records of three sources under one another, at most 12 a query and source."""
    from pyspark.sql import Window

    r = records(spark, d).select("ord", F.explode(F.split("source_database", "; ")).alias("source"), F.col("search_query").alias("query"))
    w = Window.partitionBy("source", "query").orderBy("ord")
    return r.withColumn("k", F.row_number().over(w)).where("k <= 12").groupBy("source", "query").agg(F.count("*").alias("n"), F.max("ord").alias("last"))


QUERIES["source_union_counts"] = source_union_counts
ORACLES["source_union_counts"] = f"""
select source, query, count(*) as n, max(ord) as last from (select *, row_number() over (partition by source, query order by ord) as k from
 (select ord, unnest(string_split(source_database, '; ')) as source, search_query as query from ({RECORDS}) r) a) b where k <= 12 group by 1, 2"""

QUERIES["record_types"] = lambda spark, d: table(spark, d, "part").select("p_partkey", screening.record_type(F.col("p_name"), F.lower("p_type")).alias("keyword"), screening.backward_type(F.col("p_name"), F.lower("p_type")).alias("backward"), screening.forward_type(F.col("p_name")).alias("forward"))
ORACLES["record_types"] = """
select p_partkey, case when lower(p_name || ' ' || lower(p_type)) like '%review%' then 'review' when lower(p_name || ' ' || lower(p_type)) like '%book-chapter%' or lower(p_name || ' ' || lower(p_type)) like '%book chapter%' then 'book chapter'
 when lower(p_type) in ('article', 'journal-article', 'proceedings-article') then 'primary' else 'unknown' end as keyword,
 case when lower(p_name) like '%review%' then 'review' when lower(p_type) in ('article', 'preprint') then 'primary' else 'unknown' end as backward, case when lower(p_name) like '%review%' then 'review' else 'primary' end as forward from part"""


def _expanded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = records(spark, d)
    return citations.expand(r, r.withColumn("type", F.when(F.col("ord") % 2 == 0, "article").otherwise("book")), prefix="", words=False)


QUERIES["cited_records"] = lambda spark, d: _expanded(spark, d)[0].select("source_database", "search_query", "id", "record_type")
_CHASE = f"select c.mode, c.seed_id, c.id, s.title as query, w.title, w.ord from ({ORACLES['citation_chase']}) c join ({RECORDS}) s on s.id = c.seed_id join ({RECORDS}) w on w.id = c.id"
ORACLES["cited_records"] = f"""
select 'OpenAlex ' || mode as source_database, query as search_query, id, case when lower(title) like '%review%' then 'review' when mode = 'forward citations' or ord % 2 = 0 then 'primary' else 'unknown' end as record_type
from (select distinct * from ({_CHASE}) x) q"""

QUERIES["chase_log"] = lambda spark, d: _expanded(spark, d)[1].drop("place")
ORACLES["chase_log"] = f"""
with a as (select 'review reference list' as mode, id from ({ORACLES["top_reviews"]}) r union all select unnest(['backward citations', 'forward citations']), id from {_PRI} p)
select a.mode, s.title as query, cast(coalesce(n, 0) as varchar) as results_returned, 'OK' as status, '' as notes from a join ({RECORDS}) s using (id)
 left join (select mode, seed_id, count(distinct id) as n from ({ORACLES["citation_chase"]}) c group by 1, 2) k on k.mode = a.mode and k.seed_id = a.id"""
