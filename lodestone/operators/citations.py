"""Citation graph: references as edges, seeds by citation count, backward and forward expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.rules import SEED_WORDS
from lodestone.operators.screening import backward_type, forward_type, joined_text

# Fixed values.
MAX_REVIEWS = MAX_PRIMARY = 12
REVIEW_CAP, BACKWARD_CAP, FORWARD_CAP = 150, 80, 50
OPENALEX_PREFIX = "https://openalex.org/"
REVIEW_MODE, BACKWARD_MODE, FORWARD_MODE = "review reference list", "backward citations", "forward citations"
CHASING, NO_REFERENCES, NO_ID = "citation chasing", "No references exposed by source metadata.", "No OpenAlex ID."


def references(refs: Column, prefix: str = "") -> Column:
    """The ids of a pipe-joined string that start with the prefix, blanks out, in order."""
    return F.filter(F.split(F.coalesce(refs, F.lit("")), r"\|"), lambda x: (x != "") & x.startswith(prefix))


def edges(records: DataFrame, prefix: str = "", cap: int | None = None) -> DataFrame:
    """src, n (place in the list, from 0), dst."""
    refs = references(F.col("referenced_works"), prefix)
    refs = F.slice(refs, 1, cap) if cap else refs
    return records.select(F.col("id").alias("src"), F.posexplode(refs).alias("n", "dst"))


def is_seed(title: Column, abstract: Column) -> Column:
    t = joined_text(title, abstract)
    out = F.lit(False)
    for w in SEED_WORDS:
        out = out | t.contains(w)
    return out


def top_cited(records: DataFrame, n: int) -> DataFrame:
    """The n most cited; of equal counts those that come first."""
    return records.orderBy(F.coalesce(F.col("cited_by").cast("long"), F.lit(0)).desc(), F.col("ord")).limit(n)


def seeds(records: DataFrame, max_reviews: int = MAX_REVIEWS, max_primary: int = MAX_PRIMARY, words: bool = True) -> tuple[DataFrame, DataFrame]:
    primary = records.where("record_type = 'primary'")
    if words:
        primary = primary.where(is_seed(F.col("title"), F.col("abstract")))
    return top_cited(records.where("record_type = 'review'"), max_reviews), top_cited(primary, max_primary)


def backward(seed: DataFrame, works: DataFrame, cap: int, prefix: str = "") -> DataFrame:
    """seed_id, n, id of the works that seeds cite. Seeds are few (a bounded top), so they go to the works."""
    e = edges(seed, prefix, cap)
    return works.select("id").join(F.broadcast(e), works["id"] == e["dst"]).select(F.col("src").alias("seed_id"), "n", "id")


def forward(seed: DataFrame, works: DataFrame, cap: int = FORWARD_CAP, prefix: str = "") -> DataFrame:
    """seed_id, id of the works that cite a seed, the first `cap` in the order of ord."""
    e = works.select("ord", F.col("id"), F.explode(F.array_distinct(references(F.col("referenced_works"), prefix))).alias("dst"))
    s = seed.select(F.col("id").alias("seed_id"))
    w = Window.partitionBy("seed_id").orderBy("ord")
    return e.join(F.broadcast(s), F.col("dst") == F.col("seed_id")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap).select("seed_id", "id")


def chase(records: DataFrame, works: DataFrame, max_reviews: int = MAX_REVIEWS, max_primary: int = MAX_PRIMARY, prefix: str = "", words: bool = True) -> DataFrame:
    """mode, seed_id, id: what reviews cite, what primaries cite, what cites primaries."""
    reviews, primary = seeds(records, max_reviews, max_primary, words)
    return (
        backward(reviews, works, REVIEW_CAP, prefix).select(F.lit("review reference list").alias("mode"), "seed_id", "id")
        .unionByName(backward(primary, works, BACKWARD_CAP, prefix).select(F.lit("backward citations").alias("mode"), "seed_id", "id"))
        .unionByName(forward(primary, works, FORWARD_CAP, prefix).select(F.lit("forward citations").alias("mode"), "seed_id", "id"))
    )


def _asked(reviews: DataFrame, primary: DataFrame, prefix: str) -> DataFrame:
    """What is asked for: seed (its ord), query (its title), place (the order of the calls), mode, refs (ids asked for), cites (an id whose citers are asked for), note (why nothing is)."""
    def rank(d: DataFrame) -> DataFrame:
        w = Window.orderBy(F.coalesce(F.col("cited_by").cast("long"), F.lit(0)).desc(), "ord")  # a bounded top
        return d.withColumn("rank", F.row_number().over(w))

    def backward_calls(d: DataFrame, mode: str, cap: int, first: int) -> DataFrame:
        refs = F.slice(references(F.col("referenced_works"), prefix), 1, cap)
        return rank(d).select(F.col("ord").alias("seed"), F.coalesce("title", F.lit("")).alias("query"), (F.col("rank") * 2 + first).alias("place"), F.lit(mode).alias("mode"), refs.alias("refs"), F.lit(None).cast("string").alias("cites"), F.when(F.size(refs) == 0, NO_REFERENCES).alias("note"))

    no_id = F.coalesce(F.col("id"), F.lit("")) == ""
    ahead = rank(primary).select(F.col("ord").alias("seed"), F.coalesce("title", F.lit("")).alias("query"), (F.col("rank") * 2 + 10_001).alias("place"), F.lit(FORWARD_MODE).alias("mode"), F.array().cast("array<string>").alias("refs"), F.when(~no_id, F.col("id")).alias("cites"), F.when(no_id, NO_ID).alias("note"))
    return backward_calls(reviews, REVIEW_MODE, REVIEW_CAP, 0).unionByName(backward_calls(primary, BACKWARD_MODE, BACKWARD_CAP, 10_000)).unionByName(ahead)


def expand(records: DataFrame, works: DataFrame, max_reviews: int = MAX_REVIEWS, max_primary: int = MAX_PRIMARY, prefix: str = OPENALEX_PREFIX, words: bool = True) -> tuple[DataFrame, DataFrame]:
    """The works that the best records cite and those that cite them, and the log of these calls.

    records: ord, id, title, abstract, record_type, cited_by, referenced_works; works, which may be a far larger table: ord, id,
    title, referenced_works, type and any other columns of a record. The works are read twice, for what is asked for by id
    and for what cites a seed; seeds and their references are a few thousand rows at most, so they go to the works.

    First: place (the order in which they came), mode, query, id, source_database, search_query, record_type and the other columns
    of works. Second: place, mode, query, results_returned, status, notes.
    """
    asked = _asked(*seeds(records, max_reviews, max_primary, words), prefix)
    wanted = asked.select("place", "mode", "query", F.posexplode("refs").alias("n", "id")).groupBy("place", "mode", "query", "id").agg(F.min("n").cast("long").alias("n"))
    back = works.join(F.broadcast(wanted), "id")
    e = works.select(F.col("ord").alias("n"), F.col("id").alias("citer"), F.explode(F.array_distinct(references(F.col("referenced_works"), prefix))).alias("cites"))
    ahead = e.join(F.broadcast(asked.where("cites is not null").select("place", "mode", "query", "cites")), "cites")
    first = Window.partitionBy("place").orderBy("n")
    ahead = ahead.withColumn("k", F.row_number().over(first)).where(F.col("k") <= FORWARD_CAP).select("place", "mode", "query", F.col("citer").alias("id"), F.col("n").cast("long").alias("n"))
    ahead = works.join(F.broadcast(ahead), "id")  # FORWARD_CAP a seed
    kind = F.when(F.col("mode") == FORWARD_MODE, forward_type(F.col("title"))).otherwise(backward_type(F.col("title"), F.coalesce("type", F.lit(""))))
    both = back.unionByName(ahead).drop("source_database", "search_query", "record_type")
    found = both.withColumns({"source_database": F.concat(F.lit("OpenAlex "), F.col("mode")), "search_query": F.col("query"), "record_type": kind})
    counted = found.groupBy("place").agg(F.count("*").alias("k"))
    log = asked.join(counted, "place", "left").select("place", "mode", "query", F.coalesce("k", F.lit(0)).cast("string").alias("results_returned"), F.when(F.col("note").isNull(), "OK").otherwise("SKIPPED").alias("status"), F.coalesce("note", F.lit("")).alias("notes"))
    return found, log
