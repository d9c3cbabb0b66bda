"""Full-text classification of papers from their pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions.regexes import first_match, found
from lodestone.functions.sentences import compact_sentences

CONTEXT_CHARS = 800


@dataclass(frozen=True)
class FullTextPack:
    """What full-text screening looks for. The default values are fixed."""

    name: str = "Iron"
    metal: str = R.IRON.metal
    other_metal: str = R.IRON.other_metal
    asymmetric: str = R.FULL_ASYMMETRIC
    hydrogenation: str = R.FULL_HYDROGENATION
    h2: str = R.FULL_H2
    scope: str = R.FULL_SCOPE
    table: str = R.FULL_TABLE
    ee: tuple[str, ...] = R.FULL_EE
    review: str = R.FULL_REVIEW
    non_primary: str = R.FULL_NON_PRIMARY
    exclusions: tuple[tuple[str, str], ...] = R.FULL_EXCLUSIONS


IRON = FullTextPack()


def first_on_pages(pages: DataFrame, patterns: dict[str, tuple[str, ...]], key: str = "doc_id") -> DataFrame:
    """key and, for each name, the match and its page: the lowest page with a hit, on it the first pattern of the list. Null without a hit.

    pages: key, page_no, text. One pass: every page gives small candidates, min() over (page, match) combines them before the shuffle.
    """
    aggs = []
    for name, pats in patterns.items():
        hit = F.coalesce(*[first_match(F.col("text"), p) for p in pats])
        aggs.append(F.min(F.when(hit.isNotNull(), F.struct(F.col("page_no").alias("page"), hit.alias("match")))).alias(name))
    return pages.groupBy(key).agg(*aggs)


def _context(pages: Column | str, patterns: tuple[str, ...], table: str) -> tuple[Column, Column]:
    """Of one page: the first sentence with all patterns; and, if the page has all, the first sentence with any."""
    text = F.col("text")

    def every(t: Column) -> Column:
        out = F.lit(True)
        for p in patterns:
            out = out & found(t, p)
        return out

    def some(t: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | found(t, p)
        return out

    def shaped(s: Column, fall_back: bool) -> Column:
        ref = first_match(s, table)
        ref = F.coalesce(ref, first_match(text, table)) if fall_back else ref
        return F.when(s.isNotNull(), F.struct(F.col("page_no").alias("page"), F.substring(s, 1, CONTEXT_CHARS).alias("sentence"), F.coalesce(ref, F.lit("")).alias("ref")))

    strong = F.get(F.filter("_s", every), 0)
    weak = F.when(every(text), F.get(F.filter("_s", some), 0))
    return shaped(strong, False), shaped(weak, True)


def evidence(pages: DataFrame, pack: FullTextPack = IRON, key: str = "doc_id") -> DataFrame:
    """key, evidence (struct page, sentence, ref; null if none): metal, hydrogen and asymmetry in one sentence, then on one page, then hydrogen alone."""
    all_three, only = (pack.metal, pack.h2, pack.asymmetric), (pack.h2,)
    d = pages.withColumn("_s", F.when(found(F.col("text"), pack.h2), compact_sentences(F.col("text"))).otherwise(F.array().cast("array<string>")))
    s3, w3 = _context("text", all_three, pack.table)
    s1, w1 = _context("text", only, pack.table)
    d = d.select(key, s3.alias("s3"), w3.alias("w3"), s1.alias("s1"), w1.alias("w1"))
    return d.groupBy(key).agg(*[F.min(c).alias(c) for c in ("s3", "w3", "s1", "w1")]).select(key, F.coalesce("s3", "w3", "s1", "w1").alias("evidence"))


def _labels(text: Column, rules: tuple[tuple[str, str], ...], sep: str) -> Column:
    return F.concat_ws(sep, *[F.when(found(text, p), F.lit(label)) for label, p in rules])


def classify(papers: DataFrame, pages: DataFrame, pack: FullTextPack = IRON, key: str = "doc_id") -> DataFrame:
    """papers (key, title, has_pdf boolean, error string or null) with the classification and its evidence.

    pages: key, page_no (from 1), text. One row a paper; a paper without pages that has a PDF counts as one with empty pages.
    The first rule that holds decides; `None`-like defaults are 'Not found' or 'Not verified'.
    """
    hits = first_on_pages(pages, {"h": (pack.h2,), "a": (pack.asymmetric,), "e": pack.ee, "s": (pack.scope,)}, key)
    flags = pages.groupBy(key).agg(*[F.max(found(F.col("text"), p)).alias(f"x{i}") for i, (_, p) in enumerate(pack.exclusions)])
    excluded = F.concat_ws("; ", *[F.when(F.col(f"x{i}"), F.lit(label)) for i, (label, _) in enumerate(pack.exclusions)])
    d = papers.join(hits, key, "left").join(flags.select(key, excluded.alias("_x")), key, "left").join(evidence(pages, pack, key), key, "left")
    t = F.coalesce("title", F.lit(""))
    sentence = F.coalesce("evidence.sentence", F.lit(""))
    metal, other, asym, hyd = found(t, pack.metal), first_match(t, pack.other_metal), found(t, pack.asymmetric), found(t, pack.hydrogenation)
    ev_other, title_x = first_match(sentence, pack.other_metal), _labels(t, pack.exclusions, ", ")
    n = pack.name
    missing = F.concat_ws(
        ", ", F.when(~metal, f"{n} catalyst"), F.when(F.col("h").isNull(), "molecular H2"), F.when(~asym, "asymmetric reaction"), F.when(F.col("e").isNull(), "ee value"), F.when(F.col("s").isNull(), "substrate scope")
    )
    rules = [
        (~F.col("has_pdf"), "C. Uncertain", F.lit("No accessible PDF.")),
        (F.col("error").isNotNull(), "C. Uncertain", F.lit("PDF text extraction failed.")),
        (title_x != "", "B. Excluded", F.concat(F.lit("Title: prohibited system ("), title_x, F.lit(")"))),
        (other.isNotNull() & ~metal, "B. Excluded", F.concat(F.lit(f"Title identifies non-{n} catalyst: "), other)),
        (~metal & ev_other.isNotNull(), "B. Excluded", F.concat(F.lit(f"H2 evidence sentence identifies non-{n} catalyst: "), ev_other)),
        (metal & hyd & ~asym, "B. Excluded", F.lit(f"Title identifies {n}-catalysed hydrogenation but not asymmetric.")),
        (found(t, pack.non_primary), "B. Excluded", F.lit("Non-primary record (review/ML/HTE).")),
        (metal & asym & hyd & F.col("h").isNotNull() & F.col("e").isNotNull() & F.col("s").isNotNull(), "A. Confirmed", F.lit(f"Full text explicitly supports {n} catalyst, molecular H2, asymmetric reaction, ee value, and experimental substrate scope.")),
        (found(t, pack.review), "B. Excluded", F.lit("Review or chapter.")),
        (F.lit(True), "C. Uncertain", F.concat(F.lit("Full-text evidence incomplete: "), missing)),
    ]
    label = reason = None
    for cond, cls, why in rules:
        label = F.when(cond, cls) if label is None else label.when(cond, cls)
        reason = F.when(cond, why) if reason is None else reason.when(cond, why)
    read = F.col("has_pdf") & F.col("error").isNull()

    def shown(c: Column, none: str = "Not found", unread: str = "Not verified") -> Column:
        return F.when(~read, unread).otherwise(F.coalesce(F.nullif(c, F.lit("")), F.lit(none)))

    used = F.array_join(F.array_distinct(F.array_compact(F.array(F.col("evidence.page"), *[F.col(f"{c}.page") for c in ("h", "a", "e", "s")]))), ", ")
    metal_label = F.when(metal, F.concat(first_match(t, pack.metal), F.lit(" (title evidence)")))
    no_text = F.when(~F.col("has_pdf"), "No accessible PDF available for full-text screening.").when(F.col("error").isNotNull(), F.col("error"))
    return d.select(
        *[papers[c] for c in papers.columns if c != "error"],
        label.alias("classification"),
        reason.alias("decision_reason"),
        shown(metal_label).alias("metal_used"),
        shown(F.col("h.match")).alias("hydrogen_source"),
        shown(F.col("a.match")).alias("asymmetric_evidence"),
        shown(F.col("e.match")).alias("ee_value"),
        shown(F.col("s.match")).alias("scope"),
        F.coalesce(no_text, F.nullif(sentence, F.lit("")), F.lit("No single evidence sentence found.")).alias("evidence_sentence"),
        shown(used, unread="Not available").alias("pages_used"),
        shown(F.col("evidence.ref"), unread="Not available").alias("table_reference"),
        shown(F.col("_x"), none="None").alias("exclusion_keywords"),
    )
