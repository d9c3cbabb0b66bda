"""Title-and-abstract screening with a weighted rule pack.

The text is made once a row: an explode of one value stands between it and what looks at it, or each look, and each condition
on a decision, would make it anew. Words without operators are looked for as they are, not as patterns.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.regexes import found, py_regex
from lodestone.functions.rules import IRON, ScreenPack
from lodestone.functions.text import capitalize


def joined_text(title: Column, abstract: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))


def record_type(title: Column, source_type: Column, primary=("article", "journal-article", "proceedings-article")) -> Column:
    """Of keyword searches: review, book chapter, primary (by a list of source types) or unknown."""
    t = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(source_type, F.lit(""))))
    return F.when(t.contains("review"), "review").when(t.contains("book-chapter") | t.contains("book chapter"), "book chapter").when(source_type.isin(*primary), "primary").otherwise("unknown")


def backward_type(title: Column, source_type: Column) -> Column:
    return F.when(F.lower(title).contains("review"), "review").when(source_type.isin("article", "preprint"), "primary").otherwise("unknown")


def forward_type(title: Column) -> Column:
    return F.when(F.lower(title).contains("review"), "review").otherwise("primary")


#: Lower-case letters that a case-blind pattern takes for an ASCII letter.
_ALIASES = {"s": "\u017f", "i": "\u0131"}


def _literal(pattern: str) -> str | None:
    """The lower-case words that a case-blind pattern looks for, if it has nothing else."""
    return pattern.lower() if re.fullmatch("[A-Za-z0-9 -]+", pattern) else None


def _aliased(text: Column, word: str) -> Column:
    """Has a lower-case text letters that may stand for one of `word`?"""
    return reduce(or_, [text.contains(a) for c, a in _ALIASES.items() if c in word], F.lit(False))


def _has(text: Column, pattern: str) -> Column:
    """found() in a lower-case text."""
    word = _literal(pattern)
    return found(text, pattern) if word is None else F.when(text.contains(word), True).when(_aliased(text, word), found(text, pattern)).otherwise(False)


def _first(text: Column, pattern: str) -> Column:
    """What the pattern finds first in a lower-case text, '' without a match."""
    word, match = _literal(pattern), F.coalesce(F.regexp_substr(text, F.lit(py_regex(pattern))), F.lit(""))
    return match if word is None else F.when(_aliased(text, word), match).when(text.contains(word), word).otherwise("")


def screen(df: DataFrame, pack: ScreenPack = IRON) -> DataFrame:
    """df (title, abstract, record_type) with record_type, inclusion_decision, exclusion_reason, confidence_score (string), tier, h2_evidence, strict_decision.

    An exclusion term decides first, in the order of the list, and keeps the score; then review words; then the score.
    """
    text = joined_text(F.col("title"), F.col("abstract"))
    score, missing = F.lit(0), []
    for pattern, points, label in pack.all_signals():
        hit = _has(F.col("_t"), pattern)
        score = score + F.when(hit, points).otherwise(0)
        missing.append(F.when(~hit, F.lit(label)))
    veto = F.coalesce(*[F.when(F.col("_t").contains(t.lower()), F.lit(t)) for t in pack.exclusions]) if pack.exclusions else F.lit(None).cast("string")
    kind = F.when(_has(F.col("_t"), pack.review), "review").otherwise(F.coalesce(F.nullif("record_type", F.lit("")), F.lit("unknown")))
    d = df.select("*", F.explode(F.array(text)).alias("_t")).withColumns({"record_type": kind, "_veto": veto, "_score": score, "_missing": F.concat_ws(", ", *missing)})
    kept = (
        F.when(F.col("record_type") == "review", "Review source - citation mining")
        .when(F.col("_score") == 100, "Include - metadata supports criteria; manual verification required")
        .otherwise("Primary candidate - manual review required")
    )
    decision = F.when(F.col("_veto").isNotNull(), "Exclude").otherwise(kept)  # so that who asks for "Exclude" alone needs no score
    reason = (
        F.when(F.col("_veto").isNotNull(), capitalize(F.col("_veto")))
        .when(F.col("record_type") == "review", "Review excluded from final primary-paper dataset")
        .when(F.col("_score") == 100, "")
        .otherwise(F.concat(F.lit("Not explicit in searchable metadata: "), "_missing"))
    )
    h2 = _first(F.col("_t"), pack.h2)
    return (
        d.withColumns({"inclusion_decision": decision, "exclusion_reason": reason, "confidence_score": F.col("_score").cast("string"), "h2_evidence": h2})
        .withColumn("tier", F.when(F.col("inclusion_decision").startswith("Include") | (F.col("_score") >= 80), "Tier 1").otherwise("Tier 2"))
        .withColumn("strict_decision", F.when(F.col("h2_evidence") != "", "Include in H2-only dataset - explicit H2 evidence in metadata").otherwise("Exclude from H2-only dataset - insufficient explicit evidence"))
        .drop("_t", "_veto", "_score", "_missing")
    )


def strict(screened: DataFrame) -> DataFrame:
    """Rows that are not excluded and name molecular hydrogen."""
    return screened.where((F.col("inclusion_decision") != "Exclude") & (F.col("h2_evidence") != ""))


def sheets(screened: DataFrame) -> dict[str, DataFrame]:
    """included, reviews and excluded; an excluded review is in both of the latter."""
    return {
        "included": screened.where(F.col("inclusion_decision").startswith("Include")),
        "reviews": screened.where(F.col("record_type") == "review"),
        "excluded": screened.where(F.col("inclusion_decision") == "Exclude"),
    }


def counts(screened: DataFrame, column: str = "inclusion_decision") -> DataFrame:
    return screened.groupBy(column).agg(F.count("*").alias("n"))
