"""Evidence-window candidates: one row for each distinct window around a sentence with a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions.fields import confidence, window_values
from lodestone.functions.regexes import WHITE, found, is_ascii, once
from lodestone.functions.sentences import CHUNK, SPANS, sentence_spans

METHOD = "rule-baseline-v1"


#: Chunks of a text at most whose windows are put together from the text's chunks.
FEW_CHUNKS = 128

#: Where a chunk of an ASCII text is blank or begins with white space.
_LED = r"^\s|\n[ \t\x0b\f\r]"

_WINDOWS = "array<struct<ordinal:int,start:int,end:int,evidence:string>>"


def _of_chunks(chunks: Column, context: Column) -> Column:
    """The windows of an ASCII text of which every chunk begins with its sentence: a sentence is a chunk without its end, and no sentence needs a struct."""
    hits = F.filter(F.sequence(F.lit(0), F.size(chunks) - 1), lambda i: F.get(chunks, i).rlike("(?i)" + R.RESULT))
    bounds = lambda i, n: F.struct((n + 1).alias("ordinal"), F.greatest(i - context, F.lit(0)).alias("lo"), F.least(i + context, F.size(chunks) - 1).alias("hi"))

    def new(of: Column) -> Column:
        return F.filter(of, lambda w, j: (j == 0) | (w["lo"] != F.get(of, j - 1)["lo"]) | (w["hi"] != F.get(of, j - 1)["hi"]))

    def with_evidence(w: Column) -> Column:
        start = F.octet_length(F.array_join(F.slice(chunks, F.lit(1), w["lo"]), ""))
        evidence = F.rtrim(F.array_join(F.slice(chunks, w["lo"] + 1, w["hi"] - w["lo"] + 1), ""), F.lit(WHITE))
        return once(F.struct(start.alias("s"), evidence.alias("e")), lambda x: F.struct(w["ordinal"].alias("ordinal"), x["s"].alias("start"), (x["s"] + F.octet_length(x["e"])).alias("end"), x["e"].alias("evidence")))

    return F.transform(once(F.transform(hits, bounds), new), with_evidence).cast(_WINDOWS)


def windows(df: DataFrame, text: str = "text", context: int | str = 2) -> DataFrame:
    """df's columns without its text, ordinal (of the anchor, before equal windows go), start, end, evidence.

    All inside the row: anchors are sentences with a result, windows reach `context` sentences (a number, or the column
    that has it) to both sides and grow along the text, so equal windows are neighbours and the first stays. Evidence is put
    together from the window's sentences and what lies between them, so the text itself is neither copied nor read again.
    """
    if isinstance(context, int) and context < 0:
        raise ValueError("context must not be negative")
    context = F.lit(context) if isinstance(context, int) else F.col(context)
    anchors = F.filter(F.transform("_s", lambda s, i: F.struct(i.alias("i"), found(s["text"], R.RESULT).alias("hit"))), lambda x: x["hit"])

    def window(a, n):
        lo, hi = F.greatest(a["i"] - context, F.lit(0)), F.least(a["i"] + context, F.size("_s") - 1)
        return F.struct((n + 1).alias("ordinal"), F.get("_s", lo)["start"].alias("start"), F.get("_s", hi)["end"].alias("end"), lo.alias("lo"), hi.alias("hi"))

    def with_evidence(w):
        rest = F.transform(F.slice("_s", w["lo"] + 2, w["hi"] - w["lo"]), lambda s: F.concat(s["gap"], s["text"]))
        return F.struct(w["ordinal"].alias("ordinal"), w["start"].alias("start"), w["end"].alias("end"), F.concat(F.get("_s", w["lo"])["text"], F.array_join(rest, "")).alias("evidence"))

    def new(w, j):
        before = F.get("_w", j - 1)
        return (j == 0) | (w["start"] != before["start"]) | (w["end"] != before["end"])

    # a text without a result needs no sentences
    t = F.col(text)
    chunks = F.when(is_ascii(t) & ~t.rlike(_LED), F.regexp_extract_all(t, F.lit(CHUNK), F.lit(0)))
    few = once(chunks, lambda c: F.when(F.size(c) <= FEW_CHUNKS, _of_chunks(c, context)))  # null for other texts
    d = df.withColumn("_f", F.when(found(t, R.RESULT), few).otherwise(F.array().cast(_WINDOWS)))
    d = d.withColumn("_s", F.when(F.col("_f").isNull(), sentence_spans(t)).otherwise(F.array().cast(SPANS)))
    d = d.withColumn("_w", F.transform(anchors, window)).withColumn("_w", F.transform(F.filter("_w", new), with_evidence)).withColumn("_w", F.coalesce("_f", F.col("_w").cast(_WINDOWS)))
    # an outer explode, as the filter that is inferred for an inner one would work everything out once more
    kept = [c for c in df.columns if c != text]
    return d.select(*kept, F.explode_outer("_w").alias("_w")).where("_w.ordinal is not null").select(*kept, "_w.*")


def extract_candidates(df: DataFrame, key: str = "doc_id", text: str = "text", context: int | str = 2) -> DataFrame:
    """key, candidate_id, the eight values, confidence, evidence and its place."""
    return with_values(windows(df.select(key, text, *([context] if isinstance(context, str) else [])), text, context), key)


def with_values(found: DataFrame, key: str) -> DataFrame:
    """The columns of a candidate from windows: key, ordinal, start, end, evidence."""
    return found.withColumns(window_values(F.col("evidence"))).select(
        key,
        F.format_string("rxn-%04d", "ordinal").alias("candidate_id"),
        "ee_percent",
        "yield_percent",
        "h2_pressure_bar",
        "temperature_c",
        "reaction_time_h",
        "solvent",
        "ligand",
        "substrate_class",
        confidence(F.col("evidence")).alias("confidence"),
        F.col("evidence").alias("evidence_text"),
        F.col("start").alias("evidence_start"),
        F.col("end").alias("evidence_end"),
        F.lit(METHOD).alias("extraction_method"),
    )
