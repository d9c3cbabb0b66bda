"""Sentences of a text with their places, without a shuffle: arrays inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.regexes import pieces, strip

#: A text falls into chunks that end with their delimiter, so that lengths add up to places.
#: What no delimiter begins with is run over at once.
CHUNK = r"(?s)[^.!?\n]*+.*?(?:[.!?]\s+|\n+)|.+$"
_WHITE = " \t\n\x0b\x0c\r"
SPANS = "array<struct<start:int,end:int,text:string,gap:string>>"
_STEP = 128


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _cut_ascii(chunk: Column) -> Column:
    """As _cut() does, of ASCII: trimmed without a regular expression, and a letter is an octet."""
    body, left = F.btrim(chunk, F.lit(_WHITE)), F.ltrim(chunk, F.lit(_WHITE))
    return F.struct(chunk.alias("all"), body.alias("body"), F.octet_length(chunk).alias("n"), (F.octet_length(chunk) - F.octet_length(left)).alias("lead"), F.octet_length(body).alias("size"))


def _cut(chunk: Column) -> Column:
    """all, body (without white space around it), n (letters of all), lead (of the white space before), size (of the body): worked out once a chunk."""
    body = F.when(_ascii(chunk), F.btrim(chunk, F.lit(_WHITE))).otherwise(strip(chunk))
    left = F.when(_ascii(chunk), F.ltrim(chunk, F.lit(_WHITE))).otherwise(F.regexp_replace(chunk, r"(?U)^\s+", ""))
    return F.struct(chunk.alias("all"), body.alias("body"), F.length(chunk).alias("n"), (F.length(chunk) - F.length(left)).alias("lead"), F.length(body).alias("size"))


def _add(acc: Column, c: Column) -> Column:
    blank, start = c["size"] == 0, acc["at"] + c["lead"]
    gap = F.concat(acc["gap"], F.substr(c["all"], F.lit(1), c["lead"]))
    span = F.struct(start.cast("int").alias("start"), (start + c["size"]).cast("int").alias("end"), c["body"].alias("text"), gap.alias("gap"))
    after = F.when(blank, F.concat(acc["gap"], c["all"])).otherwise(F.substr(c["all"], c["lead"] + c["size"] + 1))
    return F.struct((acc["at"] + c["n"]).alias("at"), after.alias("gap"), F.when(blank, acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))


def sentence_spans(text: Column) -> Column:
    """array of struct(start, end, text, gap): gap is the white space before a sentence; sentences end after . ! ? with white space, or at line ends; places in code points, end exclusive.

    Null and blank texts have none. Places are added up in steps, so a text of n sentences takes about n * _STEP moves, not n * n.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(_ascii(text), _spans(F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0)), _cut_ascii)).otherwise(_spans(F.regexp_extract_all(text, F.lit("(?U)" + CHUNK), F.lit(0)), _cut))


def _spans(chunks: Column, cut) -> Column:
    def block(c: Column):
        def run(acc: Column, i: Column) -> Column:
            part = F.aggregate(F.slice(c, i * _STEP + 1, F.lit(_STEP)), F.struct(acc["at"].alias("at"), acc["gap"].alias("gap"), F.array().cast(SPANS).alias("out")), _add)
            return F.element_at(F.transform(F.array(part), lambda p: F.struct(p["at"].alias("at"), p["gap"].alias("gap"), F.concat(acc["out"], F.array(p["out"])).alias("out"))), 1)

        return run

    def few(c: Column) -> Column:
        return F.aggregate(c, F.struct(F.lit(0).alias("at"), F.lit("").alias("gap"), F.array().cast(SPANS).alias("out")), _add)["out"]

    def many(c: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor((F.greatest(F.size(c), F.lit(1)) - 1) / _STEP).cast("int"))
        return F.flatten(F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit("").alias("gap"), F.array().cast(f"array<{SPANS}>").alias("out")), block(c))["out"])

    return F.element_at(F.transform(F.array(F.transform(chunks, cut)), lambda c: F.when(F.size(c) <= _STEP, few(c)).otherwise(many(c))), 1)


def compact_sentences(text: Column) -> Column:
    """array of sentences of the text with white space runs as one space; only . ! ? end one."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.filter(F.split(flat, r"(?U)(?<=[.!?])\s+"), lambda x: x != "")


def plain_sentences(text: Column) -> Column:
    """array of the pieces between sentence ends and line ends, as they are."""
    return pieces(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+")
