"""Personal data by patterns, and terms that reveal it by corpus co-occurrence; DataFrame functions only.

Patterns find the protected entities (email, ip, card, phone). An entity is what identifies it: a card or phone its digits, an
ip its numbers, an email its letters in lower case. For each entity e and each word t of its documents, outside of
entities, the corpus gives, over all documents, N, n(e), n(t) and n(e,t), and with them

    PMI(e;t) = log2(n(e,t) N / (n(e) n(t))),  IC(e) = log2(N / n(e)),  IC(kind) = log2(N / n(kind)),
    surprise(e;t) = -log2 of the chance of n(e,t) or more documents in common, n(e) n(t) / N expected (Poisson).

t discloses e if PMI(e;t) >= DISCLOSURE * IC(e) (it gives away nearly all the information of the entity),
PMI(e;t) >= IC(kind) (more than the generalisation of e, its kind, gives), and the surprise is MARGIN bits above
log2 of the number of pairs looked at (so that in the whole corpus 2^-MARGIN pairs are expected by chance). With one
common document the surprise never suffices: each rare word of a document would be as good a sign as any other. With
two it does where both words are rare. Such a term becomes a span of the kind `term` wherever it stands, in any
document, and is generalised to the label of the kind it gives away.

Possessive quantifiers and look-behind in the patterns keep Java's matcher linear and its stack flat; they
match what the plain patterns match.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents, read, scratch
from lodestone.operators.lookups import lookup

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
MIN_DOCS, DISCLOSURE, MARGIN = 2, 0.95, 10.0
#: Whole words of letters and digits: three or more of them, or two letters of which the first is a capital.
TERM = r"(?<![\p{L}\p{N}])(?:[\p{L}\p{N}]{3,}+|\p{Lu}\p{L})(?![\p{L}\p{N}])"
_STEP = 256
#: Bytes of terms, or of documents' terms, that are sent to every executor at most.
SENT_BYTES = 16 << 20


def located(text: Column, pattern: str, offset: Column | None = None) -> Column:
    """All matches, leftmost and without overlap, as array of struct(s, e, m) in code points from `offset`.

    Matches lie between the pieces that split() gives. They are added up in steps of _STEP, so that a text with very many matches takes no quadratic time.
    """
    span = "array<struct<s:long,e:long,m:string>>"
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())
    start = F.lit(0).cast("long") if offset is None else offset.cast("long")

    def one(acc: Column, x: Column) -> Column:
        s = acc["pos"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    def block(parts: Column):
        def run(acc: Column, i: Column) -> Column:
            part = F.aggregate(F.slice(parts, i * _STEP + 1, F.lit(_STEP)), F.struct(acc["pos"].alias("pos"), F.array().cast(span).alias("out")), one)
            return F.element_at(F.transform(F.array(part), lambda p: F.struct(p["pos"].alias("pos"), F.concat(acc["out"], F.array(p["out"])).alias("out"))), 1)

        return run

    many = lambda p: F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _STEP).cast("int")), F.struct(start.alias("pos"), F.array().cast(f"array<{span}>").alias("out")), block(p))["out"])
    return F.element_at(F.transform(F.array(pairs), lambda p: F.when(F.size(p) == 0, F.array().cast(span)).otherwise(many(p))), 1)


def _luhn(d: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        return acc + F.when((F.length(d) - i) % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


_GUARD = {"email": lambda t: t.contains("@"), "phone": lambda t: t.contains("+")}


def _of_kind(kind: str, found: Column) -> Column:
    valid = F.filter(found, lambda x: _valid(kind, x["m"]))
    return F.transform(valid, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))


def entities(text: Column) -> Column:
    """array of struct(kind, s, e, m): kinds in the order of KINDS, then by start."""
    parts = []
    for k in KINDS:
        found = located(text, PATTERNS[k])
        if k in _GUARD:
            found = F.when(_GUARD[k](text), found).otherwise(F.array().cast("array<struct<s:long,e:long,m:string>>"))
        parts.append(_of_kind(k, found))
    return F.concat(*parts)


def _replaced(text: Column, spans: Column, put) -> Column:
    """The text with put(span, at, pos) in place of each span; pos is where the spans before it end, at the later of pos and the span's start.

    spans: array of struct(s, e, ..), sorted. They are worked off in steps of _STEP, each in the stretch of text that it covers, so that only
    the stretches are looked for from the text's start, and arrays stay short while they grow.
    """
    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    cut = lambda t, start, n: F.substring(t, (start + 1).cast("int"), n.cast("int"))

    def one(stretch: Column, origin: Column):
        def add(acc: Column, x: Column) -> Column:
            at = F.greatest(acc["pos"], x["s"])
            return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.concat(acc["out"], F.array(cut(stretch, acc["pos"] - origin, at - acc["pos"]), put(x, at, acc["pos"]))).alias("out"))

        return add

    def step(acc: Column, i: Column) -> Column:
        def within(part: Column) -> Column:
            to = F.greatest(acc["pos"], F.array_max(F.transform(part, lambda x: x["e"])))

            def joined(stretch: Column) -> Column:
                new = F.aggregate(part, F.struct(acc["pos"].alias("pos"), F.array().cast("array<string>").alias("out")), one(stretch, acc["pos"]))
                return let(new, lambda n: F.struct(n["pos"].alias("pos"), F.concat(acc["out"], F.array(F.array_join(n["out"], ""))).alias("out")))

            return let(cut(text, acc["pos"], to - acc["pos"]), joined)

        return let(F.slice(spans, i * _STEP + 1, F.lit(_STEP)), within)

    steps = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _STEP).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out"))
    whole = let(F.aggregate(steps, start, step), lambda a: F.concat(F.array_join(a["out"], ""), cut(text, a["pos"], F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans, so that what stands outside of them keeps its place."""
    places = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    return F.element_at(F.transform(F.array(places), lambda p: _replaced(text, p, lambda x, at, _: F.repeat(F.lit(" "), F.greatest(F.lit(0), x["e"] - at).cast("int")))), 1)


def _terms(text: Column) -> Column:
    """The different terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def keyed(docs: DataFrame) -> DataFrame:
    return documents(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"))


def identity(kind: Column, m: Column) -> Column:
    """What is the same for all ways to write one entity."""
    plain_ip = F.regexp_replace(m, r"(?<![0-9])0+(?=[0-9])", "")
    return F.when(kind.isin("card", "phone"), F.regexp_replace(m, "[^0-9]", "")).when(kind == "ip", plain_ip).otherwise(F.lower(m))


def _surprise(n_et: Column, expected: Column) -> Column:
    """-log2 of the Poisson chance of n_et or more: of its first term, and the tail's geometric bound where that is less than one."""
    log_fact = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(n_et, F.lit(50).cast("long"))), F.lit(0.0), lambda s, i: s + F.log2(i.cast("double")))
    # beyond 50 by Stirling's lower bound, which makes the surprise smaller
    large = n_et * F.log2(n_et / F.lit(math.e)) + 0.5 * F.log2(2 * math.pi * n_et)
    first = F.when(n_et <= 50, log_fact).otherwise(large) - n_et * F.log2(expected) + expected * math.log2(math.e)
    return F.when(expected < n_et + 1, first + F.log2(1 - expected / (n_et + 1))).otherwise(0.0)


def _sent(df: DataFrame, size: Column) -> DataFrame:
    """A written table, sent to every executor if its rows and their sizes sum up to SENT_BYTES at most; a larger one is joined by a shuffle."""
    total = df.agg(F.sum(size.cast("long") + 64)).first()[0] or 0
    return F.broadcast(df) if total <= SENT_BYTES else df


def term_spans(found: DataFrame) -> DataFrame:
    """k1, k2, terms (array of struct(s, e, kind)): all places of terms that disclose an entity of the corpus.

    found: k1, k2, spans, clear (the text with entities blanked), one row for each document.
    """
    spark = found.sparkSession
    base = scratch(spark, "pii")
    held = found.where(F.size("spans") > 0)
    # one string an entity, as arrays of strings are made distinct by hash, those of structs by comparing all pairs
    ids = F.array_distinct(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], identity(x["kind"], x["m"]))))
    per_doc = held.select("k1", "k2", F.explode(ids).alias("entity"))
    # an entity of fewer documents cannot reach MIN_DOCS with any term; entities of one kind in the same documents have the same
    # counts with each term, so they are one class, told by sums of the documents' hashes
    parts = [F.shiftright(F.xxhash64("k1", "k2", F.lit(seed)), at).bitwiseAND(F.lit(0xFFFFFFFF)) for seed in (1, 2) for at in (0, 32)]
    n_e = per_doc.groupBy("entity").agg(F.count("*").alias("n_e"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(parts)]).where(F.col("n_e") >= MIN_DOCS)
    n_e = n_e.select("entity", F.struct(F.substring_index("entity", ":", 1).alias("kind"), "n_e", *[f"s{i}" for i in range(len(parts))]).alias("class"), F.col("n_e").alias("n"))
    kinds = held.select(F.explode(F.array_distinct(F.transform("spans", lambda x: x["kind"]))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n_kind"))
    met = lookup(per_doc, n_e, "entity", "n", F.col("k2")).where(F.col("class").isNotNull())
    often = met.groupBy("k1", "k2").agg(F.collect_set("class").alias("classes"))
    terms = held.select("k1", "k2", "clear").join(often, ["k1", "k2"]).select("classes", F.explode(_terms(F.col("clear"))).alias("term"))
    terms.select("term", F.explode("classes").alias("class")).groupBy("class", "term").agg(F.count("*").alias("n_et")).write.parquet(f"{base}/pairs")
    all_pairs = spark.read.parquet(f"{base}/pairs")
    of_class = n_e.groupBy("class").agg(F.count("*").alias("m"))
    looked = all_pairs.groupBy("class").agg(F.count("*").alias("p")).join(of_class, "class").agg(F.sum(F.col("m") * F.col("p")).alias("n_pairs"))
    pairs = all_pairs.where(F.col("n_et") >= MIN_DOCS).select("class.kind", "class.n_e", "term", "n_et").distinct()
    # counted before the join, within each partition first: a common word is a few rows, not a row for each of its documents
    # (an inner join, as a semi join would be moved below the count)
    n_t = found.select(F.explode(_terms(F.col("clear"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    n = found.agg(F.count("*").alias("n")).crossJoin(F.broadcast(looked.select(F.greatest("n_pairs", F.lit(1)).alias("n_pairs"))))  # one row each
    stats = pairs.join(n_t, "term").join(F.broadcast(kinds), "kind").crossJoin(F.broadcast(n))  # one row of n, a row a kind
    pmi = F.log2(F.col("n_et") * F.col("n") / (F.col("n_e") * F.col("n_t")))
    pmi = pmi + 1e-9  # equal counts are to give equal logarithms
    enough = _surprise(F.col("n_et"), F.col("n_e") * F.col("n_t") / F.col("n")) >= F.log2(F.col("n_pairs").cast("double")) + MARGIN
    told = stats.where((pmi >= DISCLOSURE * F.log2(F.col("n") / F.col("n_e"))) & (pmi >= F.log2(F.col("n") / F.col("n_kind"))) & enough)
    told.groupBy("term").agg(F.min("kind").alias("kind")).write.parquet(f"{base}/risky")
    risky = spark.read.parquet(f"{base}/risky")
    of_doc = found.select("k1", "k2", F.explode(_terms(F.col("clear"))).alias("term")).join(_sent(risky, F.octet_length("term")), "term").groupBy("k1", "k2").agg(F.map_from_entries(F.collect_set(F.struct("term", "kind"))).alias("risky"))
    of_doc.write.parquet(f"{base}/of_doc")
    of_doc = spark.read.parquet(f"{base}/of_doc")
    of_doc = _sent(of_doc, F.aggregate(F.map_keys("risky"), F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 16))
    places = F.filter(located(F.col("clear"), TERM), lambda x: F.map_contains_key(F.col("risky"), F.lower(x["m"])))
    places = F.transform(places, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.try_element_at("risky", F.lower(x["m"])).alias("kind")))
    return found.select("k1", "k2", "clear").join(of_doc, ["k1", "k2"]).select("k1", "k2", places.alias("terms")).groupBy("k1", "k2").agg(F.first("terms").alias("terms"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, base (array of struct(kind, s, e, m)), terms (array of struct(s, e, kind), kind being what the term gives away) of each row.

    A null or empty text has no spans. Rows with equal ids are rows of their own; equal rows have equal
    spans. An empty table gives no rows.
    """
    spark = docs.sparkSession
    d = keyed(docs)
    base = scratch(spark, "pii")
    d.withColumn("spans", entities(F.col("text"))).select("doc_id", "k1", "k2", "spans", _blanked(F.col("text"), F.col("spans")).alias("clear")).write.parquet(f"{base}/found")
    found = spark.read.parquet(f"{base}/found")
    return found.join(term_spans(found), ["k1", "k2"], "left").select("doc_id", "k1", "k2", F.col("spans").alias("base"), F.coalesce("terms", F.array().cast("array<struct<s:long,e:long,kind:string>>")).alias("terms"))


def _join(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (base ones, then terms, each by start; kinds may overlap), n_term, n_spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = _join(F.col("base"))
    terms = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["s"], x["e"])), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.when(base != "", base), F.when(terms != "", terms)).alias("spans"), F.size("terms").cast("long").alias("n_term"), (F.size("base") + F.size("terms")).cast("long").alias("n_spans"))


def _masked(text: Column, spans: Column) -> Column:
    """The text with each span's label in its place; overlapping spans become one under the label of the first."""
    return _replaced(text, spans, lambda x, _, pos: F.when(x["s"] < pos, F.lit("")).otherwise(x["label"]))


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns kept, with labels in place of entities and of disclosing terms in `text`. A null text stays null."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, text, at = docs.toDF(*names), docs.columns.index("text"), docs.columns.index("doc_id")
    found = find(docs).where((F.size("base") > 0) | (F.size("terms") > 0))
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    spans = F.concat(
        F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), label[x["kind"]].alias("label"))), F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.rtrim(label[x["kind"]], F.lit("]")), F.lit(" TERM]")).alias("label")))
    )
    spans = found.select("k1", "k2", F.array_sort(spans).alias("all_spans")).groupBy("k1", "k2").agg(F.first("all_spans").alias("all_spans"))
    k = plain.withColumns({"k1": F.coalesce(F.col(f"c{at}").cast("long"), F.lit(-(2**63))), "k2": F.xxhash64(F.coalesce(F.col(f"c{text}").cast("string"), F.lit("")), F.lit(1))})
    new = F.when(F.col("all_spans").isNull(), F.col(f"c{text}")).otherwise(_masked(F.col(f"c{text}"), F.col("all_spans")))
    return k.join(spans, ["k1", "k2"], "left").select(*[new.alias(c) if i == text else F.col(c) for i, c in enumerate(names)]).toDF(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest() of all documents; rows keep null and equal ids, a null text is empty."""
    return digest(find(read(spark, sf_dir, "documents")))


_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text: str | None) -> tuple:
    """The base columns of one text by the plain patterns, for tests."""
    out, counts = [], []
    for k in KINDS:
        n = 0
        for m in re.finditer(_PLAIN[k], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if k == "email" or k == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or k == "card" and 16 <= len(d) <= 19 and luhn or k == "phone" and 8 <= len(d) <= 15:
                out.append(f"{k}:{m.start()}:{m.end()}")
                n += 1
        counts.append(n)
    return (*counts, hashlib.sha256(",".join(out).encode()).hexdigest(), ",".join(out))
