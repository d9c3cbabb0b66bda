"""Candidates of papers that are rows of pages: the same as those of the joined text, which no row has to hold.

Papers of few pages and letters, by their counts, meet by their key and are joined in a row: pages are shuffled once. Those of more
than PAGES pages or OCTETS octets, which are few by their counts, go page by page, so no row, group or task holds one.

A line end stands between pages, and a line end ends a sentence, so each page has its own sentences. What goes over its
edges are places and ordinals, which are running sums over numbered pages, and the windows of anchors near an edge: these
pages alone ask for up to `context` sentences on both sides, by the sentences' ordinals within the paper. Nothing is grouped by
paper but the least page number, so a paper with a third of all pages is worked off like any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions.regexes import found
from lodestone.functions.sentences import sentence_spans
from lodestone.operators import numbering, scans
from lodestone.operators.candidates import windows, with_values
from lodestone.operators.shared import scratch

#: Letters of a text that range borders are made of: these are sampled on the driver.
_BORDER = 64

#: Pages and octets of a paper that a row may hold; a paper of more has at least so much of the input, so such papers are few.
PAGES, OCTETS = 1_000, 1 << 20


def _measured(pages: DataFrame, context: int, base: str) -> DataFrame:
    """n, key, size, n_s, n_a, s (sentences, null without an anchor), head and last (those an edge may need), tail: a written table of a row a page."""
    spark, k = pages.sparkSession, max(context, 1)
    order = [F.col("key").asc_nulls_first(), F.col("page_no").asc_nulls_first()]
    pages.repartitionByRange(*order, F.substring("text", 1, _BORDER).asc()).sortWithinPartitions(*order, F.col("text").asc()).write.parquet(f"{base}/sorted")
    d = numbering.by_files(spark, f"{base}/sorted", "n")
    hit = lambda s: found(s["text"], R.RESULT)
    spans = F.transform(sentence_spans(F.col("text")), lambda s, i: F.struct(i.alias("i"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), s["text"].alias("text"), s["gap"].alias("gap"), hit(s).alias("hit")))
    d = d.withColumn("s", spans)
    n_s, n_a = F.size("s"), F.size(F.filter("s", lambda x: x["hit"]))
    tail = F.when(n_s == 0, F.col("text")).otherwise(F.substr("text", F.element_at("s", -1)["end"].cast("int") + 1))
    d = d.select(
        "n", "key", F.length("text").cast("long").alias("size"), n_s.cast("long").alias("n_s"), n_a.cast("long").alias("n_a"), F.when(n_a > 0, F.col("s")).alias("s"),
        F.slice("s", 1, k).alias("head"), F.slice("s", F.greatest(n_s - k, F.least(n_s, F.lit(k))) + 1, k).alias("last"), F.when(n_s == 0, F.col("text")).otherwise(F.coalesce(tail, F.lit(""))).alias("tail"),
    )
    d.write.parquet(f"{base}/measured")
    return spark.read.parquet(f"{base}/measured")


def _placed(measured: DataFrame, base: str) -> DataFrame:
    """n, paper (the number of its first page), at (code points), sb (sentences), ab (anchors) of the paper before the page: a written table."""
    firsts = measured.groupBy("key").agg(F.min("n").alias("n")).select("n", F.lit(True).alias("first"))
    d = measured.select("n", (F.col("size") + 1).alias("size"), "n_s", "n_a").join(firsts, "n", "left")
    own = {"at": "size", "sb": "n_s", "ab": "n_a"}
    d = scans.running(d, "n", {"u_" + c: (F.sum, v) for c, v in own.items()}).withColumns({c: F.col("u_" + c) - F.col(v) for c, v in own.items()})
    # sums before a first page only rise, so the largest up to a page is that of its own paper
    d = d.withColumns({"f_" + c: F.when(F.col("first"), F.col(c)) for c in ("n", *own)})
    d = scans.running(d.select("n", *own, *["f_" + c for c in ("n", *own)]), "n", {"b_" + c: (F.max, "f_" + c) for c in ("n", *own)})
    d.select("n", F.col("b_n").alias("paper"), *[(F.col(c) - F.col("b_" + c)).alias(c) for c in own]).write.parquet(f"{base}/placed")
    return measured.sparkSession.read.parquet(f"{base}/placed")


def _met(wide: DataFrame, measured: DataFrame, placed: DataFrame, context: int) -> DataFrame:
    """n, met: the sentences around a page that its windows reach, and its own first one, each with all white space before it, by ordinal."""
    first, end = F.array_min(F.transform(F.filter("s", lambda x: x["hit"]), lambda x: x["i"])), F.col("sb") + F.col("n_s")
    last = F.array_max(F.transform(F.filter("s", lambda x: x["hit"]), lambda x: x["i"]))
    none = F.array().cast("array<long>")
    back = F.when((first < context) & (F.col("sb") > 0), F.sequence(F.greatest(F.col("sb") - context, F.lit(0).cast("long")), F.col("sb"))).otherwise(none)
    on = F.when(last >= F.col("n_s") - context, F.sequence(end, end + context - 1)).otherwise(none)
    wanted = wide.select("n", "paper", F.explode(F.concat(back, on)).alias("o"))
    edges = measured.select("n", F.explode(F.concat("head", "last")).alias("x")).join(placed, "n")
    edges = edges.select("paper", (F.col("sb") + F.col("x.i")).alias("o"), "at", "x")
    tails = measured.select("n", "n_s", "tail").join(placed, "n").select("paper", (F.col("sb") + F.col("n_s")).alias("o"), F.struct("n", F.concat("tail", F.lit("\n")).alias("tail")).alias("t"))
    tails = tails.join(wanted.select("paper", "o").distinct(), ["paper", "o"], "left_semi").groupBy("paper", "o")
    tails = tails.agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["tail"]), "").alias("between"))
    gap = F.when(F.col("x.i") == 0, F.concat(F.coalesce("between", F.lit("")), "x.gap")).otherwise(F.col("x.gap"))
    item = F.struct("o", (F.col("at") + F.col("x.start")).alias("start"), (F.col("at") + F.col("x.end")).alias("end"), F.col("x.text").alias("text"), gap.alias("gap"), F.col("x.hit").alias("hit"))
    return wanted.join(edges, ["paper", "o"]).join(tails, ["paper", "o"], "left").groupBy("n").agg(F.array_sort(F.collect_list(item)).alias("met"))


def _by_pages(plain: DataFrame, context: int, base: str) -> DataFrame:
    """key, ordinal, start, end, evidence of papers that no row may hold; pages: key, page_no, text (not null)."""
    measured = _measured(plain, context, base)
    placed = _placed(measured, base)
    wide = measured.where("n_a > 0").select("n", "key", "n_s", "s").join(placed, "n")
    d = wide.join(_met(wide, measured, placed, context), "n", "left").withColumn("met", F.coalesce("met", F.array().cast("array<struct<o:long,start:long,end:long,text:string,gap:string,hit:boolean>>")))
    own = F.transform("s", lambda x: F.struct((F.col("sb") + x["i"]).alias("o"), (F.col("at") + x["start"]).alias("start"), (F.col("at") + x["end"]).alias("end"), x["text"].alias("text"), x["gap"].alias("gap"), x["hit"].alias("hit")))
    before = F.filter("met", lambda x: x["o"] <= F.col("sb"))  # with the page's own first sentence, which has all of its gap there
    after = F.filter("met", lambda x: x["o"] >= F.col("sb") + F.col("n_s"))
    # a page of one sentence that is asked for from both sides stands in `before` once
    d = d.withColumns({"_before": before, "_own": own, "_after": after})
    d = d.withColumn("_x", F.concat("_before", F.when(F.size("_before") > 0, F.slice("_own", 2, F.greatest(F.size("_own") - 1, F.lit(0)))).otherwise(F.col("_own")), "_after"))
    size, o0 = F.size("_x"), F.get("_x", F.lit(0))["o"]
    anchors = F.filter(F.transform("_x", lambda x, i: F.struct(i.alias("i"), x["o"].alias("o"), x["hit"].alias("hit"))), lambda x: x["hit"] & (x["o"] >= F.col("sb")) & (x["o"] < F.col("sb") + F.col("n_s")))

    def window(a, j):
        lo, hi = F.greatest(a["i"] - context, F.lit(0)), F.least(a["i"] + context, size - 1)
        # only windows over a whole paper can be equal: those that both of its ends cut short
        low = F.greatest(size - 1 - context, F.lit(0))
        again = F.when((a["i"] + context > size - 1) & (lo == 0) & (o0 == 0) & (a["i"] > low), F.exists(F.slice("_x", low + 1, F.greatest(a["i"] - low, F.lit(0))), lambda x: x["hit"])).otherwise(False)
        return F.struct((F.col("ab") + j + 1).alias("ordinal"), lo.alias("lo"), hi.alias("hi"), again.alias("again"))

    def with_evidence(w):
        rest = F.transform(F.slice("_x", w["lo"] + 2, w["hi"] - w["lo"]), lambda s: F.concat(s["gap"], s["text"]))
        return F.struct(w["ordinal"].alias("ordinal"), F.get("_x", w["lo"])["start"].alias("start"), F.get("_x", w["hi"])["end"].alias("end"), F.concat(F.get("_x", w["lo"])["text"], F.array_join(rest, "")).alias("evidence"))

    d = d.withColumn("_w", F.transform(anchors, window)).withColumn("_w", F.transform(F.filter("_w", lambda w: ~w["again"]), with_evidence))
    return d.select("key", F.explode_outer("_w").alias("_w")).where("_w.ordinal is not null").select("key", "_w.*")


def _joined(pages: DataFrame, context: int) -> DataFrame:
    """key, ordinal, start, end, evidence of papers that a row may hold."""
    over = Window.partitionBy("key").orderBy(F.col("page_no").asc_nulls_first(), F.col("text").asc())
    every = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = pages.select("key", F.row_number().over(over).alias("_k"), F.collect_list("text").over(every).alias("_texts")).where("_k = 1")
    d = windows(d.select("key", F.array_join("_texts", "\n").alias("text")), "text", context)
    return d.select("key", *[F.col(c).cast("long").alias(c) for c in ("ordinal", "start", "end")], "evidence")


def windows_of_pages(pages: DataFrame, key: str = "doc_id", context: int = 2) -> DataFrame:
    """key, ordinal, start, end, evidence, as windows() gives them of the pages' joined text.

    pages: key, page_no, text, a row a page; pages are in the order of page_no, those of one number in that of their texts, nulls first; a
    null text is an empty page. A null key is a paper of its own. Other columns are passed over; no pages give no rows.
    """
    if context < 0:
        raise ValueError("context must not be negative")
    base = scratch(pages.sparkSession, "paged")
    plain = pages.select(F.col(key).alias("key"), F.col("page_no").alias("page_no"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sizes = plain.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("octets"))
    sizes.where((F.col("n") > PAGES) | (F.col("octets") > OCTETS)).select(F.col("key").alias("large")).write.parquet(f"{base}/large")
    large = pages.sparkSession.read.parquet(f"{base}/large")
    if not large.take(1):
        return _joined(plain, context).withColumnRenamed("key", key)
    same = F.col("key").eqNullSafe(F.col("large"))
    rest = _joined(plain.join(F.broadcast(large), same, "left_anti"), context)
    return rest.unionByName(_by_pages(plain.join(F.broadcast(large), same, "left_semi"), context, base)).withColumnRenamed("key", key)


def extract_candidates_of_pages(pages: DataFrame, key: str = "doc_id", context: int = 2) -> DataFrame:
    """extract_candidates() of the pages' joined text, without joining it; places are long."""
    return with_values(windows_of_pages(pages, key, context), key)
