"""Faster patterns against the ones they stand for, and how often a pattern is looked for."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions.fields import word_or_blank
from lodestone.functions.regexes import first_group, found
from lodestone.functions.sentences import sentence_spans

VOCABULARIES = (R.WINDOW_SOLVENTS, R.WINDOW_LIGANDS, R.WINDOW_SUBSTRATES, R.PAPER_SOLVENTS, R.PAPER_LIGANDS, R.PAPER_SUBSTRATES)


def test_led_words_match_what_words_match(spark):
    rng = random.Random(3)
    every = [w for v in VOCABULARIES for w in v]
    pick = lambda: rng.choice((str.lower, str.upper, str))(rng.choice(every))
    texts = ["", "\u212aetone \u017folvent", "x\u2082THF THF", None] + ["".join(rng.choice((pick(), pick()[:-1], "é", "-")) + rng.choice((" ", "-", "", ", ", "_")) for _ in range(rng.randint(1, 6))) for _ in range(600)]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    for v in (*VOCABULARIES, ("b", "bc", "B c"), ("-x", "y")):
        plain = F.coalesce(F.when(F.octet_length("text") == F.length("text"), F.regexp_extract("text", "(?i)" + R.words(v), 0)).otherwise(first_group(F.col("text"), R.words(v), 0)), F.lit(""))
        assert [tuple(r) for r in d.select(word_or_blank(F.col("text"), v).alias("a"), plain.alias("b")).where("a <> b").collect()] == []
        assert v[0] == "-x" or R.led_words(v).startswith("(?=[")


def test_result_is_there_where_ee_or_yield_is(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(("9", "12.5", ".", " ", "%", "% ", "ee", "EE", "yield", "Yield", "\n", "x", "\u2009", "\u0663")) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    r = d.select(found(F.col("text"), R.RESULT).alias("a"), (found(F.col("text"), R.EE) | found(F.col("text"), R.YIELD)).alias("b")).collect()
    assert all(x.a == x.b for x in r) and 50 < sum(x.a for x in r) < 2900


def test_sentences_are_where_the_plain_split_puts_them(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice((".", "!", "? ", "a", "b ", "\n", " ", "\t", ". ", "2.5", "é", "\u2009")) for _ in range(rng.randint(0, 40 if i % 50 else 900))) for i in range(600)]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in d.select("text", sentence_spans(F.col("text")).alias("s")).collect():
        want = [x.strip() for x in re.split(r"(?<=[.!?])\s+|\n+", r.text) if x.strip()]
        assert [s.text for s in r.s] == want
        assert all(r.text[s.start : s.end] == s.text for s in r.s)


def test_a_pattern_is_looked_for_once(spark):
    """first_group() stood twice in the plan where it was in a branch, as nullif() does."""
    d = spark.createDataFrame([("5 bar",)], "text string").select(F.when(F.col("text") != "", first_group(F.col("text"), r"(\d+)qqq")).alias("x"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("qqq") == 2  # the ASCII form and the Unicode form


def test_evidence_around_the_first_result(spark):
    """The surroundings of the first ee are those that a search by the pattern gives, also where its letters come again."""
    import re

    from pyspark.sql import functions as F

    from lodestone.functions import rules as R
    from lodestone.operators.papers import evidence_sentence

    texts = ["x" * n + f"\t{e} {'y' * m} {e}\n z" for n in (0, 3, 100, 101, 250) for m in (0, 150, 400) for e in ("9% ee", "12.5 % EE", "²٣% ee", "1999% ee")] + ["no result", " 5% ee ", "\n\n 5% ee "]
    got = [r.e for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", evidence_sentence(F.col("t"), R.IRON.metal).alias("e")).orderBy("i").collect()]
    want = []
    for t in texts:
        m = re.search("(?i)" + R.EE, t)
        want.append(t[max(m.start() - 100, 0) : m.end() + 200].replace("\n", " ").strip()[:600] if m else "")
    assert got == want


def test_rounding_without_text(spark):
    """Nearest whole numbers of units say what the exact value says; near the middle of two results text decides."""
    import random

    from pyspark.sql import functions as F

    from lodestone.functions.regexes import rounded

    rng = random.Random(5)
    xs = [rng.uniform(-200, 200) for _ in range(500)] + [rng.randint(0, 9_999_999) / 100_000 for _ in range(500)] + [0.00005, 0.00015, 1.00005, 2.5, -0.00001, 0.0, 1e5, 123456789.00005, 1e17, None]
    text = F.regexp_replace(F.format_number("x", 4), ",", "").cast("double")
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", "x", rounded(F.col("x"), 4).alias("y"), text.alias("z")).orderBy("i").collect()
    assert [r.y for r in got] == [r.z for r in got]
    assert [r.y for r in got[:500]] == [float(f"{r.x:.4f}") for r in got[:500]]
