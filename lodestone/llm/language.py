"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the longest
phrases that occur in the language's text (a character that does not occur is a phrase of its own). A phrase is named
by a place in the sample, log2(sample length) bits, so phrases times that, by the text's characters, estimates
bits a character; the language with the fewest wins. Parsing goes word by word, each word with a space
on both sides, so phrases never cross words and the phrases of equal words are counted once by a worker.

Fitting looks at SAMPLE_DOCS labelled texts a language, those with the smallest hashes, whole; the sample of a language is the
LEXICON words of up to LONGEST letters that are the most frequent in them (documented bounds on rows and words).
Every text is predicted whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import pick, read, released
from lodestone.llm.wordcodes import SLICE, WordCodes, parts

SAMPLE_DOCS, LEXICON, LONGEST = 400, 7_000, 40
#: The most languages a model holds; beyond that fitting is refused.
MOST_LANGS = 400
#: What is no part of a word, in RE2's dialect; words in Java's.
_GAP, _WORD = r"[^\p{L}\p{M}]+", r"[\p{L}\p{M}]+"


class SuffixAutomaton:
    """Accepts the substrings of its text; states as dicts of transitions."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for ch in text:
            cur = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][ch]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.length.append(self.length[p] + 1)
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def phrases(self, text: str) -> int:
        """Greedy longest-match phrases that the text falls into."""
        n, state, states = 0, 0, self.next
        for ch in text:
            to = states[state].get(ch)
            if to is None:
                n += 1
                to = states[0].get(ch)
                if to is None:
                    n += state != 0
                    to = 0
            state = to
        return n + (state != 0)


class Parser:
    """Scores texts against the languages' samples."""

    def __init__(self, samples: dict[str, str], most: int = 24 << 20) -> None:
        self.langs = sorted(samples)
        self.automata = [SuffixAutomaton(samples[k]) for k in self.langs]
        self.bits = np.array([math.log2(max(2, len(samples[k]))) for k in self.langs])
        self.words = WordCodes(self.learn, most)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The phrases of each word in each language."""
        found = [[a.phrases(f" {w} ") if w else 0 for a in self.automata] for w in words]
        return np.array(found, np.int32).ravel(), np.full(len(words), len(self.langs))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score from 0 to 1: how far it is ahead of the next, as a share of its bits, and a half; ties go to the first name."""
        n, k = len(texts), len(self.langs)
        texts = texts.fill_null("")
        known = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        if not k or not known.any():
            return ["und"] * n, np.zeros(n)
        cut = pc.split_pattern_regex(pc.utf8_lower(texts), _GAP)
        words = cut.flatten()
        of_word, phrases = np.repeat(np.arange(n), np.diff(cut.offsets.to_numpy())), np.zeros((n, k))
        for i in range(0, len(words), SLICE):
            counts = self.words.of(words.slice(i, SLICE))[0].reshape(-1, k)
            for j in range(k):
                phrases[:, j] += np.bincount(of_word[i : i + SLICE], counts[:, j], n)
        chars = np.bincount(of_word, pc.utf8_length(words).to_numpy(), n) if len(words) else np.zeros(n)
        rate = phrases * self.bits / np.maximum(chars, 1)[:, None]
        best = rate.argmin(axis=1)
        if k == 1:
            score = np.ones(n)
        else:
            first, second = np.partition(rate, 1, axis=1)[:, :2].T
            score = np.minimum(1.0, 0.5 + (second - first) / np.maximum(second, 1e-9))
        return [self.langs[i] if ok else "und" for i, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


_LAST: list = [None, None]


def parser_of(samples: dict[str, str]) -> Parser:
    """One for equal samples, kept by the worker between tasks."""
    if _LAST[0] != samples:
        _LAST[:] = [samples, Parser(samples)]
    return _LAST[1]


def sample(labelled: DataFrame, docs: int = SAMPLE_DOCS, lexicon: int = LEXICON) -> dict[str, str]:
    """The words of each language, by falling frequency, with a space between them; equal texts count once.

    labelled: lang, text. A language without any letters in its documents is left out. Of words that are as
    frequent as each other the first in order of code points counts.
    """
    d = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    if d.select("lang").distinct().limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    # the smallest hash of each of `docs` slots of a language: a bounded choice without sorting
    slots = d.groupBy("lang", F.pmod("h", F.lit(docs)).alias("slot")).agg(F.min("h").alias("h")).select("lang", "h")
    picked = d.join(F.broadcast(slots), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))
    words = picked.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("word")).where(F.length("word") <= LONGEST)
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")  # the words of at most `docs` texts
    top = words.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= lexicon)
    found: dict[str, list] = {}
    for r in top.collect():  # at most `lexicon` words a language
        found.setdefault(r.lang, []).append((r.k, r.word))
    return {lang: " " + " ".join(w for _, w in sorted(rows)) + " " for lang, rows in found.items()}


def identify(docs: DataFrame, samples: dict[str, str], text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row. Null and letterless texts are `und` with 0, all texts are without languages; ties go to the first name."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(samples)  # at most MOST_LANGS x LEXICON words of LONGEST letters
    d = pick(docs, "doc_id", text_col).toDF("doc_id", "text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(sent.value)
        for b in batches:
            for first, texts in parts(b.column(1)):
                langs, score = parser.predict(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; a null id is not held out and its text is learnt from."""
    docs = read(spark, sf_dir, "documents")
    samples = sample(pick(docs, "doc_id", "lang", "text").where(~held_out()).select("lang", "text"))
    return identify(docs, samples).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
