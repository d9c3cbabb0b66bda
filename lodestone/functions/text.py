"""Scalar text functions on columns."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions.regexes import strip


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """Character references decoded; only texts with an ampersand go through Python."""
    return F.when(text.contains("&"), _unescape(text)).otherwise(text)


def without_tags(text: Column) -> Column:
    return strip(F.regexp_replace(text, "<[^>]+>", ""))


def clean_text(text: Column) -> Column:
    """References are decoded before tags go, so escaped tags go too. Null is empty."""
    return without_tags(unescape(F.coalesce(text, F.lit(""))))


def normalize_doi(doi: Column) -> Column:
    d = F.lower(strip(F.coalesce(doi, F.lit(""))))
    return strip(F.regexp_replace(F.regexp_replace(d, r"^https?://(?:dx\.)?doi\.org/", ""), "^doi:", ""))


def title_key(cleaned: Column) -> Column:
    """a-z and 0-9 of a cleaned title, other runs as one space."""
    return F.trim(F.regexp_replace(F.lower(cleaned), "[^a-z0-9]+", " "))


def normalize_title(title: Column) -> Column:
    return title_key(clean_text(title))


def safe_filename(name: Column, suffix: str = ".pdf") -> Column:
    n = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.concat(F.coalesce(F.nullif(F.substring(n, 1, 140), F.lit("")), F.lit("paper")), F.lit(suffix))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def paper_filename(year: Column, authors: Column, title: Column) -> Column:
    """Year_LastName_FirstFourWords.pdf with defaults for what is missing."""
    y = F.when(F.coalesce(year, F.lit("")) == "", "XXXX").otherwise(F.try_to_number(year, F.lit("999999")).cast("string"))
    last = F.try_element_at(_words(F.split_part(F.coalesce(authors, F.lit("")), F.lit(";"), F.lit(1))), F.lit(-1))
    author = F.coalesce(F.nullif(F.substring(F.regexp_replace(last, r"(?U)[^\w-]", ""), 1, 20), F.lit("")), F.lit("Unknown"))
    plain = F.regexp_replace(F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")), r"(?U)[^\w\s-]", "")
    short = F.regexp_replace(F.substring(F.array_join(F.slice(_words(plain), 1, 4), "_"), 1, 45), "^_+|_+$", "")
    return F.concat_ws("_", y, author, F.concat(F.coalesce(F.nullif(short, F.lit("")), F.lit("paper")), F.lit(".pdf")))


def index_of_words(words: Column) -> Column:
    """Map of word to its positions, from 0: words are sorted with their places, so those of one word are neighbours. Inside the row, n log n moves."""

    def of(x: Column) -> Column:
        starts = F.filter(F.transform(x, lambda e, i: F.when((i == 0) | (e["w"] != F.get(x, i - 1)["w"]), i)), lambda i: i.isNotNull())
        end = lambda s, j: F.coalesce(F.get(s, j + 1), F.size(x))
        entry = lambda s, a, j: F.struct(F.get(x, a)["w"].alias("key"), F.transform(F.slice(x, a + 1, end(s, j) - a), lambda e: e["p"]).alias("value"))
        return F.element_at(F.transform(F.array(starts), lambda s: F.map_from_entries(F.transform(s, lambda a, j: entry(s, a, j)))), 1)

    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    return F.element_at(F.transform(F.array(placed), of), 1)


def abstract_from_index(index: Column) -> Column:
    """Text from a map of word to positions; words at one place in alphabetical order. Null and empty give ''."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def split_tokens(text: Column, sep: str = "; ") -> Column:
    """Trimmed tokens that are not blank, with repeats; none of null."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), f"\\Q{sep}\\E"), strip), lambda x: x != "")


def append_tokens(current: Column, new: Column, sep: str = "; ") -> Column:
    """The tokens of a string, repeats included, then those of an array that are not among them, once each."""
    have = split_tokens(current, sep)
    return F.array_join(F.concat(have, F.filter(F.array_distinct(new), lambda x: ~F.array_contains(have, x))), sep)


def append_unique(current: Column, incoming: Column, sep: str = "; ") -> Column:
    """Tokens of both, trimmed, blank ones out; what comes in is added once, what was there stays as it is."""
    return append_tokens(current, split_tokens(incoming, sep), sep)


def unique_tokens(values: Column, sep: str = "; ") -> Column:
    """append_unique over an array of strings in order: the first one's tokens as they are, later ones once."""
    return F.aggregate(values, F.lit(""), lambda acc, x: append_unique(acc, x, sep))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def short_id(url: Column) -> Column:
    return F.substring_index(url, "/", -1)
