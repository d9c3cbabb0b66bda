"""Values from text: results, conditions and vocabulary, for evidence windows and for whole papers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions.regexes import all_groups, first_group, first_match, found, group_or_blank, once, rounded


def number(text: Column, pattern: str) -> Column:
    """The first number as double, or null."""
    return first_group(text, pattern).cast("double")


def to_bar(value: Column, unit: Column) -> Column:
    """Null for a unit that is not known."""
    factor = F.create_map(*[F.lit(x) for kv in R.BAR.items() for x in kv])
    return value * F.try_element_at(factor, F.lower(unit))


def pressure_bar(text: Column) -> Column:
    """The first pressure in bar, to 4 places."""
    bar = lambda m: to_bar(F.regexp_extract(m, r"^[\d.]+", 0).cast("double"), F.regexp_extract(m, "[A-Za-z]+$", 0))
    return rounded(once(first_match(text, R.PRESSURE), bar), 4)  # a few characters, taken apart


def window_values(text: Column) -> dict[str, Column]:
    return {
        "ee_percent": number(text, R.EE),
        "yield_percent": number(text, R.YIELD),
        "h2_pressure_bar": pressure_bar(text),
        "temperature_c": number(text, R.TEMPERATURE),
        "reaction_time_h": number(text, R.TIME),
        "solvent": first_match(text, R.led_words(R.WINDOW_SOLVENTS)),
        "ligand": first_match(text, R.led_words(R.WINDOW_LIGANDS)),
        "substrate_class": first_match(text, R.led_words(R.WINDOW_SUBSTRATES)),
    }


def confidence(text: Column, value=F.col) -> Column:
    """Hundredths added up as integers, at most 1. `value` gives the column of a field."""
    points = F.lit(R.CONFIDENCE_BASE)
    for name, p in R.CONFIDENCE.items():
        points += F.when(value(name).isNotNull(), p).otherwise(0)
    points += F.when(found(text, R.HYDROGEN_WORD), R.CONFIDENCE_HYDROGEN).otherwise(0)
    return F.least(points, F.lit(100)) / 100


def best(text: Column, pattern: str) -> Column:
    """The largest value with one decimal as string, or ''."""
    top = F.array_max(F.transform(all_groups(text, pattern), lambda x: x.cast("double")))
    return F.coalesce(F.regexp_replace(F.format_number(top, 1), ",", ""), F.lit(""))


def first_or_blank(text: Column, pattern: str) -> Column:
    return group_or_blank(text, pattern)


def word_or_blank(text: Column, vocabulary: tuple[str, ...]) -> Column:
    return group_or_blank(text, R.led_words(vocabulary), 0)


def paper_values(text: Column) -> dict[str, Column]:
    """Strings, '' where nothing is reported; pressures stay in their units."""
    return {
        "ligand": word_or_blank(text, R.PAPER_LIGANDS),
        "substrate_class": word_or_blank(text, R.PAPER_SUBSTRATES),
        "ee_percent": best(text, R.EE),
        "yield_percent": best(text, R.YIELD),
        "h2_pressure": first_or_blank(text, R.PRESSURE_RAW),
        "temperature_c": first_or_blank(text, R.TEMPERATURE_PLAIN),
        "solvent": word_or_blank(text, R.PAPER_SOLVENTS),
        "reaction_time_h": first_or_blank(text, R.TIME),
        "ton": first_or_blank(text, R.TON),
        "tof": first_or_blank(text, R.TOF),
    }
