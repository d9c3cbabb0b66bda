"""Patterns written for Unicode-aware matching, in the JVM's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{N}_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def py_regex(pattern: str) -> str:
    """A case-blind pattern whose classes and word edges follow Unicode: a subscript digit is part of a word, thin spaces are white space."""
    return "(?iU)" + pattern.replace(r"\b", _EDGE)


def _either(text: Column, pattern: str, match: Callable[[str], Column]) -> Column:
    """ASCII texts take the plain pattern, which is faster and says the same of them."""
    return F.when(F.octet_length(text) == F.length(text), match("(?i)" + pattern)).otherwise(match(py_regex(pattern)))


def group_or_blank(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, '' without one or for a null text."""
    return F.coalesce(_either(text, pattern, lambda p: F.regexp_extract(text, p, group)), F.lit(""))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without a match. The group may not match nothing: the text is matched once."""
    # not nullif, which is worked out twice where it stands in a branch
    return F.get(F.filter(F.array(group_or_blank(text, pattern, group)), lambda x: x != ""), 0)


def first_match(text: Column, pattern: str) -> Column:
    return first_group(text, pattern, 0)


def first_piece(text: Column, pattern: str) -> Column:
    """What stands before the first match: the whole text without one."""
    return _either(text, pattern, lambda p: F.get(F.split(text, p, 2), 0))


def pieces(text: Column, pattern: str) -> Column:
    """array of what stands between matches."""
    return _either(text, pattern, lambda p: F.split(text, p))


def all_groups(text: Column, pattern: str, group: int = 1) -> Column:
    return _either(text, pattern, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(group)))


def found(text: Column, pattern: str) -> Column:
    return F.coalesce(_either(text, pattern, text.rlike), F.lit(False))


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), where x is worked out once however often it is used, also in a branch."""
    return F.element_at(F.transform(F.array(x), use), 1)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


#: White space of ASCII texts.
WHITE = " \t\n\x0b\x0c\r"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rounded(x: Column, places: int) -> Column:
    """Half-even on the exact binary value, as decimal text conversion does it; round() differs for many products.

    Of small numbers that are not near the middle of two results the nearest whole number of units says the same, without text.
    """
    units = 10.0**places

    def of(x: Column) -> Column:
        near = F.rint(x * units)
        sure = (F.abs(x * units) < 1e9) & (F.abs(F.abs(x * units - near) - 0.5) > 1e-6)
        return F.when(sure, near / units).otherwise(F.regexp_replace(F.format_number(x, places), ",", "").cast("double"))

    return once(x.cast("double"), of)
