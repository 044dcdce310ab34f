"""Text primitives with Python's notion of white space and words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what Python's str.split() and str.strip() take for white space.
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
#: Fixed value: word characters.
WORD = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WS}+\z", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def is_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")


def count_in(c: Column, parts: list[str]) -> Column:
    """How many of the parts occur in the text."""
    total = F.lit(0)
    for p in parts:
        total = total + F.contains(c, F.lit(p)).cast("int")
    return total


def any_in(c: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(c, F.lit(p))
    return found


def starts_any(c: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.startswith(c, F.lit(p))
    return found


def blank(c: Column) -> Column:
    """Null or empty, as falsy text."""
    return c.isNull() | (c == "")
