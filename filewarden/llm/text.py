"""Word and line expressions shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also where `body` uses it in a loop over an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none of a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def lines(text: Column) -> Column:
    """The lines of a text between line feeds; a null has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else unchanged."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def total(values: Column) -> Column:
    """Sum of an array of numbers as a long."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def matches(text: Column, chars: str) -> Column:
    """How many characters of `text` are in the class `chars`."""
    return F.length(text) - F.length(F.regexp_replace(text, chars, ""))
