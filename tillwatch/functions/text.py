"""Text expressions: number formats and normalisation of flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grouped(x: Column, digits: int = 0) -> Column:
    """``1,234,567`` with thousands separators, half-even like the ``,.Nf`` format."""
    return F.format_number(x, digits)


def fixed(x: Column, digits: int) -> Column:
    """``1234567.8`` without separators (``.Nf``)."""
    return F.translate(F.format_number(x, digits), ",", "")


def signed(x: Column, digits: int) -> Column:
    """``+12.3`` / ``-12.3`` (``+.Nf``)."""
    text = fixed(x, digits)
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def two_digits(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


# Accepted spellings of a flag, after trimming, upper-casing and removing accents.
TRUE_WORDS = ["SI", "S", "TRUE", "1"]
FALSE_WORDS = ["NO", "N", "FALSE", "0"]


def flag(c: str | Column) -> Column:
    """Spanish yes/no text to boolean; anything else is null."""
    c = F.col(c) if isinstance(c, str) else c
    word = F.translate(F.upper(F.trim(c.cast("string"))), "ÁÉÍÓÚÜÑÀÈÌÒÙ", "AEIOUUNAEIOU")
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def contains_ignoring_case(c: str | Column, fragment: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(c.cast("string")).contains(fragment.lower())
