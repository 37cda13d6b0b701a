"""Scalar cleaning functions on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..bands import RUCA_NONMETRO_MIN


def canon_id(x: Column) -> Column:
    """A 10-digit identifier as text, left-padded with zeros, or null.

    Null for: empty; scientific notation anywhere; a leading sign; a letter left when
    white space, dots and hyphens are gone; no digit or more than 10. Other characters
    than digits are dropped.
    """
    x = x.cast("string")
    letters = F.regexp_replace(x, r"[\s.-]", "").rlike("[A-Za-z]")
    digits = F.regexp_replace(x, "[^0-9]", "")
    bad = (x == "") | x.rlike("[eE][+-]?[0-9]+") | x.rlike(r"^\s*[-+]") | letters | (F.length(digits) == 0) | (F.length(digits) > 10)
    return F.when(x.isNotNull() & ~bad, F.lpad(digits, 10, "0"))


def rurality(ruca: Column, labels: tuple[str, str] = ("metro", "nonmetro")) -> Column:
    """Codes up to 3 are metropolitan, from 4 on not; null and what lies between are null."""
    return F.when(ruca <= RUCA_NONMETRO_MIN - 1, labels[0]).when((ruca >= RUCA_NONMETRO_MIN) & ~F.isnan(ruca.cast("double")), labels[1])


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """A quotient as double; null if a side is null or NaN or the denominator is 0."""
    n, d = (F.nanvl(c.cast("double"), F.lit(None).cast("double")) for c in (numerator, denominator))
    return F.try_divide(n, d)
