"""Comparisons in which an unknown value is false, and the two roundings that the data formats use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    """A column as it is, a name as a column, anything else as a literal."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def gt(a, b) -> Column:
    return _sure(col(a) > col(b))


def ge(a, b) -> Column:
    return _sure(col(a) >= col(b))


def lt(a, b) -> Column:
    return _sure(col(a) < col(b))


def le(a, b) -> Column:
    return _sure(col(a) <= col(b))


def known(a) -> Column:
    return col(a).isNotNull()


def is_true(a) -> Column:
    return _sure(col(a))


def is_text(a, text: str) -> Column:
    return _sure(col(a) == F.lit(text))


def round_up_half(x) -> Column:
    """Nearest whole number, halves up (also below zero)."""
    return F.floor(col(x) + F.lit(0.5))


def round_half_even(x) -> Column:
    return F.bround(col(x), 0)


def number(text) -> Column:
    """A number from text; blank, NaN and everything else unknown."""
    v = F.try_cast(F.trim(col(text)), "double") if hasattr(F, "try_cast") else F.trim(col(text)).try_cast("double")
    return F.when(~F.isnan(v), v)


def text(x) -> Column:
    """Trimmed text; blank is unknown."""
    return F.nullif(F.trim(col(x)), F.lit(""))
