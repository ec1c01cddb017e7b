"""Scalar functions on columns, all of built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(value: Column) -> Column:
    """Lower case; every run of other characters than a-z and 0-9 is one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def number(value: Column) -> Column:
    """Double, or null where the text is no finite number."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def truthy(value: Column) -> Column:
    """True for true, 1, yes and y in any case; null stays null."""
    return F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes", "y", "t")


def tokens(value: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(value), F.lit("[a-z0-9]+"), F.lit(0))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is 0 or null."""
    return top / F.nullif(bottom.cast("double"), F.lit(0.0))


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(value, low), high)


def any_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def all_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def messages(*pairs: tuple[Column, str]) -> Column:
    """The texts whose condition is true, as an array in the given order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in pairs]))


def comparable(value: Column, kind: str) -> Column:
    """Text form for table comparison: booleans as true/false, whole numbers without a point, others rounded to 12 digits, null as ''."""
    if kind == "boolean":
        text = F.when(value, "true").otherwise("false")
    elif kind in ("double", "float"):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        text = F.when(F.isnan(value), "").when(whole, value.cast("bigint").cast("string")).otherwise(F.format_string("%.12g", value))
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "").otherwise(text)
