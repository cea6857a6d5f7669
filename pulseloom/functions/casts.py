"""Tolerant casts: blank and unparsable text never fails a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_double(text: Column) -> Column:
    """Number text to DOUBLE, null if it is none.  The JVM also reads '1d' and '2f'; these are no numbers."""
    t = F.trim(text)
    suffix = F.right(t, F.lit(1)).isin("d", "D", "f", "F") & (F.lower(F.right(t, F.lit(3))) != "inf")
    return F.when(~suffix, t.try_cast("double"))


def first_non_blank(*columns) -> Column:
    """The first value that is not blank after trimming, returned untrimmed; null if none."""
    return F.coalesce(*[F.when(F.trim(_text(c)) != "", _text(c)) for c in columns])


def number_or_zero(value) -> Column:
    return F.coalesce(to_double(_text(value).cast("string")), F.lit(0.0))


def integer_or_zero(value) -> Column:
    """Truncate towards zero: '12.7' becomes 12."""
    return F.coalesce(to_double(_text(value).cast("string")).try_cast("long"), F.lit(0).cast("long"))


def number_or_null(value) -> Column:
    return to_double(_text(value).cast("string"))


def number_if_present(value) -> Column:
    """Null only when blank; unparsable text counts as 0."""
    text = _text(value)
    return F.when(F.trim(text) != "", number_or_zero(text))


def json_numbers(value) -> Column:
    """A JSON array of numbers; null if it is not one or if any element is not a number."""
    parts = F.from_json(_text(value), "array<string>")
    numbers = F.transform(parts, to_double)
    return F.when(F.forall(numbers, lambda x: x.isNotNull()), numbers)


def numbers_or_zero(values: Column) -> Column:
    return F.transform(values, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))


def clean_value(value, fallback: str) -> Column:
    """Trimmed text; the markers of a missing log value turn into ``fallback``."""
    text = F.trim(F.coalesce(_text(value), F.lit("")))
    return F.when(text.isin("", "-", "(empty)", "None"), F.lit(fallback)).otherwise(text)
