"""Text cells, row keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsentry.rules import NO_VALUE


def text_cell(column: Column) -> Column:
    """A stored text cell: null becomes `-`."""
    return F.coalesce(column.cast("string"), F.lit(NO_VALUE))


def number_or_zero(text: Column) -> Column:
    """Number read from a text cell; missing or unreadable text is 0."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def whole_or_zero(text: Column) -> Column:
    """Whole number read from a text cell, truncated towards zero; missing or unreadable text is 0."""
    return F.coalesce(text.try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def row_key(*parts: str) -> Column:
    """Key of a stored view row: the parts joined with `|`, a null part as `-`."""
    return F.concat_ws("|", *[text_cell(F.col(part)) for part in parts])


def row_hash(*columns: str) -> Column:
    """SHA-256 over the columns joined with `|`; nulls are skipped."""
    return F.sha2(F.concat_ws("|", *[F.col(name).cast("string") for name in columns]), 256)


def identity_hash(*columns: str) -> Column:
    """SHA-256 over the columns, which differs where any of them differs: a null is marked, the separator escaped."""
    escaped = [F.replace(F.replace(F.col(name).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for name in columns]
    return F.sha2(F.concat_ws("|", *[F.coalesce(text, F.lit("\\N")) for text in escaped]), 256)


def timestamp_or_null(column: Column) -> Column:
    """Timestamp read from text, null where it does not parse, also in ANSI mode."""
    return F.try_to_timestamp(column)
