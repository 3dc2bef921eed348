"""Casts and normalisation of scraped strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sign characters that stand for "no value".
DASHES = ("-", "–", "—")


def _keep(col: Column, dropped: str) -> Column:
    return F.nullif(F.regexp_replace(col.cast("string"), dropped, ""), F.lit(""))


def safe_numeric(col: Column, to: str = "double") -> Column:
    """Drop everything but digits, dot and minus, then cast; NULL where nothing valid is left."""
    return _keep(col, r"[^0-9.\-]").try_cast(to)


def safe_integer(col: Column, to: str = "int") -> Column:
    """Like `safe_numeric` for integers. The decimal point is dropped too: '12.5' gives 125."""
    return _keep(col, r"[^0-9\-]").try_cast(to)


def digits_to_int(col: Column) -> Column:
    """All digits of the text as one number, NULL without digits."""
    return _keep(col, r"[^0-9]").try_cast("bigint")


def history_to_bool(col: Column, tokens: Sequence[str]) -> Column:
    """NULL stays NULL (unknown); TRUE when any token occurs, case-insensitive; else FALSE."""
    text = F.lower(col.cast("string"))
    hit = F.lit(False)
    for token in tokens:
        hit = hit | text.contains(token.lower())
    return F.when(col.isNotNull(), hit)


def parse_us_date(col: Column) -> Column:
    """`M/D/YYYY` to DATE; anything else, also an impossible day, is NULL."""
    shaped = F.when(col.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), col)
    return F.try_to_date(shaped, "M/d/yyyy")


def squeeze(col: Column) -> Column:
    """Collapse runs of white space to one blank and trim."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def dash_to_null(col: Column) -> Column:
    """NULL for a lone dash of any width, the squeezed text otherwise."""
    text = squeeze(col)
    return F.when(~text.isin(*DASHES), text)


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def trimmed_lower(col: Column) -> Column:
    return F.lower(F.trim(col))


def initcap_or_null(col: Column) -> Column:
    return F.initcap(blank_to_null(col))
