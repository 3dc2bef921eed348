"""Text shaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_at_word(col: Column, limit: int = 600) -> Column:
    """At most `limit` characters, cut back to the last blank; short texts are unchanged."""
    head = F.left(col, F.lit(limit))
    return F.when(F.length(col) > limit, F.regexp_replace(head, " [^ ]*$", "")).otherwise(col)


def labelled(label: str, col: Column, suffix: str = ".") -> Column:
    """'Label: value.' or NULL when the value is missing or empty."""
    return F.when(col.isNotNull() & (col != ""), F.concat(F.lit(label), F.lit(": "), col, F.lit(suffix)))


def sentence_list(label: str, items: Column, limit: int | None = None) -> Column:
    """'Label: a, b, c.' from an array; NULL when it is empty."""
    shown = F.slice(items, 1, limit) if limit else items
    return F.when(F.size(items) > 0, F.concat(F.lit(label), F.lit(": "), F.array_join(shown, ", "), F.lit(".")))
