"""Change log: which keys are new or differ from their last logged state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import changed
from .latest import latest_per_key, previous_row


def _any_changed(left: Sequence[Column], right: Sequence[Column]) -> Column:
    test = F.lit(False)
    for a, b in zip(left, right):
        test = test | changed(a, b)
    return test


def change_log_increment(
    state: DataFrame,
    log: DataFrame,
    key: str,
    tracked: Sequence[str],
    version: Sequence[str] = ("crawl_date", "inserted_at"),
) -> DataFrame:
    """Rows of `state` to append to `log`: first sight, or any tracked column differs (null-safe).

    `version` orders the log; its latest row per key is the state to compare with.
    """
    order = [F.col(c).desc_nulls_last() for c in version]
    last = latest_per_key(log, [key], order).select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_old_{c}") for c in tracked]
    )
    joined = state.join(last, F.col(key) == F.col("_key"), "left")
    differs = _any_changed([F.col(c) for c in tracked], [F.col(f"_old_{c}") for c in tracked])
    return joined.filter(F.col("_key").isNull() | differs).select(*state.columns)


def change_history(
    snapshots: DataFrame, key: str, order: Sequence[str], tracked: Sequence[str], chunk: Column
) -> DataFrame:
    """Every snapshot that differs from the one before it, over the whole history at once."""
    withprev = previous_row(snapshots, [key], chunk, order, tracked, "_prev")
    differs = _any_changed([F.col(c) for c in tracked], [F.col(f"_prev.{c}") for c in tracked])
    return withprev.filter(F.col("_prev").isNull() | differs).drop("_prev")
