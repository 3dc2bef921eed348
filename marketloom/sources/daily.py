"""Event counts by item and day, kept as a table, so that rollups read new days of the log only.

A refresh counts the newest day known and all days after it anew and replaces their folders; a run that
is repeated, or goes on after a failure, writes the same. Events that arrive for older days are seen if
`since` names the first of these days. Events without a time are counted anew each time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollups import COUNTERS
from .tables import read_or_none


@dataclass(frozen=True)
class DailyEvents:
    """Counts of an event log with the columns `item, kind, score, ts`, at `path`."""

    spark: SparkSession
    path: str
    item: str
    kind: str
    score: str
    ts: str
    counters: Mapping[str, Sequence[str]] = field(default_factory=lambda: COUNTERS)

    def _counts(self) -> list[Column]:
        return [
            F.count("*").alias("total"), F.sum(self.score).alias("score"),
            *[F.count_if(F.col(self.kind).isin(*types)).alias(f"n_{out}") for out, types in self.counters.items()],
        ]

    def newest_day(self) -> date | None:
        """The last day that was counted."""
        known = read_or_none(self.spark, self.path)
        return None if known is None else known.agg(F.max("day")).first()[0]

    def uncounted(self, events: DataFrame, since: date | None = None) -> DataFrame:
        """The events that a refresh reads; the limit is a literal, so that it reaches the scan."""
        first = since or self.newest_day()
        return events if first is None else events.filter((F.col(self.ts) >= F.lit(first.isoformat()).cast(events.schema[self.ts].dataType)) | F.col(self.ts).isNull())

    def refresh(self, events: DataFrame, since: date | None = None) -> None:
        """Count the days of `events` from the newest one known, or from `since`, and replace them."""
        fresh = self.uncounted(events, since)
        counted = fresh.groupBy(F.col(self.item).alias("item"), F.to_date(self.ts).alias("day")).agg(*self._counts())
        counted.hint("rebalance", F.col("day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)

    def days(self) -> DataFrame:
        """`item, total, score, n_..., day`, a row per item and day."""
        return self.spark.read.parquet(self.path)

    def after(self, events: DataFrame, edge: Column) -> DataFrame:
        """`item, total, score` of the events after `edge`: whole days from the table, the day of the edge from the log."""
        day = F.to_date(edge)
        kind = events.schema[self.ts].dataType
        whole = self.days().filter(F.col("day") > day).select("item", "total", "score")
        part = events.filter((F.col(self.ts) > edge) & (F.col(self.ts) < F.date_add(day, 1).cast(kind)))
        part = part.groupBy(F.col(self.item).alias("item")).agg(F.count("*").alias("total"), F.sum(self.score).alias("score"))
        return whole.unionByName(part).groupBy("item").agg(F.sum("total").alias("total"), F.sum("score").alias("score"))

    def popularity(self, items: DataFrame, item_id: str, events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
        """As `rollups.popularity` over the whole log."""
        ever = self.days().groupBy(F.col("item").alias("_item")).agg(
            F.sum("total").alias("total_interactions"), *[F.sum(f"n_{out}").alias(out) for out in self.counters]
        )
        recent = self.after(events, as_of - F.make_dt_interval(F.lit(days))).select(F.col("item").alias("_recent"), F.col("score").alias("pop_score_30d"))
        joined = items.join(ever, F.col(item_id) == F.col("_item"), "left").join(recent, F.col(item_id) == F.col("_recent"), "left").drop("_item", "_recent")
        zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("total_interactions", *self.counters)}
        return joined.withColumns({**zero, "pop_score_30d": F.coalesce(F.col("pop_score_30d"), F.lit(0.0))})

    def trending(self, items: DataFrame, item_id: str, events: DataFrame, by: Sequence[str], as_of: Column) -> DataFrame:
        """As `rollups.trending` over the whole log."""
        week, fortnight = (self.after(events, as_of - F.make_dt_interval(F.lit(d))) for d in (7, 14))
        # All that lies within the week lies within the fortnight.
        per_item = fortnight.select("item", F.col("total").alias("_both")).join(week.select("item", F.col("total").alias("_now")), "item", "left")
        per_item = per_item.select(F.col("item").alias("_item"), "_both", F.coalesce("_now", F.lit(0)).alias("_now"))
        joined = items.filter(F.col(by[0]).isNotNull()).join(per_item, F.col(item_id) == F.col("_item"), "left")
        return joined.groupBy(*by).agg(
            F.coalesce(F.sum("_now"), F.lit(0)).alias("interactions_7d"),
            F.coalesce(F.sum(F.col("_both") - F.col("_now")), F.lit(0)).alias("interactions_prior_7d"),
        )
