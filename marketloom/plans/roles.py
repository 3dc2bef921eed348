"""Marketplace roles on the shared test tables, as frames and as SQL.

The catalogue is `part`, interactions are `events` (the item is `k` of their JSON), landed
snapshots are `lineitem`. Everything is derived from the tables by expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import Tables

AS_OF_TEXT = "2024-01-31 00:00:00"
WEIGHTS = {"view": 1.0, "click": 2.0, "signup": 4.0, "purchase": 8.0}
COUNTERS = {"views": ("view",), "saves": ("click", "signup"), "contacts": ("purchase",)}
CONTENT = {"brand": 2.0, "model": 1.5, "fuel": 0.5, "transmission": 0.5, "drivetrain": 0.3}


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


def items(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    return t.part.select(
        F.col("p_partkey").alias("item"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.concat_ws(" ", "p_brand", "p_type").alias("model"),
        F.get(words, F.lit(0)).alias("fuel"),
        F.get(words, F.lit(1)).alias("transmission"),
        F.col("p_type").alias("drivetrain"),
        F.col("p_retailprice").alias("price"),
        (F.col("p_size") / 10.0).alias("rating"),
        F.col("p_size").alias("mileage"),
        (F.lit("2024-01-30 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(F.col("p_size"))).alias("crawled_at"),
    )


def interactions(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        F.col("user_id").alias("user"),
        F.get_json_object("props", "$.k").cast("bigint").alias("item"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("score"),
        "ts",
    )


# CTEs with the same columns.
ITEMS = """items AS (
  SELECT p_partkey AS item, p_name AS title, p_brand AS brand, p_brand || ' ' || p_type AS model,
         split_part(p_name, ' ', 1) AS fuel, split_part(p_name, ' ', 2) AS transmission, p_type AS drivetrain,
         p_retailprice AS price, p_size / 10.0::DOUBLE AS rating, p_size AS mileage,
         TIMESTAMP '2024-01-30' - to_days(p_size) AS crawled_at
  FROM part)"""
INTERACTIONS = r"""ev AS (
  SELECT event_id, user_id AS "user", CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS BIGINT) AS item,
         event_type AS kind, value AS score, ts
  FROM events)"""
WEIGHT = "(CASE kind WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'signup' THEN 4.0 WHEN 'purchase' THEN 8.0 ELSE 1.0 END)::DOUBLE"
DAYS = "greatest(0, date_diff('microsecond', {ts}, TIMESTAMP '2024-01-31') / 86400000000.0::DOUBLE)"


def days(ts: str) -> str:
    return DAYS.format(ts=ts)


def decay(ts: str = "ts", lam: float = 0.05) -> str:
    return f"exp(-{lam} * {days(ts)})"
