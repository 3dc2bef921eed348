"""The weekly load: files to landing table, marts, change log, checks, rollups, similarity.

Each run writes its own folder `run=<id>` per mart and reads the folder of the run before,
so nothing that is read is overwritten and a failed run can simply be repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RecoConfig
from ..operators import changes, quality, similarity, text
from ..operators.latest import latest_per_key
from ..session import cut_lineage
from ..sources import landing, tables
from ..sources.daily import DailyEvents
from ..sources.versions import VersionedTable
from . import marketplace


@dataclass(frozen=True)
class Warehouse:
    """Folder layout of the tables."""

    root: str

    @property
    def landing(self) -> str:
        return f"{self.root}/landing"

    @property
    def price_history(self) -> str:
        return f"{self.root}/price_history"

    @property
    def last_prices(self) -> str:
        return f"{self.root}/last_prices"

    @property
    def daily_events(self) -> str:
        return f"{self.root}/daily_events"

    def mart(self, name: str, run_id: str) -> str:
        return f"{self.root}/{name}/run={run_id}"


class ChecksFailed(RuntimeError):
    """A check of severity 'error' failed."""


def newest_documents(spark: SparkSession, house: Warehouse, run_id: str, before: str | None, full: bool = False) -> marketplace.Current:
    """Write and read back the newest documents of a run.

    After a run `before`, only rows landed since then are read (those of the very time of its newest
    row too, as a load may have gone on) and meet the documents that were newest; `full` starts over.
    """
    landed = spark.read.parquet(house.landing)
    for kind in marketplace.CURRENT_KEYS:
        old = tables.read_or_none(spark, house.mart(f"newest_{kind}", before)) if before and not full else None
        new = landed if old is None else tables.newer_than(landed, "ingested_at", tables.high_watermark(old, "ingested_at"), inclusive=True)
        tables.write_snapshot(marketplace.newest(new, kind, old), house.mart(f"newest_{kind}", run_id))
    return marketplace.Current(**{k: spark.read.parquet(house.mart(f"newest_{k}", run_id)) for k in marketplace.CURRENT_KEYS})


def build_marts(spark: SparkSession, house: Warehouse, run_id: str, before: str | None, load_time: Column, full: bool = False) -> marketplace.Core:
    """Write the core tables of a run and, from what is written, all marts."""
    built = marketplace.build_core(newest_documents(spark, house, run_id, before, full))
    for part in fields(built):
        tables.write_snapshot(getattr(built, part.name), house.mart(f"core_{part.name}", run_id))
    core = marketplace.Core(**{p.name: spark.read.parquet(house.mart(f"core_{p.name}", run_id)) for p in fields(built)})
    old = spark.read.parquet(house.mart("vehicles", before)) if before else None
    made = {
        "vehicles": marketplace.merged_vehicles(old, marketplace.vehicles(core, load_time.cast("date"))),
        "car_models": marketplace.car_models(core), "sellers": marketplace.seller_mart(core), "reviews": marketplace.review_mart(core),
        "vehicle_features": marketplace.vehicle_features(core), "vehicle_images": marketplace.vehicle_images(core),
    }
    for name, frame in made.items():
        tables.write_snapshot(frame, house.mart(name, run_id))
    return core


def append_changes(spark: SparkSession, house: Warehouse, core: marketplace.Core, run_id: str, load_time: Column) -> None:
    """Append changed prices, mileages and states to the log, in folders by month and run.

    The last logged row per vehicle lies in a table of its own, so the log is written and not read. A run
    that is repeated overwrites its own folders of the log: the table of last rows changes after the log.
    """
    tracked, order = ["price", "mileage", "status"], [F.col("crawl_date").desc_nulls_last(), F.col("inserted_at").desc()]
    last = VersionedTable(spark, house.last_prices, ["vin"])
    if not last.versions():
        log = tables.read_or_none(spark, house.price_history)
        if log is not None:  # a log from before there was such a table
            last.refresh(latest_per_key(log, ["vin"], order).drop("month"))
    known, state = last.read(), marketplace.price_state(core)
    grown = state if known is None else changes.change_log_increment(state, known, "vin", tracked)
    grown = cut_lineage(grown.withColumns({"inserted_at": load_time, "run_id": F.lit(run_id)}))
    months = grown.withColumn("month", F.date_format("crawl_date", "yyyy-MM")).hint("rebalance", F.col("month"))
    months.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "run_id").parquet(house.price_history)
    last.change(grown, lambda old, new: latest_per_key(old.unionByName(new), ["vin"], order))


def refresh_rollups(spark: SparkSession, house: Warehouse, run_id: str, events: DataFrame, as_of: Column, cfg: RecoConfig, full: bool = False) -> None:
    """Popularity, trending and item similarity from the event log (vehicle_id, user_id, interaction_type, ...).

    The first two come from counts by day, so only events since the newest day counted are read, or all of them with `full`.
    """
    daily = DailyEvents(spark, house.daily_events, "vehicle_id", "interaction_type", "interaction_score", "created_at")
    daily.refresh(events, since=date.min if full else None)
    items = spark.read.parquet(house.mart("vehicles", run_id))
    shown = items.select("vehicle_id", "title", "brand", "car_model", "price", "primary_image_url", "car_rating")
    tables.write_snapshot(daily.popularity(shown, "vehicle_id", events, as_of), house.mart("popular_vehicles", run_id))
    moving = daily.trending(items, "vehicle_id", events, ["car_model", "brand"], as_of)
    tables.write_snapshot(moving, house.mart("trending_models", run_id))
    near = similarity.item_similarity(
        events, "user_id", "vehicle_id", "interaction_type", "created_at", as_of, cfg.interaction_weights,
        cfg.time_decay_lambda, cfg.lookback_days, cfg.top_n,
    )
    tables.write_snapshot(near, house.mart("item_similarity", run_id))


def build_documents(spark: SparkSession, house: Warehouse, run_id: str, since: Column | None = None) -> DataFrame:
    """(point_id, vehicle_id, document, payload) of the vehicles updated since a date, ready to embed."""
    read = {n: spark.read.parquet(house.mart(n, run_id)) for n in ("vehicles", "vehicle_features", "reviews")}
    items = read["vehicles"] if since is None else read["vehicles"].filter(F.col("last_updated_date") >= since)
    snippets = text.review_snippets(
        read["reviews"], "car_model", "review_title", "review_text", [F.col("review_date").desc_nulls_last(), F.col("review_sk")]
    )
    docs = text.item_documents(items, text.item_features(read["vehicle_features"], "vehicle_id", "feature_name"), snippets, "vehicle_id", "car_model")
    return docs.select(text.point_id(F.col("vehicle_id")).alias("point_id"), "vehicle_id", "document", text.payload(docs).alias("payload"))


def run_checks(spark: SparkSession, house: Warehouse, core: marketplace.Core, run_id: str, events: DataFrame | None, as_of: Column) -> DataFrame:
    """Write the report of a run; raise when an error-level check fails."""
    names = ("vehicles", "car_models", "sellers", "reviews", "vehicle_features", "vehicle_images")
    made = {n: spark.read.parquet(house.mart(n, run_id)) for n in names}
    made["price_history"] = spark.read.parquet(house.price_history)
    report = marketplace.load_checks(spark.read.parquet(house.landing), core, made, events, as_of)
    tables.write_snapshot(report, house.mart("checks", run_id))
    written = spark.read.parquet(house.mart("checks", run_id))
    failed = quality.blocking_failures(written).limit(1).count()
    if failed:
        raise ChecksFailed(f"error-level checks failed in run {run_id}; see {house.mart('checks', run_id)}")
    return written


def embed_documents(spark: SparkSession, house: Warehouse, run_id: str, before: str | None, since: Column | None, fn: Callable) -> None:
    """Embed the documents of vehicles updated since a date and upsert them into the points of the run before."""
    docs = build_documents(spark, house, run_id, since)
    points = text.embed(docs, "document", fn)
    old = tables.read_or_none(spark, house.mart("points", before)) if before else None
    tables.write_snapshot(points if old is None else tables.replace_by_key(old, points, ["point_id"]), house.mart("points", run_id))


def run_weekly_load(
    spark: SparkSession, files_root: str, warehouse_root: str, run_id: str, load_time: Column,
    crawl_date: str | None = None, before: str | None = None, events: DataFrame | None = None, cfg: RecoConfig | None = None,
    full: bool = False, embedding: Callable | None = None,
) -> dict[str, int]:
    """One run. `crawl_date` limits the scan to one day, None loads everything; `before` is the previous run.

    With `before`, landed rows are read from where that run ended; `full` reads them all again.
    With `embedding`, the documents of vehicles updated since `crawl_date` are embedded too.
    """
    house = Warehouse(warehouse_root)
    counts = landing.load_landing(spark, files_root, house.landing, run_id, load_time, crawl_date)
    core = build_marts(spark, house, run_id, before, load_time, full)
    append_changes(spark, house, core, run_id, load_time)
    run_checks(spark, house, core, run_id, events, load_time)
    if events is not None:
        refresh_rollups(spark, house, run_id, events, load_time, cfg or RecoConfig(), full)
    if embedding is not None:
        embed_documents(spark, house, run_id, before, F.lit(crawl_date).cast("date") if crawl_date else None, embedding)
    return counts
