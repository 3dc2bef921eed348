"""Landing scan: raw JSON files to one envelope row per distinct file."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import file_key
from ..operators.nested import is_object, parse_payload, text_at
from ..session import allow_repeated_keys, written
from .landed import LandedIndex
from .tables import append_partitioned, read_or_none

# Where page number and crawl date sit in a file path.
PAGE_IN_PATH = r"/(?:dt=\d{4}-\d{2}-\d{2}|raw_data)/(\d+)/"
DATE_IN_PATH = r"dt=(\d{4}-\d{2}-\d{2})/"
# Business keys of a listing document.
VIN_PATH = "$.post.basic_desc.VIN"
MODEL_PATH = "$.car.car_model"
TIME_PATH = "$.datetime"


def page_from_path(path: Column) -> Column:
    return F.regexp_extract(F.concat(F.lit("/"), path), PAGE_IN_PATH, 1).try_cast("int")


def date_from_path(path: Column) -> Column:
    return F.regexp_extract(F.concat(F.lit("/"), path), DATE_IN_PATH, 1).try_cast("date")


def scan_files(spark: SparkSession, root: str, crawl_date: str | None = None, suffix: str = "*.json") -> DataFrame:
    """(path, content) of every file below `root`, or below one date folder of it.

    With a date only that folder is listed, so the slice costs nothing for other days.
    """
    folder = f"{root.rstrip('/')}/dt={crawl_date}" if crawl_date else root
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix)
    return reader.load(folder).select("path", "content")


def parse_documents(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Hash, parse and lift keys; files that are not a JSON object are left out, see `rejected_files`."""
    allow_repeated_keys(files.sparkSession)
    text = F.col(content).cast("string")
    parsed = files.select(
        F.col(path).alias("file_path"), file_key(F.col(content)).alias("file_hash"), parse_payload(text).alias("payload")
    )
    payload = F.col("payload")
    return parsed.filter(is_object(payload)).select(
        "file_hash",
        "file_path",
        page_from_path(F.col("file_path")).alias("page_number"),
        date_from_path(F.col("file_path")).alias("crawl_date"),
        text_at(payload, VIN_PATH).alias("vin"),
        text_at(payload, MODEL_PATH).alias("car_model_slug"),
        text_at(payload, TIME_PATH).try_cast("timestamp").alias("crawled_at"),
        "payload",
    )


def rejected_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(file_path, reason) of the files that `parse_documents` leaves out."""
    allow_repeated_keys(files.sparkSession)
    text = F.col(content).cast("string")
    payload = parse_payload(text)
    reason = F.when(F.trim(text) == "", "empty").when(payload.isNull(), "no JSON").when(~is_object(payload), "no object")
    return files.select(F.col(path).alias("file_path"), reason.alias("reason")).filter(F.col("reason").isNotNull())


def stamp_load(df: DataFrame, source: str, run_id: str, ingested_at: Column) -> DataFrame:
    """Load columns; `source` is 'initial' for a backfill and 'incremental' for a dated slice."""
    if source not in ("initial", "incremental"):
        raise ValueError("source must be 'initial' or 'incremental'")
    return df.withColumns(
        {"ingested_at": ingested_at, "source": F.lit(source), "run_id": F.lit(run_id)}
    )


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Row count of a stage, gathered while the load itself runs (no extra pass)."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


@contextmanager
def _whole_plans(spark: SparkSession) -> Iterator[None]:
    """Keep plans that turn out to yield no rows, and with them their observed counts."""
    name, rule = "spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
    before = spark.conf.get(name, None)
    spark.conf.set(name, f"{before},{rule}" if before else rule)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def load_landing(
    spark: SparkSession,
    root: str,
    target: str,
    run_id: str,
    ingested_at: Column,
    crawl_date: str | None = None,
    index: LandedIndex | None = None,
) -> dict[str, int]:
    """Append the new files of a slice (or, without a date, of everything) to the landing table, see `land`."""
    source = "incremental" if crawl_date else "initial"
    return land(scan_files(spark, root, crawl_date), target, run_id, source, ingested_at, index)


def land(files: DataFrame, target: str, run_id: str, source: str, ingested_at: Column, index: LandedIndex | None = None) -> dict[str, int]:
    """Append the new ones of `files` (`path, content`; no path comes twice) to the landing table at `target`.

    The index of landed hashes (beside the table, unless `index` is another one) says which are new, so the
    table is not read and known files are not parsed. Files are read twice: for their hashes, and the new ones to be
    parsed. Of files with equal contents the one with the smallest path lands.

    Returns the scanned (non-empty), parsed, rejected and inserted counts, where what is known counts as it did when
    it came; `rejected_files` says why a file was rejected. Running it again appends nothing, and a load that
    died can be repeated.
    """
    spark = files.sparkSession
    landed = index or LandedIndex(spark, f"{target.rstrip('/')}_index")
    landed.recover(read_or_none(spark, target))
    seen = written(files.select("path", file_key(F.col("content")).alias("file_hash")))
    known = written(landed.known(seen))
    new = written(seen.join(known, "file_hash", "left_anti").groupBy("file_hash").agg(F.min("path").alias("path")))
    rows = stamp_load(parse_documents(files.join(new.select("path"), "path", "left_semi")), source, run_id, ingested_at)
    fresh, inserted = observed(rows, f"inserted-{run_id}-{uuid.uuid4().hex}")
    landed.begin(run_id)
    with _whole_plans(spark):
        append_partitioned(fresh, target, F.col("crawl_date"), "crawl_month")
    table = read_or_none(spark, target)  # None while nothing but rejected files came
    own = new.limit(0) if table is None else table.where(F.col("run_id") == run_id)
    own = own.select("file_hash").distinct().withColumn("ok", F.lit(True))
    judged = written(new.join(own, "file_hash", "left").select("file_hash", F.coalesce("ok", F.lit(False)).alias("ok")))
    landed.add(judged)
    landed.done(run_id)
    good = known.unionByName(judged).where("ok")
    scanned, parsed = seen.count(), seen.join(good, "file_hash", "left_semi").count()
    return {"scanned": scanned, "parsed": parsed, "rejected": scanned - parsed, "inserted": inserted.get["rows"]}
