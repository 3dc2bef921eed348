"""Streaming twins of the incremental batch steps.

Each job drains what has arrived (`availableNow`) and stops. Sinks written per micro-batch
use one folder per batch id, overwritten when a batch is repeated, so a failure between a
write and its commit leaves no duplicates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.keys import file_key
from ..operators.changes import change_history
from ..operators.latest import latest_per_key
from ..operators.sessions import normalize_events
from ..session import written
from ..sources import landing, tables

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def parquet_stream(spark: SparkSession, folder: str, schema: StructType, only: str | None = None, per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; `only` is a file name pattern."""
    reader = spark.readStream.schema(schema).format("parquet")
    if only:
        reader = reader.option("pathGlobFilter", only)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(folder)


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """Raw JSON files as they arrive."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.json")
    return reader.option("recursiveFileLookup", "true").load(root).select("path", "content")


def _drain(query: StreamingQuery) -> None:
    query.awaitTermination()


def land_files(files: DataFrame, target: str, checkpoint: str, run_id: str, within: str = "7 days") -> None:
    """Append the files whose contents are new to the landing table.

    Contents that arrived before, `within` some time, are dropped by the stream's own state; any older ones by the index
    of landed hashes. The time is that of arrival, so no file is too late. Of equal contents in one batch any may land.
    """
    arrived = files.withColumns({"file_hash": file_key(F.col("content")), "arrived": F.current_timestamp()})
    once = arrived.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["file_hash"]).select("path", "content")

    def append(batch: DataFrame, batch_id: int) -> None:
        # Written once, as a load reads its files twice. A batch that is repeated finds what it landed.
        # Loaded in the caller's session: the stream's own has no AQE, so that every task would write a file to every bucket.
        landing.land(written(batch, files.sparkSession), target, run_id, "incremental", F.current_timestamp())

    _drain(once.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def keep_current(
    rows: DataFrame, keys: Sequence[str], version: Sequence[str], target: str, checkpoint: str, buckets: int = 64
) -> None:
    """Current row per key: the largest version wins, in whatever order rows arrive.

    The state lies in `buckets` by key hash. Batch n writes `target/state=n` with the buckets that its
    rows touch and no others; older states of a bucket are kept until the caller drops them.
    """
    order = [F.col(c).desc_nulls_last() for c in version]

    def upsert(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        states = tables.read_or_none(batch.sparkSession, target)
        if states is not None:
            # A repeated batch must not see what its first try wrote.
            older = states.filter(F.col("state") < batch_id)
            touched = placed.select("bucket").distinct()
            placed = placed.unionByName(_newest_states(older).join(touched, "bucket", "left_semi").drop("state"))
        tables.write_snapshot(latest_per_key(placed, keys, order), f"{target}/state={batch_id}", ["bucket"])

    _drain(rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _newest_states(states: DataFrame) -> DataFrame:
    """Of every bucket the rows of its newest state; which that is follows from the folder names."""
    newest = states.groupBy("bucket").agg(F.max("state").alias("state"))
    return states.join(newest, ["bucket", "state"], "left_semi")


def read_current(spark: SparkSession, target: str) -> DataFrame:
    """The newest state that `keep_current` wrote."""
    return _newest_states(spark.read.parquet(target)).drop("state", "bucket")


def log_changes(
    rows: DataFrame, key: str, tracked: Sequence[str], version: Sequence[str], target: str, checkpoint: str, buckets: int = 64
) -> None:
    """Append every row that changes the state of its key: within a batch, and against the last logged row.

    Rows must arrive in the order of `version` from batch to batch; older ones than the last logged row
    are left out. The last row per key is kept next to the log, in buckets as in `keep_current`, so a
    batch reads the buckets it touches and not the log.
    """
    newest = [F.col(c).desc_nulls_last() for c in version]
    oldest = [F.col(c).asc_nulls_first() for c in version]

    def compare(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        seen = change_history(batch, key, version, tracked, F.lit(0)).withColumn("bucket", bucket)
        states = tables.read_or_none(spark, f"{target}/last")
        if states is not None:
            older = states.filter(F.col("state") < batch_id)
            last = _newest_states(older).join(seen.select("bucket").distinct(), "bucket", "left_semi").drop("state")
            after = [F.col(f"_last.{c}") for c in version]
            past = F.struct(*version) > F.struct(*after)
            known = last.select(F.col(key).alias("_key"), F.struct(*tracked, *[c for c in version if c not in tracked]).alias("_last"))
            later = seen.join(known, F.col(key) == F.col("_key"), "left").filter(F.col("_key").isNull() | past)
            # Only the first row of a key can repeat what was logged before it.
            first = F.row_number().over(Window.partitionBy(key).orderBy(*oldest)) == 1
            differs = F.lit(False)
            for c in tracked:
                differs = differs | ~F.col(c).eqNullSafe(F.col(f"_last.{c}"))
            seen = later.withColumn("_first", first).filter(~F.col("_first") | F.col("_key").isNull() | differs).drop("_key", "_last", "_first")
            state = latest_per_key(seen.unionByName(last), [key], newest)
        else:
            state = latest_per_key(seen, [key], newest)
        tables.write_snapshot(seen.drop("bucket"), f"{target}/log/batch={batch_id}")
        tables.write_snapshot(state, f"{target}/last/state={batch_id}", ["bucket"])

    _drain(rows.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_log(spark: SparkSession, target: str) -> DataFrame:
    """All rows that `log_changes` wrote, with their `batch`."""
    return spark.read.parquet(f"{target}/log")


def rolling_counts(
    events: DataFrame, ts: str, by: Sequence[str], aggs: Sequence[Column], target: str, checkpoint: str,
    width: str = "7 days", slide: str = "1 day", watermark: str = "30 days",
) -> None:
    """Sliding-window aggregates; a batch writes the windows that it changed, and the watermark drops what can't change."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    windows = timed.groupBy(F.window("_ts", width, slide).alias("_w"), *by).agg(*aggs)
    flat = windows.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "*").drop("_w")

    def write_changed(batch: DataFrame, batch_id: int) -> None:
        tables.write_snapshot(batch, f"{target}/batch={batch_id}")

    writer = flat.writeStream.outputMode("update").foreachBatch(write_changed).option("checkpointLocation", checkpoint)
    _drain(writer.trigger(availableNow=True).start())


def read_windows(spark: SparkSession, target: str, by: Sequence[str]) -> DataFrame:
    """Every window as `rolling_counts` wrote it last."""
    return latest_per_key(spark.read.parquet(target), ["window_start", *by], [F.col("batch").desc()]).drop("batch")


def track_events(raw: DataFrame, columns: Mapping[str, Column], score: Column, target: str, checkpoint: str) -> None:
    """Normalised events appended to a parquet table by Spark's own exactly-once file sink."""
    rows = normalize_events(raw, columns, score)
    writer = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    _drain(writer.outputMode("append").trigger(availableNow=True).start())
