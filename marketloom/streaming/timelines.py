"""Change logs of streams whose rows come in any order, from state that is kept per key.

The log holds a row if its tracked columns differ from the row before it in the order of its
key. A late row takes its place between its neighbours: it may have to be logged itself, and it may turn
its successor into a change or into a repetition. The job therefore writes additions and
withdrawals, and the log is what is left of them.

Without an allowed lateness all rows are state. They lie in buckets of keys, a batch reads the buckets that its
rows touch, places all rows of their keys by one window, and writes the buckets anew. A state that a
committed batch has replaced is deleted by the next one, or at the end of the drain.

With an allowed lateness, the state of a key is the rows that a late one could still fall between, and the last row before
them. It lies in RocksDB, so it need not fit in memory, and a timer per key drops
all but the last of the rows that the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..session import discard, freeing_shuffles, in_waves, written
from ..sources import tables
from .jobs import _newest_states

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Tasks that a bucket is dealt to.
PER_BUCKET = 4
#: Rows that are dealt at a time, about.
ROWS_AT_ONCE = 1 << 25
_EVENT_TIME, _MILLIS = "_event_time", "_event_millis"


class Timeline(StatefulProcessor):
    """Rows of one key in order, each with whether the log holds it."""

    def __init__(self, columns: Sequence[str], schema: str, version: Sequence[str], tracked: Sequence[str]):
        self.columns, self.schema = list(columns), schema
        self.version = [self.columns.index(c) for c in version]
        self.tracked = [self.columns.index(c) for c in tracked]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", f"{self.schema}, logged boolean")
        self.last = handle.getValueState("last", self.schema)

    def _place(self, row: tuple) -> tuple:
        """The row's version, with missing parts first."""
        return tuple((row[i] is not None, row[i]) for i in self.version)

    def _same(self, a: tuple, b: tuple) -> bool:
        return all(a[i] == b[i] for i in self.tracked)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(*(r[c] for c in self.columns), None) for r in rows]
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        before = tuple(self.last.get()) if self.last.exists() else None
        # A row that belongs before what has been dropped has no place any more.
        new = [r for r in new if before is None or self._place(r) > self._place(before)]
        # Rows that were there stay before equal ones.
        merged = sorted(held + new, key=self._place)
        kept = []
        for row in merged:
            logged = before is None or not self._same(before, row)
            if logged != bool(row[-1]):
                yield Row(**dict(zip(self.columns, row)), change=1 if logged else -1)
            before = row
            kept.append((*row[:-1], logged))
        if kept:
            self.rows.put(kept)
        if new:
            self.handle.registerTimer(max(self._millis(r) for r in new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        # The head of the timeline that no row can fall into any more.
        n = 0
        while n < len(held) and self._millis(held[n]) <= mark:
            n += 1
        if n:
            self.last.update(held[n - 1][:-1])
            if n < len(held):
                self.rows.put(held[n:])
            else:
                self.rows.clear()
        return iter(())

    def _millis(self, row: tuple) -> int:
        return row[self.columns.index(_MILLIS)] or 0

    def close(self) -> None:
        pass


def _drop_replaced(states: DataFrame, held: str) -> None:
    """Delete the folders of `states` whose buckets have a newer state among them."""
    newest = Window.partitionBy("bucket")
    folders = states.select("state", "bucket").distinct().withColumn("_newest", F.max("state").over(newest)).filter("state < _newest")
    for row in folders.collect():
        tables.drop_folder(states.sparkSession, f"{held}/state={row.state}/bucket={row.bucket}")


def _log_all(rows: DataFrame, key: str, tracked: Sequence[str], version: Sequence[str], target: str, checkpoint: str, buckets: int) -> None:
    """`log_timelines` with all rows as state: `checkpoint/held/state=n` has the buckets that batch n touched."""
    spark, columns, held = rows.sparkSession, rows.columns, f"{checkpoint.rstrip('/')}/held"
    # Rows that were there stay before equal ones; of those in one batch any order will do, but always the same.
    order = [*[F.col(c).asc_nulls_first() for c in version], "_batch", *[c for c in columns if c not in version]]
    state_of = F.struct(F.lit(1), *tracked)

    # A bucket's rows are dealt to a few tasks; all rows of a key go to one of them, which writes them, so that nothing is dealt again.
    share = F.pmod(F.hash(key), F.lit(PER_BUCKET))

    def place(batch: DataFrame, batch_id: int) -> None:
        arrived = written(batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), spark)
        placed = arrived.withColumns({"_batch": F.lit(batch_id).cast("bigint"), "_logged": F.lit(False)})
        states = tables.read_or_none(spark, held)
        if states is not None:
            # A repeated batch must not see what its first try wrote.
            # What the batch before has replaced is read no more: that batch is committed, or this one would not run.
            _drop_replaced(states.filter(F.col("state") < batch_id), held)
            older = _newest_states(spark.read.parquet(held).filter(F.col("state") < batch_id)).select(*placed.columns)
            placed = placed.unionByName(older.join(arrived.select("bucket").distinct(), "bucket", "left_semi"))
        before = F.lag(state_of).over(Window.partitionBy("bucket", "_share", key).orderBy(*order))
        renamed = {"_logged": "_was", "_now": "_logged"}
        waves = min(buckets, max(1, -(-placed.count() // ROWS_AT_ONCE)))
        # Written once, some buckets after the other, with what was logged before; the changes are read from there.
        state = f"{held}/state={batch_id}"
        with freeing_shuffles(spark):
            for n in range(waves):
                dealt = placed.filter(F.col("bucket") % waves == n).withColumn("_share", share).repartition("bucket", "_share")
                judged = dealt.withColumn("_now", ~before.eqNullSafe(state_of)).drop("_share").withColumnsRenamed(renamed)
                judged.write.mode("append" if n else "overwrite").partitionBy("bucket").parquet(state)
        changed = spark.read.schema(judged.select(*columns, "_was", "_logged").schema).parquet(state)
        changes = changed.filter("_logged <> _was").select(*columns, F.when(F.col("_logged"), 1).otherwise(-1).alias("change"))
        tables.write_snapshot(changes, f"{target}/batch={batch_id}")
        discard(arrived)

    rows.writeStream.foreachBatch(place).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    # The last batch is committed, too.
    states = tables.read_or_none(spark, held)
    if states is not None:
        _drop_replaced(states, held)


def log_timelines(
    rows: DataFrame, key: str, tracked: Sequence[str], version: Sequence[str], target: str, checkpoint: str,
    event_time: str | None = None, lateness: str | None = None, buckets: int = 64,
) -> None:
    """Write what a drain of `rows` adds to the change log and what it withdraws, as `change` 1 and -1.

    Rows may come in any order. With `event_time`, the first column of `version`, and `lateness`, rows that come later than that are left
    out, and state is dropped accordingly; without them all rows are kept as state. `version` must be total per key;
    of rows that agree in it, the first to arrive comes first. `buckets` holds for all drains of a log.
    """
    spark, given = rows.sparkSession, rows.schema
    timed = event_time is not None and lateness is not None
    if not timed:
        _log_all(rows, key, tracked, version, target, checkpoint, buckets)
        return
    # Times travel as numbers and texts of the same order, so that they are the same in rows and in state.
    plain = {"timestamp": lambda c: F.unix_micros(c), "timestamp_ntz": lambda c: c.cast("string")}
    whole = {"timestamp": lambda c: F.timestamp_micros(c), "timestamp_ntz": lambda c: c.cast("timestamp_ntz")}
    rows = rows.withColumn(_EVENT_TIME, F.col(event_time).cast("timestamp")).withWatermark(_EVENT_TIME, lateness).withColumn(_MILLIS, F.unix_millis(_EVENT_TIME))
    times = {f.name: f.dataType.typeName() for f in given if f.dataType.typeName() in plain}
    rows = rows.withColumns({c: plain[kind](F.col(c)) for c, kind in times.items()})
    fields = [f for f in rows.schema if f.name != _EVENT_TIME]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    timeline = Timeline([f.name for f in fields], schema, version, tracked)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        changes = rows.groupBy(key).transformWithState(timeline, f"{schema}, change int", "append", "eventTime")
        changes = changes.drop(_MILLIS).withColumns({c: whole[kind](F.col(c)) for c, kind in times.items()})
        writer = changes.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def read_timelines(spark: SparkSession, target: str) -> DataFrame:
    """The change log: rows that were added more often than withdrawn."""
    changes = spark.read.parquet(target)
    columns = [c for c in changes.columns if c not in ("change", "batch")]
    spread = changes.withColumn("_of", F.xxhash64(*columns))
    net = lambda part: part(spread, "_of").groupBy(*columns).agg(F.sum("change").alias("change")).filter("change > 0").drop("change")
    return in_waves(net, -(-changes.count() // ROWS_AT_ONCE))
