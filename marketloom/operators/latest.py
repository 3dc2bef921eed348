"""Latest version, top-n, position and predecessor of rows per key.

Every order ends with a full tie-break chosen by the caller. `row_number() <= n`
filters are pushed below the shuffle by Spark, so a hot key sends n rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first `n` rows per key; `rank` names the kept 1-based position."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One current row per non-empty key."""
    present = df
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
        if dict(df.dtypes)[key] == "string":
            present = present.filter(F.col(key) != "")
    return top_n_per_key(present, keys, order, 1)


def dedupe(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by all other columns, so that the choice is reproducible."""
    rest = [c for c in df.columns if c not in keys]
    return top_n_per_key(df, keys, [F.col(c).asc_nulls_last() for c in rest] or [F.lit(1)], 1)


def global_ids(df: DataFrame, order: Sequence[str], out: str = "id", start: int = 1) -> DataFrame:
    """Dense ids over a total order without a single-task window.

    The frame is range-sorted once and written to the checkpoint folder; ids are then
    the position inside the partition plus the number of rows in earlier partitions.
    The offsets hold one row per partition, so their broadcast is bounded.
    """
    width = 1 << 33
    spread = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    placed = cut_lineage(spread)
    placed = placed.withColumn("_pid", F.floor(F.col("_mid") / width))
    sizes = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(offsets), "_pid")
    position = F.col("_mid") - F.col("_pid") * width + F.col("_before") + F.lit(start)
    return joined.select(position.cast("bigint").alias(out), *df.columns)


def previous_row(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], cols: Sequence[str], out: str
) -> DataFrame:
    """Struct `out` of `cols` from the preceding row of the same key, NULL for the first row.

    `chunk` cuts the history of a key into pieces along `order` (a month, a day), so a
    key that holds much of the data is spread over as many tasks as it has pieces. The
    first row of a piece takes its predecessor from the last row of the piece before;
    that exchange moves one row per piece.
    """
    staged = df.withColumn("_chunk", chunk)
    part = [*keys, "_chunk"]
    within = Window.partitionBy(*part).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    values = F.struct(*cols)
    inside = staged.withColumn(out, F.lag(values).over(within)).withColumn("_first", F.row_number().over(within) == 1)
    ends = staged.groupBy(*part).agg(F.max_by(values, F.struct(*order)).alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carried = ends.select(*part, F.lag("_end").over(across).alias("_carried"))
    joined = inside.join(carried, part, "left")
    value = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col(out))
    return joined.select(*df.columns, value.alias(out))
