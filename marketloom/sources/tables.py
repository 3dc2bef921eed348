"""Keyed and partitioned writes on plain parquet tables.

Replace and merge are DataFrames: write them to a path that is not being read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.latest import top_n_per_key


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path`, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_if_absent(
    new: DataFrame, old: DataFrame | None, keys: Sequence[str], tie_break: Sequence[str] = ()
) -> DataFrame:
    """Rows of `new` whose key is neither in `old` nor earlier in `new`.

    Of several new rows with one key the first by `tie_break` stays; without it the rows
    must be equal, as with a key that is a content hash.
    """
    # What is known goes first, so that only new rows are ranked.
    fresh = new if old is None else new.join(old.select(*keys), list(keys), "left_anti")
    if tie_break:
        return top_n_per_key(fresh, keys, [F.col(c).asc_nulls_last() for c in tie_break], 1)
    return fresh.dropDuplicates(list(keys))


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete-and-insert: `old` without the keys of `new`, plus `new`."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def merge_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Upsert: new rows win as a whole, but `keep` columns of existing rows stay as they were."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = o.join(n.withColumn("_new", F.lit(True)).alias("n"), on, "full_outer")
    exists, arrives = F.col(f"o.{keys[0]}").isNotNull(), F.col("n._new").isNotNull()
    cols = []
    for c in new.columns:
        if c in keys:
            value = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        elif c in keep:
            value = F.when(exists, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        else:
            value = F.when(arrives, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        cols.append(value.alias(c))
    return joined.select(*cols)


def high_watermark(table: DataFrame | None, col: str):
    """Largest value of `col` in a target table, as one scalar (NULL when empty)."""
    if table is None:
        return None
    return table.agg(F.max(col)).first()[0]


def newer_than(df: DataFrame, col: str, mark, inclusive: bool = False) -> DataFrame:
    """Rows past a watermark. The mark is a literal, so the scan can skip files by statistics.

    Strict `>` drops rows with a NULL or equal time; `inclusive` keeps equal ones.
    Without a mark every row passes, also those with a NULL time.
    """
    if mark is None:
        return df
    limit = F.lit(mark)
    return df.filter(F.col(col) >= limit if inclusive else F.col(col) > limit)


def newer_than_table(df: DataFrame, table: DataFrame, col: str, inclusive: bool = False) -> DataFrame:
    """Same as `newer_than` as one lazy plan: the mark is a scalar subquery of the target."""
    # Compared with a floor where there is no mark, so that the comparison reaches the scan; NULL times pass only then.
    mark = table.agg(F.max(col)).scalar()
    floor = F.lit("0001-01-01").cast(df.schema[col].dataType) if df.schema[col].dataType.typeName() in ("timestamp", "timestamp_ntz", "date") else None
    if floor is None:
        return df.filter(mark.isNull() | (F.col(col) >= mark if inclusive else F.col(col) > mark))
    limit = F.coalesce(mark, floor)
    return df.filter(F.col(col) >= limit if inclusive else F.col(col) > limit)


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Full refresh of a table at a path that `df` does not read."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of files through Spark's own file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def append_partitioned(df: DataFrame, path: str, date: Column, month: str = "month") -> None:
    """Append into month partitions, which appear on demand. Rows without a date go to the NULL partition.

    Rebalancing by month keeps files large; AQE splits a month that holds much of the data.
    """
    staged = df.withColumn(month, F.date_format(date, "yyyy-MM"))
    staged.hint("rebalance", F.col(month)).write.mode("append").partitionBy(month).parquet(path)


def write_dated_json(df: DataFrame, path: str, date: Column) -> None:
    """JSON lines below dt=<yyyy-MM-dd> folders."""
    staged = df.withColumn("dt", F.date_format(date, "yyyy-MM-dd")).hint("rebalance", F.col("dt"))
    staged.write.mode("append").partitionBy("dt").json(path)
