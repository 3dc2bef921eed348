"""Data-quality checks. Every check yields (check, column, severity, failures, status).

A failing check of severity 'warn' is reported as 'warn' and never stops a run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ERROR, WARN = "error", "warn"


def _status(failures: Column, severity: Column) -> Column:
    return F.when(failures == 0, "pass").otherwise(F.when(severity == WARN, "warn").otherwise("fail"))


def _report(df: DataFrame, check: str, col: Column, severity: Column, failures: Column) -> DataFrame:
    count = F.coalesce(failures, F.lit(0)).cast("bigint")
    return df.select(
        F.lit(check).alias("check"), col.alias("column"), severity.alias("severity"), count.alias("failures"),
        _status(count, severity).alias("status"),
    )


def _single(df: DataFrame, check: str, col: str, severity: str) -> DataFrame:
    return _report(df, check, F.lit(col), F.lit(severity), F.col("_n"))


def check_not_null(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """`{column: severity}`, all columns in one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    entries = F.array(*[
        F.struct(F.lit(c).alias("_c"), F.lit(s).alias("_s"), F.col(c).alias("_n")) for c, s in columns.items()
    ])
    return _report(row.select(F.inline(entries)), "not_null", F.col("_c"), F.col("_s"), F.col("_n"))


def check_unique(df: DataFrame, column: str, severity: str = ERROR) -> DataFrame:
    """Number of non-null values that occur more than once."""
    twice = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_c")).filter("_c > 1")
    return _single(twice.agg(F.count("*").alias("_n")), "unique", column, severity)


def check_accepted_values(df: DataFrame, column: str, values: Sequence[object], severity: str = WARN) -> DataFrame:
    """Number of distinct non-null values outside the list."""
    strange = df.filter(~F.col(column).isin(*values)).select(column).distinct()
    return _single(strange.agg(F.count("*").alias("_n")), "accepted_values", column, severity)


def check_relationship(df: DataFrame, column: str, parent: DataFrame, field: str, severity: str = ERROR) -> DataFrame:
    """Rows whose non-null key has no parent row."""
    keyed = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(F.count("*").alias("_rows"))
    missing = keyed.join(parent.select(F.col(field).alias("_p")), F.col("_k") == F.col("_p"), "left_anti")
    return _single(missing.agg(F.sum("_rows").alias("_n")), "relationships", column, severity)


def check_freshness(df: DataFrame, ts: str, as_of: Column, warn_days: int = 8, error_days: int = 16) -> DataFrame:
    """Age of the newest row: `failures` is its whole days past the warning age."""
    age = F.timestamp_diff("DAY", F.max(ts), as_of)
    row = df.agg(F.coalesce(age, F.lit(1 << 30)).alias("_age"))
    late = F.greatest(F.lit(0), F.col("_age") - warn_days)
    state = F.when(F.col("_age") > error_days, "fail").when(F.col("_age") > warn_days, "warn").otherwise("pass")
    return row.select(
        F.lit("freshness").alias("check"), F.lit(ts).alias("column"), F.lit(ERROR).alias("severity"),
        late.cast("bigint").alias("failures"), state.alias("status"),
    )


def check_no_rows(failing: DataFrame, name: str, column: str, severity: str = ERROR) -> DataFrame:
    """A custom check: any frame of failing rows."""
    return _single(failing.agg(F.count("*").alias("_n")), name, column, severity)


def check_schema(df: DataFrame, expected: StructType) -> DataFrame:
    """One row per expected column, from one pass over the table.

    A missing column or another type is one failure; a column that must not be null fails once for
    each row in which it is.
    """
    actual = {f.name: f.dataType for f in df.schema.fields}

    def failures(f) -> Column:
        if actual.get(f.name) != f.dataType:
            return F.max(F.lit(1))
        return F.max(F.lit(0)) if f.nullable else F.count_if(F.col(f.name).isNull())

    row = df.agg(*[F.coalesce(failures(f), F.lit(int(actual.get(f.name) != f.dataType))).alias(f.name) for f in expected.fields])
    entries = F.array(*[F.struct(F.lit(f.name).alias("_c"), F.col(f.name).cast("bigint").alias("_n")) for f in expected.fields])
    return _report(row.select(F.inline(entries)), "schema", F.col("_c"), F.lit(ERROR), F.col("_n"))


def check_partitions(df: DataFrame, column: str, derived: Column, severity: str = ERROR) -> DataFrame:
    """Rows that lie in another partition than the one that follows from their values."""
    wrong = df.filter(~F.col(column).cast("string").eqNullSafe(derived.cast("string")))
    return _single(wrong.agg(F.count("*").alias("_n")), "partitioning", column, severity)


def union_reports(reports: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def blocking_failures(report: DataFrame) -> DataFrame:
    """The checks that stop a run."""
    return report.filter(F.col("status") == "fail")
