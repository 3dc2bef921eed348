"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: The ASCII white space that contracts strip and split at (fixed).
SPACE = " \t\n\x0b\f\r"


def texts(docs: DataFrame) -> DataFrame:
    """Only `doc_id` and `text` of the documents, null text as empty; other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_share(modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` below the shared checkpoint folder and go on from there.

    As a table rather than a checkpoint: a reader prunes its columns, its joins are planned by its size,
    and loops do not drag the constraints of all earlier rounds along.
    """
    path = shared_folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*steps: DataFrame | None) -> None:
    """Delete what `materialise` wrote for these frames; nothing may read them any more."""
    for step in steps:
        if step is not None:
            context = step.sparkSession.sparkContext
            for folder in {f.rsplit("/", 1)[0] for f in step.inputFiles()}:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                if path.getName().startswith("step-"):
                    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder of this run below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


class Cache(dict):
    """A dictionary that computes missing values and starts anew beyond `limit` entries."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value
