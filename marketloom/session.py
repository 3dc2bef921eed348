"""Session construction and checkpoint placement."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "marketloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned with.

    Shuffle partitions are left to the cluster's own setting: AQE coalesces small
    ones and splits skewed joins. The session time zone is UTC because naive
    timestamps in the data are read as UTC.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def allow_repeated_keys(spark: SparkSession) -> None:
    """Let JSON objects repeat a key when they are parsed to VARIANT; the last value stays."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Where none is configured, a session that runs in one process gets a local folder; on a cluster
    the other machines could not read it, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="marketloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside drops its shuffle files as it ends; they would else stay until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise `df` reliably, so that a lost executor never changes what was computed."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    if not eager:
        return df.checkpoint(eager=False)
    with freeing_shuffles(spark):
        return df.select("*").checkpoint()


def written(df: DataFrame, reader: SparkSession | None = None) -> DataFrame:
    """`df` as a table below the checkpoint folder: unlike a checkpoint, its columns can be pruned and it carries no constraints along.

    `reader` is the session that reads the table, if not that of `df`: a stream with state runs its batches in a session without AQE.
    """
    path = f"{checkpoint_dir(reader or df.sparkSession).rstrip('/')}/step-{uuid.uuid4().hex}"
    with freeing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that `written` made, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if not folder.rpartition("/")[2].startswith("step-"):
            raise ValueError(f"{folder} was not written by a step")
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def in_waves(make: Callable[[Callable[[DataFrame, str], DataFrame]], DataFrame], waves: int, keep: bool = False) -> DataFrame:
    """`make` for all keys at once, or for one part of the keys after the other, each written, so that the shuffles of one part are on disk at a time.

    `make` gets a function that keeps the rows whose key, a column, is of the part. Nothing is left out: the parts are those of a hash.
    With `keep` the result is written even if there is one part only.
    """
    if waves <= 1:
        whole = make(lambda df, key: df)
        return written(whole) if keep else whole
    found = None
    for n in range(waves):
        part = written(make(lambda df, key, n=n: df.filter(F.pmod(F.xxhash64(key), F.lit(waves)) == n)))
        found = part if found is None else found.unionByName(part)
    return found
