"""Which files have landed: an index of their hashes that a load asks instead of the landing table.

Hashes lie in runs, one for each load, and in buckets by their first digits. Every bucket of a run has a
Bloom filter of its own, kept as rows: a hash belongs to one block of four words of 64 bits and sets one bit in
each. So filters of any size are built by a grouping and asked by an equal join, and no task and no driver holds
one whole. A load reads the filters of the buckets that its hashes fall into, and hashes only of those runs and
buckets whose filter knows one of them; a load of new files reads next to no hashes.

The filters are written last and make a run visible; a hash that is in two runs does no harm. So a load that dies
leaves an index that is right but lacks its hashes, and a marker by which the next load adds them.
Runs of one size are merged when there are too many, so runs grow few. One load at a time.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

_WORDS = ["w0", "w1", "w2", "w3"]
_HASHES = "file_hash string, ok boolean, run string, bucket int"
_FILTERS = "block bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint, size int, run string, bucket int"


def bit(col: str, word: int) -> Column:
    """The bit that a hash sets in one of its words."""
    place = F.pmod(F.xxhash64(col, F.lit(word)), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def block(col: str, size: Column) -> Column:
    """The block of a hash among 2 ** size."""
    return F.pmod(F.xxhash64(col, F.lit(len(_WORDS))), F.call_function("shiftleft", F.lit(1).cast("bigint"), size))


class LandedIndex:
    """The index at `path`. `digits` hexadecimal digits of a hash make its bucket; they must not change later.

    A block holds `per_block` hashes on average: 16 are 16 bits a hash, and less than one of 100 unknown hashes is
    looked up in vain. More than `fan` runs of one size are merged into one.
    """

    def __init__(self, spark: SparkSession, path: str, digits: int = 2, per_block: int = 16, fan: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        self.digits, self.per_block, self.fan = digits, per_block, fan

    # ---- folders

    def _fs(self):
        context = self.spark.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs
        return hadoop, hadoop.Path(self.path).getFileSystem(context._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        hadoop, fs = self._fs()
        home = hadoop.Path(f"{self.path}/{folder}")
        return sorted(status.getPath().getName() for status in fs.listStatus(home)) if fs.exists(home) else []

    def runs(self) -> dict[str, int]:
        """The visible runs and the size of their filters."""
        sizes = [n for n in self._names("filters") if n.startswith("size=")]
        names = {size: self._names(f"filters/{size}") for size in sizes}
        # A run is there once its filters were committed.
        return {n.split("=", 1)[1]: int(s.split("=", 1)[1]) for s in sizes for n in names[s] if n.startswith("run=") and "_SUCCESS" in self._names(f"filters/{s}/{n}")}

    def _bucket(self) -> Column:
        return F.conv(F.substring("file_hash", 1, self.digits), 16, 10).cast("int")

    # ---- asking

    def known(self, hashes: DataFrame) -> DataFrame:
        """`file_hash, ok` of those `hashes` that have landed; `ok` is false for what was no document. Null hashes are unknown."""
        runs = self.runs()
        none = self.spark.createDataFrame([], "file_hash string, ok boolean")
        if not runs:
            return none
        sizes = F.array(*[F.lit(s) for s in sorted(set(runs.values()))])
        asked = hashes.select("file_hash").where("file_hash is not null").distinct().withColumn("bucket", self._bucket())
        asked = written(asked.withColumn("size", F.explode(sizes)).withColumn("block", block("file_hash", F.col("size"))))
        # Both lists below are bounded by the numbers of buckets and runs, whatever was asked.
        buckets = {r[0] for r in asked.select("bucket").distinct().collect()}
        folders = [f"{self.path}/filters/size={s}/run={n}/bucket={b}" for n, s in runs.items() for b in self._present("filters", n, s) if b in buckets]
        if not folders:
            return none
        filters = self.spark.read.schema(_FILTERS).option("basePath", f"{self.path}/filters").parquet(*folders)
        bits = reduce(lambda a, b: a & b, (F.col(w).bitwiseAND(bit("file_hash", i)) != 0 for i, w in enumerate(_WORDS)))
        maybe = written(asked.join(filters, ["size", "bucket", "block"]).where(bits).select("file_hash", "run", "bucket"))
        parts = sorted(map(tuple, maybe.select("run", "bucket").distinct().collect()))
        if not parts:
            return none
        found = self._hashes([f"run={run}/bucket={b}" for run, b in parts])
        found = found.join(maybe.select("file_hash").distinct(), "file_hash", "left_semi")
        return found.groupBy("file_hash").agg(F.max("ok").alias("ok"))

    def _present(self, kind: str, run: str, size: int) -> list[int]:
        folder = f"{kind}/size={size}/run={run}" if kind == "filters" else f"{kind}/run={run}"
        return [int(n.split("=", 1)[1]) for n in self._names(folder) if n.startswith("bucket=")]

    def _hashes(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(_HASHES).option("basePath", f"{self.path}/hashes").parquet(*[f"{self.path}/hashes/{f}" for f in folders])

    # ---- growing

    def add(self, hashes: DataFrame) -> None:
        """A run of `file_hash, ok`; null hashes are left out. Merges runs when there are too many."""
        self._write(hashes.where("file_hash is not null").select("file_hash", "ok"))
        self.compact()

    def _write(self, hashes: DataFrame) -> None:
        run = uuid.uuid4().hex
        # Sorted, so that a hash is looked up in few row groups.
        rows = hashes.groupBy("file_hash").agg(F.max("ok").alias("ok")).withColumn("bucket", self._bucket())
        rows = rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "file_hash")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/hashes/run={run}")
        there = self.spark.read.schema("file_hash string, ok boolean, bucket int").parquet(f"{self.path}/hashes/run={run}")
        count = there.count()
        if not count:
            return
        size = max(0, math.ceil(math.log2(count / (self.per_block * 16**self.digits))))
        placed = there.withColumn("block", block("file_hash", F.lit(size)))
        filters = placed.groupBy("bucket", "block").agg(*[F.bit_or(bit("file_hash", i)).alias(w) for i, w in enumerate(_WORDS)])
        filters = filters.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "block")
        filters.write.partitionBy("bucket").parquet(f"{self.path}/filters/size={size}/run={run}")

    def compact(self) -> None:
        """Merge the runs of a size of which there are more than `fan`; the merged run is written before they go."""
        runs = self.runs()
        while crowded := [s for s in sorted(set(runs.values())) if list(runs.values()).count(s) > self.fan]:
            old = [n for n, s in runs.items() if s == crowded[0]]
            self._write(self._hashes([f"run={n}" for n in old]).select("file_hash", "ok"))
            hadoop, fs = self._fs()
            for n in old:  # the filters first, as they make a run visible
                fs.delete(hadoop.Path(f"{self.path}/filters/size={crowded[0]}/run={n}"), True)
                fs.delete(hadoop.Path(f"{self.path}/hashes/run={n}"), True)
            runs = self.runs()

    # ---- loads

    def begin(self, load: str) -> None:
        """Note that rows of `load` may be in the landing table before their hashes are here."""
        hadoop, fs = self._fs()
        fs.create(hadoop.Path(f"{self.path}/open/{quote(load, safe='')}"), True).close()

    def done(self, load: str) -> None:
        hadoop, fs = self._fs()
        fs.delete(hadoop.Path(f"{self.path}/open/{quote(load, safe='')}"), False)

    def recover(self, landed: DataFrame | None) -> None:
        """Add what loads that died have landed (`file_hash, run_id`); an index without runs is made from the whole table."""
        if landed is None:
            return
        loads = [unquote(n) for n in self._names("open")]
        ok = landed.select("file_hash", "run_id", F.lit(True).alias("ok"))
        if not self.runs():
            self.add(ok)
        elif loads:
            self.add(ok.where(F.col("run_id").isin(*loads)))
        for load in loads:
            self.done(load)
