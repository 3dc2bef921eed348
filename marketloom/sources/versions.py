"""Tables that are changed bucket by bucket and replaced in one step.

Rows lie in buckets by a hash of their key. A version of the table is a manifest that names, for
each bucket, the folder that holds it. A change reads and writes the buckets that its rows touch, into a new
folder, and becomes visible when its manifest appears; that is one rename to a name that must not exist.
So readers see the old version or the new one, a run that dies leaves the old one, and of two runs that
start from the same version one fails.

What the driver holds is one entry per bucket, however large the table is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tables

BUCKET = "_bucket"


class VersionConflict(RuntimeError):
    """Another run has written the next version first."""


class VersionedTable:
    """A table at `path`; `buckets` holds for a new table, an old one keeps its own number."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        manifest = self.manifest()
        self.buckets = manifest["buckets"] if manifest else buckets

    # ---- manifests: small files that only the driver reads

    def _fs(self):
        context = self.spark.sparkContext
        home = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return context._jvm.org.apache.hadoop.fs, home.getFileSystem(context._jsc.hadoopConfiguration()), home

    def versions(self) -> list[int]:
        _, fs, home = self._fs()
        if not fs.exists(home):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(home)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The given version, or the newest one; None before the first."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        hadoop, fs, home = self._fs()
        stream = fs.open(hadoop.Path(home, f"{version}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {"version": version, **json.loads(text)}

    def _publish(self, version: int, schema: StructType, folders: dict[str, str]) -> None:
        hadoop, fs, home = self._fs()
        draft, final = hadoop.Path(home, f".{uuid.uuid4().hex}"), hadoop.Path(home, f"{version}.json")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"buckets": self.buckets, "schema": schema.json(), "folders": folders}).encode()))
        finally:
            out.close()
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(home.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, final, options)
        except Py4JJavaError as err:
            fs.delete(draft, False)
            if "FileAlreadyExists" in err.java_exception.getClass().getName():
                raise VersionConflict(f"version {version} of {self.path} exists") from err
            raise

    # ---- reading

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The rows of a version, of all buckets or of some; None before the first version."""
        manifest = self.manifest(version)
        if manifest is None:
            return None
        wanted = None if buckets is None else {str(b) for b in buckets}
        folders = [f"{self.path}/{folder}/{BUCKET}={b}" for b, folder in manifest["folders"].items() if wanted is None or b in wanted]
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        # Columns that came later are NULL in older buckets.
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # ---- writing

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, manifest: dict | None, kept: dict[str, str]) -> None:
        folder = f"data/{uuid.uuid4().hex}"
        # Rebalanced by bucket, so that files are large and a bucket of many rows is split.
        self._placed(rows).hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        hadoop, fs, _ = self._fs()
        names = [status.getPath().getName() for status in fs.listStatus(hadoop.Path(f"{self.path}/{folder}"))]
        written = {n.split("=", 1)[1]: folder for n in names if n.startswith(f"{BUCKET}=")}
        self._publish(manifest["version"] + 1 if manifest else 1, rows.schema, {**kept, **written})

    def refresh(self, rows: DataFrame) -> None:
        """Replace the whole table; `rows` may be computed from it."""
        self._write(rows, self.manifest(), {})

    def change(self, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Write `combine(old, new)` for the buckets that `new` touches, where `old` is what they held. `new` is read twice."""
        manifest = self.manifest()
        if manifest is None:
            return self._write(combine(self.spark.createDataFrame([], new.schema), new), None, {})
        touched = [r[0] for r in self._placed(new).select(BUCKET).distinct().collect()]
        if touched:
            kept = {b: folder for b, folder in manifest["folders"].items() if int(b) not in touched}
            self._write(combine(self.read(manifest["version"], touched), new), manifest, kept)

    def replace(self, new: DataFrame) -> None:
        """Rows of the keys of `new` give way to `new`."""
        self.change(new, lambda old, rows: tables.replace_by_key(old, rows, self.keys))

    def merge(self, new: DataFrame, keep: Sequence[str] = ()) -> None:
        """New rows win, but `keep` columns of known keys stay."""
        self.change(new, lambda old, rows: tables.merge_by_key(old, rows, self.keys, keep))

    def forget(self, versions: int = 2) -> None:
        """Delete folders that the newest `versions` manifests don't name, and older manifests. No other run may be writing."""
        known = self.versions()
        hadoop, fs, home = self._fs()
        named = {folder for v in known[-versions:] for folder in self.manifest(v)["folders"].values()}
        for v in known[:-versions]:
            fs.delete(hadoop.Path(home, f"{v}.json"), False)
        for status in fs.listStatus(hadoop.Path(f"{self.path}/data")):
            if f"data/{status.getPath().getName()}" not in named:
                fs.delete(status.getPath(), True)
