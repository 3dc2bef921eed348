"""Line deduplication over levelled sorted runs of line keys.

A run is a table of line keys, sorted and split by key: how many documents hold the key so far, and
the largest of them. A batch of documents reduces to the counts of its own keys. These are
merge-joined with the runs: what no run has (the anti join) opens an entry, the rest goes on from
the counts known, and the batch adds the outcome as a run of level 0. `fanout` runs of a level are
merged into one of the next, so that n batches leave about log(n) runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialise, texts

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ("key_a", "key_b")
_NO_ID = -(2**63)
RUN = "key_a long, key_b long, docs long, largest long"


def _halves(line: Column, at: Column, shortest: int) -> Column:
    """Two 64-bit hashes of the line's key, and where it is; null if the key is too short.

    The key is the line without ASCII white space at its ends and with A-Z in lower case.
    A line with letters beyond ASCII is hashed in two parts, all of it in lower case and what is not
    ASCII as it stands: together they say the same as the key, and are found much faster. The two
    characters whose lower case has ASCII letters would not, so lines with them are done letter by letter.
    """
    bare = F.btrim(line, F.lit(SPACE))
    simple = F.octet_length(bare) == F.length(bare)
    odd = F.contains(bare, F.lit("\u212a")) | F.contains(bare, F.lit("\u0130"))
    low = F.when(odd, F.translate(bare, _UPPER, _LOWER)).otherwise(F.lower(bare))
    rest = F.when(simple, F.lit("")).otherwise(F.regexp_replace(bare, r"[\x00-\x7F]+", F.lit("-")))
    return F.when(F.length(bare) >= shortest, F.struct(F.xxhash64(low, rest).alias("key_a"), F.xxhash64(F.lit(7), low, rest).alias("key_b"), at.alias("at")))


def line_keys(docs: DataFrame, shortest: int = 20) -> DataFrame:
    """Per row the hashed keys of `shortest` code points or more: `_id`, `_same` (hash of the text), `keys` (key_a, key_b, at).

    The lines themselves are not needed any more.
    """
    rows = _with_ids(docs)
    keys = F.array_compact(F.transform(F.split("text", "\n", -1), lambda line, at: _halves(line, at, shortest)))
    return rows.select("_id", "_same", keys.alias("keys"))


def batch_run(keys: DataFrame, batches: int = 1) -> DataFrame:
    """The run of a batch of `line_keys`: per key the documents that hold it and the largest.

    A line that a document repeats counts once: keys are made distinct before they leave their row, and
    those of ids with several rows once more across these. A key that a third of all documents hold is
    counted on the map side. With `batches`, documents are dealt to that many and counted by `batch`.
    """
    several = materialise(keys.groupBy("_id").agg(F.count("*").alias("rows")).where("rows > 1").select("_id"))
    ordered = F.array_sort("keys")
    again = lambda k, i: F.get(F.col("ordered"), i - 1)
    repeats = keys.withColumn("ordered", F.when(F.size(F.array_distinct(F.col("keys.key_a"))) < F.size("keys"), ordered))
    distinct = F.filter("ordered", lambda k, i: ~F.coalesce((again(k, i)["key_a"] == k["key_a"]) & (again(k, i)["key_b"] == k["key_b"]), F.lit(False)))
    own = repeats.select("_id", F.pmod(F.xxhash64("_id"), F.lit(batches)).alias("batch"), F.coalesce(distinct, "keys").alias("keys"))
    lines = lambda rows: rows.select("_id", "batch", F.inline("keys")).select("_id", "batch", *KEY)
    once, again_and_again = lines(own.join(several, "_id", "left_anti")), lines(own.join(several, "_id", "left_semi")).distinct()
    return once.unionByName(again_and_again).groupBy("batch", *KEY).agg(F.count("*").alias("docs"), F.max("_id").alias("largest"))


def _with_ids(docs: DataFrame) -> DataFrame:
    """A null id counts as the smallest one."""
    return texts(docs).withColumns({"_id": F.coalesce("doc_id", F.lit(_NO_ID)), "_same": F.xxhash64("text")})


class LineRuns:
    """The levels of sorted runs, in a folder that all executors share.

    Runs get new names and are never changed, so work that is done again after a failure reads what
    the first attempt read.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 4):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.levels: list[list[str]] = [[]]
        self._written = 0

    def _write(self, run: DataFrame, level: int) -> str:
        path = f"{self.folder}/level={level}/run={self._written}"
        self._written += 1
        run.sortWithinPartitions(*KEY).write.mode("overwrite").parquet(path)
        return path

    def _merged(self, paths: list[str]) -> DataFrame:
        """A key's last entry has the largest counts."""
        runs = self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)
        return runs.groupBy(*KEY).agg(F.max("docs").alias("docs"), F.max("largest").alias("largest"))

    def totals(self) -> DataFrame:
        """Per key the documents that hold it and the largest, over all batches."""
        return self._merged([p for level in self.levels for p in level])

    def new_keys(self, run: DataFrame) -> DataFrame:
        """The keys of a batch's run that no earlier run has."""
        return run.join(self.totals(), list(KEY), "left_anti")

    def add(self, run: DataFrame) -> None:
        """Merge-join the run of a batch with the runs, add it as a run, and merge the levels that are full."""
        if any(self.levels):
            seen = self.totals().withColumnsRenamed({"docs": "docs_before", "largest": "largest_before"})
            run = run.join(seen, list(KEY), "left").select(
                *KEY, (F.col("docs") + F.coalesce("docs_before", F.lit(0))).alias("docs"),
                F.greatest("largest", "largest_before").alias("largest"),
            )
        self.levels[0].append(self._write(run, 0))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(self.levels[level]), level + 1))
            self.levels[level] = []
            level += 1


    def frequent(self, at_least: int) -> DataFrame:
        """Key and largest document of keys in `at_least` documents, written, so that its size is known where it is joined."""
        path = f"{self.folder}/frequent={at_least}/run={self._written}"
        self._written += 1
        self.totals().where(F.col("docs") >= at_least).select(*KEY, "largest").write.mode("overwrite").parquet(path)
        return self.spark.read.schema("key_a long, key_b long, largest long").parquet(path)


def add_in_batches(runs: LineRuns, keys: DataFrame, batches: int = 4) -> LineRuns:
    """Take a whole table of `line_keys` in as `batches` batches: keys are counted by batch and written first."""
    counted = materialise(batch_run(keys, batches))
    for batch in range(batches):
        runs.add(counted.where(F.col("batch") == batch).drop("batch"))
    return runs


def without_lines(docs: DataFrame, keys: DataFrame, frequent: DataFrame) -> DataFrame:
    """`row` (the row as it came), `n_lines`, `n_dropped` and the text that is `kept`, for every row of the documents.

    `keys` are the `line_keys` of the documents; lines whose key is in `frequent` go, except from the
    largest document that holds it. Null and empty texts are one empty line. Rows of one id and text
    have one result, given once for each row. Only positions of dropped lines are shuffled to the texts.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own_text = F.coalesce("row.text", F.lit(""))
    rows = rows.withColumns({"_id": F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_NO_ID)), "_same": F.xxhash64(own_text)})
    gone = (
        keys.select("_id", "_same", F.inline("keys")).join(frequent, list(KEY)).where(F.col("_id") != F.col("largest"))
        .groupBy("_id", "_same").agg(F.collect_set("at").alias("gone"))
    )
    lines = F.split(own_text, "\n", -1)
    gone_or_none = F.coalesce("gone", F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone_or_none)
    split = rows.join(gone, ["_id", "_same"], "left").select("row", "gone", lines.alias("lines"))
    return split.select(
        "row", F.size("lines").cast("long").alias("n_lines"), F.size(gone_or_none).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), own_text).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")).alias("kept"),
    )


def dedup(docs: DataFrame, folder: str, shortest: int = 20, at_least: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """`without_lines` of a whole table, its runs kept below `folder`."""
    keys = materialise(line_keys(docs, shortest))
    runs = add_in_batches(LineRuns(docs.sparkSession, folder, fanout), keys, batches)
    return without_lines(docs, keys, runs.frequent(at_least))


def cleaned(docs: DataFrame, folder: str, **options) -> DataFrame:
    """The documents, with all their columns and rows, without the lines that go; `n_chars`, if there, is counted anew."""
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return dedup(docs, folder, **options).select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
