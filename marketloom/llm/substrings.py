"""Passages that occur more than once, found by compressed full-text indexes over shards of the corpus.

A passage of `width` words or more counts wherever it stands, in another document or again in the same.

Shards are cut by content, so that a document need not be searched for in all of them. Every window of
`width` words has a smallest hash among its runs of `gram` words; a segment is a run of windows of one
document with the same smallest hash, and segments go to shards by that hash. Equal windows have equal
hashes, so all occurrences of a window meet in one shard, and each window lies in one segment only. A
hash that stands at one place of the whole corpus can't belong to a repeated window; such segments stay
where they are.

Equal texts, and then equal segments, are one, with a weight. A shard holds an FM-index of its segments
(`fm_index`); its segments are streamed against it, and backward searches give the runs of windows that
weigh two or more. A hash with more than `crowded` different segments (a passage in very many different
surroundings) is cut again into single windows, each with its own hash; windows that occur once are left
out, and no shard grows with a passage's number of surroundings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, texts
from .fm_index import repeated_windows
from .words import Numbered

_STEP = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LONGS = pa.list_(pa.int64())
_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_COPY = ("copy_a", "copy_b")
_KEY = ("doc_id", "same")
#: Words that are handled at once when texts are read.
_BATCH = 1_000_000


def words_of(text: str) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in UTF-8; splitting bytes splits at just these characters."""
    return text.encode().split()


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    out = a * _STEP + b
    out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` words, from hashes of runs of powers of two."""
    out, done, power, size = None, 0, hashes, 1
    while True:
        if length & size:
            tail = power[done : len(hashes) - size + 1]
            out = tail if out is None else combined(out[: len(tail)], tail)
            done += size
        if size * 2 > length:
            return out[: max(0, len(hashes) - length + 1)]
        power = combined(power[:-size], power[size:]) if len(power) > size else power[:0]
        size *= 2


def sliding(values: np.ndarray, length: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) over every `length` consecutive values."""
    size = 1
    while size * 2 <= length:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[: len(values) - (length - size)], values[length - size :]) if length > size else values


class Windows:
    """Hashes of words, and the smallest run of words of every window, for many texts at once."""

    def __init__(self, width: int, gram: int, limit: int = 400_000):
        if not 0 < gram < width:
            raise ValueError("a run must be shorter than the window")
        self.width, self.gram = width, gram
        self.hashes = np.zeros(limit + 1, np.uint64)
        self.numbered = Numbered(self._describe, limit)

    def _describe(self, word: bytes, i: int) -> None:
        self.hashes[i] = xxhash.xxh3_64_intdigest(word)

    def hashed(self, words: list[bytes]) -> np.ndarray:
        parts = [words[at : at + 100_000] for at in range(0, len(words), 100_000)]
        return np.concatenate([self.hashes[np.fromiter(self.numbered(p), np.int64, len(p))] for p in parts] or [np.zeros(0, np.uint64)])

    def smallest(self, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts laid end to end: hashes of runs, the smallest within each window, and whether a window lies in one text."""
        ends = np.cumsum(lengths)
        inside = np.ones(max(0, len(hashes) - self.width + 1), bool)
        # A window that begins fewer than `width` words before an end, but not at or after it, runs over it.
        for begin, end in zip(np.maximum(ends - self.width + 1, ends - lengths), ends, strict=True):
            inside[begin:end] = False
        runs = run_hashes(hashes, self.gram) if len(inside) else np.zeros(0, np.uint64)
        return runs, sliding(runs, self.width - self.gram + 1, np.minimum) if len(inside) else runs, inside


def batched(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Parts of the batches with the words of their texts, of about `_BATCH` words each."""
    for batch in batches:
        begin, n, held = 0, 0, []
        for i, text in enumerate(batch.column(column)):
            words = words_of(text.as_py())
            if held and n + len(words) > _BATCH:
                yield batch.slice(begin, i - begin), held
                begin, n, held = i, 0, []
            held.append(words)
            n += len(words)
        if held:
            yield batch.slice(begin), held


def keyed(docs: DataFrame) -> DataFrame:
    """`doc_id, same, text`: the id and a hash of the text tell rows of different documents apart."""
    return texts(docs).select("doc_id", F.xxhash64("text").alias("same"), "text")


def read(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Per row: hash of its words (`copy_a, copy_b`), their number, their SHA-256 joined by blanks, and the hashes (`grams`) at every place that is the smallest of a window, each twice at most."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(width, gram)
        for batch, held in batched(batches, 2):
            hashes = [windows.hashed(w) for w in held]
            lengths = np.array([len(w) for w in held])
            runs, least, inside = windows.smallest(np.concatenate(hashes), lengths)
            begins = np.concatenate(([0], np.cumsum(lengths)))
            if len(runs):
                span = width - gram
                # A place counts if it is the smallest of any window that lies in one text.
                best = sliding(np.pad(np.where(inside, least, np.uint64(0)), span), span + 1, np.maximum)
                places = np.flatnonzero(best == runs)
                row = np.searchsorted(begins, places, side="right") - 1
                by = np.lexsort((runs[places], row))
                row, grams = row[by], runs[places][by].view(np.int64)
                # Twice in one text says it all.
                few = np.ones(len(row), bool)
                few[2:] = (row[2:] != row[:-2]) | (grams[2:] != grams[:-2])
                row, grams = row[few], grams[few]
            else:
                row = grams = np.zeros(0, np.int64)
            cuts = np.searchsorted(row, np.arange(len(held) + 1)).astype(np.int32)
            joined = [b" ".join(w) for w in held]
            copies = [xxhash.xxh3_128_intdigest(x) for x in joined]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([(c >> 64) - 2**63 for c in copies], pa.int64()), pa.array([(c & 2**64 - 1) - 2**63 for c in copies], pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in joined], pa.string()),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(grams)),
                ],
                names=["doc_id", "same", "copy_a", "copy_b", "n_words", "sha256", "grams"],
            )

    return keyed(docs).mapInArrow(compute, "doc_id long, same long, copy_a long, copy_b long, n_words long, sha256 string, grams array<long>")


def segments(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """The segments of `docs` (`doc_id, same, text, wanted`) whose smallest hash is among `wanted`.

    `bucket` is that hash, `start` the first word, `n` the number of words, `words` the words joined by blanks, `copy_a, copy_b`
    their hash, and `place` a hash of where the segment stands. Runs of windows are cut every `width` windows, so
    that a text of one word over and over has short segments, too.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(width, gram)
        for batch, held in batched(batches, 2):
            lengths = np.array([len(w) for w in held])
            _, least, inside = windows.smallest(np.concatenate([windows.hashed(w) for w in held]), lengths)
            begins = np.concatenate(([0], np.cumsum(lengths)))
            rows, starts, sizes, buckets, bodies, copies = [], [], [], [], [], []
            for row, words in enumerate(held):
                own = least[begins[row] : begins[row + 1] - width + 1]
                if len(words) < width:
                    continue
                new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
                kept = np.isin(own[new[:-1]], np.asarray(batch.column(3)[row].values.to_numpy()).view(np.uint64))
                for low, high in zip(new[:-1][kept].tolist(), new[1:][kept].tolist(), strict=True):
                    for at in range(low, high, width):
                        upto = min(high, at + width) + width - 1
                        body = b" ".join(words[at:upto])
                        rows.append(row)
                        starts.append(at)
                        sizes.append(upto - at)
                        buckets.append(own[low])
                        bodies.append(body)
                        copies.append(xxhash.xxh3_128_intdigest(body))
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.array(buckets, np.uint64).view(np.int64)),
                    pa.array([(c >> 64) - 2**63 for c in copies], pa.int64()), pa.array([(c & 2**64 - 1) - 2**63 for c in copies], pa.int64()),
                    pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(bodies, pa.binary()),
                ],
                names=["doc_id", "same", "bucket", "copy_a", "copy_b", "start", "n", "words"],
            )

    kind = "doc_id long, same long, bucket long, copy_a long, copy_b long, start int, n int, words binary"
    return docs.select(*_KEY, "text", "wanted").mapInArrow(compute, kind).withColumn("place", F.xxhash64(*_KEY, "start"))


def _contents(found: DataFrame, also: list[Column] | None = None) -> DataFrame:
    """Equal segments as one: their words, and whether they stand at several places (a row that comes twice stands at one)."""
    return found.groupBy("bucket", *_COPY).agg(F.first("words").alias("words"), F.first("n").alias("n"), (F.min("place") < F.max("place")).alias("several"), *(also or []))


def cut(contents: DataFrame, width: int) -> DataFrame:
    """Single windows of contents, as contents of their own; `place` tells windows apart, `from_a, from_b, start` where they come from."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, bodies, copies = [], [], [], []
            for row, body in enumerate(batch.column(2)):
                words = body.as_py().split()
                for at in range(len(words) - width + 1):
                    rows.append(row)
                    starts.append(at)
                    bodies.append(b" ".join(words[at : at + width]))
                    copies.append(xxhash.xxh3_128_intdigest(bodies[-1]))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take), batch.column(1).take(take), batch.column(3).take(take), pa.array(starts, pa.int32()),
                    pa.array([(c >> 64) - 2**63 for c in copies], pa.int64()), pa.array([(c & 2**64 - 1) - 2**63 for c in copies], pa.int64()), pa.array(bodies, pa.binary()),
                ],
                names=["from_a", "from_b", "several_from", "start", "copy_a", "copy_b", "words"],
            )

    kind = "from_a long, from_b long, several_from boolean, start int, copy_a long, copy_b long, words binary"
    windows = contents.select(F.col("copy_a"), F.col("copy_b"), "words", "several").mapInArrow(compute, kind)
    return windows.select("*", F.col("copy_a").alias("bucket"), F.lit(width).alias("n"), F.xxhash64("from_a", "from_b", "start").alias("place"))


def searched(contents: DataFrame, width: int, shard_words: int) -> DataFrame:
    """`copy_a, copy_b, runs`: of every content with any, the runs of words whose windows occur again in its shard."""
    shards = contents.agg(F.greatest(F.ceil(F.coalesce(F.sum("n"), F.lit(0)) / shard_words), F.lit(1))).first()[0]
    shards = max(int(shards), int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def search(table: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        text, lengths = [], []
        for body in table.column("words"):
            words = body.as_py().split()
            text.extend(numbers.setdefault(w, len(numbers) + 1) for w in words)
            text.append(0)
            lengths.append(len(words))
        lengths = np.array(lengths)
        begins = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        weight = np.repeat(1 + table.column("several").to_numpy().astype(np.int64), lengths + 1)
        lane, first, end = repeated_windows(np.array(text, np.int64), begins, lengths, weight, width)
        by = np.lexsort((first, lane))
        lane, first, end = lane[by], first[by], end[by] + width - 1
        own, at = np.unique(lane, return_index=True)
        runs = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(end, pa.int32())], names=["start", "end"])
        rows = pa.array(own, pa.int64())
        return pa.table([
            table.column("copy_a").take(rows), table.column("copy_b").take(rows), pa.ListArray.from_arrays(pa.array(np.append(at, len(lane)), pa.int32()), runs),
        ], names=["copy_a", "copy_b", "runs"])

    sharded = contents.select(F.pmod(F.xxhash64("bucket"), F.lit(shards)).alias("shard"), *_COPY, "words", "several")
    return sharded.groupBy("shard").applyInArrow(search, "copy_a long, copy_b long, runs array<struct<start: int, end: int>>")


def repeated_runs(rows: DataFrame, docs: DataFrame, width: int, gram: int, crowded: int, shard_words: int) -> DataFrame:
    """`doc_id, same, runs` of one document of each group of equal words (`rows` of `read`): runs of words that occur again among these."""
    one = rows.groupBy(*_COPY).agg(F.min(F.struct(*_KEY, "grams")).alias("one")).select("one.*")
    members = materialise(one.select(*_KEY, F.explode("grams").alias("gram")))
    # Written, so that a hash that very many texts hold can be split over tasks.
    shared = materialise(members.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1").select("gram"))
    wanted = members.join(shared, "gram", "left_semi").groupBy(*_KEY).agg(F.collect_set("gram").alias("wanted"))
    found = materialise(segments(keyed(docs).join(wanted, list(_KEY)), width, gram))
    contents = materialise(_contents(found))
    many = contents.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > crowded).select("bucket")
    # Windows of crowded hashes; those at one place go no further.
    windows = materialise(cut(contents.join(many, "bucket", "left_semi"), width))
    repeated = _contents(windows, [F.max("several_from").alias("copied")]).where("several or copied").withColumn("several", F.lit(True)).drop("copied")
    index = materialise(contents.join(many, "bucket", "left_anti").select("bucket", *_COPY, "words", "n", "several").unionByName(repeated.select("bucket", *_COPY, "words", "n", "several")))
    runs = materialise(searched(index, width, shard_words))
    again = windows.join(runs, list(_COPY)).select(F.col("from_a").alias("copy_a"), F.col("from_b").alias("copy_b"), F.struct("start", (F.col("start") + width).alias("end")).alias("run"))
    whole = runs.select(*_COPY, F.explode("runs").alias("run")).unionByName(again)
    placed = found.select(*_KEY, *_COPY, F.col("start").alias("at")).join(whole, list(_COPY))
    return placed.groupBy(*_KEY).agg(F.collect_set(F.struct((F.col("at") + F.col("run.start")).alias("start"), (F.col("at") + F.col("run.end")).alias("end"))).alias("runs"))


def covered(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs with those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without(docs: DataFrame) -> DataFrame:
    """`doc_id, same, n_removed, passages, kept` of texts with `runs`: what they lose and the other words, joined by blanks."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept, passages = [], [], []
            for text, runs in zip(batch.column(2), batch.column(3), strict=True):
                words, at, left = words_of(text.as_py()), 0, []
                whole = covered([(r["start"], r["end"]) for r in runs.as_py()])
                for start, end in whole:
                    left += words[at:start]
                    at = end
                left += words[at:]
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
                passages.append([{"start": s, "end": e} for s, e in whole])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(passages, _RUNS), pa.array(kept, pa.string())],
                names=["doc_id", "same", "n_removed", "passages", "kept"],
            )

    return docs.select(*_KEY, "text", "runs").mapInArrow(compute, "doc_id long, same long, n_removed long, passages array<struct<start: int, end: int>>, kept string")


def _found(docs: DataFrame, width: int, gram: int, crowded: int, shard_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows as read, with their number of copies; and the texts that lose a part of their words."""
    rows = materialise(read(docs, width, gram))
    runs = materialise(repeated_runs(rows, docs, width, gram, crowded, shard_words))
    # Written, so that a text that a third of all rows share can be split over tasks.
    copies = materialise(rows.groupBy(*_COPY).agg(F.count("*").alias("copies")).where("copies > 1"))
    rows = rows.drop("grams").join(copies, list(_COPY), "left").withColumn("whole", F.col("copies").isNotNull() & (F.col("n_words") >= width))
    # Texts that lose all are known; only the others are read again.
    part = keyed(docs).join(runs, list(_KEY)).join(rows.where("copies is null").select(*_KEY), list(_KEY), "left_semi")
    return rows, runs, without(part)


def deduplicated(docs: DataFrame, width: int = 35, gram: int = 12, crowded: int = 512, shard_words: int = 500_000) -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256` for every row: what is left without words of repeated passages.

    A word goes if any window of `width` words that covers it occurs again anywhere; all windows are judged on the
    input. A null text has no words. Every row is a document: rows that come twice repeat each other, and rows of
    one id are judged by their own texts. An empty table gives an empty table.
    """
    rows, _, part = _found(docs, width, gram, crowded, shard_words)
    less = part.select(*_KEY, "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return rows.join(less.withColumnRenamed("n_removed", "some"), list(_KEY), "left").select(
        "doc_id", "n_words", F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("some", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def passages(docs: DataFrame, width: int = 35, gram: int = 12, crowded: int = 512, shard_words: int = 500_000) -> DataFrame:
    """`doc_id, start, end` (words) of every repeated passage, for every row that has any; edge cases as in `deduplicated`."""
    rows, _, part = _found(docs, width, gram, crowded, shard_words)
    some = part.select(*_KEY, F.explode("passages").alias("p")).select("doc_id", F.col("p.start").alias("start"), F.col("p.end").alias("end"))
    return rows.where("whole").select("doc_id", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")).unionByName(some)
