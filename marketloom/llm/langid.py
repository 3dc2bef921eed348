"""Language identification with bit-sliced Bloom filters of n-grams.

A slot of the filter is a mask with one bit for each language, in slices of 64. The mask of an n-gram
is the `and` of its slots, so one look a slice returns all languages that contain it. A text's bits are counted by language,
corrected by the share of bits that chance sets, and the largest count decides.

The filter has a fixed size for each slice. Its n-grams are counted over at most `max_docs` documents of each
language, taken by the hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_share, materialise
from .words import blocks

SIZES = (3, 4, 5)
SLOT_BITS = 20
SLICE = 64
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_STEP = np.uint64(0x100000001B3)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of the text's words, lower case, a blank at either end, block by block; none without a letter."""
    for part in blocks(text):
        points = np.frombuffer(f" {part.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(letters()[points], points, np.uint32(32)).astype(np.uint64)
        blank = points == 32
        points = points[~(blank & np.concatenate(([False], blank[:-1])))]  # one blank between words
        blank = points == 32
        inner = np.concatenate(([0], np.cumsum(blank)))
        for n in SIZES:
            m = len(points) - n + 1
            if m <= 0:
                continue
            out = np.full(m, n, np.uint64)
            for j in range(n):
                out = out * _STEP + points[j : j + m]
            # No n-gram has a blank inside.
            yield out[inner[n - 1 : n - 1 + m] - inner[1 : 1 + m] == 0]


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes ^ (hashes >> np.uint64(31))) * k >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for k in _MIX]


@dataclass
class Filter:
    """Masks by slice and slot, the languages by slice and bit, and the chance that an n-gram which a language lacks seems to be in it."""

    masks: np.ndarray
    languages: list[str]
    chance: np.ndarray
    usual: str

    def predict(self, text: str) -> tuple[str, float]:
        """The language and its share of the corrected counts; `und` without a letter or a language."""
        total, n = np.zeros(len(self.languages)), 0
        for hashes in grams(text):
            a, b = slots(hashes)
            n += len(hashes)
            for at, masks in zip(range(0, len(total), SLICE), self.masks, strict=True):
                found = masks[a] & masks[b]
                total[at : at + SLICE] += _per_bit(found[found != 0], min(SLICE, len(total) - at))
        if not n and not any(map(str.isalpha, text)) or not self.languages:
            return "und", 0.0
        count = np.maximum(0.0, (total - n * self.chance) / (1 - self.chance))
        if not count.any():
            return self.usual, 0.0
        best = int(count.argmax())  # ties: the language that comes first by name
        return self.languages[best], float(count[best] / count.sum())


def _per_bit(masks: np.ndarray, bits: int) -> list[int]:
    return [np.count_nonzero(masks >> np.uint64(i) & np.uint64(1)) for i in range(bits)]


def train(docs: DataFrame, max_docs: int = 1500, rarest: float = 0.1, least: int = 3) -> Filter:
    """The filter of all languages of `docs` (`doc_id, text, lang`, none null).

    A language contains an n-gram if it has it at least `least` times and at `rarest` of the rate of the
    language where it is most common, so that a foreign passage in a text sets no bit.
    """
    spark = docs.sparkSession
    by_lang = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    languages = sorted(r["lang"] for r in by_lang)
    # Ids alone are ranked, first in 64 parts of a language, so that at most 64 * max_docs of them meet in a task.
    chosen = docs.select("lang", "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)))
    for within in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*within).orderBy(F.xxhash64("doc_id"), "doc_id")
        chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_docs).drop("rank")
    chosen = materialise(chosen.select("lang", "doc_id").distinct())  # written, so that the join knows its size
    sample = docs.join(chosen, ["lang", "doc_id"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in set(batch.column(0).to_pylist()):
                found = [h for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if k == lang for h in grams(t.as_py())]
                hashes, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(hashes.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialise(counted)
    size = counted.groupBy("lang").agg(F.sum("n").alias("size"))
    rate = counted.join(F.broadcast(size), "lang").withColumn("rate", F.col("n") / F.col("size"))  # a row for each language
    most = Window.partitionBy("gram")
    bits = spark.createDataFrame(list(enumerate(languages)), "bit int, lang string")
    inside = rate.withColumn("most", F.max("rate").over(most)).where((F.col("n") >= least) & (F.col("rate") >= F.col("most") * rarest)).join(F.broadcast(bits), "lang").select("gram", "bit")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, bit = np.divmod(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), SLICE)
            for at in slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(at), pa.array(np.left_shift(np.int64(1), bit))], names=["slice", "slot", "mask"])

    masks = np.zeros((-(-len(languages) // SLICE), 1 << SLOT_BITS), np.uint64)
    filled = inside.mapInArrow(place, "slice long, slot long, mask long").groupBy("slice", "slot").agg(F.bit_or("mask").alias("mask"))
    table = filled.toPandas()  # at most 2 ** SLOT_BITS rows for each 64 languages
    masks[table["slice"].to_numpy(np.int64), table["slot"].to_numpy(np.int64)] = table["mask"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([x for part in masks for x in _per_bit(part, SLICE)][: len(languages)]) / (1 << SLOT_BITS)
    return Filter(masks, languages, np.minimum(0.9, fill ** len(_MIX)), by_lang[0]["lang"] if by_lang else "und")


def predicted(docs: DataFrame, max_docs: int = 1500) -> DataFrame:
    """`doc_id, held_out, lang_pred, score` for every row of the documents.

    Only rows that aren't held out, with text and language, are learnt from. Null and empty texts, and
    texts without a letter, are `und` with score 0; repeated rows are predicted alike.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang"), (id_share(4) == 2).alias("held_out"))
    known = rows.where("not held_out and text is not null and lang is not null").select("doc_id", "text", "lang")
    sent = docs.sparkSession.sparkContext.broadcast(train(known, max_docs))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    whole = rows.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
