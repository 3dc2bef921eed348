"""Benchmark decontamination by template windows.

Words become canonical: numbers, units and names are typed placeholders, the rest is lower case
without punctuation at its ends. Every window of eight canonical words of a benchmark item is a
template; items with few literals have windows of their plain words besides. Windows of documents that a Bloom filter of fixed size lets through are hash-joined with
the templates. Along one alignment, a slot value of the item must always stand for the same value
of the document; only passages long enough to tell on their own may lie beside a contradiction. So a question with other numbers or names is caught, and words that only look
alike are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, texts
from .words import Numbered, blocks

#: Words that measure; placeholders of one type.
UNITS = frozenset((
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs oz ounce ounces ton "
    "tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years cent cents dollar dollars usd eur euro euros pound pounds percent pct degree degrees kwh watt watts "
    "volt volts hz khz mhz ghz kb mb gb tb mph kph"
).split())
_LITERAL, _NUMBER, _UNIT, _NAME, _NOTHING = range(5)
_PLACEHOLDER = np.array([0, 0x1E3779B97F4A7C15, 0x42B2AE3D27D4EB4F, 0x165667B19E3779F9, 0], dtype=np.uint64)
_EDGES = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_IS_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*%?")
_LINE = "\x00"
#: Characters of scripts that write no blanks between words: Thai, Lao, Burmese, Khmer, kana, Han.
_NO_BLANKS = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"
_CHARACTER = re.compile(_NO_BLANKS)
_PIECES = re.compile(rf"{_NO_BLANKS}|(?:(?!{_NO_BLANKS})\w)+")
_STEP = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
BLOOM_BITS = 22
_EXACT = 1 << 32
_WINDOWS = pa.list_(pa.struct([("place", pa.int32()), ("value", pa.string())]))


class Templates:
    """Canonical words of texts, and windows over them."""

    def __init__(self, limit: int = 300_000):
        self.numbered = Numbered(self._describe, limit)
        self.kind, self.ends = np.zeros(limit + 1, np.int8), np.zeros(limit + 1, bool)
        self.joined = np.zeros(limit + 1, bool)
        self.hash, self.bare = np.zeros(limit + 1, np.uint64), [""] * (limit + 1)

    def _describe(self, word: str, i: int) -> None:
        bare = _EDGES.sub("", word)
        low = bare.lower()
        if not bare or word == _LINE:
            kind = _NOTHING
        elif _IS_NUMBER.fullmatch(bare):
            kind = _NUMBER
        elif low in UNITS:
            kind = _UNIT
        else:
            kind = _NAME if bare[0].isupper() and bare[1:] == low[1:] else _LITERAL
        self.kind[i], self.bare[i] = kind, low
        self.ends[i] = word == _LINE or any(c in ".!?" for c in word[len(word.rstrip("\"')]}.!?#*$%&")) :])
        self.hash[i] = xxhash.xxh64_intdigest(low) if low else 0
        self.joined[i] = _CHARACTER.search(low) is not None

    def canonical(self, text: str) -> tuple[np.ndarray, np.ndarray, dict[int, str], np.ndarray]:
        """Per word its hash and whether it is a literal; the values of the words that aren't. A word that starts a sentence or line is no name.

        Last, the hashes of the words as they are in lower case; characters of scripts without blanks are words there.
        """
        hashes, literals, slots, ended, exact = [], [], {}, True, []
        done = 0
        for block in blocks(text):
            words = block.replace("\n", f" {_LINE} ").split()
            for at in range(0, len(words), 100_000):
                part = words[at : at + 100_000]
                codes = np.fromiter(self.numbered(part), np.int64, len(part))
                kind, ends = self.kind[codes], self.ends[codes]
                first = np.concatenate(([ended], ends[:-1]))
                ended = bool(ends[-1])
                literal = (kind == _LITERAL) | (kind == _NAME) & first
                keep = kind != _NOTHING
                literal, codes, kind = literal[keep], codes[keep], kind[keep]
                exact.append(self._exact(codes))
                hashes.append(np.where(literal, self.hash[codes], _PLACEHOLDER[kind]))
                literals.append(literal)
                slots.update((done + i, self.bare[codes[i]]) for i in np.nonzero(~literal)[0].tolist())
                done += len(codes)
        none = np.zeros(0, np.uint64)
        return np.concatenate(hashes or [none]), np.concatenate(literals or [none.astype(bool)]), slots, np.concatenate(exact or [none])

    def _exact(self, codes: np.ndarray) -> np.ndarray:
        plain, joined = self.hash[codes], self.joined[codes]
        if not joined.any():
            return plain
        parts, at = [], 0
        for i in np.nonzero(joined)[0].tolist():
            pieces = _PIECES.findall(self.bare[codes[i]])
            parts += [plain[at:i], np.fromiter((xxhash.xxh64_intdigest(p) for p in pieces), np.uint64, len(pieces))]
            at = i + 1
        return np.concatenate([*parts, plain[at:]])

    @staticmethod
    def windows(hashes: np.ndarray, literals: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window at each word, and whether it has literals enough to mean something."""
        out = _rolled(hashes, width, width)
        if not len(out):
            return out, np.zeros(0, bool)
        known = np.concatenate(([0], np.cumsum(literals)))
        return out, known[width:] - known[:-width] >= _needed(width)


def _rolled(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, seed, np.uint64)
    for j in range(width):
        out = out * _STEP + hashes[j : j + n]
        out ^= out >> np.uint64(29)
    return out


def _verbatim(exact: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of the words as they are; never those of templates."""
    return _rolled(exact, width, _EXACT + width)


def _bit(windows: np.ndarray) -> np.ndarray:
    return ((windows * _SPREAD) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)


def _needed(width: int) -> int:
    """Literals that a template must have."""
    return max(3, -(-width * 6 // 10))


def _slots(slots: dict[int, str], at: int, width: int) -> list[dict]:
    return [{"place": j, "value": slots[at + j]} for j in range(width) if at + j in slots]


def item_templates(benchmark: DataFrame, window: int = 8, shortest: int = 4) -> DataFrame:
    """`item_id, window, bit, width, exact, item_at, item_rank, item_slots, n_windows` of the items' templates.

    An item shorter than the window is one template of its own width; items of fewer than `shortest`
    words, null and empty ones say too little and have none. Where fewer than half of its windows
    have the literals, or characters of scripts without blanks (two count as a word), an item has all
    windows of its words as they are besides (`exact`): these hold verbatim and need no literals. Repeated items stay apart by their id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes, literals, slots, exact = templates.canonical(text)
                single = len(_CHARACTER.findall(text.lower()))
                values, usable, width = np.zeros(0, np.uint64), np.zeros(0, bool), min(window, len(hashes))
                if len(hashes) >= shortest:
                    values, usable = templates.windows(hashes, literals, width)
                if (single or 2 * usable.sum() < len(usable)) and 2 * len(exact) - single >= 2 * shortest:
                    wide = min(window, len(exact))
                    words = _verbatim(exact, wide)
                    rows += [(item, v, b, wide, True, i, i, [], len(words)) for i, (v, b) in enumerate(zip(words.view(np.int64).tolist(), _bit(words).tolist(), strict=True))]
                bits = _bit(values)
                rows += [(item, int(values[i].view(np.int64)), int(bits[i]), width, False, i, rank, _slots(slots, i, width), int(usable.sum())) for rank, i in enumerate(np.nonzero(usable)[0].tolist())]
            yield _batch(rows, ("item_id", "window", "bit", "width", "exact", "item_at", "item_rank", "item_slots", "n_windows"), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), _WINDOWS, pa.int32()))

    kind = "item_id long, window long, bit int, width int, exact boolean, item_at int, item_rank int, item_slots array<struct<place: int, value: string>>, n_windows int"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    return items.mapInArrow(cut, kind)


def _batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def document_windows(docs: DataFrame, bloom: np.ndarray, widths: list[tuple[int, bool]]) -> DataFrame:
    """Windows of documents that may be templates, by the Bloom filter."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, bits = Templates(), sent.value
        for batch in batches:
            rows = []
            for doc, same, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                hashes, literals, slots, words = templates.canonical(text.as_py())
                for width, exact in widths:
                    values, usable = (_verbatim(words, width), True) if exact else templates.windows(hashes, literals, width)
                    bit = _bit(values)
                    usable = usable & ((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1)
                    rows += [(doc, same, int(values[i].view(np.int64)), width, exact, i, [] if exact else _slots(slots, i, width)) for i in np.nonzero(usable)[0].tolist()]
            yield _batch(rows, ("doc_id", "same", "window", "width", "exact", "at", "slots"), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), _WINDOWS))

    kind = "doc_id long, same long, window long, width int, exact boolean, at int, slots array<struct<place: int, value: string>>"
    return texts(docs).select("doc_id", F.xxhash64("text").alias("same"), "text").mapInArrow(cut, kind)


def _agreeing(covered: str, places: str, values: str) -> Column:
    """The templates of an alignment without those that contradict what most places of an item's value stand for; of ties the same value, then the largest."""
    counted = F.transform(values, lambda v: F.struct(
        v["item"].alias("item"), F.struct(F.size(F.filter(places, lambda p: (p["item"] == v["item"]) & (p["doc"] == v["doc"]))), v["item"] == v["doc"], v["doc"].alias("doc")).alias("rank")
    ))
    lost = F.filter(counted, lambda v: F.exists(counted, lambda u: (u["item"] == v["item"]) & (u["rank"] > v["rank"])))
    return F.filter(covered, lambda w: ~F.exists(w["pairs"], lambda p: F.exists(lost, lambda x: (x["item"] == p["item"]) & (x["rank"]["doc"] == p["doc"]))))


def _longest_run(covered: str, window: int, passage: int) -> Column:
    """The most templates of an alignment, sorted, that follow each other in the item and touch; 0 if there are less than `passage`."""
    none = F.lit(0)
    start = F.struct(F.lit(-2).alias("rank"), none.alias("at"), none.alias("run"), none.alias("best"))

    def step(a: Column, w: Column) -> Column:
        run = F.when((w["item_rank"] == a["rank"] + 1) & (w["item_at"] - a["at"] <= window), a["run"] + 1).otherwise(1)
        return F.struct(w["item_rank"].alias("rank"), w["item_at"].alias("at"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.when(F.size(covered) >= passage, F.aggregate(covered, start, step, lambda a: a["best"])).otherwise(0)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`doc_id, item_id, covered, verbatim` of every document that holds a benchmark item.

    A document holds an item if at least the share `coverage` of the item's templates lies in it, on
    alignments whose slots are consistent, or a passage of it: a run of `passage` templates that follow
    each other without a gap (20 words at least), whatever share of the item that is. Of an
    alignment with two values for one, passages are sought in the templates that agree with the more
    frequent value; its share does not count, as a short item with two roles changed is another question. `verbatim` says that all slots have the item's values.
    Null ids, null and empty texts, repeated rows and empty tables need no care: rows of one id and
    text are one document, a null id is an id of its own, empty texts have no windows.
    """
    return found_items(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), F.max("verbatim").alias("verbatim"))


def found_items(docs: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.5, passage: int = 13) -> DataFrame:
    """`doc_id, same, item_id, covered, verbatim`: as `contaminated`, but texts of one id stay apart by the hash `same`."""
    templates = materialise(item_templates(benchmark, window))
    bloom = np.zeros(1 << BLOOM_BITS - 3, np.uint8)
    bits = templates.select("bit").distinct().toArrow()["bit"].to_numpy().astype(np.int64)  # at most 2 ** BLOOM_BITS
    np.bitwise_or.at(bloom, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
    widths = sorted((r["width"], r["exact"]) for r in templates.select("width", "exact").distinct().collect())  # at most `window` of either
    document = ["doc_id", "same", "item_id", "exact"]
    alignments = (
        document_windows(docs, bloom, widths).join(templates.drop("bit"), ["window", "width", "exact"])
        .groupBy(*document, "n_windows", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(  # no more rows than the item has windows
            F.array_sort(F.collect_set(F.struct("item_rank", "item_at", F.transform(
                F.arrays_zip("item_slots", "slots"),
                lambda s: F.struct((F.col("item_at") + s["slots"]["place"]).alias("place"), s["item_slots"]["value"].alias("item"), s["slots"]["value"].alias("doc")),
            ).alias("pairs")))).alias("covered")
        )
        .withColumn("places", F.array_distinct(F.flatten("covered.pairs")))
        .withColumn("values", F.array_distinct(F.transform("places", lambda p: F.struct(p["item"], p["doc"]))))
        .withColumn("whole", F.size("values") == F.size(F.array_distinct(F.col("values.item"))))
        .where(F.col("whole") | (F.size("covered") >= passage))
        .withColumn("covered", F.when(F.col("whole"), F.col("covered")).otherwise(_agreeing("covered", "places", "values")))
        .withColumn("run", _longest_run("covered", window, passage))
    )
    return (
        alignments.where(F.col("whole") | (F.col("run") >= passage))
        .select(*document, "n_windows", F.explode("covered.item_at").alias("item_at"), "run", "whole", F.forall("values", lambda v: v["item"] == v["doc"]).alias("as_is"))
        .groupBy(*document, "n_windows", "item_at").agg(F.max("as_is").alias("as_is"), F.max("run").alias("run"), F.max("whole").alias("whole"))
        .groupBy(*document, "n_windows").agg(F.count("*").alias("n"), F.min("as_is").alias("as_is"), F.max("run").alias("run"), F.count_if("whole").alias("n_whole"))
        .where((F.col("n_whole") >= F.col("n_windows") * coverage) | (F.col("run") >= passage))
        .groupBy("doc_id", "same", "item_id").agg(F.max(F.col("n") / F.col("n_windows")).alias("covered"), F.max("as_is").alias("verbatim"))
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item."""
    bad = found_items(docs, benchmark, **options).select(F.col("doc_id").alias("_bad"), F.col("same").alias("_bad_text")).distinct()
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]) & (text == bad["_bad_text"]), "left_anti")
