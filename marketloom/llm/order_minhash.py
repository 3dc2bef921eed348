"""Near-duplicates by Order MinHash.

A document is its sequence of five-word shingles, each labelled with its occurrence. A sketch takes
the `pick` smallest labelled shingles under a hash and keeps them in text order, so that it agrees
for texts that agree in content and in order. Documents that share one of `sketches` sketches are
candidates; a banded alignment of their words verifies them: the words that lie in both in the same order,
over those that lie in either, must reach `similarity`. One changed word costs one word there, not the five shingles that
hold it. The band is as wide as a pair that reaches it can need, so it loses nothing.

Before two texts are aligned, the parities of their words in 1024 cells give a lower bound of how
many words are in one of them only; a pair that this bound rules out goes no further.

Copies collapse first. Only buckets of equal sketches with several members are kept, as pairs of bucket and
document; sizes, parities and words are joined to the pairs that are left. Within a bucket nobody meets everybody: for `rounds` rounds
the members outside the largest class of their buckets meet a few hubs (first 1, then 16), and links join classes. Then a member outside the largest
class of its bucket meets those members that are still in another class. So each pair of a bucket is
compared or already in one class, and no link is lost. A family whose pairs mostly lie just below the
similarity costs a comparison of parities for each pair of a bucket, inside a join that deals the bucket to many tasks.
"""

from __future__ import annotations

import uuid

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Cache, forget, materialise, texts
from .words import Numbered, blocks

_STEP = np.uint64(0x100000001B3)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = -(2**63)
_KEY = "struct<doc_id: bigint, same: bigint>"
_LONGS = pa.list_(pa.int64())


class Shingles:
    """Hashes of occurrence-labelled shingles of a text, in lower case, split at white space."""

    def __init__(self, width: int = 5, limit: int = 300_000):
        self.width, self.hashes = width, np.zeros(limit + 1, np.uint64)
        self.numbered = Numbered(self._describe, limit)

    def _describe(self, word: str, i: int) -> None:
        self.hashes[i] = xxhash.xxh64_intdigest(word)

    def words(self, text: str) -> np.ndarray:
        parts = []
        for block in blocks(text.lower()):
            words = block.split()
            for at in range(0, len(words), 100_000):
                part = words[at : at + 100_000]
                parts.append(self.hashes[np.fromiter(self.numbered(part), np.int64, len(part))])
        return np.concatenate(parts or [np.zeros(0, np.uint64)])

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words and of the labelled shingles; a text of fewer words is one shingle, an empty one none."""
        words = self.words(text)
        width = min(self.width, len(words))
        if not width:
            return words, words
        n = len(words) - width + 1
        out = np.full(n, width, np.uint64)
        for j in range(width):
            out = out * _STEP + words[j : j + n]
            out ^= out >> np.uint64(29)
        order = np.argsort(out, kind="stable")
        ordered = out[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        if not new.all():  # the how-manieth of its kind
            index = np.arange(n)
            occurrence = np.empty(n, np.uint64)
            occurrence[order] = index - np.maximum.accumulate(np.where(new, index, 0))
            out = out + occurrence * _ODD
            out ^= out >> np.uint64(31)
            out *= _STEP
        return words, out


def sketch(shingles: np.ndarray, sketches: int, pick: int) -> np.ndarray:
    """A hash of the `pick` smallest shingles in text order, for each of the hash functions."""
    factors = np.random.default_rng(7).integers(1, 2**63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    pick = min(pick, len(shingles))
    spread = shingles ^ (shingles >> np.uint64(33))
    out = np.empty(sketches, np.uint64)
    step = max(1, 2_000_000 // len(shingles))  # hash functions at a time
    for at in range(0, sketches, step):
        values = spread[None, :] * factors[at : at + step, None]
        places = np.argpartition(values, pick - 1, axis=1)[:, :pick] if pick < len(shingles) else np.tile(np.arange(pick), (len(values), 1))
        places.sort(axis=1)
        rows = np.full(len(values), len(factors), np.uint64)
        for k in range(pick):
            rows = rows * _STEP + shingles[places[:, k]]
            rows ^= rows >> np.uint64(29)
        out[at : at + step] = rows
    return out


def parity(words: np.ndarray) -> np.ndarray:
    """Of each of 1024 cells, whether an odd number of words lies in it, as 16 numbers."""
    cells = np.bincount((words >> np.uint64(54)).astype(np.int64), minlength=1024) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def may_reach(similarity: float) -> Column:
    """Whether sizes and parities (`n, parity` and `n_b, parity_b`) leave room for the similarity."""
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("parity_b", F.lit(i)))) for i in range(16)))
    close = F.least("n", "n_b") >= F.greatest("n", "n_b") * similarity - 1e-9
    return close & (apart <= (F.col("n") + F.col("n_b")) * ((1 - similarity) / (1 + similarity)) + 1e-9)


def keyed(docs: DataFrame, name: str = "key") -> DataFrame:
    """The rows with what tells documents apart: the id and a hash of the text, as ids may be null or stand for several texts."""
    same = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn(name, F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), same.alias("same")))


def sketched(docs: DataFrame, sketches: int = 32, pick: int = 3, width: int = 5) -> DataFrame:
    """`key` (id and hash of the text), hash of the words (`copy_a`, `copy_b`), their number `n`, their `parity`, and the `sketches`."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            a, b, n, odd, found = [], [], [], [], []
            for text in batch.column(2):
                words, own = shingles(text.as_py())
                digest = xxhash.xxh3_128_intdigest(words.tobytes())
                a.append((digest >> 64) - 2**63)
                b.append((digest & 2**64 - 1) - 2**63)
                n.append(len(words))
                odd.append(parity(words))
                found.append(sketch(own, sketches, pick).view(np.int64) if len(own) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(odd, _LONGS), pa.array(found, _LONGS)],
                names=["doc_id", "same", "copy_a", "copy_b", "n", "parity", "sketches"],
            )

    kind = "doc_id long, same long, copy_a long, copy_b long, n int, parity array<long>, sketches array<long>"
    return keyed(texts(docs)).select("key.doc_id", "key.same", "text").mapInArrow(compute, kind).select(F.struct("doc_id", "same").alias("key"), "copy_a", "copy_b", "n", "parity", "sketches")


def word_arrays(docs: DataFrame) -> DataFrame:
    """`rep` and the `words` of the texts as 32-bit hashes, in bytes."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            words = [(shingles.words(text.as_py()) >> np.uint64(32)).astype(np.uint32).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], names=["rep", "words"])

    return docs.select("rep", "text").mapInArrow(compute, f"rep {_KEY}, words binary")


def common(a: list[int], b: list[int], band: int) -> int:
    """How many words lie in both in the same order, no two of them more than `band` places apart.

    Bit-parallel: of the places of `a` near the current one of `b`, a 0 stands where the longest common part gets longer.
    """
    where: dict[int, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    width = 2 * band + 1
    whole = (1 << width) - 1
    now, low, found = whole, 0, 0
    for i, word in enumerate(b):
        if i - band > low:  # the lowest place leaves the band
            low += 1
            found += 1 - (now & 1)
            now = now >> 1 | 1 << (width - 1)
        met = where.get(word, 0) >> low & whole & now
        if met:
            now = (now + met | now - met) & whole
    return found + width - now.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """Words in both and in the same order over words in either; 0 where it surely is below `similarity`."""
    total = len(a) + len(b)
    apart = int(total * (1 - similarity) / (1 + similarity) + 1e-9)  # words in one only, at most
    if abs(len(a) - len(b)) > apart or not total:
        return 0.0
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[len(a) - short + head :][::-1] != b[len(b) - short + head :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    x, y = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    # What the longer middle has more of can't be in both, so it is no reason to look further aside.
    m = head + tail + (common(x, y, min(apart, max(len(x), len(y)))) if x and y else 0)
    return m / (total - m)


def verified(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """The pairs `a, b` of `bodies` (`rep, words`) whose alignment reaches `similarity`."""
    left, right = (bodies.select(F.col("rep").alias(c), F.col("words").alias(f"words_{c}")) for c in "ab")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = lambda x: np.frombuffer(x.as_py(), np.uint32)
        for batch in batches:
            keep = [aligned(array(x), array(y), similarity) >= similarity - 1e-9 for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "words_a", "words_b").mapInArrow(compare, f"a {_KEY}, b {_KEY}")


def components(links: DataFrame) -> DataFrame:
    """`node, root` of every node of `links` (`a, b`): nodes get the same root if links connect them.

    Each round every node points to the neighbour with the most neighbours, or to itself if it has more,
    and what points to one node becomes one node. Ties are broken by an order that changes with the
    round, so that a path shrinks as fast as a star.
    """
    steps, edges, before = [], links, None
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    turn = 0
    while True:
        both = materialise(edges.select(F.inline(ways)).distinct())
        forget(before)
        before = both
        if both.isEmpty():
            break
        degree = both.groupBy("a").agg(F.count("*").alias("degree"))
        key = lambda c: F.struct((-F.col("degree")).alias("minus"), F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        best = both.join(degree.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min(key("b")).alias("best"))
        points = materialise(best.join(degree, "a").select("a", F.least("best", key("a"))["v"].alias("to")))
        steps.append(points)
        other = points.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        edges = both.join(points, "a").join(other, "b").where("to < to_b").select(F.col("to").alias("a"), F.col("to_b").alias("b"))
        turn += 1
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    first = steps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    return reduce(
        lambda found, step: found.join(step.withColumnsRenamed({"a": "root"}), "root", "left").select("node", F.coalesce("to", "root").alias("root")), steps[1:], first
    )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """`doc_id, class_id, copy_of` for every row: the smallest id of its class, and of its copies.

    Texts that agree in all words, whatever the white space and case, are copies; null and empty texts
    are copies of each other. Rows of one id and text are one document; texts that differ are documents of
    their own, also if their id is null or repeated, so ids name classes only as far as they are unique
    (`classes` names them by id and text). A null id comes before all others. An empty table gives an empty table.
    """
    given = lambda c: F.nullif(f"{c}.doc_id", F.lit(_NO_ID))
    return classes(docs, **options).select(given("key").alias("doc_id"), given("class").alias("class_id"), given("rep").alias("copy_of"))


def _not_apart(pairs: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """The pairs `a, b` that `facts` (`rep, n, parity`) leave room for."""
    left, right = facts.select(F.col("rep").alias("a"), "n", "parity"), facts.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("parity_b"))
    return pairs.join(left, "a").join(right, "b").where(may_reach(similarity)).select("a", "b")


def classes(docs: DataFrame, similarity: float = 0.8, sketches: int = 32, pick: int = 3, width: int = 5, rounds: int = 3, crowd: int = 256) -> DataFrame:
    """`key, class, rep` for every row: the id and text hash of its document, and the smallest of its class and of its copies.

    In the last round a bucket is dealt out in parts of about `crowd` members.
    """
    docs = texts(docs)
    rows = materialise(sketched(docs, sketches, pick, width))
    # Written, so that a text that a third of all rows share can be split over tasks.
    copies = materialise(rows.groupBy("copy_a", "copy_b").agg(F.min("key").alias("rep")))
    facts = rows.select("key", "n", "parity", "sketches").join(copies.select(F.col("rep").alias("key")), "key", "left_semi").dropDuplicates(["key"])
    facts = materialise(facts.withColumnRenamed("key", "rep"))
    # A bucket is a sketch and its number; those of one member say nothing.
    members = facts.select("rep", F.posexplode("sketches").alias("k", "value")).select("rep", F.xxhash64("k", "value").alias("bucket"))
    shared = materialise(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket"))
    # Merged at every size, so that a small corpus shows what a large one costs.
    members = materialise(members.join(shared.hint("merge"), "bucket", "left_semi"))
    wanted = materialise(members.select("rep").distinct())
    bodies = materialise(word_arrays(keyed(docs, "rep").select("rep", "text").join(wanted.hint("merge"), "rep", "left_semi")).dropDuplicates(["rep"]))
    known = materialise(facts.join(wanted.hint("merge"), "rep", "left_semi"))
    labels = wanted.select(F.col("rep").alias("node"), F.col("rep").alias("root"))
    done = None
    for turn in range(rounds + 1):
        now = materialise(members.join(labels.withColumnRenamed("node", "rep"), "rep")) if turn else members.withColumn("root", F.col("rep"))
        by_class = now.groupBy("bucket", "root").agg(F.count("*").alias("size"))
        largest = by_class.groupBy("bucket").agg(F.max(F.struct("size", "root")).alias("top"), F.count("*").alias("classes"), F.sum("size").alias("size"))
        largest = materialise(largest.where("classes > 1").select("bucket", F.col("top.root").alias("top"), F.ceil(F.col("size") / crowd).cast("int").alias("parts")))
        # Buckets of one class are done with.
        before, members = members, materialise(now.join(largest, "bucket"))
        forget(before, largest, *([now] if turn else []))
        if turn < rounds:
            # One hub at first, then some for those who are still outside; a member takes the hubs with which it shares most buckets.
            hubs = 16 if turn else 1
            facts_of = known.select("rep", "n", "parity")
            by_hash = Window.partitionBy("bucket").orderBy(F.xxhash64("rep", F.lit(turn)), "rep")
            hub = members.select("bucket", "rep", "root").withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= hubs)
            hub = hub.select("bucket", F.col("rep").alias("b"), F.col("root").alias("root_b"))
            outside, near = members.where("root <> top").select("bucket", "rep", "root"), F.col("root") != F.col("root_b")
            if turn:  # few enough to carry their parities, so that no hub is met in vain
                outside, near = outside.join(facts_of, "rep"), near & may_reach(similarity)
                hub = hub.join(facts_of.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("parity_b")), "b")
            met = outside.join(hub, "bucket").where(near).groupBy("rep", "b").agg(F.count("*").alias("shared"))
            met = met.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("shared"), "b"))).where(F.col("place") <= hubs)
            met = met.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
            pairs, steps = met if done is None else met.join(done, ["a", "b"], "left_anti"), []
            pairs = pairs if turn else _not_apart(pairs, known, similarity)
        else:
            full = materialise(members.join(known, "rep"))
            # A bucket of many is dealt out: one side by hash, the other to each part.
            dealt = full.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
            apart = full.where("root <> top").select(
                "bucket", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"), F.col("parity").alias("parity_b"), F.col("sketches").alias("sketches_b"),
                F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
            )
            steps = [full]
            # Two members meet in the first bucket they share, and two outside the largest class meet once there.
            shares = [F.get("sketches", F.lit(i)) == F.get("sketches_b", F.lit(i)) for i in range(sketches)]
            first = reduce(lambda other, i: F.when(shares[i], F.xxhash64(F.lit(i), F.get("sketches", F.lit(i)))).otherwise(other), reversed(range(sketches)), F.lit(None).cast("bigint"))
            met = dealt.join(apart, ["bucket", "part"]).where((F.col("root") != F.col("root_b")) & may_reach(similarity) & ((F.col("root") == F.col("top")) | (F.col("rep") < F.col("b"))) & (F.col("bucket") == first))
            pairs = met.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
            pairs = pairs if done is None else pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        found = materialise(verified(pairs, bodies, similarity))
        ends = lambda c, to: labels.select(F.col("node").alias(c), F.col("root").alias(to))  # noqa: B023, E731
        merged = components(found.join(ends("a", "root_a"), "a").join(ends("b", "root_b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        before, members = labels, members.select("rep", "bucket")
        labels = materialise(labels.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        done = pairs if done is None else done.unionByName(pairs)
        forget(*steps, found, *([before] if turn else []))
    forget(members, shared, known, bodies, facts, done)
    whole = copies.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = materialise(whole.groupBy("root").agg(F.min("rep").alias("class")))
    named = materialise(whole.join(least, "root").select("copy_a", "copy_b", "class", "rep"))
    return rows.select("key", "copy_a", "copy_b").join(named, ["copy_a", "copy_b"]).select("key", "class", "rep")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that are the smallest of their class by id and text hash; one row of each."""
    kept = classes(docs, **options).where(F.col("key") == F.col("class")).select("key").distinct()
    key = f"_key_{uuid.uuid4().hex}"
    mine = keyed(docs, key)
    return mine.join(kept.withColumnRenamed("key", key), key, "left_semi").dropDuplicates([key]).drop(key)
