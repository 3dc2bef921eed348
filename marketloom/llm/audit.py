"""How five quality filters interact: what each removes alone, in every order, and its fair share.

Every document is reduced to the set of filters that it fails; all figures follow from counts of
these sets, at most 32 a part and kind of label, so the table is read once and counted on the map side.

A coalition of filters removes the documents that fail any of its members. The potential of the game
of removals (Hart and Mas-Colell) is 0 for no filter, and for a coalition S it is the removals of S
plus the potentials of S without each one of its members, over the size of S. A filter's Shapley value
is the potential of all filters less the potential of all but this one; what a filter removes as a step of
an order is the difference of the coalitions after and before it. All is done in whole numbers: a
potential times 5! is whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

FILTERS = "ABCDE"
_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_MARKS = re.compile(r"[#$%&*|]")
_IDENTICAL = 1 << FILTERS.index("E")
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def failed_alone(text: str) -> int:
    """The filters that a text fails by itself (A to D), as bits."""
    data = text.encode()
    words = data.split()  # of bytes: at ASCII white space only
    return (
        (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * len(data.translate(None, _NOT_CAPITAL)) > 3 * len(text)) << 2 | (_MARKS.search(text) is not None) << 3
    )


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """`doc_id, part, fails` of every row: the filters it fails, as bits from A on.

    A null text is empty, a null part is the empty string. A row fails E if a row of a smaller id has the
    same text; rows of a null id neither precede others nor are preceded, and rows of one id don't precede
    each other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            copies = [xxhash.xxh3_128_digest(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(failed_alone, texts), pa.int32()), pa.array(copies, pa.binary())],
                names=["doc_id", "part", "fails", "copy"],
            )

    judged = materialise(rows.mapInArrow(judge, "doc_id long, part string, fails int, copy binary"))
    # Texts that occur once are out of the join; a text that a third of all rows share is one row of its other side.
    # Written, so that the join can be split over tasks there.
    first = materialise(judged.groupBy("copy").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("copy", "first"))
    later = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return judged.join(first, "copy", "left").select("doc_id", "part", F.when(later, F.col("fails").bitwiseOR(F.lit(_IDENTICAL))).otherwise(F.col("fails")).alias("fails"))


def potentials(removed: list[int], n: int = len(FILTERS)) -> list[int]:
    """n! times the potential of every coalition (bits), given what each coalition removes."""
    out = [0] * (1 << n)
    for coalition in range(1, 1 << n):
        members = [i for i in range(n) if coalition >> i & 1]
        # The sum is whole: a potential of k filters times k! is, and n! holds k!.
        out[coalition] = (factorial(n) * removed[coalition] + sum(out[coalition & ~(1 << i)] for i in members)) // len(members)
    return out


def removals(counts: list[int]) -> list[int]:
    """How many documents each coalition removes, given how many fail each exact set of filters."""
    return [sum(c for fails, c in enumerate(counts) if fails & coalition) for coalition in range(len(counts))]


def steps(part: str, counts: list[int], good: list[int], toxic: list[int]) -> Iterator[tuple]:
    """The rows of the report for one part."""
    n, everybody = len(FILTERS), (1 << len(FILTERS)) - 1
    gone, good_gone, toxic_gone = removals(counts), removals(good), removals(toxic)
    potential = potentials(gone)
    share = [potential[everybody] - potential[everybody & ~(1 << i)] for i in range(n)]
    total = sum(counts)
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            yield (
                part, "".join(FILTERS[j] for j in order), step, total - gone[after], removed, gone[1 << i] - removed, counts[1 << i],
                good_gone[after] - good_gone[before], toxic_gone[after] - toxic_gone[before], share[i],
            )
            before = after


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """What each filter removes at each step of each order, one row per part, order and step (`AUDIT`).

    `shapley` is the filter's removals summed over all orders, that is 120 times its Shapley value. A document
    counts as good (toxic) if any of its rows of `labels` says so. Repeated rows of documents count each.
    An empty table has no parts, so it gives no rows.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    counted = failures(docs, part).join(marks, "doc_id", "left").groupBy("part", "fails").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )

    def report(rows: pd.DataFrame) -> pd.DataFrame:
        tables = {c: [0] * (1 << len(FILTERS)) for c in ("n", "good", "toxic")}
        for r in rows.itertuples():
            for c, table in tables.items():
                table[r.fails] = int(getattr(r, c))
        return pd.DataFrame(steps(rows["part"].iloc[0], *tables.values()), columns=[c.split()[0] for c in AUDIT.split(", ")])

    return counted.groupBy("part").applyInPandas(report, AUDIT)
