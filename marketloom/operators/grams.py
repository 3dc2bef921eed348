"""Substring joins by posting lists of short pieces.

A needle meets the rows that hold its rarest piece of three characters, not all rows, and is then looked for
in these. Pieces of a needle are counted over all rows first, so a needle that holds no rare piece is the only one that
meets many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Characters of a piece; a shorter needle is a piece itself.
LENGTH = 3


def _pieces(text: str, length: int) -> Column:
    """The distinct pieces of a text, in lower case; none for NULL and for shorter texts."""
    places = F.sequence(F.lit(1), F.length(text) - length + 1)
    pieces = F.array_distinct(F.transform(places, lambda i: F.substring(F.lower(text), i, F.lit(length))))
    return F.when(F.length(F.lower(text)) >= length, pieces).otherwise(F.array().cast("array<string>"))


def _posted(texts: Sequence[str], lengths: Sequence[int]) -> Column:
    """(slot, piece) of a row: the slot is the place of the column in `texts`, and -1 for the entry that every row has."""
    def in_slot(slot: int) -> Callable[[Column], Column]:
        return lambda piece: F.struct(F.lit(slot).alias("slot"), piece.alias("piece"))

    own = [F.transform(_pieces(text, length), in_slot(i)) for i, text in enumerate(texts) for length in lengths]
    return F.concat(F.array(F.struct(F.lit(-1).alias("slot"), F.lit("").alias("piece"))), *own)


def containing(rows: DataFrame, texts: Sequence[str], asked: DataFrame, needles: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Columns of `rows` and of `asked` (those of `within` once), where every text holds its needle, in whatever case.

    `needles` of `asked` belong to `texts` of `rows`, one by one; a NULL or empty needle asks nothing, and a NULL text holds
    none. Rows meet what is asked for their own values of `within`; NULL there meets nothing. Equal rows of `asked`
    count once. Apart from `within` the two share no column names.
    """
    holds = [(F.coalesce(F.col(n), F.lit("")) == "") | F.lower(t).contains(F.lower(n)) for t, n in zip(texts, needles, strict=True)]
    return met_rows(rows, texts, asked, needles, within).filter(reduce(lambda a, b: a & b, holds, F.lit(True)))


def met_rows(rows: DataFrame, texts: Sequence[str], asked: DataFrame, needles: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """What `containing` looks through: the rows that hold the rarest piece of what is asked."""
    asked = asked.distinct()
    for column in within:
        asked = asked.filter(F.col(column).isNotNull())
    asked = written(asked.withColumn("_asked", F.sha2(F.to_json(F.struct(*within, *needles), {"ignoreNullFields": "false"}), 256)))
    entries = F.array(*[F.struct(F.lit(i).alias("slot"), F.lower(n).alias("needle")) for i, n in enumerate(needles)])
    wanted = asked.select("_asked", *within, F.inline(entries)).filter("needle <> ''").distinct()
    short = F.least(F.length("needle"), F.lit(LENGTH))
    lengths = sorted(r[0] for r in wanted.select(short.alias("n")).distinct().collect())  # at most LENGTH of them
    wanted = wanted.withColumn("piece", F.explode(F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length("needle") - short + 1), lambda i: F.substring(F.col("needle"), i, short)))))
    free = asked.join(wanted.select("_asked").distinct(), "_asked", "left_anti").select("_asked", *within, F.lit(-1).alias("slot"), F.lit("").alias("piece"))
    wanted = written(wanted.select("_asked", *within, "slot", "piece").unionByName(free).distinct())

    by = [*within, "slot", "piece"]
    posted = rows.select(*rows.columns, F.inline(_posted(texts, lengths)))
    counts = posted.select(*by).join(wanted.select(*by).distinct(), by, "left_semi").groupBy(*by).agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, by, "left").groupBy("_asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "slot", "piece")).alias("r"))
    # Written, so that its size is known: a small one is broadcast and the pieces of the rows are not shuffled.
    picked = written(asked.join(rarest.filter("r.n > 0").select("_asked", "r.slot", "r.piece"), "_asked").drop("_asked"))
    return posted.join(picked, by).drop("slot", "piece")
