"""Positions of regular-expression matches by native functions.

`split` gives what stands between the matches that `regexp_extract_all` gives, so a running sum of
both lengths is where each match starts. The sums are windows over the matches of one text, and no
text leaves the task that reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import texts

DOCUMENT = ("doc_id", "_same")
#: Code points kept on either side of a match.
CONTEXT = 40
_MATCHES = "array<struct<kind: string, i: int, gap: int, found: string, left: string, right: string>>"


def located(docs: DataFrame, kinds: list[tuple[str, str, Column | None]]) -> DataFrame:
    """One row per match: document, kind, `found`, `start`, `end` (code points), and text at either side.

    `kinds` are names, patterns and cheap conditions that a text must meet to have a match at all.
    Rows of one id and text are one document. A document without matches keeps one row of null kind,
    so that no join has to bring it back.
    """
    rows = texts(docs).withColumn("_same", F.xxhash64("text"))
    split = rows.select(*DOCUMENT, *(
        c for kind, pattern, needs in kinds for c in (
            F.when(_needed(needs), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"found_{kind}"),
            F.when(_needed(needs), F.split("text", pattern, -1)).alias(f"gap_{kind}"),
        )
    ))
    # One exchange by document serves all that is grouped and ordered within documents.
    matches = split.select(*DOCUMENT, F.inline_outer(F.concat(*(_matches(kind) for kind, _, _ in kinds)))).repartition(*DOCUMENT)
    before = Window.partitionBy(*DOCUMENT, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # A row that comes twice has each match twice: the same number in the same text.
    one = matches.groupBy(*DOCUMENT, "kind", "i").agg(*(F.min(c).alias(c) for c in ("gap", "found", "left", "right")))
    return one.withColumn("end", F.sum(F.col("gap") + F.length("found")).over(before)).select(
        *DOCUMENT, "kind", "found", "left", "right", (F.col("end") - F.length("found")).alias("start"), "end"
    )


def _needed(needs: Column | None) -> Column:
    return F.lit(True) if needs is None else needs


def _matches(kind: str) -> Column:
    """Structs of the matches of a kind: its number, the length of the gap before it, and the text around it."""
    zipped = F.arrays_zip(
        F.col(f"found_{kind}").alias("found"), F.col(f"gap_{kind}").alias("gap"),
        F.slice(F.col(f"gap_{kind}"), 2, F.greatest(F.size(f"found_{kind}"), F.lit(0))).alias("next"),
    )
    structs = F.transform(F.slice(zipped, F.lit(1), F.greatest(F.size(f"found_{kind}"), F.lit(0))), lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(z["gap"]).alias("gap"), z["found"].alias("found"),
        F.right(z["gap"], F.lit(CONTEXT)).alias("left"), F.left(z["next"], F.lit(CONTEXT)).alias("right"),
    ))
    return F.coalesce(structs, F.array().cast(_MATCHES))


def joined_spans(spans: Column) -> Column:
    """`kind:start:end` of an array of structs (start, rank, kind, end), by start, then rank."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
