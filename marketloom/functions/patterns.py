"""Numbers, bylines and keyword classes pulled out of page text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import digits_to_int

# Labels that end a "value label" line of the basics block.
BASIC_LABELS = ("exterior color", "interior color", "fuel type", "engine", "mpg", "drivetrain", "transmission")

# Output names and states of the vehicle-history classes.
HISTORY_ACCIDENT = "Accidents or damage"
HISTORY_OWNER = "1-owner vehicle"
HISTORY_PERSONAL = "Personal use only"
HISTORY_RECALL = "Open recall"
HISTORY_TITLE = "Clean Title"
NONE_REPORTED = "None reported"
SOME_REPORTED = "At least 1 reported"


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL (not '') when the pattern does not occur."""
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def review_count(col: Column) -> Column:
    """'Based on 1,234 reviews' -> 1234."""
    return digits_to_int(extract(col, r"Based on ([\d,]+) reviews"))


def percentage(col: Column) -> Column:
    """First 'NN%' or 'NN.N%' as a number."""
    return extract(col, r"(\d+(?:\.\d+)?)%").try_cast("double")


def first_grouped_int(col: Column) -> Column:
    """First run of digits and thousands separators as a number."""
    return digits_to_int(extract(col, r"([\d,]+)"))


def byline(col: Column) -> Column:
    """'By NAME from PLACE' or 'By NAME on DATE' to struct(name, place); place NULL without either word."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), r"^By ", "")
    sep = F.when(text.contains(" from "), F.lit(" from ")).when(text.contains(" on "), F.lit(" on "))
    cut = F.locate(" from ", text)
    cut = F.when(cut > 0, cut).otherwise(F.locate(" on ", text))
    name = F.when(sep.isNull(), text).otherwise(F.substring(text, F.lit(1), cut - 1))
    place = F.when(sep.isNotNull(), F.substring(text, cut + F.length(sep), F.length(text)))
    return F.struct(F.trim(name).alias("name"), F.trim(place).alias("place"))


def condition_and_title(col: Column) -> Column:
    """Split a headline at its first blank to struct(condition, title)."""
    pieces = F.split(col, " ", 2)
    return F.struct(
        F.nullif(F.get(pieces, F.lit(0)), F.lit("")).alias("condition"),
        F.get(pieces, F.lit(1)).alias("title"),
    )


def value_and_label(col: Column, labels: Sequence[str] = BASIC_LABELS) -> Column:
    """'Front-wheel Drive Drivetrain' to struct(label, value), by the trailing label word."""
    pattern = r"(?is)^(.*)\s+(" + "|".join(labels) + r")$"
    label = F.initcap(F.lower(extract(col, pattern, 2)))
    return F.struct(
        F.when(label == "Mpg", "MPG").otherwise(label).alias("label"),
        F.trim(extract(col, pattern, 1)).alias("value"),
    )


def history_class(col: Column) -> Column:
    """Phrase of the history report to struct(label, value); the first class that fits wins."""
    t = F.lower(F.trim(col))

    def reported(no: Column) -> Column:
        return F.when(no, NONE_REPORTED).otherwise(SOME_REPORTED)

    def yes_no(yes: Column) -> Column:
        return F.when(yes, "Yes").otherwise("No")

    classes = [
        (HISTORY_ACCIDENT, t.contains("accident") | t.contains("damage"), reported(t.startswith("no "))),
        (HISTORY_OWNER, t.contains("owner"), yes_no(t.contains("1 owner"))),
        (HISTORY_PERSONAL, t.contains("personal use"), F.lit("Yes")),
        (HISTORY_RECALL, t.contains("recall"), reported(t.contains("no "))),
        (HISTORY_TITLE, t.contains("title"), yes_no(t.contains("clean"))),
    ]
    label = F.coalesce(*[F.when(test, name) for name, test, _ in classes])
    value = F.coalesce(*[F.when(label == name, out) for name, _, out in classes])
    return F.struct(label.alias("label"), value.alias("value"))
