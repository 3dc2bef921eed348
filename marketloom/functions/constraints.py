"""Price, condition, fuel and year constraints found in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword tables in order of precedence.
CONDITIONS = (
    ("brand new", "New"), ("new", "New"), ("used", "Used"),
    ("pre-owned", "Used"), ("second hand", "Used"), ("certified", "Certified"),
)
FUELS = (
    ("gasoline", "Gasoline"), ("gas", "Gasoline"), ("petrol", "Gasoline"),
    ("hybrid", "Hybrid"), ("electric", "Electric"), ("ev", "Electric"),
    ("diesel", "Diesel"), ("plug-in", "Plug-In Hybrid"),
)
# A price, its multiplier words, the words that make it a lower bound, a model year.
AMOUNT = r"\$?\s*(\d[\d,]*(?:\.\d+)?)\s*(k|thousand)?"
LOWER_BOUND = r"(?i)(over|above|more than|at least|min|from|>)"
YEAR = r"\b((?:19|20)\d{2})\b"
LEAST_PRICE = 1000
CONTEXT_CHARS = 25


def _first_price(text: Column) -> Column:
    """struct(value, left): the first number of at least 1000 and the text just before it.

    The numbers and the gaps between them alternate, so one fold over both sees each
    number with the last characters of everything to its left.
    """
    pattern = "(?i)" + AMOUNT
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    nothing = F.struct(
        F.lit("").alias("tail"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("left")
    )

    def step(acc: Column, piece: Column) -> Column:
        left = F.right(F.concat(acc["tail"], F.coalesce(piece["gap"], F.lit(""))), F.lit(CONTEXT_CHARS))
        number = F.replace(F.regexp_extract(piece["hit"], pattern, 1), F.lit(","), F.lit("")).try_cast("double")
        value = number * F.when(F.regexp_extract(piece["hit"], pattern, 2) != "", 1000.0).otherwise(1.0)
        is_price = acc["value"].isNull() & (value >= LEAST_PRICE)
        return F.struct(
            F.right(F.concat(left, F.coalesce(piece["hit"], F.lit(""))), F.lit(CONTEXT_CHARS)).alias("tail"),
            F.when(is_price, value).otherwise(acc["value"]).alias("value"),
            F.when(is_price, left).otherwise(acc["left"]).alias("left"),
        )

    return F.when(F.size(found) > 0, F.aggregate(pieces, nothing, step))


def _first_keyword(text: Column, table: tuple[tuple[str, str], ...], whole_word: bool) -> Column:
    low = F.lower(text)
    tests = [
        F.when(low.rlike(r"\b" + word + r"\b") if whole_word else low.contains(word), value)
        for word, value in table
    ]
    return F.coalesce(*tests)


def parse_constraints(text: Column) -> Column:
    """struct(price_min, price_max, status, fuel_type, year) read from a message.

    The first number of at least 1000 is the price. It is a lower bound when the
    25 characters before it hold a lower-bound word, else an upper bound.
    """
    # A one-element array, so that the fold behind the price is evaluated once.
    bounds = F.transform(
        F.array(_first_price(text)),
        lambda p: F.struct(
            F.when(p["left"].rlike(LOWER_BOUND), p["value"]).alias("lower"),
            F.when(~p["left"].rlike(LOWER_BOUND), p["value"]).alias("upper"),
        ),
    )
    price = F.get(bounds, F.lit(0))
    return F.struct(
        price["lower"].alias("price_min"),
        price["upper"].alias("price_max"),
        _first_keyword(text, CONDITIONS, whole_word=False).alias("status"),
        _first_keyword(text, FUELS, whole_word=True).alias("fuel_type"),
        F.regexp_extract(text, YEAR, 1).try_cast("int").alias("year"),
    )
