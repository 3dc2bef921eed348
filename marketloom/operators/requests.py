"""Constraint searches as data: a table of requests, each with its own limits and exclusions, answered by joins.

Requests that ask the same are answered once. Their texts are looked up by posting lists, once for each set of texts; what a
set of texts leaves is then asked for the cheapest rows of a price range, brand by brand, so
that a request without a brand meets at most `limit` rows of every brand it does not exclude.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .grams import containing
from .latest import top_n_per_key
from .ranges import range_top_k
from .search import Columns

#: Columns of a request besides its key, and their types. NULL, an empty text or list and the year 0 ask nothing.
CONSTRAINTS = {
    "brand": "string", "model": "string", "price_min": "double", "price_max": "double", "status": "string",
    "fuel_type": "string", "year": "int", "exclude_brands": "array<string>",
}
_MOST = 1.7976931348623157e308


def _typed(requests: DataFrame, query: str) -> DataFrame:
    """The key and all constraints, under names of their own; missing columns ask nothing."""
    there = {c: (F.col(c) if c in requests.columns else F.lit(None)).cast(kind) for c, kind in CONSTRAINTS.items()}
    text = {c: F.nullif(F.lower(there[c]), F.lit("")) for c in ("model", "status", "fuel_type")}
    unwanted = F.array_sort(F.array_distinct(F.array_compact(there["exclude_brands"])))
    return requests.select(
        F.col(query).alias("_query"), F.nullif(there["brand"], F.lit("")).alias("_wanted"), text["model"].alias("_model"),
        text["status"].alias("_status"), text["fuel_type"].alias("_fuel"), F.nullif(there["year"], F.lit(0)).cast("string").alias("_year"),
        there["price_min"].alias("_min"), there["price_max"].alias("_max"), F.when(F.size(unwanted) > 0, unwanted).alias("_unwanted"),
    )


def answer_requests(items: DataFrame, c: Columns, requests: DataFrame, query: str, limit: int = 6) -> DataFrame:
    """For each request its distinct matches, cheapest first (unpriced last), at most `limit`: `query, position` and the columns of items.

    Request columns are those of `CONSTRAINTS`, as `search.constraint_filter` takes them: a brand is met exactly, texts anywhere
    and in any case, a price limit leaves out unpriced rows and an exclusion rows without a brand. Rows
    without a title are never found. Requests without a match have no rows; a repeated key has an answer for each of its requests.
    """
    texts = ["_model", "_year", "_status", "_fuel"]
    asked = _typed(requests, query)
    parts = [f for f in asked.columns if f != "_query"]
    # Equal requests become one, named by what they ask.
    named = written(asked.withColumn("_what", F.sha2(F.to_json(F.struct(*parts)), 256)).withColumn("_shape", F.sha2(F.to_json(F.struct(*texts)), 256)))
    what = named.drop("_query").dropDuplicates(["_what"])

    cols = list(dict.fromkeys([c.key, c.title, c.brand, c.price, c.status, c.fuel, *c.extra]))
    rows = items.filter(F.col(c.title).isNotNull()).select(*cols).distinct()
    shapes = what.select("_shape", *texts).distinct()
    held = containing(rows, [c.title, c.title, c.status, c.fuel], shapes, texts).select("_shape", *cols)
    price = F.col(c.price).cast("double")
    held = held.withColumns({
        "_branded": F.col(c.brand).isNotNull(), "_brand": F.coalesce(F.col(c.brand).cast("string"), F.lit("")),
        # The unpriced come behind all prices, and only a request without a limit reaches them.
        "_price": F.coalesce(price, F.lit(float("inf"))),
    })
    held = written(held)
    brands = held.select("_shape", "_branded", "_brand").distinct()
    fits = F.when(F.col("_wanted").isNotNull(), F.col("_branded") & (F.col("_brand") == F.col("_wanted"))).otherwise(True)
    allowed = F.col("_unwanted").isNull() | (F.col("_branded") & ~F.array_contains("_unwanted", F.col("_brand")))
    probes = what.join(brands, "_shape").filter(fits & F.coalesce(allowed, F.lit(True))).select(
        "_what", "_shape", "_branded", "_brand", F.coalesce("_min", F.lit(float("-inf"))).alias("_low"),
        F.coalesce("_max", F.when(F.col("_min").isNull(), F.lit(float("inf"))).otherwise(F.lit(_MOST))).alias("_high"),
    )
    order = [F.col(c.price).asc_nulls_last(), F.col(c.key), *[F.col(x) for x in cols if x not in (c.key, c.price)]]
    keys = ["_shape", "_branded", "_brand"]
    found = range_top_k(probes, held, keys, "_price", "_low", "_high", order, limit, ["_what", *keys], rank="_r")
    best = top_n_per_key(found, ["_what"], order, limit, rank="position")
    return named.select(F.col("_query").alias(query), "_what").join(best.select("_what", "position", *cols), "_what").drop("_what")
