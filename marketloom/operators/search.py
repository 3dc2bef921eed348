"""Faceted and constraint search, paging and comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .grams import containing
from .latest import top_n_per_key

# Sort keys a caller may use and the columns behind them.
SORT_COLUMNS = {
    "price": "price", "mileage": "mileage", "car_rating": "car_rating",
    "rating": "car_rating", "created_at": "first_seen_date",
}
DEFAULT_SORT = "first_seen_date"


def contains_text(col: Column, needle: str, escape: bool = True) -> Column:
    """Case-insensitive substring. Unescaped, `%` and `_` of the needle act as wildcards."""
    if escape:
        for special in ("\\", "%", "_"):
            needle = needle.replace(special, "\\" + special)
    return col.ilike(f"%{needle}%")


def facet_filter(
    required: str,
    query: str | None = None,
    query_columns: Sequence[str] = (),
    text: Mapping[str, str | None] | None = None,
    at_least: Mapping[str, float | None] | None = None,
    at_most: Mapping[str, float | None] | None = None,
    escape: bool = True,
) -> Column:
    """Conjunction of the facets that are set; a bound of 0 counts as set."""
    test = F.col(required).isNotNull()
    if query:
        any_column = F.lit(False)
        for c in query_columns:
            any_column = any_column | contains_text(F.col(c), query, escape)
        test = test & any_column
    for c, needle in (text or {}).items():
        if needle:
            test = test & contains_text(F.col(c), needle, escape)
    for c, bound in (at_least or {}).items():
        if bound is not None:
            test = test & (F.col(c) >= bound)
    for c, bound in (at_most or {}).items():
        if bound is not None:
            test = test & (F.col(c) <= bound)
    return test


def sort_order(sort_by: str, descending: bool, tie_break: str, columns: Mapping[str, str] | None = None,
               default: str = DEFAULT_SORT) -> list[Column]:
    """Whitelisted order with NULLs last and the key as tie-break."""
    col = F.col((columns or SORT_COLUMNS).get(sort_by, default))
    return [col.desc_nulls_last() if descending else col.asc_nulls_last(), F.col(tie_break).asc()]


def page_of(df: DataFrame, order: Sequence[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of an ordered result; the plan keeps page * page_size rows per task."""
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def page_totals(df: DataFrame, page_size: int) -> DataFrame:
    """One row with the match count and the number of pages."""
    return df.agg(F.count("*").alias("total")).select(
        "total", F.ceil(F.col("total") / page_size).cast("bigint").alias("total_pages")
    )


def newest_per_user(
    events: DataFrame, user: str, order: Sequence[Column], skip: int, limit: int,
    types: Sequence[str] | None = None, kind: str | None = None, position: str = "position",
) -> DataFrame:
    """History page for every user at once: rows skip+1 .. skip+limit, newest first."""
    rows = events.filter(F.col(kind).isin(*types)) if types else events
    ranked = top_n_per_key(rows, [user], order, skip + limit, rank=position)
    return ranked.filter(F.col(position) > skip) if skip else ranked


@dataclass(frozen=True)
class Columns:
    """Column names the constraint search reads."""

    key: str = "vin"
    title: str = "title"
    brand: str = "brand"
    price: str = "price"
    status: str = "new_used"
    fuel: str = "fuel_type"
    name: str | None = None
    extra: Sequence[str] = field(default_factory=tuple)


def constraint_filter(
    c: Columns,
    brand: str | None = None,
    model: str | None = None,
    price_min: float | None = None,
    price_max: float | None = None,
    status: str | None = None,
    fuel_type: str | None = None,
    year: int | None = None,
    exclude_brands: Sequence[str] = (),
) -> Column:
    """Hard filters of a conversational search. Excluded brands also drop rows without a brand."""
    test = facet_filter(
        c.title,
        text={c.title: model, c.status: status, c.fuel: fuel_type},
        at_least={c.price: price_min},
        at_most={c.price: price_max},
    )
    if year:
        test = test & contains_text(F.col(c.title), str(year))
    if brand:
        test = test & (F.col(c.brand) == brand)
    if exclude_brands:
        test = test & ~F.col(c.brand).isin(*exclude_brands)
    return test


def constraint_search(df: DataFrame, c: Columns, limit: int = 6, **constraints: object) -> DataFrame:
    """Distinct matches, cheapest first (unpriced last), at most `limit`."""
    cols = list(dict.fromkeys([c.key, c.title, c.brand, c.price, c.status, c.fuel, *c.extra]))
    found = df.filter(constraint_filter(c, **constraints)).select(*cols).distinct()
    return found.orderBy(F.col(c.price).asc_nulls_last(), F.col(c.key)).limit(limit)


def exclude_values(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Case-insensitive exclusion; rows without a value stay."""
    if not values:
        return df
    low = F.lower(F.coalesce(F.col(col), F.lit("")))
    return df.filter(~low.isin(*[v.lower() for v in values]))


def exclude_asked(df: DataFrame, col: str, asked: DataFrame, query: str, values: str) -> DataFrame:
    """`exclude_values` with a list of values for each query; a query without a row or list excludes nothing."""
    pairs = asked.select(query, F.explode(values).alias("_value")).select(query, F.lower("_value").alias("_value")).distinct()
    return df.withColumn("_value", F.lower(F.coalesce(F.col(col), F.lit("")))).join(pairs, [query, "_value"], "left_anti").drop("_value").select(*df.columns)


def within_score(df: DataFrame, col: str, limit: float | None = None) -> DataFrame:
    """Drop hits whose score (a distance) is above a threshold; no threshold keeps all."""
    return df if limit is None else df.filter(F.col(col) <= limit)


def compare_items(items: DataFrame, requests: DataFrame, c: Columns) -> DataFrame:
    """One row per request (req_id, req_brand, req_model, req_year) with its cheapest match and market stats.

    The cheapest match carries the model text (and year) in its title; the stats are of all priced items of the brand with that
    text in title or name. Requests of one brand and text meet the items that hold its rarest piece, once for all of them.
    Requests without a match come back with `found` false and NULLs.
    """
    # A needle does not reach over the mark between title and name.
    both = F.concat_ws("\x00", c.title, c.name) if c.name else F.col(c.title)
    cols = list(dict.fromkeys([c.key, c.title, c.price, *c.extra]))
    rows = items.filter(F.col(c.title).isNotNull()).select(F.col(c.brand).alias("req_brand"), F.struct(*cols).alias("_item"), both.alias("_text"))
    texts = requests.select("req_brand", "req_model").filter(F.col("req_model").isNotNull())
    met = written(containing(rows, ["_text"], texts, ["req_model"], within=["req_brand"]).drop("_text"))
    own = {x: F.col("_item")[x] for x in cols}
    years = requests.select("req_brand", "req_model", "req_year").distinct()
    titled = F.lower(own[c.title]).contains(F.lower("req_model")) & (F.col("req_year").isNull() | own[c.title].contains(F.col("req_year").cast("string")))
    best = top_n_per_key(
        met.join(years, ["req_brand", "req_model"]).filter(titled), ["req_brand", "req_model", "req_year"], [own[c.price].asc_nulls_last(), own[c.key]], 1
    ).select(F.struct("req_brand", "req_model").alias("_named"), F.col("req_year").alias("_year"), *[own[x].alias(x) for x in cols])
    same = (F.struct("req_brand", "req_model") == F.col("_named")) & F.col("req_year").eqNullSafe(F.col("_year"))
    match = requests.join(best, same).select("req_id", *cols)
    price = own[c.price]
    stats = met.filter(price > 0).groupBy("req_brand", "req_model").agg(
        F.avg(price).alias("avg_price"), F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.count("*").alias("total_listings"),
    )
    stats = requests.select("req_id", "req_brand", "req_model").join(stats, ["req_brand", "req_model"]).drop("req_brand", "req_model")
    alone = F.coalesce(F.col(c.price), F.lit(0.0))
    found = F.col(c.key).isNotNull()
    out = requests.join(match, "req_id", "left").join(stats, "req_id", "left")
    return out.withColumns({
        "found": found,
        **{s: F.when(found, F.coalesce(F.col(s), alone)) for s in ("avg_price", "min_price", "max_price")},
        "total_listings": F.when(found, F.coalesce(F.col("total_listings"), F.lit(1))),
    })
