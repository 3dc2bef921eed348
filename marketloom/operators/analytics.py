"""Inventory analytics: price statistics, counts and top lists, per group or overall.

A `by` list of group columns gives the batch form (all brands at once); an empty list
gives the overall report. Top lists order by explicit NULLS LAST and a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import top_n_per_key
from .search import contains_text


def price_stats(df: DataFrame, price: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, min, max price and distinct items among rows with a positive price."""
    return df.filter(F.col(price) > 0).groupBy(*by).agg(
        F.avg(price).alias("avg_price"), F.min(price).alias("min_price"),
        F.max(price).alias("max_price"), F.count_distinct(key).alias("total_cars"),
    )


def market_stats(
    df: DataFrame, price: str, key: str, brand: tuple[str, str] | None = None, model: tuple[Sequence[str], str] | None = None
) -> DataFrame:
    """Price statistics of a brand and/or of items whose name columns contain a model text."""
    rows = df
    if brand:
        rows = rows.filter(F.col(brand[0]) == brand[1])
    if model:
        hit = F.lit(False)
        for c in model[0]:
            hit = hit | contains_text(F.col(c), model[1])
        rows = rows.filter(hit)
    return price_stats(rows, price, key)


def top_groups(
    df: DataFrame, name: Sequence[str], aggs: Sequence[Column], order: Sequence[Column], limit: int,
    by: Sequence[str] = (), rank: str = "position",
) -> DataFrame:
    """Aggregate by name and keep the first `limit` names, overall or within each `by` group."""
    grouped = df.groupBy(*by, *name).agg(*aggs)
    if by:
        return top_n_per_key(grouped, by, order, limit, rank=rank)
    return grouped.orderBy(*order).limit(limit)


def top_sellers(df: DataFrame, name: str, rating: str, recommend: str, by: Sequence[str], limit: int = 10,
                price: str | None = None) -> DataFrame:
    """Names with the most listings, best rated first among equals."""
    aggs = [F.count("*").alias("total_listings"), F.max(rating).alias("rating"), F.max(recommend).alias("recommend")]
    if price:
        aggs.append(F.avg(price).alias("avg_price"))
    order = [F.col("total_listings").desc(), F.col("rating").desc_nulls_last(), F.col(name).asc_nulls_last()]
    return top_groups(df, [name], aggs, order, limit, by)


def top_rated(df: DataFrame, name: str, rating: str, recommend: str, by: Sequence[str], limit: int = 10,
              price: str | None = None) -> DataFrame:
    """Names with the best rating among rated rows."""
    aggs = [F.max(rating).alias("rating"), F.max(recommend).alias("recommend")]
    if price:
        aggs.append(F.avg(price).alias("avg_price"))
    order = [F.col("rating").desc_nulls_last(), F.col("recommend").desc_nulls_last(), F.col(name).asc_nulls_last()]
    return top_groups(df.filter(F.col(rating).isNotNull()), [name], aggs, order, limit, by)


def value_mix(df: DataFrame, col: str, by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Rows per value of a column, most frequent first."""
    counted = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("total"))
    order = [F.col("total").desc(), F.col(col)]
    if limit is None:
        return counted
    return top_n_per_key(counted, by, order, limit, rank="position") if by else counted.orderBy(*order).limit(limit)


def top_features(
    features: DataFrame, item: str, feature: Sequence[str], limit: int = 15,
    items: DataFrame | None = None, item_key: str | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Features on the most distinct items, optionally per attribute of the item.

    Duplicates go first, so the count needs no distinct aggregate after the join.
    """
    pairs = features.select(item, *feature).distinct()
    if by:
        pairs = pairs.join(items.select(F.col(item_key).alias("_k"), *by), F.col(item) == F.col("_k")).drop("_k")
    counted = pairs.groupBy(*by, *feature).agg(F.count("*").alias("total"))
    order = [F.col("total").desc(), *[F.col(c).asc_nulls_last() for c in feature]]
    return top_n_per_key(counted, by, order, limit, rank="position") if by else counted.orderBy(*order).limit(limit)


def cheapest(df: DataFrame, brand: tuple[str, str], model: tuple[str, str], price: str, key: str, limit: int = 10) -> DataFrame:
    """Cheapest rows of one model of a brand."""
    rows = df.filter((F.col(brand[0]) == brand[1]) & contains_text(F.col(model[0]), model[1]))
    return rows.orderBy(F.col(price).asc_nulls_last(), F.col(key)).limit(limit)
