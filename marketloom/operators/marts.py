"""Star joins, child aggregates and per-entity rollups.

Children are aggregated before the wide join, so the fact side is never multiplied.
No broadcast is forced: Spark broadcasts a side when its measured size is small and
otherwise shuffles it, and AQE splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def child_counts(children: DataFrame, key: str, out: str) -> DataFrame:
    return children.groupBy(key).agg(F.count("*").alias(out))


def child_count_and_first(
    children: DataFrame, key: str, order: str, value: str, count: str = "image_count", first: str = "primary_image_url"
) -> DataFrame:
    """Number of children and the value of the child at position 1, in one pass."""
    return children.groupBy(key).agg(
        F.count("*").alias(count), F.max(F.when(F.col(order) == 1, F.col(value))).alias(first)
    )


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]], counts: Sequence[str] = ()) -> DataFrame:
    """Left-join dimensions `(frame, fact column, dimension column)`; rows without a match stay.

    `counts` names columns whose missing value means zero.
    """
    out = fact
    for i, (dim, left, right) in enumerate(dims):
        name = f"_k{i}"
        overlap = [c for c in dim.columns if c in out.columns and c != right]
        renamed = dim.drop(*overlap).withColumnRenamed(right, name)
        out = out.join(renamed, F.col(left) == F.col(name), "left").drop(name)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts}) if counts else out


def entity_rollup(df: DataFrame, key: str, price: str, prefix: str = "") -> DataFrame:
    """Count, min, max and rounded mean price per entity; rows without a key are left out."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count("*").alias(f"{prefix}listing_count"),
            F.min(price).alias(f"{prefix}min_price"),
            F.max(price).alias(f"{prefix}max_price"),
            F.round(F.avg(price), 0).alias(f"{prefix}avg_price"),
        )
    )


def restrict_to_parents(children: DataFrame, parents: DataFrame, child_key: Column, parent_key: str) -> DataFrame:
    """Children whose parent exists."""
    ids = parents.select(F.col(parent_key).alias("_parent"))
    return children.join(ids, child_key == F.col("_parent"), "left_semi")


def build_bridge(
    items: DataFrame, dim: DataFrame, fact: DataFrame, on: Sequence[str], item_key: Column, fact_key: str, dim_key: str
) -> DataFrame:
    """Distinct (fact key, dimension key) pairs of exploded items that exist on both sides."""
    keyed = items.select(*on, item_key.alias("_fk"))
    found = keyed.join(dim.select(*on, dim_key), list(on))
    facts = fact.select(fact_key)
    return found.join(facts, F.col("_fk") == F.col(fact_key)).select(fact_key, dim_key).distinct()


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, out: str = "orphans") -> DataFrame:
    """Child keys without a parent and how many rows carry each."""
    counted = children.groupBy(child_key).agg(F.count("*").alias(out))
    return counted.join(parents, counted[child_key] == parents[parent_key], "left_anti")


def semi_join(df: DataFrame, ids: DataFrame, col: str, id_col: str) -> DataFrame:
    """Rows whose key is in a list of ids."""
    return df.join(ids, df[col] == ids[id_col], "left_semi")


def denormalize(bridge: DataFrame, left: tuple[DataFrame, str], right: tuple[DataFrame, str], cols: Mapping[str, str]) -> DataFrame:
    """Many-to-many pairs with the attributes of both ends; `cols` maps output to input column."""
    joined = bridge.join(left[0], left[1]).join(right[0], right[1])
    return joined.select(*[F.col(src).alias(out) for out, src in cols.items()])
