"""Semi-structured payloads: typed flattening, explosion and re-nesting.

Payloads are VARIANT. `try_variant_get` to a map, array or scalar is also the type
guard: a value of another kind, or JSON null, becomes SQL NULL and explodes to no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cleaning

ANY_MAP = "map<string,variant>"


_NOT_A_NUMBER = r"(?<=[:,\[])(\s*)(?:-?Infinity|NaN)(?=\s*[,}\]])"


def parse_payload(col: Column) -> Column:
    """JSON text to VARIANT, NULL when it is not valid JSON.

    Numbers that JSON lacks (NaN and the infinities) become JSON null. Of repeated keys the last wins
    where the session allows them, see `session.allow_repeated_keys`.
    """
    return F.coalesce(F.try_parse_json(col), F.try_parse_json(F.regexp_replace(col, _NOT_A_NUMBER, "$1null")))


def is_object(payload: Column, path: str = "$") -> Column:
    return F.try_variant_get(payload, path, ANY_MAP).isNotNull()


def is_array(payload: Column, path: str = "$") -> Column:
    return F.try_variant_get(payload, path, "array<variant>").isNotNull()


def keep_if_object(payload: Column, path: str = "$") -> Column:
    return F.when(is_object(payload, path), F.try_variant_get(payload, path, "variant"))


def keep_if_array(payload: Column, path: str = "$") -> Column:
    return F.when(is_array(payload, path), F.try_variant_get(payload, path, "variant"))


def text_at(payload: Column, path: str) -> Column:
    """Scalar or nested value at a path as text."""
    return F.try_variant_get(payload, path, "string")


def field(payload: Column, path: str, kind: str = "string") -> Column:
    """One typed value: kind is string, numeric, integer, date, variant or bool:<token>|<token>."""
    if kind == "variant":
        return F.try_variant_get(payload, path, "variant")
    raw = text_at(payload, path)
    if kind == "string":
        return raw
    if kind == "numeric":
        return cleaning.safe_numeric(raw)
    if kind == "integer":
        return cleaning.safe_integer(raw)
    if kind == "initcap":
        return F.initcap(raw)
    if kind == "date":
        return cleaning.parse_us_date(raw)
    if kind.startswith("bool:"):
        return cleaning.history_to_bool(raw, kind[5:].split("|"))
    raise ValueError(f"unknown field kind: {kind}")


def flatten(df: DataFrame, payload: str, spec: Mapping[str, tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """Typed columns from `{column: (path, kind)}`, next to the `keep` columns."""
    typed = [field(F.col(payload), path, kind).alias(name) for name, (path, kind) in spec.items()]
    return df.select(*keep, *typed)


def explode_categories(
    df: DataFrame, payload: str, path: str, keep: Sequence[str], category: str = "category", item: str = "item"
) -> DataFrame:
    """`{category: [item, ...]}` to distinct trimmed non-empty (keep..., category, item) rows."""
    groups = F.try_variant_get(F.col(payload), path, ANY_MAP)
    by_category = df.select(*keep, F.explode(groups).alias("_category", "_items"))
    items = F.try_variant_get(F.col("_items"), "$", "array<string>")
    rows = by_category.select(*keep, F.trim("_category").alias(category), F.explode(items).alias("_item"))
    return (
        rows.select(*keep, category, F.trim("_item").alias(item))
        .filter(F.col(item) != "")
        .distinct()
    )


def explode_ordered(
    df: DataFrame, array: Column, keep: Sequence[str], order: str = "item_order", item: str = "item"
) -> DataFrame:
    """Array elements with their 1-based position; NULL and empty ones are dropped, positions stay."""
    return (
        df.select(*keep, F.posexplode(array).alias("_pos", item))
        .select(*keep, (F.col("_pos") + 1).alias(order), item)
        .filter(F.col(item) != "")
    )


def explode_records(
    df: DataFrame, payload: str, path: str, spec: Mapping[str, tuple[str, str]], keep: Sequence[str]
) -> DataFrame:
    """Array of objects to one typed row per object; other shapes give no rows."""
    records = F.try_variant_get(F.col(payload), path, "array<variant>")
    return flatten(df.select(*keep, F.explode(records).alias("_record")), "_record", spec, keep)


def nest_by_category(
    df: DataFrame, key: str, category: str, item: str, out: str = "features", other: str = "Other"
) -> DataFrame:
    """Rows back to map<category, sorted distinct items> per key; a NULL category is `other`.

    Duplicates go in the first, partially aggregated step, so only distinct items are
    ever collected for a key.
    """
    rows = df.filter(F.col(item).isNotNull()).select(
        key, F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit(other)).alias("_category"), item
    )
    lists = rows.distinct().groupBy(key, "_category").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    entries = F.array_sort(F.collect_list(F.struct("_category", "_items")))
    return lists.groupBy(key).agg(F.map_from_entries(entries).alias(out))


def collect_children(
    children: DataFrame, key: str, order: Sequence[Column], value: str, limit: int | None, out: str
) -> DataFrame:
    """The first `limit` child values per parent as an array in the given order.

    With a limit the rank filter is applied below the shuffle, so a parent with very
    many children costs `limit` rows per task.
    """
    ranked = children.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    if limit is not None:
        ranked = ranked.filter(F.col("_rank") <= limit)
    pairs = F.array_sort(F.collect_list(F.struct("_rank", F.col(value).alias("_value"))))
    return ranked.groupBy(key).agg(F.transform(pairs, lambda p: p["_value"]).alias(out))


def first_child(children: DataFrame, key: str, order: Column, value: str, out: str) -> DataFrame:
    """The value of the first child per parent, as a map-side combinable aggregate."""
    return children.groupBy(key).agg(F.min_by(value, order).alias(out))


def map_columns(df: DataFrame, col: str, names: Mapping[str, str]) -> DataFrame:
    """Fixed columns from a map column: `{output column: map key}`."""
    return df.select("*", *[F.try_element_at(F.col(col), F.lit(k)).alias(out) for out, k in names.items()])


# Output column per weekday.
WEEKDAYS = {
    "hours_monday": "Monday", "hours_tuesday": "Tuesday", "hours_wednesday": "Wednesday",
    "hours_thursday": "Thursday", "hours_friday": "Friday", "hours_saturday": "Saturday",
    "hours_sunday": "Sunday",
}


def weekday_columns(df: DataFrame, hours: str) -> DataFrame:
    return map_columns(df, hours, WEEKDAYS)
