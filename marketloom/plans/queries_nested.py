"""Nested data: payloads are built from table rows by Spark, then taken apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import nested
from .registry import Tables, query


@query(r"""
SELECT event_id, CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS INTEGER) AS k,
  CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS DOUBLE) AS k_number, regexp_extract(props, '"k":\s*(\d+)', 1) AS k_text,
  CAST(NULL AS VARCHAR) AS missing, TRUE AS is_object, FALSE AS k_is_array
FROM events""")
def payload_fields(t: Tables) -> DataFrame:
    payloads = t.events.select("event_id", nested.parse_payload(F.col("props")).alias("payload"))
    spec = {"k": ("$.k", "integer"), "k_number": ("$.k", "numeric"), "k_text": ("$.k", "string"), "missing": ("$.a.b", "string")}
    guarded = payloads.withColumns({
        "is_object": nested.is_object(F.col("payload")), "k_is_array": nested.is_array(F.col("payload"), "$.k"),
    })
    return nested.flatten(guarded, "payload", spec, keep=["event_id", "is_object", "k_is_array"])


def _listing_payloads(t: Tables) -> DataFrame:
    """A listing document per part: two feature lists with blanks and repeats, one value that is no list."""
    words = F.split("p_name", " ")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    text = F.format_string(
        '{"features": {"%s": ["%s", " %s ", "", "%s"], "Size": ["%s"], "Odd": "no list"}, '
        '"images": ["u1/%s", null, "", "u4/%s"], "reviews": [{"rating": "%s", "by": {"name": "%s"}}, {"rating": null}], '
        '"hours": %s, "highlights": %s}',
        F.col("p_type"), first, second, first, F.col("p_size").cast("string"), first, second,
        F.col("p_size").cast("string"), F.col("p_brand"),
        F.when(F.col("p_size") % 2 == 0, '{"Monday": "9-5"}').otherwise("null"),
        F.when(F.col("p_size") % 3 == 0, '["clean"]').otherwise('"clean"'),
    )
    return t.part.select("p_partkey", F.try_parse_json(text).alias("payload"))


@query("""
SELECT p_partkey, p_type AS category, split_part(p_name, ' ', 1) AS feature FROM part
UNION SELECT p_partkey, p_type, split_part(p_name, ' ', 2) FROM part
UNION SELECT p_partkey, 'Size', CAST(p_size AS VARCHAR) FROM part""")
def exploded_features(t: Tables) -> DataFrame:
    return nested.explode_categories(_listing_payloads(t), "payload", "$.features", ["p_partkey"], "category", "feature")


@query("""
SELECT p_partkey, 1 AS image_order, 'u1/' || split_part(p_name, ' ', 1) AS image_url FROM part
UNION ALL SELECT p_partkey, 4, 'u4/' || split_part(p_name, ' ', 2) FROM part""")
def exploded_images(t: Tables) -> DataFrame:
    images = F.try_variant_get("payload", "$.images", "array<string>")
    return nested.explode_ordered(_listing_payloads(t), images, ["p_partkey"], "image_order", "image_url")


@query("""
SELECT p_partkey, CAST(p_size AS DOUBLE) AS rating, p_brand AS author FROM part
UNION ALL SELECT p_partkey, NULL, NULL FROM part""")
def exploded_records(t: Tables) -> DataFrame:
    spec = {"rating": ("$.rating", "numeric"), "author": ("$.by.name", "string")}
    return nested.explode_records(_listing_payloads(t), "payload", "$.reviews", spec, ["p_partkey"])


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '{"Monday":"9-5"}' END AS hours,
  CASE WHEN p_size % 3 = 0 THEN '["clean"]' END AS highlights
FROM part""")
def guarded_payloads(t: Tables) -> DataFrame:
    payload = F.col("payload")
    return _listing_payloads(t).select(
        "p_partkey", F.to_json(nested.keep_if_object(payload, "$.hours")).alias("hours"),
        F.to_json(nested.keep_if_array(payload, "$.highlights")).alias("highlights"),
    )


@query("""
WITH d AS (SELECT DISTINCT l_orderkey, coalesce(nullif(l_returnflag, 'N'), 'Other') AS c, CAST(l_partkey AS VARCHAR) AS p FROM lineitem),
g AS (SELECT l_orderkey, c, '"' || c || '":["' || string_agg(p, '","' ORDER BY p) || '"]' AS e FROM d GROUP BY l_orderkey, c)
SELECT l_orderkey, '{' || string_agg(e, ',' ORDER BY c) || '}' AS parts_by_flag FROM g GROUP BY l_orderkey""")
def nested_categories(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"), F.col("l_partkey").cast("string").alias("part")
    )
    maps = nested.nest_by_category(rows, "l_orderkey", "flag", "part", out="m")
    return maps.select("l_orderkey", F.to_json("m").alias("parts_by_flag"))


@query("""
SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS hours_monday, NULL::VARCHAR AS hours_tuesday,
  NULL::VARCHAR AS hours_wednesday, NULL::VARCHAR AS hours_thursday, NULL::VARCHAR AS hours_friday, NULL::VARCHAR AS hours_saturday,
  c_name AS hours_sunday
FROM customer""")
def weekday_hours(t: Tables) -> DataFrame:
    day = F.when(F.col("c_nationkey") % 2 == 0, "Monday").otherwise("Holiday")
    hours = t.customer.select("c_custkey", F.create_map(day, F.col("c_mktsegment"), F.lit("Sunday"), F.col("c_name")).alias("h"))
    return nested.weekday_columns(hours, "h").drop("h")


_LINE_ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"]


@query("""
WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) AS n FROM lineitem)
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY n) AS first_parts FROM r WHERE n <= 3 GROUP BY l_orderkey""")
def bounded_children(t: Tables) -> DataFrame:
    order = [F.col(c) for c in _LINE_ORDER]
    kids = nested.collect_children(t.lineitem, "l_orderkey", order, "l_partkey", 3, "parts")
    return kids.select("l_orderkey", F.array_join(F.transform("parts", lambda p: p.cast("string")), ",").alias("first_parts"))


@query("""
WITH f AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_shipdate, l_partkey, l_suppkey)) AS p FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(CAST(p AS VARCHAR), '') AS first_part FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""")
def first_children(t: Tables) -> DataFrame:
    firsts = nested.first_child(t.lineitem, "l_orderkey", F.struct(*_LINE_ORDER), "l_partkey", "p")
    joined = t.orders.join(firsts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce(F.col("p").cast("string"), F.lit("")).alias("first_part"))
