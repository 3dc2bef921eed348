"""Search, joins, rollups, analytics and data-quality checks over the catalogue tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import mileage_text
from ..operators import analytics, latest, marts, nested, quality, ranges, rollups, search
from ..session import checkpoint_dir
from ..sources.daily import DailyEvents
from . import roles
from .registry import Tables, query

# ---- rollups -------------------------------------------------------------------------


_POPULAR_SQL = f"""
WITH {roles.ITEMS}, {roles.INTERACTIONS},
c AS (SELECT item, count(*) AS total_interactions, count(*) FILTER (kind = 'view') AS views, count(*) FILTER (kind IN ('click', 'signup')) AS saves,
  count(*) FILTER (kind = 'purchase') AS contacts, sum(score) FILTER (ts > TIMESTAMP '2024-01-01') AS pop FROM ev GROUP BY item)
SELECT i.item, title, brand, price, coalesce(total_interactions, 0) AS total_interactions, coalesce(views, 0) AS views,
  coalesce(saves, 0) AS saves, coalesce(contacts, 0) AS contacts, round(coalesce(pop, 0), 2) AS pop_score_30d
FROM items i LEFT JOIN c USING (item)"""
_TRENDING_SQL = f"""
WITH {roles.ITEMS}, {roles.INTERACTIONS},
c AS (SELECT item, count(*) FILTER (ts > TIMESTAMP '2024-01-24') AS a, count(*) FILTER (ts <= TIMESTAMP '2024-01-24' AND ts > TIMESTAMP '2024-01-17') AS b FROM ev GROUP BY item)
SELECT model, brand, CAST(coalesce(sum(a), 0) AS BIGINT) AS interactions_7d, CAST(coalesce(sum(b), 0) AS BIGINT) AS interactions_prior_7d
FROM items LEFT JOIN c USING (item) GROUP BY model, brand"""


@query(_POPULAR_SQL)
def popular_items(t: Tables) -> DataFrame:
    rolled = rollups.popularity(
        roles.items(t).select("item", "title", "brand", "price"), roles.interactions(t),
        "item", "item", "kind", "score", "ts", roles.as_of(), roles.COUNTERS,
    )
    return rolled.withColumn("pop_score_30d", F.round("pop_score_30d", 2))


@query(_TRENDING_SQL)
def trending_models(t: Tables) -> DataFrame:
    return rollups.trending(roles.items(t), roles.interactions(t), "item", "item", "ts", ["model", "brand"], roles.as_of())


def _daily(t: Tables) -> DailyEvents:
    """Event counts by day after five refreshes, each with the log as far as it went."""
    log = roles.interactions(t)
    daily = DailyEvents(t.spark, f"{checkpoint_dir(t.spark)}/marketloom-daily-{uuid.uuid4().hex}", "item", "kind", "score", "ts", roles.COUNTERS)
    for end in ("2024-01-06 05:00:00", "2024-01-12 17:00:00", "2024-01-18 00:00:00", "2024-01-25 23:00:00"):
        daily.refresh(log.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    daily.refresh(log)
    return daily


@query(_POPULAR_SQL)
def refreshed_popularity(t: Tables) -> DataFrame:
    rolled = _daily(t).popularity(roles.items(t).select("item", "title", "brand", "price"), "item", roles.interactions(t), roles.as_of())
    return rolled.withColumn("pop_score_30d", F.round("pop_score_30d", 2))


@query(_TRENDING_SQL)
def refreshed_trending(t: Tables) -> DataFrame:
    return _daily(t).trending(roles.items(t), "item", roles.interactions(t), ["model", "brand"], roles.as_of())


@query(f"""
WITH {roles.ITEMS}
SELECT 'brand' AS facet, brand AS value FROM items UNION SELECT 'fuel', fuel FROM items
UNION SELECT 'transmission', transmission FROM items UNION SELECT 'drivetrain', drivetrain FROM items""")
def facet_values(t: Tables) -> DataFrame:
    return rollups.facet_values(roles.items(t), ["brand", "fuel", "transmission", "drivetrain"])


@query(f"""
WITH {roles.ITEMS}
SELECT 'price' AS facet, min(price) AS low, max(price) AS high FROM items
UNION ALL SELECT 'mileage', CAST(min(mileage) AS DOUBLE), CAST(max(mileage) AS DOUBLE) FROM items""")
def facet_ranges(t: Tables) -> DataFrame:
    return rollups.facet_ranges(roles.items(t), ["price", "mileage"])


# ---- search --------------------------------------------------------------------------

_SEARCH = "title IS NOT NULL AND (title ILIKE '%ring%' OR brand ILIKE '%ring%' OR model ILIKE '%ring%') AND brand ILIKE '%brand#1%' AND price >= 0 AND price <= 960 AND rating >= 1.5"


def _search(t: Tables) -> DataFrame:
    test = search.facet_filter(
        "title", "RING", ["title", "brand", "model"], {"brand": "brand#1", "fuel": None},
        {"price": 0, "rating": 1.5}, {"price": 960, "mileage": None},
    )
    return roles.items(t).filter(test)


@query(f"""
WITH {roles.ITEMS}
SELECT item, title, price, format('{{:,}}', mileage) || ' mi.' AS mileage_str FROM items WHERE {_SEARCH}
ORDER BY price DESC NULLS LAST, item LIMIT 10 OFFSET 10""")
def search_page(t: Tables) -> DataFrame:
    order = search.sort_order("price", descending=True, tie_break="item")
    rows = search.page_of(_search(t), order, page=2, page_size=10)
    return rows.select("item", "title", "price", mileage_text(F.col("mileage")).alias("mileage_str"))


@query(f"""
WITH {roles.ITEMS}
SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages FROM items WHERE {_SEARCH}""")
def search_totals(t: Tables) -> DataFrame:
    return search.page_totals(_search(t), 10)


@query(f"""
WITH {roles.ITEMS}
SELECT item, title, rating FROM items ORDER BY rating DESC NULLS LAST, crawled_at DESC NULLS LAST, item LIMIT 20""")
def featured_items(t: Tables) -> DataFrame:
    order = [F.col("rating").desc_nulls_last(), F.col("crawled_at").desc_nulls_last(), F.col("item")]
    return search.page_of(roles.items(t), order, page_size=20).select("item", "title", "rating")


@query("""
WITH l AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) FILTER (n <= 5) AS parts, count(*) AS lines
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) AS n FROM lineitem) GROUP BY 1)
SELECT o_orderkey, c_name, o_totalprice, coalesce(parts, '') AS parts, coalesce(lines, 0) AS lines
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN l ON o_orderkey = l_orderkey""")
def detail_views(t: Tables) -> DataFrame:
    order = [F.col(c) for c in ("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")]
    kids = nested.collect_children(t.lineitem, "l_orderkey", order, "l_partkey", 5, "_parts")
    counts = marts.child_counts(t.lineitem, "l_orderkey", "lines").withColumnRenamed("l_orderkey", "_k")
    parents = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    full = parents.join(kids, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(counts, F.col("o_orderkey") == F.col("_k"), "left")
    parts = F.array_join(F.transform("_parts", lambda p: p.cast("string")), ",")
    return full.select(
        "o_orderkey", "c_name", "o_totalprice", F.coalesce(parts, F.lit("")).alias("parts"), F.coalesce("lines", F.lit(0)).alias("lines")
    )


_COLUMNS = search.Columns(key="item", status="transmission", fuel="fuel")


@query(f"""
WITH {roles.ITEMS}
SELECT DISTINCT item, title, brand, price, transmission, fuel FROM items
WHERE title ILIKE '%bolt%' AND price >= 910 AND price <= 990 AND fuel ILIKE '%red%' AND brand NOT IN ('Brand#1', 'Brand#2')
ORDER BY price ASC NULLS LAST, item LIMIT 6""")
def constraint_search(t: Tables) -> DataFrame:
    return search.constraint_search(
        roles.items(t), _COLUMNS, limit=6, model="bolt", price_min=910, price_max=990, fuel_type="red",
        exclude_brands=["Brand#1", "Brand#2"],
    )


@query(f"""
WITH {roles.ITEMS} SELECT item, brand FROM items WHERE lower(coalesce(brand, '')) NOT IN ('brand#3', 'brand#4') AND price <= 950""")
def excluded_brands(t: Tables) -> DataFrame:
    rows = search.exclude_values(roles.items(t), "brand", ["BRAND#3", "Brand#4"])
    return search.within_score(rows, "price", 950).select("item", "brand")


@query("""
WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('view', 'click'))
SELECT user_id, event_id, event_type FROM r WHERE n > 5 AND n <= 15""")
def user_history(t: Tables) -> DataFrame:
    order = [F.col("ts").desc_nulls_last(), F.col("event_id").desc()]
    rows = search.newest_per_user(t.events, "user_id", order, 5, 10, ["view", "click"], "event_type")
    return rows.select("user_id", "event_id", "event_type")


@query(f"""
WITH {roles.ITEMS},
req AS (SELECT s_suppkey AS req_id, 'Brand#' || (s_suppkey % 25) AS req_brand, ['bolt', 'ring', 'nothing'][s_suppkey % 3 + 1] AS req_model FROM supplier),
m AS (SELECT req_id, item, title, price, row_number() OVER (PARTITION BY req_id ORDER BY price, item) AS n FROM req JOIN items ON brand = req_brand AND contains(lower(title), req_model)),
s AS (SELECT req_id, avg(price) AS a, min(price) AS lo, max(price) AS hi, count(*) AS c FROM req JOIN items ON brand = req_brand AND contains(lower(title), req_model) AND price > 0 GROUP BY 1)
SELECT req_id, item, price, round(a, 4) AS avg_price, lo AS min_price, hi AS max_price, c AS total_listings, item IS NOT NULL AS found
FROM req LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (req_id) LEFT JOIN s USING (req_id)""")
def compared_items(t: Tables) -> DataFrame:
    names = F.array(F.lit("bolt"), F.lit("ring"), F.lit("nothing"))
    requests = t.supplier.select(
        F.col("s_suppkey").alias("req_id"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25).cast("string")).alias("req_brand"),
        F.get(names, (F.col("s_suppkey") % 3).cast("int")).alias("req_model"), F.lit(None).cast("int").alias("req_year"),
    )
    out = search.compare_items(roles.items(t), requests, _COLUMNS)
    return out.select("req_id", "item", "price", F.round("avg_price", 4).alias("avg_price"), "min_price", "max_price", "total_listings", "found")


# ---- joins and marts -----------------------------------------------------------------


@query("""
SELECT o_orderkey, o_totalprice, c_name, c_mktsegment, n_name, r_name, coalesce(k.lines, 0) AS lines, k.first_part
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT l_orderkey, count(*) AS lines, max(l_partkey) FILTER (l_linenumber = 1) AS first_part FROM lineitem GROUP BY 1) k ON o_orderkey = k.l_orderkey""")
def wide_star(t: Tables) -> DataFrame:
    children = marts.child_count_and_first(t.lineitem, "l_orderkey", "l_linenumber", "l_partkey", "lines", "first_part")
    dims = [
        (t.customer, "o_custkey", "c_custkey"), (t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey"),
        (children, "o_orderkey", "l_orderkey"),
    ]
    out = marts.star_join(t.orders, dims, counts=["lines"])
    return out.select("o_orderkey", "o_totalprice", "c_name", "c_mktsegment", "n_name", "r_name", "lines", "first_part")


@query("""
WITH d AS (SELECT DISTINCT p_type, split_part(p_name, ' ', 1) AS word FROM part)
SELECT DISTINCT p_partkey, md5(d.p_type || '||' || d.word) AS feature_sk FROM part JOIN d ON part.p_type = d.p_type AND split_part(p_name, ' ', 1) = d.word
JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON p_partkey = l_partkey""")
def feature_bridge(t: Tables) -> DataFrame:
    word = F.get(F.split("p_name", " "), F.lit(0)).alias("word")
    exploded = t.part.select("p_partkey", "p_type", word)
    dim = exploded.select("p_type", "word").distinct().withColumn("feature_sk", F.md5(F.concat_ws("||", "p_type", "word")))
    fact = t.lineitem.select("l_partkey").distinct()
    bridge = marts.build_bridge(exploded, dim, fact, ["p_type", "word"], F.col("p_partkey"), "l_partkey", "feature_sk")
    return bridge.withColumnRenamed("l_partkey", "p_partkey")


@query("""
SELECT DISTINCT p_name, s_name, n_name FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def many_to_many(t: Tables) -> DataFrame:
    bridge = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    sellers = marts.star_join(t.supplier, [(t.nation, "s_nationkey", "n_nationkey")])
    cols = {"p_name": "p_name", "s_name": "s_name", "n_name": "n_name"}
    return marts.denormalize(bridge, (t.part, "p_partkey"), (sellers, "s_suppkey"), cols).distinct()


@query("""
SELECT s_suppkey, s_name, coalesce(c, 0) AS listing_count, lo AS min_price, hi AS max_price, a AS avg_price
FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS c, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_extendedprice)) AS a FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey""")
def seller_inventory(t: Tables) -> DataFrame:
    rolled = marts.entity_rollup(t.lineitem, "l_suppkey", "l_extendedprice")
    out = marts.star_join(t.supplier, [(rolled, "s_suppkey", "l_suppkey")], counts=["listing_count"])
    return out.select("s_suppkey", "s_name", "listing_count", "min_price", "max_price", "avg_price")


@query("""
WITH m AS (SELECT p_brand AS car_model, count(*) AS listing_count, min(p_retailprice) AS min_price, max(p_retailprice) AS max_price, round(avg(p_retailprice)) AS avg_price FROM part GROUP BY 1),
r AS (SELECT p_brand, count(*) AS n FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1)
SELECT m.*, coalesce(n, 0) AS review_count FROM m LEFT JOIN r ON p_brand = car_model""")
def model_mart(t: Tables) -> DataFrame:
    dim = t.part.select(F.col("p_brand").alias("car_model")).distinct()
    listing = marts.entity_rollup(t.part, "p_brand", "p_retailprice")
    # Lines shrink to one row per part before they meet the catalogue.
    lines = marts.child_counts(t.lineitem, "l_partkey", "n")
    reviews = t.part.join(lines, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("_b")).agg(F.sum("n").alias("review_count"))
    out = marts.star_join(dim, [(listing, "car_model", "p_brand"), (reviews, "car_model", "_b")], counts=["listing_count", "review_count"])
    return out.select("car_model", "listing_count", "min_price", "max_price", "avg_price", "review_count")


@query("""
WITH ev AS (SELECT user_id * 3 AS uid FROM events)
SELECT uid, count(*) AS orphans FROM ev WHERE uid NOT IN (SELECT s_suppkey FROM supplier) GROUP BY uid""")
def orphan_events(t: Tables) -> DataFrame:
    events = t.events.select((F.col("user_id") * 3).alias("uid"))
    return marts.orphans(events, t.supplier, "uid", "s_suppkey").select("uid", "orphans")


@query("""
SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) FROM events WHERE event_type = 'purchase')""".replace("\\\\", "\\"))
def bought_items(t: Tables) -> DataFrame:
    bought = roles.interactions(t).filter(F.col("kind") == "purchase").select(F.col("item").alias("id"))
    return marts.semi_join(t.part, bought, "p_partkey", "id").select("p_partkey", "p_name")


@query("""
WITH r AS (SELECT p_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY p_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey) AS n
  FROM part JOIN lineitem ON p_partkey = l_partkey)
SELECT p_partkey, l_orderkey, l_linenumber FROM r WHERE n <= 10""")
def recent_children(t: Tables) -> DataFrame:
    order = [F.col("l_shipdate").desc_nulls_last(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    top = latest.top_n_per_key(t.lineitem, ["l_partkey"], order, 10)
    return t.part.join(top, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "l_orderkey", "l_linenumber")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, s_name, s_acctbal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def item_sellers(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "s_name", "s_acctbal")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')""")
def known_parents(t: Tables) -> DataFrame:
    parents = t.part.filter(F.col("p_type") == "PROMO")
    rows = marts.restrict_to_parents(t.lineitem, parents, F.col("l_partkey"), "p_partkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"""
WITH {roles.ITEMS},
p AS (SELECT a.item AS seed, b.item, row_number() OVER (PARTITION BY a.item ORDER BY b.rating DESC NULLS LAST, b.item) AS n
  FROM items a JOIN items b ON a.brand = b.brand AND a.item <> b.item AND b.price BETWEEN a.price * (1 - 0.01) AND a.price * (1 + 0.01))
SELECT seed, item, n AS position FROM p WHERE n <= 6""")
def similar_in_band(t: Tables) -> DataFrame:
    found = ranges.similar_in_price_band(roles.items(t), "item", "brand", "price", "rating", band=0.01, limit=6)
    return found.select("seed", "item", F.col("position").cast("bigint").alias("position"))


# ---- analytics -----------------------------------------------------------------------


@query(f"""
WITH {roles.ITEMS}
SELECT brand, round(avg(price), 4) AS avg_price, min(price) AS min_price, max(price) AS max_price, count(DISTINCT item) AS total_cars FROM items WHERE price > 0 GROUP BY brand""")
def brand_price_stats(t: Tables) -> DataFrame:
    stats = analytics.price_stats(roles.items(t), "price", "item", ["brand"])
    return stats.withColumn("avg_price", F.round("avg_price", 4))


@query(f"""
WITH {roles.ITEMS}
SELECT round(avg(price), 4) AS avg_price, min(price) AS min_price, max(price) AS max_price, count(DISTINCT item) AS total_cars
FROM items WHERE price > 0 AND brand = 'Brand#7' AND (title ILIKE '%ring%' OR model ILIKE '%ring%')""")
def market_stats(t: Tables) -> DataFrame:
    stats = analytics.market_stats(roles.items(t), "price", "item", ("brand", "Brand#7"), (["title", "model"], "ring"))
    return stats.withColumn("avg_price", F.round("avg_price", 4))


@query(f"""
WITH {roles.ITEMS},
g AS (SELECT brand, title, count(*) AS total_listings, max(rating) AS rating, max(mileage) AS recommend, avg(price) AS a FROM items GROUP BY brand, title),
r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY total_listings DESC, rating DESC NULLS LAST, title) AS n FROM g)
SELECT brand, title, total_listings, rating, recommend, round(a, 4) AS avg_price, n AS position FROM r WHERE n <= 10""")
def brand_top_sellers(t: Tables) -> DataFrame:
    top = analytics.top_sellers(roles.items(t), "title", "rating", "mileage", ["brand"], 10, price="price")
    return top.withColumns({"avg_price": F.round("avg_price", 4), "position": F.col("position").cast("bigint")})


@query(f"""
WITH {roles.ITEMS},
g AS (SELECT brand, title, max(rating) AS rating, max(mileage) AS recommend FROM items WHERE rating IS NOT NULL GROUP BY brand, title),
r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY rating DESC NULLS LAST, recommend DESC NULLS LAST, title) AS n FROM g)
SELECT brand, title, rating, recommend, n AS position FROM r WHERE n <= 10""")
def brand_top_rated(t: Tables) -> DataFrame:
    top = analytics.top_rated(roles.items(t), "title", "rating", "mileage", ["brand"], 10)
    return top.withColumn("position", F.col("position").cast("bigint"))


@query(f"""WITH {roles.ITEMS} SELECT brand, fuel, count(*) AS total FROM items WHERE fuel IS NOT NULL GROUP BY brand, fuel""")
def brand_fuel_mix(t: Tables) -> DataFrame:
    return analytics.value_mix(roles.items(t), "fuel", ["brand"])


@query(f"""WITH {roles.ITEMS} SELECT brand, count(*) AS total FROM items WHERE brand IS NOT NULL GROUP BY brand ORDER BY total DESC, brand LIMIT 10""")
def top_brands(t: Tables) -> DataFrame:
    return analytics.value_mix(roles.items(t), "brand", limit=10)


@query(f"""
WITH {roles.ITEMS}
SELECT title, brand, count(*) AS total_listings, round(avg(price), 4) AS avg_price, max(rating) AS rating FROM items WHERE title IS NOT NULL
GROUP BY title, brand ORDER BY total_listings DESC, title, brand LIMIT 15""")
def top_models(t: Tables) -> DataFrame:
    aggs = [F.count("*").alias("total_listings"), F.round(F.avg("price"), 4).alias("avg_price"), F.max("rating").alias("rating")]
    order = [F.col("total_listings").desc(), F.col("title"), F.col("brand")]
    return analytics.top_groups(roles.items(t).filter(F.col("title").isNotNull()), ["title", "brand"], aggs, order, 15)


@query("""
WITH p AS (SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem),
g AS (SELECT p_brand AS brand, l_returnflag, l_linestatus, count(*) AS total FROM p JOIN part ON p_partkey = l_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY total DESC, l_returnflag, l_linestatus) AS n FROM g)
SELECT brand, l_returnflag, l_linestatus, total, n AS position FROM r WHERE n <= 3""")
def brand_top_features(t: Tables) -> DataFrame:
    items = t.part.select("p_partkey", F.col("p_brand").alias("brand"))
    top = analytics.top_features(t.lineitem, "l_partkey", ["l_returnflag", "l_linestatus"], 3, items, "p_partkey", ["brand"])
    return top.withColumn("position", F.col("position").cast("bigint"))


@query(f"""
WITH {roles.ITEMS} SELECT item, title, price FROM items WHERE brand = 'Brand#3' AND model ILIKE '%promo%' ORDER BY price ASC NULLS LAST, item LIMIT 10""")
def cheapest_of_model(t: Tables) -> DataFrame:
    return analytics.cheapest(roles.items(t), ("brand", "Brand#3"), ("model", "promo"), "price", "item", 10).select("item", "title", "price")


# ---- data quality --------------------------------------------------------------------


@query("""
WITH c AS (
  SELECT 'not_null' AS "check", 'o_orderkey' AS "column", 'error' AS severity, count(*) FILTER (o_orderkey IS NULL) AS failures FROM orders
  UNION ALL SELECT 'not_null', 'rare', 'warn', count(*) FILTER (nullif(o_orderstatus, 'P') IS NULL) FROM orders
  UNION ALL SELECT 'unique', 'o_orderkey', 'error', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'unique', 'l_orderkey', 'error', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'accepted_values', 'o_orderstatus', 'warn', count(DISTINCT o_orderstatus) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders
  UNION ALL SELECT 'relationships', 'o_custkey', 'error', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'relationships', 'l_quantity', 'warn', count(*) FROM lineitem WHERE l_quantity NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 20)
  UNION ALL SELECT 'late_lines', 'l_shipdate', 'warn', count(*) FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-01-01')
SELECT *, CASE WHEN failures = 0 THEN 'pass' WHEN severity = 'warn' THEN 'warn' ELSE 'fail' END AS status FROM c
UNION ALL SELECT 'freshness', 'ts', 'error', greatest(0, d - 8), CASE WHEN d > 16 THEN 'fail' WHEN d > 8 THEN 'warn' ELSE 'pass' END
FROM (SELECT CAST(floor(date_diff('microsecond', max(ts), TIMESTAMP '2024-02-10') / 86400000000.0) AS BIGINT) AS d FROM events)""")
def quality_report(t: Tables) -> DataFrame:
    orders = t.orders.withColumn("rare", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return quality.union_reports([
        quality.check_not_null(orders, {"o_orderkey": quality.ERROR, "rare": quality.WARN}),
        quality.check_unique(t.orders, "o_orderkey"),
        quality.check_unique(t.lineitem, "l_orderkey"),
        quality.check_accepted_values(t.orders, "o_orderstatus", ["F", "O"]),
        quality.check_relationship(t.orders, "o_custkey", t.customer, "c_custkey"),
        quality.check_relationship(t.lineitem, "l_quantity", t.supplier.filter("s_suppkey < 20"), "s_suppkey", quality.WARN),
        quality.check_no_rows(
            t.lineitem.filter(F.col("l_shipdate") > F.lit("2001-01-01").cast("timestamp_ntz")), "late_lines", "l_shipdate", quality.WARN
        ),
        quality.check_freshness(t.events, "ts", F.lit("2024-02-10").cast("timestamp_ntz")),
    ])


@query("""
WITH n AS (SELECT count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (month(o_orderdate) = 2) AS february FROM orders),
r AS (SELECT * FROM (VALUES ('schema', 'o_orderkey', 0), ('schema', 'o_custkey', 1), ('schema', 'o_orderdate', 0), ('schema', 'o_comment', 1)) v("check", "column", failures)
UNION ALL SELECT 'schema', 'priority', urgent FROM n UNION ALL SELECT 'partitioning', 'o_month', february FROM n)
SELECT "check", "column", 'error' AS severity, CAST(failures AS BIGINT) AS failures, CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status FROM r""")
def schema_report(t: Tables) -> DataFrame:
    """A type, a column and a value that are missing, and rows in a wrong partition, on purpose."""
    from pyspark.sql.types import StructType

    expected = StructType.fromDDL("o_orderkey bigint not null, o_custkey int, o_orderdate timestamp_ntz not null, o_comment string, priority string not null")
    month = F.date_format("o_orderdate", "yyyy-MM")
    orders = t.orders.withColumns({
        "priority": F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")),
        "o_month": F.when(F.month("o_orderdate") == 2, "elsewhere").otherwise(month),
    })
    return quality.union_reports([quality.check_schema(orders, expected), quality.check_partitions(orders, "o_month", month)])
