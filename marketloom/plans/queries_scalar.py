"""Scalar functions over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning, constraints, keys, patterns, scoring, text, urls
from . import roles
from .registry import Tables, query

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "marketloom.example")


@query(r"""
SELECT l_orderkey, l_linenumber,
  TRY_CAST(NULLIF(regexp_replace('$' || CAST(l_extendedprice AS VARCHAR) || ' USD', '[^0-9.\-]', '', 'g'), '') AS DOUBLE) AS price,
  TRY_CAST(NULLIF(regexp_replace(CAST(l_quantity AS VARCHAR) || ' mi.', '[^0-9\-]', '', 'g'), '') AS INTEGER) AS miles,
  TRY_CAST(NULLIF(regexp_replace('1.' || l_returnflag || '.2.3', '[^0-9.\-]', '', 'g'), '') AS DOUBLE) AS garbage,
  TRY_CAST(NULLIF(regexp_replace(l_returnflag, '[^0-9.\-]', '', 'g'), '') AS DOUBLE) AS nothing
FROM lineitem""")
def clean_numbers(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        cleaning.safe_numeric(F.concat(F.lit("$"), F.col("l_extendedprice").cast("string"), F.lit(" USD"))).alias("price"),
        cleaning.safe_integer(F.concat(F.col("l_quantity").cast("string"), F.lit(" mi."))).alias("miles"),
        cleaning.safe_numeric(F.concat(F.lit("1."), "l_returnflag", F.lit(".2.3"))).alias("garbage"),
        cleaning.safe_numeric(F.col("l_returnflag")).alias("nothing"),
    )


@query("""
SELECT o_orderkey,
  CASE WHEN nullif(o_orderpriority, '5-LOW') IS NULL THEN NULL
       WHEN contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high') THEN TRUE
       ELSE FALSE END AS flagged
FROM orders""")
def history_flags(t: Tables) -> DataFrame:
    priority = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return t.orders.select("o_orderkey", cleaning.history_to_bool(priority, ["urgent", "high"]).alias("flagged"))


@query(r"""
WITH d AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '13/45/2020' WHEN 'P' THEN 'May 7'
  ELSE strftime(o_orderdate, '%-m/%-d/%Y') END AS x FROM orders)
SELECT o_orderkey, CASE WHEN regexp_full_match(x, '\d{1,2}/\d{1,2}/\d{4}') THEN CAST(try_strptime(x, '%m/%d/%Y') AS DATE) END AS review_date
FROM d""")
def review_dates(t: Tables) -> DataFrame:
    written = (
        F.when(F.col("o_orderstatus") == "F", "13/45/2020").when(F.col("o_orderstatus") == "P", "May 7")
        .otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    )
    return t.orders.select("o_orderkey", cleaning.parse_us_date(written).alias("review_date"))


@query("""
SELECT p_partkey, md5(p_brand) AS brand_sk, md5(p_brand || '||' || p_type) AS pair_sk,
       md5(nullif(p_type, 'PROMO')) AS nullable_sk
FROM part""")
def surrogate_keys(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", keys.surrogate_key(F.col("p_brand")).alias("brand_sk"),
        keys.surrogate_key(F.col("p_brand"), F.col("p_type")).alias("pair_sk"),
        keys.surrogate_key(F.nullif(F.col("p_type"), F.lit("PROMO"))).alias("nullable_sk"),
    )


@query("""
SELECT doc_id, md5(lang || source || text) AS content_sk, sha256(text) AS text_sha FROM documents""")
def content_keys(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", keys.content_key(F.col("lang"), F.col("source"), text=F.col("text")).alias("content_sk"),
        keys.file_key(F.col("text")).alias("text_sha"),
    )


@query(f"""
WITH h AS (SELECT p_partkey, sha1(unhex('{NAMESPACE.hex}') || encode(CAST(p_partkey AS VARCHAR))) AS x FROM part)
SELECT p_partkey, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' ||
  substr('89ab', (strpos('0123456789abcdef', substr(x, 17, 1)) - 1) % 4 + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS point_id
FROM h""")
def point_ids(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", keys.uuid5(NAMESPACE, F.col("p_partkey")).alias("point_id"))


@query(r"""
SELECT p_partkey,
  upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS shown,
  lower(trim('  ' || p_brand || ' ')) AS folded, left(p_name, 5) AS head,
  coalesce(nullif(p_type, 'PROMO'), 'none') AS kind,
  TRY_CAST(NULLIF(regexp_replace(p_brand, '\D', '', 'g'), '') AS BIGINT) AS digits
FROM part""")
def text_basics(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", cleaning.initcap_or_null(F.col("p_name")).alias("shown"),
        cleaning.trimmed_lower(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("folded"),
        F.left("p_name", F.lit(5)).alias("head"),
        F.coalesce(F.nullif(F.col("p_type"), F.lit("PROMO")), F.lit("none")).alias("kind"),
        cleaning.digits_to_int(F.col("p_brand")).alias("digits"),
    )


@query(r"""
WITH u AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS nf FROM pages)
SELECT page_id, nf AS no_fragment, regexp_replace(url, '\?.*$', '') AS no_query,
  list_filter(string_split(nf, '/'), lambda x: x <> '')[-1] AS last_segment,
  regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/cars?id=1' AS rooted,
  regexp_replace(regexp_replace(nf, '\?.*$', ''), '[^/]*$', '') || 'next' AS sibling
FROM u""")
def url_parts(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select(
        "page_id", urls.strip_fragment(url).alias("no_fragment"), urls.strip_query(url).alias("no_query"),
        urls.last_path_segment(url).alias("last_segment"),
        urls.absolutize(F.lit("/cars?id=1"), url).alias("rooted"), urls.absolutize(F.lit("next"), url).alias("sibling"),
    )


@query(r"""
WITH s AS (SELECT p_partkey, replace(p_name, ' ', '-') || CASE WHEN p_size % 3 = 0 THEN '' ELSE '-' || (1970 + p_size) END AS slug,
           p_name, p_size FROM part),
w AS (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM s)
SELECT p_partkey, slug, upper(left(a, 1)) || substr(a, 2) AS brand,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE 1970 + p_size END AS model_year,
  CASE WHEN p_size % 3 = 0 THEN '' ELSE (1970 + p_size) || ' ' END || upper(left(a, 1)) || substr(a, 2) || ' ' || upper(left(b, 1)) || substr(b, 2) AS name
FROM w""")
def model_slugs(t: Tables) -> DataFrame:
    year = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("-"), (F.col("p_size") + 1970).cast("string"))).otherwise("")
    slug = F.concat(urls.slug_of(F.col("p_name")), year)
    return t.part.select("p_partkey", slug.alias("slug")).select(
        "p_partkey", "slug", urls.slug_brand(F.col("slug")).alias("brand"), urls.slug_year(F.col("slug")).alias("model_year"),
        urls.slug_name(F.col("slug")).alias("name"),
    )


@query(r"""
WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n, o_orderpriority FROM orders)
SELECT o_orderkey, n AS reviews, CAST(n % 100 AS DOUBLE) + 0.5 AS recommend, n AS grouped,
  CAST(NULL AS BIGINT) AS missing
FROM s""")
def text_numbers(t: Tables) -> DataFrame:
    n = F.floor("o_totalprice")
    shown = F.format_number(n, 0)
    return t.orders.select(
        "o_orderkey",
        patterns.review_count(F.concat(F.lit("Based on "), shown, F.lit(" reviews"))).alias("reviews"),
        patterns.percentage(F.concat((n % 100).cast("string"), F.lit(".5% of drivers recommend"))).alias("recommend"),
        patterns.first_grouped_int(F.concat(F.lit("("), shown, F.lit(" reviews)"))).alias("grouped"),
        patterns.review_count(F.col("o_orderpriority")).alias("missing"),
    )


@query("""
SELECT c_custkey, c_name AS name,
  CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'May 2023' END AS place
FROM customer""")
def bylines(t: Tables) -> DataFrame:
    n = F.col("c_custkey") % 3
    line = F.concat(
        F.lit("By "), "c_name",
        F.when(n == 0, F.concat(F.lit(" from "), "c_mktsegment")).when(n == 1, " on May 2023").otherwise(""),
    )
    return t.customer.select("c_custkey", patterns.byline(line).alias("b")).select("c_custkey", "b.name", "b.place")


@query("""
SELECT p_partkey, split_part(p_name, ' ', 1) AS condition, split_part(p_name, ' ', 2) AS title,
  ['Exterior Color', 'Fuel Type', 'MPG', 'Drivetrain'][p_size % 4 + 1] AS label, p_name AS value
FROM part""")
def headline_parts(t: Tables) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in ("exterior color", "Fuel type", "MPG", "drivetrain")])
    line = F.concat_ws(" ", "p_name", F.get(labels, F.col("p_size") % 4))
    head, pair = patterns.condition_and_title(F.col("p_name")), patterns.value_and_label(line)
    return t.part.select("p_partkey", head.alias("h"), pair.alias("v")).select(
        "p_partkey", "h.condition", "h.title", "v.label", "v.value"
    )


@query("""
SELECT c_custkey,
  ['Accidents or damage', 'Accidents or damage', '1-owner vehicle', '1-owner vehicle', 'Personal use only', 'Open recall', 'Open recall', 'Clean Title', NULL][c_custkey % 9 + 1] AS label,
  ['None reported', 'At least 1 reported', 'Yes', 'No', 'Yes', 'None reported', 'At least 1 reported', 'Yes', NULL][c_custkey % 9 + 1] AS value
FROM customer""")
def history_classes(t: Tables) -> DataFrame:
    phrases = (
        "No accidents reported", "Damage reported", "1 owner", "2 owners", "Personal use only", "There is no open recall",
        "Open recall found", "Clean title", "Something else",
    )
    phrase = F.get(F.array(*[F.lit(p) for p in phrases]), (F.col("c_custkey") % 9).cast("int"))
    return t.customer.select("c_custkey", patterns.history_class(phrase).alias("h")).select("c_custkey", "h.label", "h.value")


@query(r"""
SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS squeezed, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS shown
FROM documents""")
def squeezed_text(t: Tables) -> DataFrame:
    shown = F.when(F.col("lang") == "en", " – ").otherwise(F.concat(F.lit(" "), "lang", F.lit("  ")))
    return t.documents.select(
        "doc_id", cleaning.squeeze(F.col("text")).alias("squeezed"), cleaning.dash_to_null(shown).alias("shown")
    )


@query("""
SELECT o_orderkey, '$' || format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) AS price_text,
  format('{:,}', o_custkey) || ' mi.' AS mileage_text
FROM orders""")
def display_numbers(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", scoring.price_text(F.col("o_totalprice")).alias("price_text"),
        scoring.mileage_text(F.col("o_custkey")).alias("mileage_text"),
    )


@query(f"""
SELECT event_id, round({roles.decay()}, 6) AS decay, round({roles.decay(lam=0.023)}, 6) AS fresh,
  round(coalesce({roles.decay("CASE WHEN event_type = 'error' THEN NULL ELSE ts END")}, 1.0), 6) AS decay_or_one
FROM events""")
def time_decays(t: Tables) -> DataFrame:
    known = F.when(F.col("event_type") != "error", F.col("ts"))
    return t.events.select(
        "event_id", F.round(scoring.time_decay(F.col("ts"), roles.as_of()), 6).alias("decay"),
        F.round(scoring.recency(F.col("ts"), roles.as_of()), 6).alias("fresh"),
        F.round(scoring.time_decay(known, roles.as_of()), 6).alias("decay_or_one"),
    )


@query(f"""
WITH e AS (SELECT *, {roles.WEIGHT.replace('kind', 'event_type')} AS w FROM events),
n AS (SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id)
SELECT event_id, w AS weight, round(CASE WHEN top > 0 THEN value / top ELSE 0 END, 6) AS share,
  round(least(1.0, n / 60.0::DOUBLE), 6) AS warm, round(greatest(0.0, 1 - least(1.0, abs(value - 10) / 10)), 6) AS fit
FROM e JOIN n USING (user_id)""")
def score_helpers(t: Tables) -> DataFrame:
    per_user = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    share = F.when(F.col("top") > 0, F.col("value") / F.col("top")).otherwise(0.0)
    return t.events.join(per_user, "user_id").select(
        "event_id", scoring.type_weight(F.col("event_type"), roles.WEIGHTS).alias("weight"),
        F.round(share, 6).alias("share"), F.round(scoring.warmup(F.col("n"), 60), 6).alias("warm"),
        F.round(scoring.price_fit(F.col("value"), F.lit(10.0)), 6).alias("fit"),
    )


@query("""
SELECT doc_id, CASE WHEN length(text) > 600 THEN regexp_replace(left(text, 600), ' [^ ]*$', '') ELSE text END AS shown FROM documents""")
def truncated_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.truncate_at_word(F.col("text")).alias("shown"))


@query("""
WITH m AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n, year(o_orderdate) AS y, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey,
  CASE WHEN k = 1 AND n >= 1000 THEN CAST(n AS DOUBLE) WHEN k = 2 THEN 1000.0 * (20 + n % 50) END AS price_min,
  CASE WHEN k = 0 THEN CAST(CASE WHEN n >= 1000 THEN n ELSE y END AS DOUBLE) WHEN k = 1 AND n < 1000 THEN CAST(y AS DOUBLE) END AS price_max,
  CASE k WHEN 0 THEN 'Used' WHEN 1 THEN 'New' WHEN 2 THEN 'Certified' END AS status,
  CASE k WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'Gasoline' WHEN 2 THEN 'Electric' END AS fuel_type,
  CASE WHEN k = 1 AND n BETWEEN 1900 AND 2099 THEN n WHEN k IN (0, 1) THEN y END AS year
FROM m""")
def text_constraints(t: Tables) -> DataFrame:
    n = F.floor("o_totalprice")
    year = F.year("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 4
    message = (
        F.when(k == 0, F.concat(F.lit("a used hybrid under $"), F.format_number(n, 0), F.lit(" from "), year))
        .when(k == 1, F.concat(F.lit("A NEW gas car over "), n.cast("string"), F.lit(" dollars. Made in "), year))
        .when(k == 2, F.concat(F.lit("certified EV for at least "), (n % 50 + 20).cast("string"), F.lit("k please")))
        .otherwise("three doors, no number at all")
    )
    return t.orders.select("o_orderkey", constraints.parse_constraints(message).alias("c")).select("o_orderkey", "c.*")


@query("""
SELECT l_orderkey, l_linenumber, l_linestatus,
  nullif(l_returnflag, 'N') IS DISTINCT FROM nullif(l_linestatus, 'O') AS differs,
  CASE WHEN l_tax = 0 OR l_discount = 0 OR l_tax = l_discount THEN NULL WHEN l_tax < l_discount THEN 'left' ELSE 'right' END AS lower_is_better,
  CASE WHEN l_tax = 0 OR l_discount = 0 OR l_tax = l_discount THEN NULL WHEN l_tax > l_discount THEN 'left' ELSE 'right' END AS higher_is_better
FROM lineitem""")
def pair_comparisons(t: Tables) -> DataFrame:
    a, b = F.col("l_tax"), F.col("l_discount")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_linestatus",
        scoring.changed(F.nullif(F.col("l_returnflag"), F.lit("N")), F.nullif(F.col("l_linestatus"), F.lit("O"))).alias("differs"),
        scoring.better_side(a, b, "lower").alias("lower_is_better"),
        scoring.better_side(a, b, "higher").alias("higher_is_better"),
    )


@query("""
SELECT l_suppkey, round(sum(CAST(l_extendedprice AS DECIMAL(18,2))) / count(*))::DOUBLE AS avg_price FROM lineitem GROUP BY l_suppkey""")
def rounded_means(t: Tables) -> DataFrame:
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))
    mean = scoring.round_half_up(total / F.count("*")).cast("double")
    return t.lineitem.groupBy("l_suppkey").agg(mean.alias("avg_price"))
