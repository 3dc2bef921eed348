"""Landing, keyed writes, change log and latest versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes, latest
from ..session import checkpoint_dir
from ..sources import landing, tables
from ..sources.versions import VersionedTable
from .registry import Tables, query


def _scratch(t: Tables, name: str) -> str:
    """A new folder for a table that a query writes and reads back."""
    return f"{checkpoint_dir(t.spark)}/marketloom-{name}-{uuid.uuid4().hex}"


@query(r"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'raw_data/' || page_id || '/7.json'
  WHEN page_id % 3 = 1 THEN 'store/dt=2024-02-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || '/' || page_id || '/7.json' ELSE url END AS path FROM pages)
SELECT page_id, CASE WHEN page_id % 3 < 2 THEN page_id END AS page_number,
  CASE WHEN page_id % 3 = 1 THEN CAST('2024-02-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS DATE) END AS crawl_date
FROM p""")
def path_fields(t: Tables) -> DataFrame:
    n = F.col("page_id")
    day = F.lpad((n % 28 + 1).cast("string"), 2, "0")
    path = (
        F.when(n % 3 == 0, F.concat(F.lit("raw_data/"), n.cast("string"), F.lit("/7.json")))
        .when(n % 3 == 1, F.concat(F.lit("store/dt=2024-02-"), day, F.lit("/"), n.cast("string"), F.lit("/7.json")))
        .otherwise(F.col("url"))
    )
    return t.pages.select(
        "page_id", landing.page_from_path(path).cast("bigint").alias("page_number"), landing.date_from_path(path).alias("crawl_date")
    )


def _files(t: Tables) -> DataFrame:
    """One file per event: most are listing documents, some are broken or not objects."""
    n = F.col("event_id")
    body = (
        F.when(n % 7 == 0, F.concat(F.lit("{broken"), n.cast("string")))
        .when(n % 7 == 1, F.concat(F.lit("["), n.cast("string"), F.lit("]")))
        .when(n % 7 == 2, F.concat(F.lit('{"post": "none", "k": '), F.col("user_id").cast("string"), F.lit("}")))
        .otherwise(F.format_string(
            '{"post": {"basic_desc": {"VIN": "V%s"}}, "car": {"car_model": "m-%s"}, "datetime": "2024-01-02 03:04:05"}',
            F.col("user_id").cast("string"), F.col("event_type"),
        ))
    )
    path = F.concat(F.lit("dt=2024-01-02/"), n.cast("string"), F.lit("/1.json"))
    return t.events.select(path.alias("path"), body.alias("content"))


_FILES_SQL = """files AS (
  SELECT event_id AS n, 'dt=2024-01-02/' || event_id || '/1.json' AS path, CASE event_id % 7 WHEN 0 THEN '{broken' || event_id WHEN 1 THEN '[' || event_id || ']'
    WHEN 2 THEN '{"post": "none", "k": ' || user_id || '}'
    ELSE '{"post": {"basic_desc": {"VIN": "V' || user_id || '"}}, "car": {"car_model": "m-' || event_type || '"}, "datetime": "2024-01-02 03:04:05"}' END AS content,
    CASE WHEN event_id % 7 > 2 THEN 'V' || user_id END AS vin, CASE WHEN event_id % 7 > 2 THEN 'm-' || event_type END AS slug
  FROM events)"""


@query(f"""
WITH {_FILES_SQL}
SELECT path AS file_path, sha256(content) AS file_hash, n AS page_number, DATE '2024-01-02' AS crawl_date, vin, slug AS car_model_slug
FROM files WHERE n % 7 >= 2""")
def landed_documents(t: Tables) -> DataFrame:
    rows = landing.parse_documents(_files(t))
    return rows.select(
        "file_path", "file_hash", F.col("page_number").cast("bigint").alias("page_number"), "crawl_date", "vin", "car_model_slug"
    )


@query(f"""
WITH {_FILES_SQL}
SELECT count(*) AS scanned, count(*) FILTER (n % 7 >= 2) AS parsed, count(DISTINCT content) FILTER (n % 7 >= 2) AS inserted FROM files""")
def load_counts(t: Tables) -> DataFrame:
    run = uuid.uuid4().hex
    files, scanned = landing.observed(_files(t), f"scanned-{run}")
    rows, parsed = landing.observed(landing.parse_documents(files), f"parsed-{run}")
    fresh = tables.append_if_absent(rows.drop("payload"), None, ["file_hash"], ["file_path"])
    fresh, inserted = landing.observed(fresh, f"inserted-{run}")
    path = _scratch(t, "landing")
    tables.append_partitioned(fresh, path, F.col("crawl_date"), "crawl_month")
    counts = (scanned.get["rows"], parsed.get["rows"], inserted.get["rows"])
    return t.spark.createDataFrame([counts], "scanned bigint, parsed bigint, inserted bigint")


@query("""
WITH n AS (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents)
SELECT doc_id, h AS file_hash FROM n WHERE r = 1 AND h NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')""")
def new_documents(t: Tables) -> DataFrame:
    hashed = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("file_hash"))
    old = hashed.filter(F.col("lang") == "en")
    return tables.append_if_absent(hashed, old, ["file_hash"], ["doc_id"]).select("doc_id", "file_hash")


@query(f"""
WITH {_FILES_SQL},
a AS (SELECT sha256(content) AS h, min(path) AS p FROM files WHERE n % 7 >= 2 AND n % 3 > 0 GROUP BY 1),
b AS (SELECT sha256(content) AS h, min(path) AS p FROM files WHERE n % 7 >= 2 AND sha256(content) NOT IN (SELECT h FROM a) GROUP BY 1)
SELECT h AS file_hash, p AS file_path, 'first' AS run_id FROM a UNION ALL SELECT h, p, 'second' FROM b""")
def indexed_landing(t: Tables) -> DataFrame:
    """A part of the files, then all of them: the index of landed hashes tells the second load what is new."""
    path, files = _scratch(t, "indexed"), _files(t)
    part = files.filter(F.regexp_extract("path", r"/(\d+)/", 1).cast("bigint") % 3 > 0)
    for run, some in (("first", part), ("second", files)):
        landing.land(some, path, run, "incremental", F.current_timestamp())
    return t.spark.read.parquet(path).select("file_hash", "file_path", "run_id")


# Landed snapshots: every line of a part is a sighting of it, ordered by ship date.
_VERSION = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
_LINES = ["l_partkey", "l_returnflag", "l_quantity", *_VERSION]
_CURRENT_SQL = """SELECT * EXCLUDE (r) FROM (SELECT l_partkey, l_returnflag, l_quantity, l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS r
  FROM lineitem WHERE {where}) WHERE r = 1"""


def _current(lines: DataFrame) -> DataFrame:
    return latest.latest_per_key(lines.select(*_LINES), ["l_partkey"], [F.col(c).desc_nulls_last() for c in _VERSION])


@query(_CURRENT_SQL.format(where="TRUE"))
def latest_versions(t: Tables) -> DataFrame:
    return _current(t.lineitem)


_CUT = "1998-01-01"


def _split(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Current rows of the earlier load and of the later one."""
    day = F.lit(_CUT).cast("timestamp_ntz")
    return _current(t.lineitem.filter(F.col("l_shipdate") < day)), _current(t.lineitem.filter(F.col("l_shipdate") >= day))


_OLD_SQL = _CURRENT_SQL.format(where=f"l_shipdate < TIMESTAMP '{_CUT}'")
_NEW_SQL = _CURRENT_SQL.format(where=f"l_shipdate >= TIMESTAMP '{_CUT}'")


@query(f"""
WITH o AS ({_OLD_SQL}), n AS ({_NEW_SQL})
SELECT * FROM n UNION ALL SELECT * FROM o WHERE l_partkey NOT IN (SELECT l_partkey FROM n)""")
def replaced_rows(t: Tables) -> DataFrame:
    old, new = _split(t)
    return tables.replace_by_key(old, new, ["l_partkey"])


@query(f"""
WITH o AS ({_OLD_SQL}), n AS ({_NEW_SQL})
SELECT coalesce(n.l_partkey, o.l_partkey) AS l_partkey, CASE WHEN n.l_partkey IS NULL THEN o.l_quantity ELSE n.l_quantity END AS l_quantity,
  CAST(CASE WHEN o.l_partkey IS NULL THEN n.l_shipdate ELSE o.l_shipdate END AS DATE) AS first_seen
FROM o FULL JOIN n ON o.l_partkey = n.l_partkey""")
def merged_rows(t: Tables) -> DataFrame:
    old, new = (
        df.select("l_partkey", "l_quantity", F.col("l_shipdate").cast("date").alias("first_seen")) for df in _split(t)
    )
    return tables.merge_by_key(old, new, ["l_partkey"], keep=["first_seen"])


@query(f"""
WITH o AS ({_OLD_SQL}), n AS ({_NEW_SQL}), late AS (SELECT * FROM n WHERE l_partkey % 50 = 7),
r AS (SELECT * FROM late UNION ALL SELECT * FROM o WHERE l_partkey NOT IN (SELECT l_partkey FROM late))
SELECT coalesce(n.l_partkey, r.l_partkey) AS l_partkey, CASE WHEN n.l_partkey IS NULL THEN r.l_quantity ELSE n.l_quantity END AS l_quantity,
  CAST(CASE WHEN r.l_partkey IS NULL THEN n.l_shipdate ELSE r.l_shipdate END AS DATE) AS first_seen
FROM r FULL JOIN n ON r.l_partkey = n.l_partkey""")
def versioned_rows(t: Tables) -> DataFrame:
    """A table that is written whole, then has a few keys replaced, then all new ones merged; three versions."""
    old, new = (df.select("l_partkey", "l_quantity", F.col("l_shipdate").cast("date").alias("first_seen")) for df in _split(t))
    table = VersionedTable(t.spark, _scratch(t, "versions"), ["l_partkey"])
    table.refresh(old)
    table.replace(new.filter(F.col("l_partkey") % 50 == 7))
    table.merge(new, keep=["first_seen"])
    return table.read()


@query("""
SELECT event_id, ts > (SELECT max(ts) FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-20') AS past_mark
FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-20')""")
def rows_past_watermark(t: Tables) -> DataFrame:
    seen = t.events.filter((F.col("event_type") == "view") & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    inclusive = tables.newer_than_table(t.events, seen, "ts", inclusive=True).select("event_id")
    strict = tables.newer_than_table(t.events, seen, "ts").select("event_id", F.lit(True).alias("past_mark"))
    joined = inclusive.join(strict, "event_id", "left")
    return joined.select("event_id", F.coalesce("past_mark", F.lit(False)).alias("past_mark"))


_TRACKED = ["l_quantity", "l_returnflag"]


@query(f"""
WITH o AS ({_OLD_SQL}), n AS ({_NEW_SQL})
SELECT n.l_partkey, n.l_quantity, n.l_returnflag, CAST(n.l_shipdate AS DATE) AS crawl_date FROM n LEFT JOIN o USING (l_partkey)
WHERE o.l_partkey IS NULL OR n.l_quantity IS DISTINCT FROM o.l_quantity OR n.l_returnflag IS DISTINCT FROM o.l_returnflag""")
def change_log_rows(t: Tables) -> DataFrame:
    # The log is the earlier history, the state is the current row of the later load.
    log = t.lineitem.filter(F.col("l_shipdate") < F.lit(_CUT).cast("timestamp_ntz")).select(*_LINES)
    _, state = _split(t)
    grown = changes.change_log_increment(state, log, "l_partkey", _TRACKED, version=_VERSION)
    return grown.select("l_partkey", *_TRACKED, F.col("l_shipdate").cast("date").alias("crawl_date"))


@query("""
WITH p AS (SELECT l_partkey, l_quantity, l_returnflag, l_shipdate, l_orderkey, l_linenumber,
  lag(l_quantity) OVER w AS q, lag(l_returnflag) OVER w AS f, row_number() OVER w AS n FROM lineitem
  WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice))
SELECT l_partkey, l_quantity, l_returnflag, CAST(l_shipdate AS DATE) AS crawl_date, l_orderkey, l_linenumber FROM p
WHERE n = 1 OR l_quantity IS DISTINCT FROM q OR l_returnflag IS DISTINCT FROM f""")
def change_history(t: Tables) -> DataFrame:
    month = F.date_trunc("month", "l_shipdate")
    rows = changes.change_history(t.lineitem.select(*_LINES), "l_partkey", _VERSION, _TRACKED, month)
    return rows.select("l_partkey", *_TRACKED, F.col("l_shipdate").cast("date").alias("crawl_date"), "l_orderkey", "l_linenumber")


@query("""
SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, CAST(round(sum(l_quantity)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1""")
def monthly_partitions(t: Tables) -> DataFrame:
    path = _scratch(t, "months")
    rows = t.lineitem.select("l_partkey", "l_quantity", "l_shipdate")
    tables.append_partitioned(rows, path, F.col("l_shipdate"))
    back = t.spark.read.schema("l_quantity double, month string").parquet(path)
    return back.groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity")).cast("bigint").alias("quantity"))


@query("""SELECT CAST(ts AS DATE) AS dt, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1""")
def dated_json_layout(t: Tables) -> DataFrame:
    path = _scratch(t, "dated")
    tables.write_dated_json(t.events.select("event_id", "ts", "event_type"), path, F.col("ts"))
    back = t.spark.read.schema("event_id bigint, dt date").json(path)
    return back.groupBy("dt").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


@query("""
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS id, l_orderkey, l_linenumber, l_partkey
FROM lineitem""")
def dense_ids(t: Tables) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    return latest.global_ids(t.lineitem.select(*order), order).select("id", "l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT arg_min(doc_id, doc_id) AS doc_id, md5(lang || text) AS review_sk FROM documents GROUP BY 2""")
def deduped_reviews(t: Tables) -> DataFrame:
    hashed = t.documents.select(F.md5(F.concat("lang", "text")).alias("review_sk"), "doc_id")
    return latest.dedupe(hashed, ["review_sk"]).select("doc_id", "review_sk")


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, event_id, CAST(n AS BIGINT) AS position FROM r WHERE n <= 50""")
def recent_seeds(t: Tables) -> DataFrame:
    order = [F.col("ts").desc_nulls_last(), F.col("event_id").desc()]
    top = latest.top_n_per_key(t.events, ["user_id"], order, 50, rank="position")
    return top.select("user_id", "event_id", F.col("position").cast("bigint").alias("position"))
