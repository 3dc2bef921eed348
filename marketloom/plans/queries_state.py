"""Session state, user state and streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sessions
from ..session import checkpoint_dir
from ..streaming import jobs, timelines
from . import roles
from .queries_load import _CURRENT_SQL, _CUT, _FILES_SQL, _LINES, _VERSION, _files
from .registry import Tables, query

_SLOTS = ["budget_max", "body_type", "fuel_type"]


def _updates(t: Tables) -> DataFrame:
    """Slot updates of a dialogue: text length, role and first word stand for slot values."""
    return t.conversations.select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", F.length("text").cast("double")).alias("budget_max"),
        F.when(F.col("role") != "user", F.col("role")).alias("body_type"),
        F.when(F.col("role") == "system", F.left("text", F.lit(3))).alias("fuel_type"),
        F.split("text", r"\s+").alias("words"),
    )


_SLOT_SQL = """u AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN CAST(length(text) AS DOUBLE) END AS budget_max, CASE WHEN role <> 'user' THEN role END AS body_type,
  CASE WHEN role = 'system' THEN left(text, 3) END AS fuel_type, text FROM conversations),
slots AS (SELECT conv_id, arg_max(budget_max, turn) FILTER (budget_max IS NOT NULL) AS budget_max, arg_max(body_type, turn) FILTER (body_type IS NOT NULL) AS body_type,
  arg_max(fuel_type, turn) FILTER (fuel_type IS NOT NULL) AS fuel_type FROM u GROUP BY 1)"""


@query(rf"""
WITH {_SLOT_SQL},
w AS (SELECT conv_id, turn, unnest(string_split_regex(text, '\s+')) AS v, generate_subscripts(string_split_regex(text, '\s+'), 1) AS pos FROM u),
f AS (SELECT conv_id, v, min((turn, pos)) AS seen FROM w WHERE v <> '' GROUP BY 1, 2),
l AS (SELECT conv_id, string_agg(v, ' ' ORDER BY seen) AS words FROM f GROUP BY 1)
SELECT conv_id, budget_max, body_type, fuel_type, coalesce(words, '') AS words FROM slots LEFT JOIN l USING (conv_id)""")
def session_profiles(t: Tables) -> DataFrame:
    profile = sessions.fold_profile(_updates(t), "conv_id", "turn", _SLOTS, ["words"])
    return profile.select("conv_id", *_SLOTS, F.array_join("words", " ").alias("words"))


@query(f"""
WITH {_SLOT_SQL},
m AS (SELECT *, concat_ws(',', CASE WHEN budget_max IS NULL THEN 'budget_max' END, CASE WHEN body_type IS NULL THEN 'body_type' END, CASE WHEN fuel_type IS NULL THEN 'fuel_type' END) AS missing FROM slots)
SELECT conv_id, missing, CASE conv_id % 5 WHEN 0 THEN 'compare_retrieve' WHEN 1 THEN CASE WHEN missing = '' THEN 'hybrid_retrieve' ELSE 'ask_slot' END
  WHEN 2 THEN 'hybrid_retrieve' WHEN 3 THEN 'redirect_topic' ELSE 'consult' END AS branch FROM m""")
def routed_intents(t: Tables) -> DataFrame:
    slots = sessions.fold_slots(_updates(t), "conv_id", "turn", _SLOTS).withColumn("missing", sessions.missing_slots())
    intents = F.array(*[F.lit(x) for x in ("compare", "vague", "specific", "off_topic", "chat")])
    intent = F.get(intents, (F.col("conv_id") % 5).cast("int"))
    return slots.select(
        "conv_id", F.array_join("missing", ",").alias("missing"), sessions.route_intent(intent, F.col("missing")).alias("branch")
    )


@query("""
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS n FROM conversations) WHERE n <= 3""")
def recent_messages(t: Tables) -> DataFrame:
    return sessions.recent_messages(t.conversations, "conv_id", ["turn", "role"], 3).select("conv_id", "turn", "role")


_FAVORITES = f"""{roles.INTERACTIONS},
fav AS (SELECT "user", item, kind, ts FROM ev WHERE kind IN ('click', 'error') QUALIFY row_number() OVER (PARTITION BY "user", item ORDER BY ts DESC, event_id DESC) = 1)"""


@query(f"""
WITH {_FAVORITES} SELECT "user" AS user_id, item AS item_id, 'favorite' AS interaction_type, 2.0::DOUBLE AS interaction_score, ts AS created_at FROM fav WHERE kind = 'click'""")
def current_favorites(t: Tables) -> DataFrame:
    actions = roles.interactions(t).filter(F.col("kind").isin("click", "error"))
    order = [F.col("ts").desc_nulls_last(), F.col("event_id").desc()]
    kept = sessions.current_favorites(actions, "user", "item", "kind", order, added="click")
    return sessions.favorite_events(kept, "user", "item", "ts")


@query(f"""
WITH {_FAVORITES} SELECT DISTINCT "user", item FROM ev WHERE kind = 'click' AND item IN (SELECT p_partkey FROM part)""")
def distinct_favorites(t: Tables) -> DataFrame:
    clicks = roles.interactions(t).filter(F.col("kind") == "click")
    return sessions.distinct_favorites(clicks, "user", "item", t.part, "p_partkey")


_EVENT_SQL = r"""
SELECT user_id, CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS BIGINT) AS item_id, event_type AS interaction_type,
  coalesce(CASE WHEN value > 5 THEN value END, 1.0)::DOUBLE AS interaction_score, ts AS created_at FROM events"""


def _event_columns() -> dict:
    return {
        "user_id": F.col("user_id"), "item_id": F.get_json_object("props", "$.k").cast("bigint"),
        "interaction_type": F.col("event_type"), "created_at": F.col("ts"),
    }


@query(_EVENT_SQL)
def normalized_events(t: Tables) -> DataFrame:
    return sessions.normalize_events(t.events, _event_columns(), F.when(F.col("value") > 5, F.col("value")))


# ---- streams: each drains the table's file and is compared with the batch result -----


def _folders(t: Tables, name: str) -> tuple[str, str]:
    base = f"{checkpoint_dir(t.spark)}/marketloom-{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/progress"


def _stream(t: Tables, name: str) -> DataFrame:
    return jobs.parquet_stream(t.spark, t.folder, getattr(t, name).schema, only=f"{name}.parquet")


@query(_EVENT_SQL)
def streamed_events(t: Tables) -> DataFrame:
    out, progress = _folders(t, "events")
    jobs.track_events(_stream(t, "events"), _event_columns(), F.when(F.col("value") > 5, F.col("value")), out, progress)
    return t.spark.read.parquet(out)


@query("""
WITH d AS (SELECT date_trunc('day', ts) - to_days(CAST(o AS INTEGER)) AS s, event_type, value FROM events, range(0, 7) r(o))
SELECT CAST(s AS DATE) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS score FROM d GROUP BY 1, 2""")
def streamed_windows(t: Tables) -> DataFrame:
    out, progress = _folders(t, "windows")
    aggs = [F.count("*").alias("n"), F.sum("value").alias("total")]
    jobs.rolling_counts(_stream(t, "events"), "ts", ["event_type"], aggs, out, progress)
    rows = jobs.read_windows(t.spark, out, ["event_type"])
    return rows.select(F.col("window_start").cast("date").alias("window_start"), "event_type", "n", F.round("total", 2).alias("score"))


def _two_arrivals(t: Tables, base: str, early_first: bool):
    """Lines before and after a date, written one after the other; yields once each has arrived."""
    cut = F.lit(_CUT).cast("timestamp_ntz")
    parts = [t.lineitem.filter(F.col("l_shipdate") < cut), t.lineitem.filter(F.col("l_shipdate") >= cut)]
    for part in parts if early_first else parts[::-1]:
        part.select(*_LINES).write.mode("append").parquet(base)
        yield jobs.parquet_stream(t.spark, base, part.select(*_LINES).schema)


@query(_CURRENT_SQL.format(where="TRUE"))
def streamed_latest(t: Tables) -> DataFrame:
    """Two drains of one stream, the later lines first."""
    out, progress = _folders(t, "latest")
    for stream in _two_arrivals(t, f"{out}-in", early_first=False):
        jobs.keep_current(stream, ["l_partkey"], _VERSION, out, progress)
    return jobs.read_current(t.spark, out)


_HISTORY = """
WITH p AS (SELECT l_partkey, l_returnflag, l_quantity, l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
  lag(l_quantity) OVER w AS q, lag(l_returnflag) OVER w AS f, row_number() OVER w AS n FROM lineitem
  WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice))
SELECT * EXCLUDE (q, f, n) FROM p WHERE n = 1 OR l_quantity IS DISTINCT FROM q OR l_returnflag IS DISTINCT FROM f"""


@query(_HISTORY)
def streamed_changes(t: Tables) -> DataFrame:
    """Two drains of one stream, whose log is that of the whole history."""
    out, progress = _folders(t, "changes")
    for stream in _two_arrivals(t, f"{out}-in", early_first=True):
        jobs.log_changes(stream, "l_partkey", ["l_quantity", "l_returnflag"], _VERSION, out, progress)
    return jobs.read_log(t.spark, out).drop("batch")


@query(_HISTORY)
def streamed_timelines(t: Tables) -> DataFrame:
    """Five arrivals of lines dealt by hash, so that most come late; the log is that of the whole history."""
    out, progress = _folders(t, "timelines")
    lines = t.lineitem.select(*_LINES)
    for n in range(5):
        lines.filter(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(5)) == n).write.mode("append").parquet(f"{out}-in")
        timelines.log_timelines(jobs.parquet_stream(t.spark, f"{out}-in", lines.schema), "l_partkey", ["l_quantity", "l_returnflag"], _VERSION, out, progress)
    return timelines.read_timelines(t.spark, out)


@query(f"""
WITH {_FILES_SQL} SELECT DISTINCT sha256(content) AS file_hash, vin, slug AS car_model_slug FROM files WHERE n % 7 >= 2""")
def streamed_landing(t: Tables) -> DataFrame:
    """Two arrivals of files, the second with contents of the first among its own."""
    out, progress = _folders(t, "landing")
    files = _files(t)
    for n in range(2):
        files.filter(F.pmod(F.xxhash64("path"), F.lit(2)) == n).write.mode("append").parquet(f"{out}-in")
        jobs.land_files(jobs.parquet_stream(t.spark, f"{out}-in", files.schema), out, progress, "stream")
    return t.spark.read.parquet(out).select("file_hash", "vin", "car_model_slug")
