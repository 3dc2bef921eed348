"""Rollups from daily counts: equal to those of the whole log, however it grew, and reading new days only."""

import datetime as dt
import random

from pyspark.sql import functions as F

from marketloom.operators import rollups
from marketloom.sources.daily import DailyEvents

SCHEMA = "item int, kind string, score double, ts timestamp_ntz"


def rows_of(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_refreshes_equal_the_whole_log(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    events = [(rng.randrange(12), rng.choice(["view", "save", "contact", "other"]), rng.choice([1.0, 2.5, None]), start + dt.timedelta(hours=rng.randrange(24 * 60))) for _ in range(900)]
    events += [(3, "view", 1.0, None), (3, None, None, None), (None, "view", 1.0, start), (5, "view", 1.0, dt.datetime(2024, 2, 1, 6)), (5, "view", 1.0, dt.datetime(2024, 2, 1, 6, 0, 1))]
    items = spark.createDataFrame([(i, f"m{i % 4}" if i != 9 else None, "b") for i in range(15)], "id int, model string, brand string")
    daily = DailyEvents(spark, str(tmp_path / "daily"), "item", "kind", "score", "ts")
    as_of = F.lit("2024-03-02 06:00:00").cast("timestamp_ntz")
    assert daily.newest_day() is None
    for end in (dt.datetime(2024, 1, 9, 5), dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 20), dt.datetime(2024, 2, 11, 13), dt.datetime(2024, 4, 1)):
        log = spark.createDataFrame([e for e in events if e[3] is None or e[3] < end], SCHEMA)
        daily.refresh(log)
        whole = rollups.popularity(items, log, "id", "item", "kind", "score", "ts", as_of)
        assert rows_of(daily.popularity(items, "id", log, as_of).select(*whole.columns)) == rows_of(whole)
        named = items.filter("model is not null")
        assert rows_of(daily.trending(items, "id", log, ["model", "brand"], as_of)) == rows_of(rollups.trending(named, log, "id", "item", "ts", ["model", "brand"], as_of))


def test_a_refresh_reads_new_days_only(spark, tmp_path):
    day = lambda d, h=1: dt.datetime(2024, 1, d, h)
    log, daily = str(tmp_path / "log"), DailyEvents(spark, str(tmp_path / "daily"), "item", "kind", "score", "ts")
    spark.createDataFrame([(1, "view", 1.0, day(d)) for d in (1, 2, 3)], SCHEMA).write.parquet(log)
    daily.refresh(spark.read.parquet(log))
    spark.createDataFrame([(1, "view", 1.0, day(3, 5)), (2, "save", 1.0, day(4)), (1, "view", 1.0, day(1, 9))], SCHEMA).write.mode("append").parquet(log)
    again = spark.read.parquet(log)
    assert daily.newest_day() == dt.date(2024, 1, 3)
    plan = daily.uncounted(again)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-03T00:00)" in plan
    daily.refresh(again)
    totals = lambda: {(r.item, r.day.day): r.total for r in daily.days().collect()}
    # The event that came late for the first day is seen when that day is named.
    assert totals() == {(1, 1): 1, (1, 2): 1, (1, 3): 2, (2, 4): 1}
    daily.refresh(again, since=dt.date.min)
    assert totals() == {(1, 1): 2, (1, 2): 1, (1, 3): 2, (2, 4): 1}
