"""Change logs of rows that come in any order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom.operators import changes
from marketloom.streaming import jobs, timelines

SCHEMA = "k string, day timestamp, seq int, v int, w string"
START = datetime(2024, 1, 1)


def rows(seed, n=120):
    rng = random.Random(seed)
    return [
        (rng.choice(["a", "a", "b", "c"]), None if rng.random() < 0.05 else START + timedelta(days=rng.randrange(12)), i, rng.choice([1, 1, 2, None]), rng.choice(["x", "y"]))
        for i in range(n)
    ]


def drain(spark, tmp_path, batches, **options):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.parquet_stream(spark, folder, spark.read.parquet(folder).schema)
        timelines.log_timelines(stream, "k", ["v", "w"], ["day", "seq"], out, str(tmp_path / "progress"), **options)
    return spark.read.parquet(folder), out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_whole_history(spark, tmp_path, seed):
    made = rows(seed)
    random.Random(seed).shuffle(made)
    whole, out = drain(spark, tmp_path, [made[i::5] for i in range(5)])
    want = changes.change_history(whole, "k", ["day", "seq"], ["v", "w"], F.col("day"))
    assert sorted(map(str, timelines.read_timelines(spark, out).collect())) == sorted(map(str, want.select(*whole.columns).collect()))
    # Something had to be withdrawn on the way.
    assert spark.read.parquet(out).filter("change < 0").count() > 0


def test_rows_that_come_twice_change_nothing(spark, tmp_path):
    row = ("a", START, 1, 1, "x")
    _, out = drain(spark, tmp_path, [[row], [row, row]])
    assert [tuple(r) for r in timelines.read_timelines(spark, out).collect()] == [row]


def test_state_is_dropped_behind_the_watermark(spark, tmp_path):
    day = lambda n: START + timedelta(days=n)
    batches = [
        [("a", day(1), 1, 1, "x"), ("a", day(2), 2, 1, "x")], [("a", day(20), 3, 2, "x")], [("a", day(21), 4, 2, "x")],
        # Day 3 is more than five days behind; day 18 is not, and makes day 20 a repetition.
        [("a", day(3), 5, 7, "x"), ("a", day(18), 6, 2, "x")],
    ]
    _, out = drain(spark, tmp_path, batches, event_time="day", lateness="5 days")
    assert sorted(r.seq for r in timelines.read_timelines(spark, out).collect()) == [1, 6]
