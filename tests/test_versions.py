"""Tables that are changed bucket by bucket."""

import pytest
from pyspark.sql import functions as F

from marketloom.operators import changes
from marketloom.plans import weekly
from marketloom.sources.versions import VersionConflict, VersionedTable

SCHEMA = "k long, v int, seen int"


def frame(spark, keys, v, seen=0):
    return spark.createDataFrame([(k, v, seen) for k in keys], SCHEMA)


def state(table, version=None):
    return {r.k: (r.v, r.seen) for r in table.read(version).collect()}


@pytest.fixture()
def table(spark, tmp_path):
    made = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=16)
    assert made.read() is None
    made.refresh(frame(spark, range(400), 1, 1))
    return made


def test_a_change_writes_the_buckets_it_touches(spark, table):
    few = [r.k for r in table.read(buckets=[3]).limit(4).collect()]
    table.merge(frame(spark, few, 2, 2), keep=["seen"])
    before, after = table.manifest(1)["folders"], table.manifest()["folders"]
    assert {b for b in after if after[b] != before[b]} == {"3"} and len(after) == 16
    assert state(table) == {k: ((2, 1) if k in few else (1, 1)) for k in range(400)}
    table.replace(frame(spark, [*few[:1], 1000], 3, 3))
    assert state(table) == {**{k: ((2, 1) if k in few else (1, 1)) for k in range(400)}, few[0]: (3, 3), 1000: (3, 3)}
    # Old versions stay until they are forgotten.
    assert state(table, 1) == {k: (1, 1) for k in range(400)}
    assert not [p for p in table.read(buckets=[3]).inputFiles() if "_bucket=3/" not in p]
    table.forget(versions=1)
    assert table.versions() == [3] and len(state(table)) == 401


def test_a_run_that_dies_leaves_the_old_version(spark, table):
    broken = frame(spark, range(50), 9).withColumn("v", F.when(F.col("k") < 40, 9).otherwise(F.raise_error(F.lit("lost")).cast("int")))
    with pytest.raises(Exception, match="lost"):
        table.refresh(broken)
    assert table.versions() == [1] and state(table) == {k: (1, 1) for k in range(400)}


def test_one_of_two_runs_fails(spark, table):
    other = VersionedTable(spark, table.path, ["k"])
    assert other.buckets == 16
    with pytest.raises(VersionConflict):
        table.change(frame(spark, [1], 2), lambda old, new: other.replace(frame(spark, [2], 5)) or old)
    assert state(table)[2] == (5, 0) and state(table)[1] == (1, 1)


def test_columns_that_come_later_and_empty_changes(spark, table):
    table.replace(frame(spark, [], 0))
    assert table.versions() == [1]
    table.refresh(table.read().filter("k < 3").withColumn("more", F.lit("x")))
    table.replace(frame(spark, [7], 7).withColumn("more", F.lit(None).cast("string")))
    assert {(r.k, r.more) for r in table.read().collect()} == {(0, "x"), (1, "x"), (2, "x"), (7, None)}


def test_the_log_is_not_read(spark, tmp_path, monkeypatch):
    house = weekly.Warehouse(str(tmp_path / "w"))
    schema = "vin string, price double, mileage int, status string, crawl_date date"
    at = lambda d: F.lit(f"2024-03-{d:02} 00:00:00").cast("timestamp")
    days = {1: [("a", 1.0), ("b", 1.0)], 2: [("a", 1.0), ("b", 2.0)], 3: [("a", 3.0), ("b", 2.0), ("c", None)]}
    read = []
    original = changes.change_log_increment
    monkeypatch.setattr(changes, "change_log_increment", lambda state, known, *a: read.extend(known.inputFiles()) or original(state, known, *a))
    for day, prices in [*days.items(), (3, days[3])]:  # the last run is repeated
        rows = spark.createDataFrame([(v, p, 5, "Used") for v, p in prices], "vin string, price double, mileage int, status string").withColumn("crawl_date", at(day).cast("date"))
        monkeypatch.setattr(weekly.marketplace, "price_state", lambda core: rows.select(*[c.split()[0] for c in schema.split(", ")]))  # noqa: B023
        weekly.append_changes(spark, house, None, f"r{day}", at(day))
    log = {(r.vin, r.price, r.run_id) for r in spark.read.parquet(house.price_history).collect()}
    assert log == {("a", 1.0, "r1"), ("b", 1.0, "r1"), ("b", 2.0, "r2"), ("a", 3.0, "r3"), ("c", None, "r3")}
    assert read and all("/last_prices/" in p for p in read)
