"""The index of landed file hashes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from marketloom.sources import landing
from marketloom.sources.landed import LandedIndex

SCHEMA = "file_hash string, ok boolean"


def digest(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def hashes(spark, keys, ok=True):
    return spark.createDataFrame([(digest(i), ok) for i in keys], SCHEMA)


def asked(index, spark, keys):
    return {r.file_hash: r.ok for r in index.known(hashes(spark, keys)).collect()}


def read_parts(found):
    return {"/".join(p.split("/")[-3:-1]) for p in found.inputFiles() if "/hashes/" in p}


def test_a_load_reads_the_buckets_of_its_hashes_only(spark, tmp_path):
    index = LandedIndex(spark, str(tmp_path / "i"))
    assert asked(index, spark, [1]) == {}
    index.add(hashes(spark, range(8000)))
    index.add(hashes(spark, range(8000, 8400), ok=False))
    found = index.known(hashes(spark, [5, 6, 8001, 99_999]))
    buckets = {int(digest(i)[:2], 16) for i in (5, 6, 8001)}
    assert {int(p.split("bucket=")[1]) for p in read_parts(found)} <= buckets and len(read_parts(found)) == 3
    assert {r.file_hash: r.ok for r in found.collect()} == {digest(5): True, digest(6): True, digest(8001): False}
    # New hashes meet filters, and next to no stored hashes.
    assert len(read_parts(index.known(hashes(spark, range(20_000, 20_100))))) <= 6


def test_every_landed_hash_is_known_and_few_others_are_looked_up(spark, tmp_path):
    index = LandedIndex(spark, str(tmp_path / "i"), digits=1)
    index.add(hashes(spark, range(5000)))
    assert len(asked(index, spark, range(-1000, 6000))) == 5000
    (run, size), = index.runs().items()
    assert 16 * 2**size * index.per_block >= 5000
    filters = spark.read.parquet(f"{index.path}/filters")
    words = filters.select(*[F.sum(F.bit_count(w)).alias(w) for w in ("w0", "w1", "w2", "w3")]).first()
    share = sum(words) / (4 * 64 * 16 * 2**size)
    assert share**4 < 0.01


def test_runs_of_a_size_are_merged(spark, tmp_path):
    index = LandedIndex(spark, str(tmp_path / "i"), digits=1, fan=2)
    for n in range(5):
        index.add(hashes(spark, range(10 * n, 10 * n + 15), ok=n % 2 == 0))
    assert len(index.runs()) <= 2
    got = asked(index, spark, range(70))
    assert set(got) == {digest(i) for i in range(55)} and got[digest(10)] and not got[digest(16)]


def test_null_and_repeated_hashes(spark, tmp_path):
    index = LandedIndex(spark, str(tmp_path / "i"), digits=1)
    index.add(spark.createDataFrame([], SCHEMA))
    assert index.runs() == {} and asked(index, spark, [1]) == {}
    index.add(spark.createDataFrame([(None, True), (digest(1), False), (digest(1), True)], SCHEMA))
    found = index.known(spark.createDataFrame([(None, True), (digest(1), True)], SCHEMA).unionByName(hashes(spark, [1])))
    assert [tuple(r) for r in found.collect()] == [(digest(1), True)]


def files(spark, *numbers):
    bodies = {1: '{"k": 1}', 2: '{"k": 2}', 3: "{broken", 4: '{"k": 1}', 5: '{"k": 5}', 6: "[1]"}
    return spark.createDataFrame([(f"dt=2024-01-02/1/{n}.json", bodies[n]) for n in numbers], "path string, content string")


def land(spark, target, run, *numbers):
    return landing.land(files(spark, *numbers), target, run, "incremental", F.lit("2024-01-03").cast("timestamp"))


def landed(spark, target):
    return sorted((r.file_path[-6:-5], r.run_id) for r in spark.read.parquet(target).collect())


@pytest.fixture()
def parsed(monkeypatch):
    """The files that each load parses."""
    seen, parse = [], landing.parse_documents
    monkeypatch.setattr(landing, "parse_documents", lambda df, *a: (seen.append(sorted(r.path[-6:-5] for r in df.select("path").collect())), parse(df, *a))[1])
    return seen


def test_only_new_files_are_parsed(spark, tmp_path, parsed):
    target = str(tmp_path / "landing")
    # Nothing but a broken file, then others: known files count as when they came.
    assert land(spark, target, "a", 3) == {"scanned": 1, "parsed": 0, "rejected": 1, "inserted": 0}
    assert land(spark, target, "b", 1, 3, 4) == {"scanned": 3, "parsed": 2, "rejected": 1, "inserted": 1}
    assert land(spark, target, "c", 1, 2, 3, 4, 6) == {"scanned": 5, "parsed": 3, "rejected": 2, "inserted": 1}
    assert land(spark, target, "c", 1, 2, 3, 4, 6)["inserted"] == 0
    assert parsed == [["3"], ["1"], ["2", "6"], []]
    assert landed(spark, target) == [("1", "b"), ("2", "c")]


@pytest.mark.parametrize("after", ["a", "b"])
def test_a_load_that_died_lands_nothing_twice(spark, tmp_path, monkeypatch, after):
    target = str(tmp_path / "landing")
    land(spark, target, "0", 5)
    with monkeypatch.context() as m:
        m.setattr(LandedIndex, "add", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            land(spark, target, "a", 1, 2)
    assert landed(spark, target) == [("1", "a"), ("2", "a"), ("5", "0")]
    assert land(spark, target, after, 1, 2, 4)["inserted"] == 0
    assert landed(spark, target) == [("1", "a"), ("2", "a"), ("5", "0")]


def test_an_old_table_gets_an_index(spark, tmp_path, parsed):
    target = str(tmp_path / "landing")
    land(spark, target, "a", 1)
    new = LandedIndex(spark, str(tmp_path / "other"))
    counts = landing.land(files(spark, 1, 2), target, "b", "incremental", F.current_timestamp(), new)
    assert counts["inserted"] == 1 and parsed[-1] == ["2"]
