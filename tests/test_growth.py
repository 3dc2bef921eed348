"""Steps whose cost must not grow faster than their input."""

import glob
import time
import tracemalloc
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from marketloom import session
from marketloom.config import RecoConfig
from marketloom.llm import line_rules
from marketloom.operators import pages, recall, text, vectors
from marketloom.plans import recommend
from marketloom.plans.registry import all_queries
from marketloom.streaming import jobs, timelines


def test_streamed_loads_write_a_bucket_of_the_index_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "landing")
    made = spark.range(400).select(F.concat(F.lit("dt=2024-01-02/"), "id", F.lit("/1.json")).alias("path"), F.concat(F.lit('{"a": '), "id", F.lit("}")).alias("content"))
    made.write.parquet(source)
    jobs.land_files(jobs.parquet_stream(spark, source, made.schema), target, str(tmp_path / "progress"), "s")
    assert spark.read.parquet(target).count() == 400
    files = glob.glob(f"{target}_index/hashes/run=*/bucket=*/*.parquet")
    # One task for every bucket, not each task a file for each.
    assert len(files) == len({f.rsplit("/", 1)[0] for f in files})


def _dealt_plan(spark, tmp_path, name, table, columns, row):
    spark.createDataFrame([row], columns).write.parquet(f"{tmp_path}/{table}.parquet")
    plan = all_queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("MapInPandas") :]


def test_listing_pages_are_parsed_by_more_tasks_than_their_narrow_table_has(spark, tmp_path):
    columns = "p_partkey bigint, p_name string, p_retailprice double, p_type string, p_brand string, p_size int"
    assert "Exchange hashpartitioning(p_partkey" in _dealt_plan(spark, tmp_path, "listing_pages", "part", columns, (1, "n", 9.0, "t", "b", 3))


def test_selectors_are_matched_once_for_elements_that_repeat(monkeypatch):
    calls, fits = [], pages._fits
    monkeypatch.setattr(pages, "_fits", lambda *a: (calls.append(1), fits(*a))[1])
    matcher = pages._Matcher(pages._compiled(pages.LISTING_FIELDS))
    for n in range(20):
        picker = pages._Picker(matcher, list(pages.LISTING_FIELDS))
        picker.feed(f'<h1 id="vehicle-title">Used {n}</h1><fuse-gallery-grid id="gallery"><img src="{n}"></fuse-gallery-grid>')
        found = picker.done()
        assert (found["headline"], found["images"]) == ([f"Used {n}"], [str(n)])
    # Three different elements, each held against every step once.
    assert len(calls) == 3 * len(matcher.steps)


class _Frame:
    """Stands in for a frame and hands back the function that would run in its tasks."""

    schema = StructType([StructField("id", LongType()), StructField("text", StringType())])

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_chunks_of_a_batch_of_long_texts_are_handed_on_in_parts():
    batch = pa.RecordBatch.from_pydict({"id": list(range(40)), "text": [None, "", *["word " * 20_000] * 38]})
    parts = list(text.word_chunks(_Frame(), "id", "text")(iter([batch])))
    assert len(parts) >= 3 and max(sum(map(len, p.column(2).to_pylist())) for p in parts) < 2 * text.CHUNKED_AT_ONCE
    whole = pa.Table.from_batches(parts)
    assert whole["chunk"].to_pylist() == text.split_text("word " * 20_000) * 38
    assert whole["chunk_no"].to_pylist()[:3] == [0, 1, 2] and sorted(set(whole["id"].to_pylist())) == list(range(2, 40))


def test_dealer_pages_are_parsed_by_more_tasks_than_their_narrow_table_has(spark, tmp_path):
    columns = "c_custkey bigint, c_nationkey int, c_mktsegment string"
    assert "Exchange hashpartitioning(c_custkey" in _dealt_plan(spark, tmp_path, "dealer_pages", "customer", columns, (1, 2, "m"))


def test_seeds_of_equal_attributes_and_price_share_one_list(spark, monkeypatch):
    columns = "item bigint, price double, rating double, a string, b string"
    rows = [(n, 10.0 if n % 2 else None, float(n % 4), "x", "y" if n % 3 else None) for n in range(60)]
    items = spark.createDataFrame(rows, columns)
    asked, made = [], recall._groups_to_read
    monkeypatch.setattr(recall, "_groups_to_read", lambda df, *rest: (asked.append(df.select("seed").distinct().count()), made(df, *rest))[1])
    monkeypatch.setattr(recall, "PER_LIST", 7)
    weights = {"a": 2.0, "b": 1.0}
    found = recall.content_neighbors(items, items.select("item"), weights, k=5, band=0.1)
    got = {}
    for r in sorted(found.collect(), key=str):
        got.setdefault(r.seed, set()).add((r.item, r.score))

    def score(s, o):
        near = o[1] is not None and s[1] is not None and s[1] * 0.9 <= o[1] <= s[1] * 1.1
        return 2.0 + (s[4] is not None and s[4] == o[4]) + near

    # Two prices times two values of b.
    assert asked == [4]
    for s in (r for r in rows if r[1] is not None):
        best = sorted((o for o in rows if o[0] != s[0]), key=lambda o: (-score(s, o), -o[2], o[0]))[:5]
        assert got[s[0]] == {(o[0], score(s, o)) for o in best}
    assert all(len(v) == 5 and n not in {i for i, _ in v} for n, v in got.items()) and len(got) == 60


def test_timelines_without_lateness_need_no_state_of_python_workers(spark, tmp_path, monkeypatch):
    monkeypatch.delattr(timelines, "Timeline")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([("a", 3, 1), ("b", 1, 1)], [("a", 1, 1), ("a", 2, 2), (None, 1, None)], [("a", 4, 1), (None, 2, 5)]):
        spark.createDataFrame(batch, "k string, at int, v int").write.mode("append").parquet(source)
        timelines.log_timelines(jobs.parquet_stream(spark, source, spark.read.parquet(source).schema), "k", ["v"], ["at"], out, str(tmp_path / "progress"))
    assert {tuple(r) for r in timelines.read_timelines(spark, out).collect()} == {("a", 1, 1), ("a", 2, 2), ("a", 3, 1), ("b", 1, 1), (None, 1, None), (None, 2, 5)}


def test_timelines_keep_one_state_of_a_bucket_and_no_steps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(timelines, "ROWS_AT_ONCE", 50, raising=False)
    source, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    steps = lambda: set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/step-*"))
    before = steps()
    for n in range(3):
        made = spark.range(40).select(F.concat(F.lit("k"), F.col("id") % 9).alias("k"), (F.col("id") * 3 + n).cast("int").alias("at"), (F.col("id") % 2).cast("int").alias("v"))
        made.write.mode("append").parquet(source)
        timelines.log_timelines(jobs.parquet_stream(spark, source, made.schema), "k", ["v"], ["at"], out, progress, buckets=4)
    held = glob.glob(f"{progress}/held/state=*/bucket=*")
    assert {f.split("state=")[1][0] for f in held} == {"2"} and len(held) == 4 and steps() == before
    found = sorted(tuple(r) for r in spark.read.parquet(source).collect())
    want = [r for i, r in enumerate(found) if not i or found[i - 1][0] != r[0] or found[i - 1][2] != r[2]]
    assert sorted(tuple(r) for r in timelines.read_timelines(spark, out).collect()) == want


def test_pairs_of_blocks_are_dealt_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(n if n < 299 else None, [float(x) for x in rng.normal(size=4)]) for n in range(300)] + [(5, [1.0, 2.0, 0.5, 0.0])]
    made = spark.createDataFrame(rows, "id bigint, vec array<double>")
    found = lambda: vectors.nearest_neighbors(made, made, 4, exclude_self=True, cell_target=40)
    whole = sorted(map(str, found().collect()))
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 2048)
    steps, written = [], session.written
    monkeypatch.setattr(vectors, "written", lambda df: (steps.append(1), written(df))[1], raising=False)
    monkeypatch.setattr(vectors, "BYTES_AT_ONCE", 20_000, raising=False)
    assert sorted(map(str, found().collect())) == whole and len(steps) > 4


def test_scores_of_a_pair_of_blocks_are_not_in_memory_at_once():
    rng, n = np.random.default_rng(1), 4096
    vectors_, ids = rng.normal(size=(n, 8)), np.arange(n)
    tracemalloc.start()
    found = sum(len(part) for part in vectors._best_of_block(ids, vectors_, ids, vectors_, 3, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All scores are 134 MB, without their order.
    assert found == 3 * n and peak < 100e6


def test_phrases_are_looked_for_one_by_one(spark):
    lines = ["ALL Rights Reserved 2020", "plain words", "", "Cookie Policy", "mentions légales: tous DROITS réservés"]
    made = spark.createDataFrame([(x,) for x in lines], "line string").select(line_rules.line_fails(F.col("line")).alias("fails"))
    assert [r.fails for r in made.collect()] == [True, False, True, True, True]
    assert "reserved|" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_lists_that_all_requests_share_are_dealt_by_what_comes_out(spark, monkeypatch):
    for name, value in (("PAIRS_PER_TASK", 64), ("PER_LIST", 7), ("CROWDED", 3)):
        monkeypatch.setattr(recall, name, value, raising=False)
    # Seed 0 meets every request; requests, seeds, items and scores may be null, rows may repeat.
    asked = [(n if n < 199 else None, s) for n in range(200) for s in (0, n % 50 + 1)] + [(5, 0), (6, None)]
    near = [(s, (s + i) % 60 if i else None, None if i == 1 else 1.0 + (s * 7 + i) % 11) for s in range(51) for i in range(6)] + [(None, 3, 9.0)]
    seed_items, neighbors = spark.createDataFrame(asked, "request bigint, item bigint"), spark.createDataFrame(near, "seed bigint, item bigint, score double")
    found = recall.from_neighbors(seed_items, neighbors)
    plan = found._jdf.queryExecution().executedPlan().toString()
    best = {}
    for request, seed in asked:
        for _, item, score in (x for x in near if x[0] == seed and seed is not None):
            had = best.setdefault((request, item), score)
            best[request, item] = max((x for x in (had, score) if x is not None), default=None)
    top = {}
    for (request, _), score in best.items():
        top[request] = max(top.get(request, 0.0), score or 0.0)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == len(best)
    assert {(r.request, r.item): r.score for r in rows} == {k: None if v is None else v / top[k[0]] for k, v in best.items()}
    # Few bytes are read, yet the pairs lie in many tasks, and none of them are held before they are dealt.
    assert len({r.task for r in rows}) > 20 and max(sum(r.task == t for r in rows) for t in {r.task for r in rows}) < len(rows) / 20
    assert plan.index("partial_max(score") < plan.index("Exchange hashpartitioning(request")


def test_seeds_are_answered_in_parts_whose_pairs_are_not_on_disk_together(spark, monkeypatch):
    rows = [(n if n < 79 else None, 10.0 + n % 13 if n % 5 else None, float(n % 4), f"x{n % 3}", f"y{n % 7}" if n % 4 else None) for n in range(80)] + [(3, 13.0, 3.0, "x0", "y3")]
    items = spark.createDataFrame(rows, "item bigint, price double, rating double, a string, b string")
    near = lambda: recall.content_neighbors(items, items.select("item"), {"a": 2.0, "b": 1.0}, k=5, band=0.1)
    whole = near()
    monkeypatch.setattr(recall, "PAIRS_AT_ONCE", 256, raising=False)
    parts = near()
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    # What is handed on is read from where the parts were written.
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") > 3
    assert "Exchange" in whole._jdf.queryExecution().executedPlan().toString()


def test_item_pages_are_made_in_parts_from_lists_made_once(spark, monkeypatch):
    start = datetime(2024, 1, 30)
    rows = [(n, f"b{n % 3}", f"m{n % 6}", 100.0 + n, float(n % 5), start, f"f{n % 2}") for n in range(40)] + [(None, "b1", "m1", 101.0, 2.0, start, "f1"), (7, "b2", "m1", 103.0, 1.0, start, "f0")]
    items = spark.createDataFrame(rows, "item bigint, brand string, model string, price double, rating double, crawled_at timestamp_ntz, fuel string")
    similarity = spark.createDataFrame([(n, (n * 3 + 1) % 40, 0.5 + n / 100, 1) for n in range(20)], "item bigint, neighbor bigint, score double, rank int")
    cfg = RecoConfig(content_weights={"brand": 2.0, "fuel": 0.5}, content_limit=6, popularity_limit=5, top_k=6)
    data = recommend.Inputs(items, None, similarity)
    made, content = [], recall.content_neighbors
    monkeypatch.setattr(recall, "content_neighbors", lambda *a, **b: (made.append(1), content(*a, **b))[1])
    as_of = F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz")
    whole = recommend.similar_items(data, cfg, as_of)
    monkeypatch.setattr(recommend, "REQUESTS_AT_ONCE", 25, raising=False)
    parts = recommend.similar_items(data, cfg, as_of)
    assert len(made) == 2
    got = sorted(map(str, parts.collect()))
    assert got == sorted(map(str, whole.collect())) and len(got) > 200
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 2


def test_steps_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for d in disk.localDirs() for f in glob.glob(f"{d}/*/shuffle_*.data")}
    for step in (session.written, session.cut_lineage):
        before = shuffles()
        made = step(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
        until = time.time() + 20
        while shuffles() - before and time.time() < until:
            time.sleep(0.1)
        assert not shuffles() - before and {r.n for r in made.collect()} == {142, 143}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_recent_seeds_are_read_from_where_they_are_written(spark):
    seeds = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, 8, 3), (1, 9, 4), (1, 6, 5), (2, 7, 1)], "request bigint, item bigint, recency int")
    recent = recall.recent_seed_items(seeds)
    assert {tuple(r) for r in recent.collect()} == {(1, 7, 1), (1, 8, 3), (1, 9, 4), (2, 7, 1)}
    assert "Window" not in recent._jdf.queryExecution().executedPlan().toString()
