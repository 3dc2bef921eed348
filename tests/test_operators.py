"""Edge rows and laws of load, nested, session and quality operators."""

import datetime
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom import config
from marketloom.operators import changes, evaluation, latest, nested, quality, ranking, recall, search, sessions, text
from marketloom.sources import tables

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PAIRS = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3)), max_size=12)


def as_set(df):
    return {tuple(r) for r in df.collect()}


@FEW
@given(PAIRS, PAIRS)
def test_append_is_idempotent(spark, old, new):
    schema = "k int, v int"
    first = tables.append_if_absent(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), ["k"], ["v"])
    got = as_set(first)
    seen = {k for k, _ in old}
    assert got == {(k, min(v for kk, v in new if kk == k)) for k, _ in new if k not in seen}
    again = tables.append_if_absent(spark.createDataFrame(new, schema), spark.createDataFrame(list(got) + old, schema), ["k"], ["v"])
    assert again.count() == 0


@FEW
@given(PAIRS, PAIRS)
def test_replace_and_merge(spark, old, new):
    schema = "k int, v int, first int"
    o = [(k, v, 1) for k, v in dict(old).items()]
    n = [(k, v, 2) for k, v in dict(new).items()]
    a, b = spark.createDataFrame(o, schema), spark.createDataFrame(n, schema)
    olds, news = dict(old), dict(new)
    assert as_set(tables.replace_by_key(a, b, ["k"])) == set(n) | {r for r in o if r[0] not in news}
    merged = tables.merge_by_key(a, b, ["k"], keep=["first"])
    assert as_set(merged) == {(k, news.get(k, olds.get(k)), 1 if k in olds else 2) for k in olds | news}
    assert as_set(tables.merge_by_key(merged, b, ["k"], keep=["first"])) == as_set(merged)


@FEW
@given(st.permutations([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "d"), (2, 0, "e"), (None, 9, "f")]))
def test_latest_ignores_arrival_order(spark, rows):
    df = spark.createDataFrame(rows, "k int, day int, v string")
    got = latest.latest_per_key(df, ["k"], [F.col("day").desc_nulls_last(), F.col("v").desc()])
    assert as_set(got) == {(1, 2, "c"), (2, 0, "e")}


def test_empty_keys_are_no_keys(spark):
    df = spark.createDataFrame([("", 1), ("x", 2), (None, 3)], "k string, v int")
    assert as_set(latest.latest_per_key(df, ["k"], [F.col("v")])) == {("x", 2)}


def test_change_log_edges(spark):
    schema = "k string, price int, crawl_date int, inserted_at int"
    log = spark.createDataFrame([("same", 1, 1, 1), ("null", None, 1, 1), ("value", 5, 1, 1), ("day", 1, 2, 1), ("day", 2, 2, 2)], schema)
    state = spark.createDataFrame(
        [("new", 1, 3, 3), ("same", 1, 3, 3), ("null", 7, 3, 3), ("value", None, 3, 3), ("day", 2, 3, 3)], schema
    )
    got = changes.change_log_increment(state, log, "k", ["price"])
    assert {r.k for r in got.collect()} == {"new", "null", "value"}


def test_history_with_a_hot_key(spark):
    rows = [("hot", n, (n // 7) % 3) for n in range(200)] + [("cold", n, n % 2) for n in range(5)] + [("one", 1, None)]
    df = spark.createDataFrame(rows, "k string, ts int, v int")
    got = changes.change_history(df, "k", ["ts"], ["v"], F.floor(F.col("ts") / 10))
    want, last = set(), {}
    for k, n, v in sorted(rows, key=lambda r: (r[0], r[1])):
        if k not in last or last[k] != v:
            want.add((k, n, v))
        last[k] = v
    assert as_set(got) == want


def test_global_ids_are_dense(spark):
    rows = [(n * 7919 % 1000,) for n in range(1000)]
    got = latest.global_ids(spark.createDataFrame(rows, "v int").repartition(7), ["v"])
    assert sorted((r.v, r.id) for r in got.collect()) == [(n, n + 1) for n in range(1000)]


def test_explode_guards(spark):
    docs = [
        {"f": None, "im": None}, {"f": {"A": ["x", " x ", "", None], "B": "no list", " C ": ["y"], "D": []}, "im": ["a", None, "", "d"]},
        {"f": ["not", "object"], "im": "u"}, {},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string").select("i", F.try_parse_json("t").alias("p"))
    assert as_set(nested.explode_categories(df, "p", "$.f", ["i"])) == {(1, "A", "x"), (1, "C", "y")}
    images = F.try_variant_get("p", "$.im", "array<string>")
    assert as_set(nested.explode_ordered(df, images, ["i"])) == {(1, 1, "a"), (1, 4, "d")}
    assert [r.o for r in df.orderBy("i").select(nested.is_object(F.col("p"), "$.f").alias("o")).collect()] == [False, True, False, False]


def test_profile_fold(spark):
    rows = [(1, 0, 5.0, ["b", "a", "b"]), (1, 1, None, None), (1, 2, 7.0, ["c", "a", ""]), (2, 0, None, [])]
    df = spark.createDataFrame(rows, "s int, turn int, budget_max double, likes array<string>")
    got = sessions.fold_profile(df, "s", "turn", ["budget_max"], ["likes"])
    assert {(r.s, r.budget_max, tuple(r.likes)) for r in got.collect()} == {(1, 7.0, ("b", "a", "c")), (2, None, ())}


def test_search_wildcards(spark):
    df = spark.createDataFrame([("100% off",), ("1000 off",), (None,)], "t string")
    assert df.filter(search.contains_text(F.col("t"), "0% O")).count() == 1
    assert df.filter(search.contains_text(F.col("t"), "0% O", escape=False)).count() == 2


def test_quality_severity(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "z")], "k int, v string")
    report = quality.union_reports([
        quality.check_unique(df, "k"), quality.check_accepted_values(df, "v", ["a"]), quality.check_relationship(df, "k", df, "k"),
        quality.check_freshness(spark.createDataFrame([(datetime.datetime(2024, 1, 1),)], "ts timestamp"), "ts", F.lit("2024-01-12").cast("timestamp")),
    ])
    assert [(r.check, r.failures, r.status) for r in report.collect()] == [
        ("unique", 1, "fail"), ("accepted_values", 1, "warn"), ("relationships", 0, "pass"), ("freshness", 3, "warn"),
    ]
    assert quality.blocking_failures(report).count() == 1


def test_recall_edges(spark):
    seeds = spark.createDataFrame(
        [(1, "a", "view", None, 1), (1, "b", "odd", None, 2), (2, "a", "view", None, 1), (3, "q", "view", None, 1)],
        "request int, item string, kind string, ts timestamp_ntz, recency int",
    )
    near = spark.createDataFrame([("a", "b", 0.5, 1), ("a", "c", 0.4, 2), ("b", "c", 0.2, 1), ("b", "d", 0.1, 30)], "item string, neighbor string, score double, rank int")
    got = recall.collaborative(seeds, near, F.lit("2024-01-01").cast("timestamp_ntz"), {"view": 1.0})
    assert {(r.request, r.item, round(r.score, 6)) for r in got.collect()} == {(1, "c", 1.0), (2, "b", 1.0), (2, "c", 0.8)}


def test_popularity_fill(spark):
    df = spark.createDataFrame([(1, "x", 5.0), (2, "x", 0.0), (3, "y", 4.0), (4, None, 3.0)], "item int, brand string, pop double")
    lists = recall.popularity_lists(df, "item", "brand", F.col("pop"), k=2)
    got = {}
    for r in lists.collect():
        got.setdefault(r.brand, {})[r.item] = r.score
    assert got == {"x": {1: 1.0, 2: 0.0}, "y": {3: 0.8, 1: 1.0}, None: {1: 1.0, 3: 0.8}}
    asked = spark.createDataFrame([(1, "y"), (2, None), (3, "unknown")], "request int, brand string")
    assert {(r.request, r.item) for r in recall.popular(asked, lists).collect()} == {(1, 3), (1, 1), (2, 1), (2, 3), (3, 1), (3, 3)}


def test_explain_adds_up(spark):
    cfg = config.RecoConfig()
    df = spark.createDataFrame([(0.5, 0.2, 0.1, 1.0, 0.7, 0.9, 0.3)], ", ".join(f"{n} double" for n in cfg.feature_weights))
    scored = ranking.rank_score(df, cfg.feature_weights, F.lit(0.25))
    row = scored.select("rank_score", ranking.explain(cfg.feature_weights, F.lit(0.25)).alias("m")).first()
    assert abs(sum(row.m.values()) - row.rank_score) < 1e-3


def test_ndcg_may_exceed_one(spark):
    df = spark.createDataFrame([(1, 1, 1, "m"), (1, 2, 1, "m"), (2, 1, 0, None)], "u int, rank int, hit int, _group string")
    got = {r.u: r for r in evaluation.list_metrics(df, "u", "rank").collect()}
    assert got[1].ndcg > 1 and got[1].ndcg_capped == 1.0 and got[2].hit_rate == 0.0 and got[2].diversity == 0.0


def test_config_overrides():
    cfg = config.from_mapping({"interaction_weights": {"view": 3}, "candidates": {"vector": {"enabled": False}}, "reranker": {"mmr_lambda": 1.0}, "unknown": 1})
    assert cfg.interaction_weights["view"] == 3 and cfg.interaction_weights["click"] == 2.0
    assert cfg.vector is False and cfg.mmr_lambda == 1.0 and cfg.top_k == 20


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(5, 20), st.integers(0, 4))
def test_chunks_keep_every_word(body, size, overlap):
    chunks = text.split_text(body, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    # Whole texts: every character that is no blank is in some chunk, in order.
    rest = "".join(body.split())
    seen = 0
    for c in chunks:
        flat = "".join(c.split())
        start = max((i for i in range(max(0, seen - len(flat)), seen + 1) if rest[i : i + len(flat)] == flat), default=None)
        assert start is not None
        seen = max(seen, start + len(flat))
    assert seen == len(rest)


def test_chunk_boundaries():
    assert text.split_text("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert text.split_text("one two\n\nthree", 9, 0) == ["one two", "three"]
    assert text.split_text("x" * 12, 5, 0) == ["xxxxx", "xxxxx", "xx"]


def test_popularity_falls_back_to_the_rating(spark):
    from marketloom.config import RecoConfig
    from marketloom.plans import recommend

    items = spark.createDataFrame([(1, "a", 4.0), (2, "a", 5.0), (3, "b", None), (4, "b", 2.5)], "item long, brand string, rating double")
    got = recommend.popularity_table(recommend.Inputs(items), RecoConfig()).collect()
    assert {(r.item, r.score) for r in got if r.brand is None} == {(2, 1.0), (1, 0.8), (4, 0.5)}
