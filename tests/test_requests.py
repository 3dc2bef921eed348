"""Substring joins and constraint searches as data, against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import requests, search
from marketloom.operators.grams import containing, met_rows

COLUMNS = search.Columns(key="k", title="title", brand="brand", price="price", status="status", fuel="fuel", name="name")
ITEMS = "k long, title string, name string, brand string, price double, status string, fuel string"


def pairs(found, *cols):
    return sorted(tuple(r) for r in found.select(*cols).collect())


def test_needles_of_any_length_are_found_where_they_are(spark):
    texts = ["Red Bolt", "bolted ring", "BO", "b", "", None, "aaaa", "50% off_x", "ünïcode Bolt", "x" * 3000 + "bolt"]
    needles = ["bolt", "BO", "B", "", None, "aa", "aaa", "% off_", "zzz", "ÜNÏ", "ing", "xbolt"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(n,) for n in needles] * 2, "needle string")
    got = pairs(containing(rows, ["text"], asked, ["needle"]).fillna("-", ["needle"]), "id", "needle")
    want = [(i, "-" if n is None else n) for i, t in enumerate(texts) for n in needles if not n or t is not None and n.lower() in t.lower()]
    assert got == sorted(want)
    for left, right in ((rows.limit(0), asked), (rows, asked.limit(0))):
        assert containing(left, ["text"], right, ["needle"]).count() == 0


def test_needles_meet_rows_of_their_own_group(spark):
    rows = spark.createDataFrame([(1, "a", "bolt"), (2, "b", "bolt"), (3, None, "bolt")], "id long, g string, text string")
    asked = spark.createDataFrame([("a", "ol"), ("b", "zz"), (None, "ol"), ("b", None)], "g string, needle string")
    assert pairs(containing(rows, ["text"], asked, ["needle"], within=["g"]), "id", "g") == [(1, "a"), (2, "b")]


def test_a_needle_meets_the_rows_of_its_rarest_piece(spark):
    """2,000 rows hold the first pieces of the needle, three the last one."""
    rows = spark.range(2000).select("id", F.concat(F.lit("common word "), F.when(F.col("id") < 3, "quartz").otherwise("stone")).alias("text"))
    asked = spark.createDataFrame([("common word quartz",), ("common word quark",)], "needle string")
    met = met_rows(rows, ["text"], asked, ["needle"])
    plan = met._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    # Three rows for the first needle, and none for the second: no row holds its last piece.
    assert pairs(met, "needle", "id") == [("common word quartz", i) for i in range(3)]
    assert pairs(containing(rows, ["text"], asked, ["needle"]), "id") == [(0,), (1,), (2,)]


def some_items(spark, n=400):
    r = random.Random(5)
    names = ["2020 Red Bolt", "2019 bolted ring", "Quartz 50%", "ring", None]
    made = [
        (i, r.choice(names), r.choice(["Bolt line", None]), r.choice(["A", "B", "C", "D", None]), r.choice([None, *[float(x) for x in range(1, 60)]]),
         r.choice(["New", "Used", "Certified used", None]), r.choice(["Gas", "Diesel", None]))
        for i in range(n)
    ]
    return made + made[:20], spark.createDataFrame(made + made[:20], ITEMS)


ASKED = "q long, brand string, model string, price_min double, price_max double, status string, fuel_type string, year int, exclude_brands array<string>"


def some_requests():
    r = random.Random(6)
    return [
        (i // 2 * 2 if i % 50 == 1 else i, r.choice([None, "", "A", "B", "zz"]), r.choice([None, "", "BOLT", "in", "%"]), r.choice([None, 0.0, 10.0]), r.choice([None, 0.0, 30.0, 50.0]),
         r.choice([None, "", "used", "e"]), r.choice([None, None, "gas"]), r.choice([None, 0, 2020]), r.choice([None, [], ["A"], ["B", "C", None]]))
        for i in range(300)
    ]


def fits(item, ask):
    _, title, _, brand, price, status, fuel = item
    _, wanted, model, low, high, state, burns, year, unwanted = ask
    holds = lambda text, part: not part or (text is not None and part.lower() in text.lower())
    unwanted = [b for b in unwanted or [] if b is not None]
    return (
        title is not None and (not wanted or brand == wanted) and holds(title, model) and holds(status, state) and holds(fuel, burns) and holds(title, str(year) if year else None)
        and (low is None or price is not None and price >= low) and (high is None or price is not None and price <= high)
        and (not unwanted or brand is not None and brand not in unwanted)
    )


def test_requests_are_answered_as_one_by_one(spark):
    items, frame = some_items(spark)
    asked = some_requests()
    got = requests.answer_requests(frame, COLUMNS, spark.createDataFrame(asked, ASKED), "q", limit=4)
    want = []
    for ask in asked:
        found = {(i[0], i[4]) for i in items if fits(i, ask)}
        best = sorted(found, key=lambda x: (x[1] is None, x[1] or 0, x[0]))[:4]
        want += [(ask[0], n + 1, k) for n, (k, _) in enumerate(best)]
    assert pairs(got, "q", "position", "k") == sorted(want)


def test_one_request_equals_the_search_by_parameters(spark):
    _, frame = some_items(spark)
    for limits in ({}, {"price_max": 20.0, "exclude_brands": ["A"]}, {"model": "bolt", "year": 2020, "price_min": 5.0}, {"brand": "B", "status": "used"}):
        asked = spark.createDataFrame([(1,)], "q long").withColumns({c: (F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)) for c, v in limits.items()})
        got = requests.answer_requests(frame, COLUMNS, asked, "q")
        assert [r.k for r in got.orderBy("position").collect()] == [r.k for r in search.constraint_search(frame, COLUMNS, **limits).collect()]


@pytest.mark.parametrize("items, asked", [(0, 3), (3, 0)])
def test_empty_tables(spark, items, asked):
    _, frame = some_items(spark)
    rows = spark.createDataFrame(some_requests()[:asked], ASKED)
    assert requests.answer_requests(frame.limit(items) if not items else frame, COLUMNS, rows, "q").count() == 0


def test_two_thousand_comparisons_of_one_brand(spark):
    items, frame = some_items(spark)
    asked = [(i, "A", ["bolt", "ring", "nothing", None][i % 4], [None, 2020][i % 2]) for i in range(2000)] + [(2000, None, "bolt", None)]
    got = {r.req_id: r for r in search.compare_items(frame, spark.createDataFrame(asked, "req_id long, req_brand string, req_model string, req_year int"), COLUMNS).collect()}
    assert len(got) == 2001
    for i, brand, model, year in (*asked[:8], asked[-1]):
        own = [x for x in items if x[1] is not None and brand and x[3] == brand and model]
        best = sorted((x[4] is None, x[4] or 0, x[0]) for x in own if model in x[1].lower() and (not year or str(year) in x[1]))[:1]
        priced = [x[4] for x in own if (model in x[1].lower() or model in (x[2] or "").lower()) and (x[4] or 0) > 0]
        assert got[i].found == bool(best) and got[i].k == (best[0][2] if best else None)
        if best and priced:
            assert (got[i].min_price, got[i].max_price, got[i].total_listings) == (min(priced), max(priced), len(priced))


def test_exclusions_of_each_query(spark):
    hits = spark.createDataFrame([(1, "A"), (1, "b"), (1, None), (2, "A")], "q long, brand string")
    asked = spark.createDataFrame([(1, ["a", "B"]), (3, ["A"])], "q long, no array<string>")
    assert pairs(search.exclude_asked(hits, "brand", asked, "q", "no").fillna("-"), "q", "brand") == [(1, "-"), (2, "A")]
