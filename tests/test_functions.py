"""Edge rows of the scalar functions."""

import datetime
import uuid

from pyspark.sql import functions as F

from marketloom.functions import cleaning, constraints, keys, patterns, scoring, text, urls


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_safe_numbers(spark):
    raw = ["$21,950.50", "1.2.3", "-", "", None, "12.5"]
    assert column(spark, raw, cleaning.safe_numeric) == [21950.5, None, None, None, None, 12.5]
    assert column(spark, raw, cleaning.safe_integer) == [2195050, 123, None, None, None, 125]


def test_history_tokens(spark):
    raw = [None, "None reported", "At least 1 reported", "Yes", "no"]
    assert column(spark, raw, lambda c: cleaning.history_to_bool(c, ["at least"])) == [None, False, True, False, False]
    assert column(spark, raw, lambda c: cleaning.history_to_bool(c, ["yes"])) == [None, False, False, True, False]


def test_review_dates(spark):
    day = datetime.date(2023, 5, 7)
    raw = ["5/7/2023", "05/07/2023", "13/45/2020", "May 7", None]
    assert column(spark, raw, cleaning.parse_us_date) == [day, day, None, None, None]


def test_uuid5_equals_python(spark):
    space = uuid.uuid5(uuid.NAMESPACE_DNS, "some.space")
    names = ["", "a", "1FTEW1EP5KFA12345", "zażółć", "x" * 300]
    assert column(spark, names, lambda c: keys.uuid5(space, c)) == [str(uuid.uuid5(space, n)) for n in names]


def test_keys_keep_null(spark):
    assert column(spark, [None, "a"], keys.surrogate_key)[0] is None


def test_absolutize_like_urljoin(spark):
    from urllib.parse import urljoin

    bases = ["https://a.example/x/y.html?q=1#top", "http://b.example"]
    hrefs = ["/p?x=1", "z", "?p=2", "#f", "//c.example/d", "https://d.example/", "mailto:x@y"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    rows = df.select("b", "h", urls.absolutize(F.col("h"), F.col("b")).alias("u")).collect()
    # An empty path gets a slash here, as browsers do.
    assert all(r.u == urljoin(r.b if r.b.count("/") > 2 or r.h[0] in "?#" else r.b + "/", r.h) for r in rows)


def test_slugs(spark):
    raw = ["land_rover-range_rover-2019", "tesla-model_3", None]
    assert column(spark, raw, urls.slug_brand) == ["Land Rover", "Tesla", None]
    assert column(spark, raw, urls.slug_year) == [2019, None, None]
    assert column(spark, ["toyota-4runner-2019"], urls.slug_name) == ["2019 Toyota 4runner"]


def test_labels_and_bylines(spark):
    assert column(spark, ["Jet Black exterior color", "2.0L I4 Engine", "24 MPG", "odd"], patterns.value_and_label) == [
        ("Exterior Color", "Jet Black"), ("Engine", "2.0L I4"), ("MPG", "24"), (None, None),
    ]
    assert column(spark, ["By Ann from Rome on May 1", "By Bo on May 1", "Cy", None], patterns.byline) == [
        ("Ann", "Rome on May 1"), ("Bo", "May 1"), ("Cy", None), ("", None),
    ]


def test_history_classes(spark):
    got = column(spark, ["No accidents or damage", "Accident reported", "1 owner", "3 owners", "at least 1 open recall", "none"],
                 patterns.history_class)
    assert [tuple(g) for g in got] == [
        ("Accidents or damage", "None reported"), ("Accidents or damage", "At least 1 reported"), ("1-owner vehicle", "Yes"),
        ("1-owner vehicle", "No"), ("Open recall", "At least 1 reported"), (None, None),
    ]


def test_constraints(spark):
    got = column(spark, ["under $30k", "over 25,000", "used hybrid 2019", "brand new", "no number", None, "at least 3 doors and max 18 thousand"],
                 constraints.parse_constraints)
    assert [tuple(g) for g in got] == [
        (None, 30000.0, None, None, None), (25000.0, None, None, None, None), (None, 2019.0, "Used", "Hybrid", 2019),
        (None, None, "New", None, None), (None, None, None, None, None), (None, None, None, None, None),
        (18000.0, None, None, None, None),
    ]


def test_scores(spark):
    assert column(spark, [10.0, 20.0, 45.0, None], lambda c: scoring.price_fit(c, F.lit(20.0)), "double") == [0.5, 1.0, 0.0, 1.0]
    assert column(spark, [0, 5, 40], lambda c: scoring.warmup(c, 20), "int") == [0.0, 0.25, 1.0]
    assert column(spark, [0.0, 1.0, 2.0], lambda c: scoring.better_side(c, F.lit(1.5), "lower"), "double") == [None, "left", "right"]


def test_truncate(spark):
    long = "word " * 200
    assert column(spark, ["short", long], text.truncate_at_word) == ["short", long[:600].rsplit(" ", 1)[0]]
