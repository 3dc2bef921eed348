"""Streams drain to the batch result over several batches; pages give records."""

from pyspark.sql import functions as F

from marketloom.operators import changes, latest, pages
from marketloom.streaming import jobs

SCHEMA = "k string, day int, v int, seq int"


def drop_files(spark, folder, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return jobs.parquet_stream(spark, folder, spark.read.parquet(folder).schema, per_batch=1)


BATCHES = [
    [("a", 3, 1, 1), ("b", 1, 5, 2)],
    [("a", 1, 9, 3), ("b", 2, 5, 4), ("c", 1, None, 5)],
    [("a", 4, 1, 6), ("b", 2, 6, 7), ("c", 2, 0, 8)],
]


def test_late_rows_do_not_win(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    drop_files(spark, folder, BATCHES)
    jobs.keep_current(source(spark, folder), ["k"], ["day", "seq"], out, str(tmp_path / "ck"))
    batch = latest.latest_per_key(spark.read.parquet(folder), ["k"], [F.col("day").desc(), F.col("seq").desc()])
    assert {tuple(r) for r in jobs.read_current(spark, out).collect()} == {tuple(r) for r in batch.collect()}
    # A second drain with more files continues from the state.
    drop_files(spark, folder, [[("a", 9, 2, 9)]])
    jobs.keep_current(source(spark, folder), ["k"], ["day", "seq"], out, str(tmp_path / "ck"))
    assert {(r.k, r.day) for r in jobs.read_current(spark, out).collect()} == {("a", 9), ("b", 2), ("c", 2)}


def test_change_log_stream(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    ordered = [[("a", 1, 1, 1), ("b", 1, 5, 2)], [("a", 2, 1, 3), ("b", 2, 6, 4)], [("a", 3, None, 5), ("b", 3, 6, 6)]]
    for rows in ordered:
        drop_files(spark, folder, [rows])
        jobs.log_changes(source(spark, folder), "k", ["v"], ["day", "seq"], out, str(tmp_path / "ck"))
    log = jobs.read_log(spark, out).select("k", "day", "v", "seq")
    whole = changes.change_history(spark.read.parquet(folder), "k", ["day", "seq"], ["v"], F.col("day"))
    assert {tuple(r) for r in log.collect()} == {tuple(r) for r in whole.select("k", "day", "v", "seq").collect()}


def test_landing_stream(spark, tmp_path):
    root, out = tmp_path / "raw", str(tmp_path / "landing")
    day = root / "dt=2024-01-02" / "1"
    day.mkdir(parents=True)
    (day / "1.json").write_text('{"post": {"basic_desc": {"VIN": "V1"}}}')
    (day / "2.json").write_text("{broken")
    for extra in (None, '{"post": {"basic_desc": {"VIN": "V1"}}}', '{"k": 1}'):
        if extra:
            (day / f"{len(extra)}.json").write_text(extra)
        jobs.land_files(jobs.file_stream(spark, str(root)), out, str(tmp_path / "ck"), "run")
    rows = spark.read.parquet(out).select("vin", "page_number", "source").collect()
    assert sorted(map(tuple, rows), key=str) == [("V1", 1, "incremental"), (None, 1, "incremental")] or {tuple(r) for r in rows} == {
        ("V1", 1, "incremental"), (None, 1, "incremental")
    }
    assert len(rows) == 2


PAGE = """
<html><body><h1 id="vehicle-title">Used 2020 Toyota Camry</h1><div class="msrp x">12,345 mi.</div><span class="list-price">$21,950</span>
<section id="features-and-specs"><div class="subtitle">VIN: ABC123 Stock #: S9</div></section>
<div class="basics"><li data-qa="basics-entry">Jet Black <b>Exterior color</b></li><li data-qa="basics-entry">Gasoline Fuel type</li></div>
<div class="highlight-feature"><h3 class="features-spec-heading">Safety</h3><li data-qa="spec-value">ABS</li><li data-qa="spec-value">Airbags</li></div>
<div class="highlight-feature"><h3 class="features-spec-heading">Comfort</h3><li data-qa="spec-value">Seats</li></div>
<section id="vehicle_history_report"><fuse-list><ul><li><span>No accidents</span></li><li><span>1 owner</span></li></ul></fuse-list></section>
<section class="sds-page-section warranty_section"><dl class="fancy-description-list"><dt>Basic</dt><dd>–</dd><dt>Drive</dt><dd>5 years</dd></dl></section>
<fuse-gallery-grid id="gallery"><img src="http://i/1.jpg?w=9"><img src="http://i/2.jpg"></fuse-gallery-grid>
<div class="dealer-info"><h3>Best &amp; Co</h3><fuse-stack class="rating-stack"><fuse-rating rating="4.5"><a href="/dealers/42/best-co/#reviews">(1,234 reviews)</a></fuse-rating></fuse-stack></div>
<section id="consumer-reviews"><div class="rating-out-of"><span class="rating-count">4.4</span></div><div>Based on 1,050 reviews</div>
<div class="subtitle">93% of drivers recommend this car</div>
<div class="ratings-breakdown"><div class="review-text">Comfort <strong>4.6</strong></div></div></section>
<fuse-button class="review-btn-secondary" href="/research/toyota-camry-2020/write-a-review/">x</fuse-button>
<div class="consumer-review-container"><fuse-rating rating="5"></fuse-rating><div class="review-date">5/7/2023</div>
<div class="author-details"><div>By Ann from Rome</div></div><h3 class="title">Good</h3><p class="review-body">Nice car</p></div>
<div class="consumer-review-container"><h3 class="title"></h3></div>
<script>var x = "<h1 id='vehicle-title'>no</h1>";</script></body></html>"""


def test_listing_page(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>nothing</p>"), (3, None)], "id int, html string")
    got = {r.id: r for r in pages.listing_records(pages.listing_fields(df, "id", "html"), "id", "https://site.example").collect()}
    post, seller, car = got[1].post, got[1].seller, got[1].car
    assert (post.new_used, post.title, post.price, post.mileage) == ("Used", "2020 Toyota Camry", 21950, 12345)
    assert post.basic_desc == {"VIN": "ABC123", "Stock Number": "S9", "Fuel Type": "Gasoline"} | {
        k: v for k, v in post.basic_desc.items() if k == "Exterior Color"
    }
    assert post.feature_des == {"Safety": ["ABS", "Airbags"], "Comfort": ["Seats"]}
    assert post.user_history_des == {"Accidents or damage": "None reported", "1-owner vehicle": "Yes"}
    assert post.warranty_des == {"Basic": None, "Drive": "5 years"} and post.image == ["http://i/1.jpg", "http://i/2.jpg"]
    assert (seller.seller_name, seller.seller_key, seller.seller_rating, seller.seller_rating_count) == ("Best & Co", "best-co", 4.5, 1234)
    assert (car.car_rating, car.car_rating_count, car.percentage_recommend, car.ratings) == (4.4, 1050, 93.0, {"Comfort": 4.6})
    assert (car.car_model, car.brand, car.car_name) == ("toyota-camry-2020", "Toyota", "2020 Toyota Camry")
    assert car.car_link == "https://site.example/research/toyota-camry-2020/"
    assert got[2].post.title is None and got[3].post.basic_desc is None
    review = [r.review for r in pages.review_records(df, "id", "html").collect()]
    assert [(r.overall_rating, r.time, r.user_name, r["from"], r.title, r.review) for r in review] == [
        (5.0, "5/7/2023", "Ann", "Rome", "Good", "Nice car")
    ]


def test_dealer_page(spark):
    html = """<div class="dealer-phone"><span class="phone-number-title">New</span><a class="phone-number">(1) 23</a></div>
    <table class="dealer-hours"><tr><td>Monday:</td><td>9-5</td></tr><tr><td>Sunday:</td><td>Closed</td></tr></table>"""
    df = spark.createDataFrame([(1, html)], "id int, html string")
    row = pages.dealer_records(pages.extract_fields(df, ["id"], "html", pages.DEALER_FIELDS), "id").first()
    assert row.phone_info == {"New": "(1) 23"} and row.hours == {"Monday": "9-5", "Sunday": "Closed"}


def test_fields_that_go_together_stay_together(spark):
    html = """<div class="dealer-phone"><a class="phone-number">111</a></div>
    <div class="dealer-phone"><span class="phone-number-title">Used</span><a class="phone-number">222</a></div>
    <table class="dealer-hours"><tr><td>Sales</td></tr><tr><td>Monday:</td><td>9-5</td></tr></table>
    <div class="highlight-feature"><h3 class="features-spec-heading">Safety</h3><li data-qa="spec-value">Comfort</li></div>
    <div class="highlight-feature"><h3 class="features-spec-heading">Comfort</h3><li data-qa="spec-value">Seats</li></div>
    <div class="highlight-feature"><h3 class="features-spec-heading">Safety</h3><li data-qa="spec-value">ABS</li></div>
    <div class="highlight-feature"><li data-qa="spec-value">lost</li></div>
    <section class="sds-page-section warranty_section"><dl class="fancy-description-list"><dt>Basic</dt></dl>
    <dl class="fancy-description-list"><dt>Drive</dt><dt>Rust</dt><dd>5 years</dd><dt>Last</dt></dl></section>
    <fuse-gallery-grid id="gallery"><img><img src="a?x"><img src="b"><img src="c"></fuse-gallery-grid>"""
    df = spark.createDataFrame([(1, html)], "id int, html string")
    dealer = pages.dealer_records(pages.extract_fields(df, ["id"], "html", pages.DEALER_FIELDS), "id").first()
    assert dealer.phone_info == {"Unknown": "111", "Used": "222"} and dealer.hours == {"Monday": "9-5"}
    post = pages.listing_records(pages.listing_fields(df, "id", "html"), "id", "https://site.example").first().post
    assert post.feature_des == {"Safety": ["ABS"], "Comfort": ["Seats"]}
    assert post.warranty_des == {"Drive": "5 years", "Rust": "5 years"} and post.image == ["a", "b", "c"]
