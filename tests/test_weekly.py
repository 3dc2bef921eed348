"""The weekly load on small literal documents."""

import json
import os

import pytest
from pyspark.sql import functions as F

from marketloom.plans import weekly
from marketloom.sources import landing


def listing(vin, price, slug="toyota-camry-2020", seller="best-cars", **post):
    return {
        "datetime": "2024-01-02 03:04:05",
        "post": {
            "new_used": "used", "title": "2020 Toyota Camry", "price": price, "mileage": 1200, "monthly_payment": None,
            "basic_desc": {"VIN": vin, "Stock Number": "S1", "Fuel Type": "Gasoline"},
            "feature_des": {"Safety": ["ABS", " ABS ", "", "Airbags"], "Odd": "text"},
            "user_history_des": {"Accidents or damage": "At least 1 reported", "Clean Title": "Yes"},
            "warranty_des": {"Basic": None}, "image": ["u1", None, "", "u4"], **post,
        },
        "seller": {"seller_key": seller, "seller_name": "Best", "seller_rating": "4.5", "hours": {"Monday": "9-5"}, "highlights": None},
        "car": {
            "car_model": slug, "brand": "Toyota", "car_name": "2020 Toyota Camry", "car_rating": 4.4, "ratings": {"Comfort": 4.5},
            "reviews": [
                {"overall_rating": 5, "time": "5/7/2023", "user_name": "Ann", "title": "Good", "review": "Nice car"},
                {"overall_rating": 5, "time": "5/7/2023", "user_name": "Ann", "title": "Good", "review": "Nice car"},
            ],
        },
    }


def put(root, path, body):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w", encoding="utf-8") as f:
        f.write(body if isinstance(body, str) else json.dumps(body))


def at(text):
    return F.lit(text).cast("timestamp")


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory):
    raw, root = str(tmp_path_factory.mktemp("raw")), str(tmp_path_factory.mktemp("house"))
    put(raw, "dt=2024-01-02/1/1.json", listing("V1", "$21,950"))
    put(raw, "dt=2024-01-02/1/2.json", listing("V1", "$21,950"))
    put(raw, "dt=2024-01-02/1/3.json", listing("V2", 30000, seller=None))
    put(raw, "dt=2024-01-02/1/4.json", "{broken")
    put(raw, "dt=2024-01-02/1/5.json", "[1, 2]")
    put(raw, "dt=2024-01-02/1/6.json", "")
    events = spark.createDataFrame(
        [("u1", "V1", "view", 1.0, "2024-01-09"), ("u1", "V2", "favorite", 2.0, "2024-01-08"), ("u2", "V1", "view", 1.0, "2023-12-31"),
         ("u2", "V2", "inquiry", 1.0, "2024-01-01"), ("u2", "gone", "view", 1.0, "2024-01-01")],
        "user_id string, vehicle_id string, interaction_type string, interaction_score double, created_at string",
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    first = weekly.run_weekly_load(spark, raw, root, "r1", at("2024-01-03"), "2024-01-02", events=events)
    put(raw, "dt=2024-01-09/1/1.json", listing("V1", 20000))
    put(raw, "dt=2024-01-09/1/2.json", listing("V3", None, image=None, feature_des=None))
    put(raw, "dt=2024-01-01/7/1.json", listing("V2", 1))
    second = weekly.run_weekly_load(spark, raw, root, "r2", at("2024-01-10"), before="r1", events=events)
    again = weekly.run_weekly_load(spark, raw, root, "r3", at("2024-01-11"), before="r2", events=events)
    return weekly.Warehouse(root), (first, second, again)


def rows(spark, path):
    return spark.read.parquet(path)


def test_load_counts(house):
    first, second, again = house[1]
    # The file reader leaves out empty files, so they are not counted as scanned.
    assert first == {"scanned": 5, "parsed": 3, "rejected": 2, "inserted": 2}
    assert second == {"scanned": 8, "parsed": 6, "rejected": 2, "inserted": 3}
    assert again["inserted"] == 0


def test_vehicles(spark, house):
    got = {r.vehicle_id: r for r in rows(spark, house[0].mart("vehicles", "r2")).collect()}
    assert set(got) == {"V1", "V2", "V3"}
    v1 = got["V1"]
    assert (v1.price, str(v1.first_seen_date), str(v1.last_updated_date)) == (20000.0, "2024-01-02", "2024-01-09")
    assert (v1.image_count, v1.primary_image_url, v1.feature_count) == (2, "u1", 2)
    assert (v1.new_used, v1.has_accidents, v1.clean_title, v1.is_one_owner) == ("Used", True, True, None)
    assert (v1.seller_name, v1.brand, v1.car_rating, v1.comfort_rating) == ("Best", "Toyota", 4.4, 4.5)
    # The document loaded last is older by crawl date, so it is not current.
    assert got["V2"].price == 30000.0 and got["V2"].seller_name is None
    assert (got["V3"].image_count, got["V3"].feature_count) == (0, 0)


def test_model_and_seller_marts(spark, house):
    model = rows(spark, house[0].mart("car_models", "r2")).collect()
    assert [(m.car_model, m.listing_count, m.review_count, m.min_price, m.avg_price) for m in model] == [
        ("toyota-camry-2020", 3, 1, 20000.0, 25000.0)
    ]
    seller = rows(spark, house[0].mart("sellers", "r2")).collect()
    assert [(s.seller_key, s.inventory_count, s.seller_rating) for s in seller] == [("best-cars", 2, 4.5)]
    images = rows(spark, house[0].mart("vehicle_images", "r2")).orderBy("id").collect()
    assert [(i.id, i.vehicle_id, i.image_order) for i in images] == [(1, "V1", 1), (2, "V1", 4), (3, "V2", 1), (4, "V2", 4)]
    features = {(f.vehicle_id, f.feature_name) for f in rows(spark, house[0].mart("vehicle_features", "r2")).collect()}
    assert features == {(v, f) for v in ("V1", "V2") for f in ("ABS", "Airbags")}


def test_change_log(spark, house):
    log = {(r.vin, r.price, r.run_id, r.month) for r in rows(spark, house[0].price_history).collect()}
    assert log == {("V1", 21950.0, "r1", "2024-01"), ("V2", 30000.0, "r1", "2024-01"), ("V1", 20000.0, "r2", "2024-01"), ("V3", None, "r2", "2024-01")}


def test_checks_and_rollups(spark, house):
    report = {(r.check, r.column): r.status for r in rows(spark, house[0].mart("checks", "r2")).collect()}
    assert report["no_orphan_interactions", "vehicle_id"] == "warn" and report["not_null", "price"] == "warn"
    assert "fail" not in report.values()
    popular = {r.vehicle_id: r for r in rows(spark, house[0].mart("popular_vehicles", "r2")).collect()}
    assert (popular["V1"].total_interactions, popular["V1"].views, popular["V2"].saves, popular["V2"].contacts) == (2, 2, 1, 1)
    assert popular["V3"].pop_score_30d == 0.0
    near = {(r.item, r.neighbor) for r in rows(spark, house[0].mart("item_similarity", "r2")).collect()}
    assert ("V1", "V2") in near and ("V2", "V1") in near


def test_documents(spark, house):
    docs = {r.vehicle_id: r for r in weekly.build_documents(spark, house[0], "r2").collect()}
    assert docs["V1"].document == (
        "Used 2020 Toyota Camry Brand: Toyota. Model: 2020 Toyota Camry. Price: $20,000. Mileage: 1,200 miles. Fuel: Gasoline. "
        "Owner rating: 4.4/5. Features: ABS, Airbags. Sold by Best (). What owners say: Good Nice car."
    )
    assert docs["V1"].payload.price == 20000.0
    fresh = weekly.build_documents(spark, house[0], "r2", since=F.lit("2024-01-05").cast("date"))
    assert {r.vehicle_id for r in fresh.collect()} == {"V1", "V3"}


def test_paths(spark):
    df = spark.createDataFrame([("dt=2026-05-29/1/3.json",), ("raw_data/1/3.json",), ("x.json",)], "p string")
    got = df.select(landing.page_from_path(F.col("p")).alias("n"), landing.date_from_path(F.col("p")).cast("string").alias("d")).collect()
    assert [(r.n, r.d) for r in got] == [(1, "2026-05-29"), (1, None), (None, None)]


def test_going_on_equals_starting_over(spark, house):
    whole = weekly.newest_documents(spark, weekly.Warehouse(house[0].root), "whole", "r1", full=True)
    for kind, key in (("listing", "vin"), ("model", "car_model_slug"), ("seller", "seller_key")):
        step = rows(spark, house[0].mart(f"newest_{kind}", "r3"))
        assert {(r[0], r[1]) for r in step.select(key, "file_hash").collect()} == {(r[0], r[1]) for r in getattr(whole, kind).select(key, "file_hash").collect()}
    # Later runs read landed rows from where the run before ended.
    old = rows(spark, house[0].mart("newest_listing", "r2"))
    new = weekly.tables.newer_than(spark.read.parquet(house[0].landing), "ingested_at", weekly.tables.high_watermark(old, "ingested_at"), inclusive=True)
    assert new.count() == 3 and "PushedFilters: [IsNotNull(ingested_at), GreaterThanOrEqual(ingested_at" in new._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_marts_read_no_landing(spark, house):
    core = weekly.marketplace.Core(**{f.name: rows(spark, house[0].mart(f"core_{f.name}", "r2")) for f in weekly.fields(weekly.marketplace.Core)})
    for mart in (weekly.marketplace.vehicles(core, F.current_date()), weekly.marketplace.car_models(core), weekly.marketplace.vehicle_images(core)):
        assert not [p for p in mart.inputFiles() if "/landing/" in p]


def test_points_are_upserted(spark, house):
    for run_id, before, since in (("r1", None, None), ("r2", "r1", F.lit("2024-01-05").cast("date"))):
        weekly.embed_documents(spark, house[0], run_id, before, since, lambda texts: [[float(len(t))] for t in texts])
    first, second = (rows(spark, house[0].mart("points", r)).select("vehicle_id", "embedding").collect() for r in ("r1", "r2"))
    assert {r.vehicle_id for r in first} == {"V1", "V2"} and {r.vehicle_id for r in second} == {"V1", "V2", "V3"} and len(second) == 3


def test_odd_json_is_kept_and_rejects_have_reasons(spark):
    files = spark.createDataFrame(
        [("dt=2024-01-02/1/1.json", '{"k": 1, "k": 2, "post": {"basic_desc": {"VIN": "A"}}}'), ("dt=2024-01-02/1/2.json", '{"car": {"car_model": "m", "r": NaN}}'),
         ("3.json", "{broken"), ("4.json", "[1]"), ("5.json", " ")], "path string, content string",
    )
    got = landing.parse_documents(files).select("vin", "car_model_slug", F.try_variant_get("payload", "$.k", "int").alias("k")).collect()
    assert {tuple(r) for r in got} == {("A", None, 2), (None, "m", None)}
    assert {(r.file_path, r.reason) for r in landing.rejected_files(files).collect()} == {("3.json", "no JSON"), ("4.json", "no object"), ("5.json", "empty")}


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from marketloom.session import checkpoint_dir

    conf = SimpleNamespace(get=lambda name, default: default)
    with pytest.raises(RuntimeError):
        checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
