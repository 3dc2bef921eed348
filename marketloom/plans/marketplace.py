"""Listing marketplace: landed documents to current views, core tables and marts.

Every step is a function of DataFrames. Model-level facts (rating, reviews) are kept once
per model and only copied to listings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import parse_us_date
from ..functions.keys import content_key, surrogate_key
from ..operators import latest, marts, nested, quality
from ..sources import tables

# Where the fields of a listing document are and how they are read.
LISTING_SPEC = {
    "seller_key": ("$.seller.seller_key", "string"),
    "stock_number": ("$.post.basic_desc['Stock Number']", "string"),
    "new_used": ("$.post.new_used", "initcap"),
    "title": ("$.post.title", "string"),
    "price": ("$.post.price", "numeric"),
    "monthly_payment": ("$.post.monthly_payment", "numeric"),
    "mileage": ("$.post.mileage", "integer"),
    "exterior_color": ("$.post.basic_desc['Exterior Color']", "string"),
    "interior_color": ("$.post.basic_desc['Interior Color']", "string"),
    "fuel_type": ("$.post.basic_desc['Fuel Type']", "string"),
    "engine": ("$.post.basic_desc.Engine", "string"),
    "mpg": ("$.post.basic_desc.MPG", "string"),
    "drivetrain": ("$.post.basic_desc.Drivetrain", "string"),
    "transmission": ("$.post.basic_desc.Transmission", "string"),
    "clean_title": ("$.post.user_history_des['Clean Title']", "bool:yes"),
    "has_accidents": ("$.post.user_history_des['Accidents or damage']", "bool:accident|damage reported|at least"),
    "is_one_owner": ("$.post.user_history_des['1-owner vehicle']", "bool:yes"),
    "is_personal_use": ("$.post.user_history_des['Personal use only']", "bool:yes"),
    "has_open_recall": ("$.post.user_history_des['Open recall']", "bool:at least|recall reported"),
    "warranty": ("$.post.warranty_des", "variant"),
}
# Rating categories of models and reviews.
RATING_PARTS = ("Comfort", "Interior", "Performance", "Value", "Exterior", "Reliability")
MODEL_SPEC = {
    "brand": ("$.car.brand", "string"),
    "car_name": ("$.car.car_name", "string"),
    "car_link": ("$.car.car_link", "string"),
    "review_link": ("$.car.review_link", "string"),
    "car_rating": ("$.car.car_rating", "numeric"),
    "car_rating_count": ("$.car.car_rating_count", "integer"),
    "percentage_recommend": ("$.car.percentage_recommend", "numeric"),
    **{f"rating_{p.lower()}": (f"$.car.ratings.{p}", "numeric") for p in RATING_PARTS},
}
SELLER_SPEC = {
    "seller_name": ("$.seller.seller_name", "string"),
    "seller_link": ("$.seller.seller_link", "string"),
    "seller_website": ("$.seller.seller_website", "string"),
    "destination": ("$.seller.destination", "string"),
    "seller_rating": ("$.seller.seller_rating", "numeric"),
    "seller_rating_count": ("$.seller.seller_rating_count", "integer"),
    "description": ("$.seller.description", "string"),
    "phone_new": ("$.seller.phone_info.New", "string"),
    "phone_used": ("$.seller.phone_info.Used", "string"),
    "phone_service": ("$.seller.phone_info.Service", "string"),
}
REVIEW_SPEC = {
    "overall_rating": ("$.overall_rating", "numeric"),
    "review_time_raw": ("$.time", "string"),
    "user_name": ("$.user_name", "string"),
    "reviewer_from": ("$.from", "string"),
    "review_title": ("$.title", "string"),
    "review_text": ("$.review", "string"),
    **{f"rb_{p.lower()}": (f"$.ratings_breakdown.{p}", "numeric") for p in RATING_PARTS},
}
# States of a listing.
CONDITIONS = ("New", "Used", "Certified")

_NEWEST = ("crawl_date", "ingested_at", "file_hash")


def _order() -> list[Column]:
    # Crawl time decides what is current; load time and the hash only break ties.
    return [F.col(c).desc_nulls_last() for c in _NEWEST]


@dataclass(frozen=True)
class Current:
    """Newest landed document per vehicle, model and seller. All core tables derive from these."""

    listing: DataFrame
    model: DataFrame
    seller: DataFrame


@dataclass(frozen=True)
class Core:
    """Current state in normal form."""

    listings: DataFrame
    models: DataFrame
    ratings: DataFrame
    sellers: DataFrame
    reviews: DataFrame
    features: DataFrame
    listing_features: DataFrame
    images: DataFrame


# ---- current views -------------------------------------------------------------------


def with_keys(landing: DataFrame) -> DataFrame:
    return landing.withColumn("seller_key", nested.text_at(F.col("payload"), "$.seller.seller_key"))


#: Key of the newest documents of each kind.
CURRENT_KEYS = {"listing": "vin", "model": "car_model_slug", "seller": "seller_key"}


def newest(landing: DataFrame, kind: str, before: DataFrame | None = None) -> DataFrame:
    """Newest document per key of a kind, of new landed rows and those that were newest before."""
    rows = with_keys(landing)
    rows = rows if before is None else rows.unionByName(before)
    return latest.latest_per_key(rows, [CURRENT_KEYS[kind]], _order())


def current(landing: DataFrame) -> Current:
    return Current(**{kind: newest(landing, kind) for kind in CURRENT_KEYS})


def listings(current: DataFrame) -> DataFrame:
    keep = ["vin", "car_model_slug", "crawl_date", "source", "crawled_at", "file_path"]
    return nested.flatten(current, "payload", LISTING_SPEC, keep)


def models(newest_models: DataFrame) -> DataFrame:
    """Newest model record per slug."""
    return nested.flatten(newest_models, "payload", MODEL_SPEC, ["car_model_slug"])


def sellers(newest_sellers: DataFrame) -> DataFrame:
    """Newest seller record per key; opening hours and highlights stay semi-structured."""
    parts = newest_sellers.withColumns({
        "hours": nested.keep_if_object(F.col("payload"), "$.seller.hours"),
        "highlights": nested.keep_if_array(F.col("payload"), "$.seller.highlights"),
    })
    return nested.flatten(parts, "payload", SELLER_SPEC, ["seller_key", "hours", "highlights"])


def reviews(newest_models: DataFrame) -> DataFrame:
    """Reviews of the newest record per model, one row per content key."""
    rows = nested.explode_records(newest_models, "payload", "$.car.reviews", REVIEW_SPEC, ["car_model_slug"])
    keyed = rows.withColumns({
        "review_sk": content_key(
            F.col("car_model_slug"), F.col("user_name"), F.col("review_time_raw"), F.col("review_title"), text=F.col("review_text")
        ),
        "review_date": parse_us_date(F.col("review_time_raw")),
    })
    return latest.dedupe(keyed, ["review_sk"])


def listing_features(current: DataFrame) -> DataFrame:
    return nested.explode_categories(current, "payload", "$.post.feature_des", ["vin"], "feature_category", "feature_name")


def listing_images(current: DataFrame) -> DataFrame:
    images = F.try_variant_get("payload", "$.post.image", "array<string>")
    return nested.explode_ordered(current, images, ["vin"], "image_order", "image_url")


# ---- core tables ---------------------------------------------------------------------


def build_core(now: Current) -> Core:
    current = now.listing
    slug, seller = F.col("car_model_slug"), F.col("seller_key")
    fact = listings(current).withColumns({
        "listing_sk": surrogate_key(F.col("vin")), "car_model_sk": surrogate_key(slug),
        "seller_sk": surrogate_key(seller), "last_updated_date": F.col("crawl_date"),
    })
    model = models(now.model).withColumn("car_model_sk", surrogate_key(slug))
    rating_columns = ["car_rating", "car_rating_count", "percentage_recommend", *[f"rating_{p.lower()}" for p in RATING_PARTS]]
    exploded = listing_features(current)
    pair = ["feature_category", "feature_name"]
    feature = exploded.select(*pair).distinct().withColumn("feature_sk", surrogate_key(*[F.col(c) for c in pair]))
    bridge = marts.build_bridge(exploded, feature, fact, pair, surrogate_key(F.col("vin")), "listing_sk", "feature_sk")
    images = marts.restrict_to_parents(listing_images(current), fact, surrogate_key(F.col("vin")), "listing_sk")
    return Core(
        listings=fact,
        models=model.select("car_model_sk", "car_model_slug", "brand", "car_name", "car_link", "review_link"),
        ratings=model.select("car_model_sk", "car_model_slug", *rating_columns),
        sellers=sellers(now.seller).withColumn("seller_sk", surrogate_key(seller)),
        reviews=reviews(now.model).withColumn("car_model_sk", surrogate_key(slug)),
        features=feature,
        listing_features=bridge,
        images=images.withColumn("listing_sk", surrogate_key(F.col("vin"))),
    )


# ---- marts ---------------------------------------------------------------------------


def vehicles(core: Core, load_date: Column) -> DataFrame:
    """One wide row per listing. `first_seen_date` is kept by `tables.merge_by_key` on later loads."""
    images = marts.child_count_and_first(core.images, "listing_sk", "image_order", "image_url")
    counts = marts.child_counts(core.listing_features, "listing_sk", "feature_count")
    seller = core.sellers.select("seller_sk", "seller_name", "seller_link", "destination", "seller_rating", "seller_rating_count")
    wide = marts.star_join(
        core.listings,
        [
            (core.models.drop("car_model_slug"), "car_model_sk", "car_model_sk"),
            (core.ratings.drop("car_model_slug"), "car_model_sk", "car_model_sk"),
            (seller, "seller_sk", "seller_sk"), (images, "listing_sk", "listing_sk"), (counts, "listing_sk", "listing_sk"),
        ],
        counts=["image_count", "feature_count"],
    )
    renamed = wide.withColumnRenamed("car_model_slug", "car_model")
    return renamed.withColumns({
        "vehicle_id": F.col("vin"), "condition": F.col("new_used"), "vehicle_url": F.col("car_link"),
        "first_seen_date": F.coalesce("crawl_date", load_date),
        **{f"{p.lower()}_rating": F.col(f"rating_{p.lower()}") for p in RATING_PARTS},
    })


def car_models(core: Core) -> DataFrame:
    rolled = marts.entity_rollup(core.listings, "car_model_sk", "price")
    written = marts.child_counts(core.reviews, "car_model_sk", "review_count")
    dims = [(core.ratings.drop("car_model_slug"), "car_model_sk", "car_model_sk"), (rolled, "car_model_sk", "car_model_sk"),
            (written, "car_model_sk", "car_model_sk")]
    out = marts.star_join(core.models, dims, counts=["listing_count", "review_count"])
    return out.withColumnRenamed("car_model_slug", "car_model")


def seller_mart(core: Core) -> DataFrame:
    rolled = marts.entity_rollup(core.listings, "seller_sk", "price").select(
        "seller_sk", F.col("listing_count").alias("inventory_count"), F.col("avg_price").alias("avg_listing_price")
    )
    return marts.star_join(core.sellers, [(rolled, "seller_sk", "seller_sk")], counts=["inventory_count"])


def review_mart(core: Core) -> DataFrame:
    names = core.models.select("car_model_sk", "brand", "car_name")
    return marts.star_join(core.reviews, [(names, "car_model_sk", "car_model_sk")]).withColumnRenamed("car_model_slug", "car_model")


def vehicle_features(core: Core) -> DataFrame:
    cols = {"vehicle_id": "vin", "feature_category": "feature_category", "feature_name": "feature_name"}
    facts = core.listings.select("listing_sk", "vin")
    return marts.denormalize(core.listing_features, (facts, "listing_sk"), (core.features, "feature_sk"), cols)


def vehicle_images(core: Core) -> DataFrame:
    """Images with a dense id over (vehicle, order)."""
    rows = core.images.select(F.col("vin").alias("vehicle_id"), "image_order", "image_url")
    return latest.global_ids(rows, ["vehicle_id", "image_order"])


def merged_vehicles(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Upsert into the mart; the first sighting of a known vehicle stays."""
    return new if old is None else tables.merge_by_key(old, new, ["vin"], keep=["first_seen_date"])


def price_state(core: Core) -> DataFrame:
    """What the change log tracks."""
    return core.listings.select("vin", "price", "mileage", F.col("new_used").alias("status"), "crawl_date")


# ---- checks --------------------------------------------------------------------------


def load_checks(landing: DataFrame, core: Core, marts_: dict[str, DataFrame], events: DataFrame | None, as_of: Column) -> DataFrame:
    """The checks of a load as one report."""
    q = quality
    reports = [
        q.check_freshness(landing, "ingested_at", as_of),
        q.check_not_null(landing, {"file_hash": q.ERROR, "payload": q.ERROR}),
        q.check_unique(landing, "file_hash"),
        q.check_not_null(core.listings, {"listing_sk": q.ERROR, "vin": q.ERROR, "price": q.WARN}),
        q.check_accepted_values(core.listings, "new_used", CONDITIONS, q.WARN),
        q.check_relationship(core.listings, "car_model_sk", core.models, "car_model_sk"),
        q.check_relationship(core.listings, "seller_sk", core.sellers, "seller_sk"),
        q.check_relationship(core.ratings, "car_model_sk", core.models, "car_model_sk"),
        q.check_relationship(core.reviews, "car_model_sk", core.models, "car_model_sk"),
        q.check_relationship(core.listing_features, "listing_sk", core.listings, "listing_sk"),
        q.check_relationship(core.listing_features, "feature_sk", core.features, "feature_sk"),
        q.check_relationship(core.images, "listing_sk", core.listings, "listing_sk"),
        q.check_accepted_values(marts_["vehicles"], "new_used", CONDITIONS, q.WARN),
        q.check_not_null(marts_["vehicle_features"], {"vehicle_id": q.ERROR}),
        q.check_not_null(marts_["vehicle_images"], {"vehicle_id": q.ERROR}),
        q.check_not_null(marts_["price_history"], {"vin": q.ERROR, "crawl_date": q.ERROR}),
    ]
    for frame, keys in (
        (core.listings, ("listing_sk", "vin")), (core.models, ("car_model_sk", "car_model_slug")), (core.ratings, ("car_model_sk",)),
        (core.sellers, ("seller_sk", "seller_key")), (core.features, ("feature_sk",)), (core.reviews, ("review_sk",)),
        (marts_["vehicles"], ("vehicle_id", "vin")), (marts_["car_models"], ("car_model",)), (marts_["sellers"], ("seller_key",)),
        (marts_["reviews"], ("review_sk",)),
    ):
        reports.append(q.check_not_null(frame, {k: q.ERROR for k in keys}))
        reports.extend(q.check_unique(frame, k) for k in keys)
    if events is not None:
        lost = marts.orphans(events.select("vehicle_id"), marts_["vehicles"].select(F.col("vehicle_id").alias("_v")), "vehicle_id", "_v")
        reports.append(q.check_no_rows(lost, "no_orphan_interactions", "vehicle_id", q.WARN))
    return q.union_reports(reports)
