"""Similarity, recall, ranking, re-ranking and evaluation on the shared tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RecoConfig
from ..operators import evaluation, ranking, recall, rerank, rollups, similarity, vectors
from . import recommend, roles
from .registry import Tables, query

CFG = RecoConfig(interaction_weights=roles.WEIGHTS, content_weights=roles.CONTENT, price_band=0.01)


def _similarity(t: Tables, top_n: int = 50) -> DataFrame:
    return similarity.item_similarity(
        roles.interactions(t), "user", "item", "kind", "ts", roles.as_of(), roles.WEIGHTS,
        CFG.time_decay_lambda, CFG.lookback_days, top_n,
    )


def _popular(t: Tables) -> DataFrame:
    rolled = rollups.popularity(
        roles.items(t), roles.interactions(t), "item", "item", "kind", "score", "ts", roles.as_of(), roles.COUNTERS
    )
    return rolled.withColumn("pop", F.col("pop_score_30d") + F.coalesce("rating", F.lit(0.0)))


def _embeddings(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))


def _inputs(t: Tables) -> recommend.Inputs:
    return recommend.Inputs(roles.items(t), _popular(t), _similarity(t), _embeddings(t), "pop")


def _seeds(t: Tables) -> DataFrame:
    return recall.user_seeds(roles.interactions(t), "user", "item", "kind", "ts", "event_id", CFG.history_limit)


# ---- SQL pieces, one CTE per stage ---------------------------------------------------

_SIM = f"""cells AS (SELECT "user", item, sum({roles.WEIGHT} * {roles.decay()}) AS w FROM ev WHERE ts >= TIMESTAMP '2024-01-31' - to_days(180) GROUP BY 1, 2),
norms AS (SELECT item, sqrt(sum(w * w)) AS norm FROM cells GROUP BY 1),
unit AS (SELECT "user", item, CAST(round(w / norm * 1000000000) AS BIGINT) AS x FROM cells JOIN norms USING (item)),
pairs AS (SELECT a.item, b.item AS neighbor, sum(a.x * b.x) AS s FROM unit a JOIN unit b ON a."user" = b."user" AND a.item <> b.item GROUP BY 1, 2),
sim AS (SELECT item, neighbor, CAST(s AS DOUBLE) / 1e18 AS score, row_number() OVER (PARTITION BY item ORDER BY s DESC, neighbor) AS rank FROM pairs WHERE s > 0 QUALIFY rank <= 50)"""
_SEEDS = """seeds AS (SELECT "user" AS request, item, kind, ts, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, event_id DESC) AS recency FROM ev QUALIFY recency <= 50),
seen AS (SELECT DISTINCT request, item FROM seeds),
recent AS (SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY min(recency)) AS n FROM seeds GROUP BY request, item QUALIFY n <= 3)"""
_CF = f"""pull AS (SELECT request, item, sum({roles.WEIGHT} * {roles.decay()}) AS pull FROM seeds GROUP BY 1, 2),
cf0 AS (SELECT request, neighbor AS item, sum(pull * score) AS s FROM pull JOIN sim USING (item) WHERE rank <= 20 GROUP BY 1, 2),
cf1 AS (SELECT cf0.* FROM cf0 ANTI JOIN seen USING (request, item)),
cf AS (SELECT request, item, s / max(s) OVER (PARTITION BY request) AS score FROM cf1)"""


def _content_sql(seeds: str) -> str:
    return f"""cn0 AS (SELECT a.item AS seed, b.item, b.rating, round(
  (CASE WHEN a.brand = b.brand THEN 2.0 ELSE 0 END + CASE WHEN a.model = b.model THEN 1.5 ELSE 0 END + CASE WHEN a.fuel = b.fuel THEN 0.5 ELSE 0 END
   + CASE WHEN a.transmission = b.transmission THEN 0.5 ELSE 0 END + CASE WHEN a.drivetrain = b.drivetrain THEN 0.3 ELSE 0 END
   + CASE WHEN b.price BETWEEN a.price * (1 - 0.01) AND a.price * (1 + 0.01) THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS score
  FROM items a JOIN items b ON a.item <> b.item WHERE a.item IN (SELECT item FROM {seeds})),
cn AS (SELECT seed, item, score, row_number() OVER (PARTITION BY seed ORDER BY score DESC, rating DESC NULLS LAST, item) AS n FROM cn0 WHERE score > 0 QUALIFY n <= 150)"""


_CONTENT = """content0 AS (SELECT request, cn.item, max(score) AS s FROM recent JOIN cn ON recent.item = seed GROUP BY 1, 2),
content AS (SELECT request, item, s / max(s) OVER (PARTITION BY request) AS score FROM content0)"""


def _vector_sql(k: int) -> str:
    return f"""vec AS (SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nrm AS (SELECT item, v, sqrt(list_dot_product(v, v)) AS len FROM vec),
vn AS (SELECT a.item AS seed, b.item, round(list_dot_product(a.v, b.v) / (a.len * b.len), 9) AS score,
  row_number() OVER (PARTITION BY a.item ORDER BY round(list_dot_product(a.v, b.v) / (a.len * b.len), 9) DESC, b.item) AS n
  FROM nrm a JOIN nrm b ON a.item <> b.item QUALIFY n <= {k})"""


_VECTOR = """vector0 AS (SELECT request, vn.item, max(score) AS s FROM recent JOIN vn ON recent.item = seed GROUP BY 1, 2),
vector AS (SELECT request, item, CASE WHEN max(s) OVER (PARTITION BY request) > 0 THEN s / max(s) OVER (PARTITION BY request) ELSE 0 END AS score FROM vector0)"""
_POP = """pop0 AS (SELECT i.item, i.brand, round(coalesce(p, 0) + coalesce(rating, 0), 6) AS score FROM items i
  LEFT JOIN (SELECT item, sum(score) AS p FROM ev WHERE ts > TIMESTAMP '2024-01-01' GROUP BY 1) USING (item)),
overall AS (SELECT item, score FROM pop0 ORDER BY score DESC, item LIMIT 100),
own AS (SELECT brand, item, score, row_number() OVER (PARTITION BY brand ORDER BY score DESC, item) AS n FROM pop0 QUALIFY n <= 100),
filled AS (SELECT brand, item, score FROM own UNION ALL
  SELECT b.brand, o.item, o.score FROM (SELECT brand FROM own GROUP BY 1 HAVING count(*) < 100) b, overall o WHERE (b.brand, o.item) NOT IN (SELECT brand, item FROM own)),
lists AS (SELECT brand, item, score / max(score) OVER (PARTITION BY brand) AS score FROM filled),
popularity AS (SELECT request, lists.item, lists.score FROM seeds JOIN items ON seeds.item = items.item JOIN lists ON lists.brand = items.brand WHERE recency = 1)"""
_POOL = """pool0 AS (SELECT request, item, coalesce(max(cf), 0) AS cf_score, coalesce(max(co), 0) AS content_score, coalesce(max(ve), 0) AS vector_score, coalesce(max(po), 0) AS popularity,
  concat_ws(',', CASE WHEN max(cf) IS NOT NULL THEN 'collaborative' END, CASE WHEN max(co) IS NOT NULL THEN 'content' END, CASE WHEN max(ve) IS NOT NULL THEN 'vector' END, CASE WHEN max(po) IS NOT NULL THEN 'popularity' END) AS sources
  FROM (SELECT request, item, score AS cf, NULL::DOUBLE AS co, NULL::DOUBLE AS ve, NULL::DOUBLE AS po FROM cf UNION ALL SELECT request, item, NULL, score, NULL, NULL FROM content
    UNION ALL SELECT request, item, NULL, NULL, score, NULL FROM vector UNION ALL SELECT request, item, NULL, NULL, NULL, score FROM popularity) GROUP BY 1, 2),
pool AS (SELECT *, round(cf_score + content_score + vector_score + popularity, 9) AS pre_score,
  row_number() OVER (PARTITION BY request ORDER BY round(cf_score + content_score + vector_score + popularity, 9) DESC, item) AS n FROM pool0 QUALIFY n <= 300)"""
_RANKED = f"""hist AS (SELECT request, least(1.0, count(*) / 20.0)::DOUBLE AS cf_scale FROM seeds GROUP BY 1),
budget AS (SELECT request, avg(price) AS budget FROM seen JOIN items USING (item) GROUP BY 1),
feat AS (SELECT pool.*, brand, model, price, cf_scale, coalesce(rating, 0) / 5.0 AS model_rating, greatest(0.0, 1 - least(1.0, abs(price - budget) / budget)) AS price_fit,
  {roles.decay("crawled_at", 0.023)} AS recency FROM pool ANTI JOIN seen USING (request, item) JOIN items USING (item) JOIN hist USING (request) JOIN budget USING (request)),
ranked AS (SELECT *, round(3.0 * cf_scale * cf_score + 1.5 * content_score + 2.0 * vector_score + popularity + price_fit + 0.8 * model_rating + 0.5 * recency, 9) AS rank_score FROM feat)"""

_ALL = f"{roles.ITEMS}, {roles.INTERACTIONS}, {_SIM}, {_SEEDS}, {_CF}, {_content_sql('recent')}, {_CONTENT}, {_vector_sql(100)}, {_VECTOR}, {_POP}, {_POOL}"

# ---- stage 0: similarity -------------------------------------------------------------


@query(f"""
WITH {roles.INTERACTIONS}
SELECT "user", item, round(sum({roles.WEIGHT} * {roles.decay()}), 6) AS weight FROM ev WHERE ts >= TIMESTAMP '2024-01-31' - to_days(20) GROUP BY 1, 2""")
def preference_cells(t: Tables) -> DataFrame:
    cells = similarity.preference_cells(
        roles.interactions(t), "user", "item", "kind", "ts", roles.as_of(), roles.WEIGHTS, 0.05, 20
    )
    return cells.withColumn("weight", F.round("weight", 6))


@query(f"WITH {roles.INTERACTIONS}, {_SIM} SELECT item, neighbor, round(score, 6) AS score, rank FROM sim")
def item_similarity(t: Tables) -> DataFrame:
    near = _similarity(t)
    return near.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("bigint")})


_BOTS = f"""shoppers AS (SELECT * FROM ev UNION ALL
  SELECT -item, b AS "user", item, CASE WHEN item % 4 = b % 4 THEN 'purchase' ELSE 'view' END, 0, TIMESTAMP '2024-01-20'
  FROM items, (VALUES (-1), (-2)) bots(b) WHERE item BETWEEN CASE b WHEN -1 THEN 1 ELSE 501 END AND CASE b WHEN -1 THEN 1000 ELSE 1500 END)"""


@query(f"""WITH {roles.INTERACTIONS}, {roles.ITEMS}, {_BOTS}, {_SIM.replace("FROM ev", "FROM shoppers")}
SELECT item, neighbor, round(score, 6) AS score, rank FROM sim""")
def bot_similarity(t: Tables) -> DataFrame:
    """Item similarity with two bots among the users, who look at a thousand items each, half of them the same."""
    item = F.col("item")
    bots = roles.items(t).select("item", F.explode(F.array(F.lit(-1), F.lit(-2))).alias("user"))
    bots = bots.filter(item.between(F.when(F.col("user") == -1, 1).otherwise(501), F.when(F.col("user") == -1, 1000).otherwise(1500)))
    seen = bots.select(
        (-item).alias("event_id"), F.col("user").cast("bigint").alias("user"), "item",
        F.when(item % 4 == F.col("user") % 4, "purchase").otherwise("view").alias("kind"), F.lit(0.0).alias("score"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz").alias("ts"),
    )
    near = similarity.item_similarity(
        roles.interactions(t).unionByName(seen), "user", "item", "kind", "ts", roles.as_of(), roles.WEIGHTS, CFG.time_decay_lambda, CFG.lookback_days, 50,
    )
    return near.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("bigint")})


@query(f"""WITH {_vector_sql(10)} SELECT seed AS query, item AS id, round(score, 6) AS score, n AS rank FROM vn""")
def vector_neighbors(t: Tables) -> DataFrame:
    e = _embeddings(t)
    near = vectors.nearest_neighbors(e, e, 10, "item", "vector", "item", "vector", exclude_self=True)
    return near.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("bigint")})


# ---- stage 1: recall -----------------------------------------------------------------


@query(f"WITH {roles.INTERACTIONS}, {_SIM}, {_SEEDS}, {_CF} SELECT request, item, round(score, 6) AS score FROM cf")
def collaborative_recall(t: Tables) -> DataFrame:
    lists = recall.collaborative(_seeds(t), _similarity(t), roles.as_of(), roles.WEIGHTS)
    return lists.withColumn("score", F.round("score", 6))


@query(f"WITH {roles.ITEMS}, {_content_sql('items')} SELECT seed, item, score FROM cn")
def content_neighbors(t: Tables) -> DataFrame:
    catalogue = roles.items(t)
    return recall.content_neighbors(catalogue, catalogue.select("item"), roles.CONTENT, band=0.01)


@query(f"""WITH {roles.ITEMS}, {roles.INTERACTIONS}, {_SEEDS}, {_content_sql('recent')}, {_CONTENT} SELECT request, item, round(score, 6) AS score FROM content""")
def content_recall(t: Tables) -> DataFrame:
    recent = recall.recent_seed_items(_seeds(t))
    near = recall.content_neighbors(roles.items(t), recent.select("item"), roles.CONTENT, band=0.01)
    return recall.from_neighbors(recent, near).withColumn("score", F.round("score", 6))


@query(f"""WITH {roles.ITEMS}, {roles.INTERACTIONS}, {_SEEDS}, {_POP} SELECT request, item, round(score, 6) AS score FROM popularity""")
def popularity_recall(t: Tables) -> DataFrame:
    lists = recommend.popularity_table(recommend.Inputs(roles.items(t), _popular(t), popular_score="pop"), CFG)
    brands = recall.seed_brand(_seeds(t), roles.items(t), "item", "brand")
    return recall.popular(brands, lists).withColumn("score", F.round("score", 6))


@query(f"""WITH {roles.ITEMS}, {roles.INTERACTIONS}, {_SEEDS}
SELECT request, brand, round(budget, 4) AS budget, n_events FROM (SELECT request, brand FROM seeds JOIN items USING (item) WHERE recency = 1)
JOIN (SELECT request, avg(price) AS budget FROM seen JOIN items USING (item) GROUP BY 1) USING (request) JOIN (SELECT request, count(*) AS n_events FROM seeds GROUP BY 1) USING (request)""")
def request_context(t: Tables) -> DataFrame:
    seeds, catalogue = _seeds(t), roles.items(t)
    budget = recall.request_budget(seeds, catalogue, "item", "price")
    brand = recall.seed_brand(seeds, catalogue, "item", "brand")
    joined = brand.join(budget, "request").join(recall.request_history(seeds), "request")
    return joined.withColumn("budget", F.round("budget", 4))


# ---- stage 2: pool and rank ----------------------------------------------------------


@query(f"""WITH {_ALL} SELECT request, item, round(cf_score, 6) AS cf_score, round(content_score, 6) AS content_score, round(vector_score, 6) AS vector_score, round(popularity, 6) AS popularity, sources FROM pool""")
def candidate_pool(t: Tables) -> DataFrame:
    pool = ranking.candidate_pool(recommend.recall_lists(_seeds(t), _inputs(t), CFG, roles.as_of()), CFG.candidate_pool_size)
    scores = {c: F.round(c, 6) for c in ranking.SOURCE_COLUMNS.values()}
    return pool.select("request", "item", *[v.alias(k) for k, v in scores.items()], F.array_join("sources", ",").alias("sources"))


_SIGNALS = "greatest(cf_score, vector_score, content_score, popularity)"


@query(f"""
WITH {_ALL}, {_RANKED}
SELECT request, item, round(rank_score, 4) AS score, round(3.0 * cf_scale * cf_score, 4) AS cf_part, round(price_fit, 4) AS fit_part,
  CASE WHEN {_SIGNALS} <= 0 THEN 'Popular with other shoppers' WHEN cf_score = {_SIGNALS} THEN 'Similar to cars you engaged with'
    WHEN vector_score = {_SIGNALS} THEN 'Semantically similar to your interests' WHEN content_score = {_SIGNALS} THEN 'Same segment / specs as your picks'
    ELSE 'Popular with other shoppers' END AS reason
FROM ranked WHERE brand = 'Brand#3' AND price >= 905 AND price <= 990""")
def ranked_candidates(t: Tables) -> DataFrame:
    hard = recommend.Filters(equal={"brand": "Brand#3"}, at_least={"price": 905}, at_most={"price": 990})
    scored = recommend.ranked_for_users(roles.interactions(t), _inputs(t), CFG, roles.as_of(), hard)
    parts = ranking.explain(CFG.feature_weights, F.col("cf_scale"))
    return scored.select(
        "request", "item", F.round("rank_score", 4).alias("score"), parts["cf_score"].alias("cf_part"),
        parts["price_fit"].alias("fit_part"), ranking.reason().alias("reason"),
    )


@query(f"""
WITH {roles.INTERACTIONS}, {_SIM}, {_SEEDS}, {_CF}, {_vector_sql(100)}, {_VECTOR},
r AS (SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY round(score, 9) DESC, item) AS rank FROM cf
  UNION ALL SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY round(score, 9) DESC, item) FROM vector)
SELECT request, item, round(sum(1.0 / (60 + rank)), 6) AS score FROM r GROUP BY 1, 2""")
def fused_ranks(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    lists = recommend.recall_lists(_seeds(t), _inputs(t), replace(CFG, content=False, popularity=False), roles.as_of())
    w = Window.partitionBy("request").orderBy(F.round("score", 9).desc(), F.col("item"))
    ranked = {s: lists[s].withColumn("rank", F.row_number().over(w)) for s in ("collaborative", "vector")}
    return ranking.fuse_ranks(ranked).withColumn("score", F.round("score", 6))


# ---- stage 3 -------------------------------------------------------------------------


@query(f"""
WITH {roles.ITEMS}, scored AS (SELECT CAST(mileage % 7 AS BIGINT) AS request, item, brand, model, rating + price / 10000 AS score FROM items),
m AS (SELECT *, row_number() OVER (PARTITION BY request, model ORDER BY score DESC, item) AS rm FROM scored),
b AS (SELECT *, row_number() OVER (PARTITION BY request, brand ORDER BY score DESC, item) AS rb FROM m WHERE rm <= 2),
p AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS position FROM b WHERE rb <= 3)
SELECT request, item, position FROM p WHERE position <= 20""")
def capped_lists(t: Tables) -> DataFrame:
    """Pure relevance (lambda 1) with the brand and model caps, on the pool of the best items per request."""
    from ..operators.latest import top_n_per_key

    scored = roles.items(t).select(
        (F.col("mileage") % 7).cast("bigint").alias("request"), "item", "brand", "model",
        (F.col("rating") + F.col("price") / 10000).alias("score"),
    )
    # Only the best rows per model and brand can pass the caps, which bounds the pool.
    order = [F.col("score").desc(), F.col("item")]
    pool = top_n_per_key(top_n_per_key(scored, ["request", "model"], order, 2), ["request", "brand"], order, 3)
    picked = rerank.diversify(pool, "request", "score", "brand", "model", ["item"], 20, lam=1.0)
    return picked.select("request", "item", F.col("position").cast("bigint").alias("position"))


@query()
def recommended_for_users(t: Tables) -> DataFrame:
    users = t.customer.select(F.col("c_custkey").alias("user"))
    recs = recommend.recommend_for_users(users, roles.interactions(t), _inputs(t), CFG, roles.as_of())
    out = ranking.with_details(recs, roles.items(t), "item", ["title", "brand", "price"])
    return out.withColumn("sources", F.array_join("sources", ","))


@query()
def similar_items(t: Tables) -> DataFrame:
    recs = recommend.similar_items(_inputs(t), CFG, roles.as_of())
    return recs.withColumn("sources", F.array_join("sources", ","))


@query(f"""
WITH {roles.ITEMS}, {roles.INTERACTIONS}, {_SEEDS}, {_POP},
s AS (SELECT o.item, o.score / max(o.score) OVER () AS popularity, rating, crawled_at FROM overall o JOIN items USING (item)),
r AS (SELECT item, round(popularity + 1.0 + 0.8 * (rating / 5.0) + 0.5 * {roles.decay("crawled_at", 0.023)}, 9) AS rank_score, round(popularity, 9) AS pre FROM s)
SELECT item, round(rank_score, 4) AS score, row_number() OVER (ORDER BY rank_score DESC, pre DESC, item) AS position FROM r QUALIFY position <= 20""")
def popular_ranked(t: Tables) -> DataFrame:
    scored = recommend.ranked_popular(_inputs(t), CFG, roles.as_of())
    top = recommend.top_by_score(scored, 20)
    return top.select("item", F.round("rank_score", 4).alias("score"), F.col("position").cast("bigint").alias("position"))


# ---- evaluation ----------------------------------------------------------------------


@query(f"""
WITH {roles.INTERACTIONS}, act AS (SELECT "user", count(*) AS n FROM ev GROUP BY 1 HAVING count(*) >= 60),
held AS (SELECT "user", event_id FROM ev JOIN act USING ("user") QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, event_id DESC) = 1)
SELECT "user", h.event_id AS held_event, (SELECT count(*) FROM ev e WHERE e."user" = h."user") - 1 AS train_events FROM held h""")
def held_out_events(t: Tables) -> DataFrame:
    order = [F.col("ts").desc_nulls_last(), F.col("event_id").desc()]
    train, held = evaluation.leave_last_out(roles.interactions(t), "user", order, "event_id", 60)
    counts = train.groupBy("user").agg(F.count("*").alias("train_events"))
    return held.select("user", F.col("event_id").alias("held_event")).join(counts, "user")


_HELD = f"""{roles.ITEMS}, {roles.INTERACTIONS}, held AS (SELECT "user", event_id, item AS target FROM ev QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, event_id DESC) = 1),
recs AS (SELECT "user", item, row_number() OVER (PARTITION BY "user" ORDER BY w DESC, item) AS position FROM (SELECT "user", item, round(sum({roles.WEIGHT}), 6) AS w
  FROM ev WHERE event_id NOT IN (SELECT event_id FROM held) GROUP BY 1, 2) QUALIFY position <= 20),
j AS (SELECT recs."user", recs.position, i.brand, CAST(recs.item = target OR i.brand = ti.brand AS INTEGER) AS hit FROM recs JOIN held USING ("user") JOIN items i ON i.item = recs.item JOIN items ti ON ti.item = target),
m AS (SELECT "user", count(*) AS n, sum(hit) AS hits, sum(hit / log2(position + 1)) AS dcg, count(DISTINCT brand) / count(brand) AS div FROM j GROUP BY 1),
mm AS (SELECT *, CASE WHEN hits > 0 THEN dcg / list_sum(list_transform(range(1, CAST(hits AS BIGINT) + 1), lambda r: 1 / log2(r + 1))) ELSE 0 END AS capped FROM m)"""


def _judged(t: Tables) -> DataFrame:
    """Lists of each user's strongest items before the newest event, judged against that event."""
    from ..operators.latest import top_n_per_key
    from ..functions.scoring import type_weight

    order = [F.col("ts").desc_nulls_last(), F.col("event_id").desc()]
    train, held = evaluation.leave_last_out(roles.interactions(t), "user", order, "event_id", 1)
    strength = train.groupBy("user", "item").agg(F.round(F.sum(type_weight(F.col("kind"), roles.WEIGHTS)), 6).alias("w"))
    recs = top_n_per_key(strength, ["user"], [F.col("w").desc(), F.col("item")], 20, rank="position")
    return evaluation.judge(recs.select("user", "item", "position"), held, roles.items(t), "user", "item", "item", "brand")


@query(f"""
WITH {_HELD}
SELECT count(*) AS users_evaluated, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0 END), 4)::DOUBLE AS hit_rate, round(avg(hits / n), 4) AS precision,
  round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0 END), 4)::DOUBLE AS recall, round(avg(dcg), 4) AS ndcg, round(avg(capped), 4) AS ndcg_capped, round(avg(div), 4) AS diversity FROM mm""")
def list_quality(t: Tables) -> DataFrame:
    out = evaluation.summary(evaluation.list_metrics(_judged(t), "user", "position"))
    return out.select("users_evaluated", *[F.round(c, 4).alias(c) for c in out.columns if c != "users_evaluated"])


@query(f"""
WITH {_HELD} SELECT (SELECT count(DISTINCT item) FROM recs) AS recommended, round((SELECT count(DISTINCT item) FROM recs) / (SELECT count(*) FROM items), 6) AS coverage,
  (SELECT count(DISTINCT "user") FROM recs) AS lists, (SELECT round(avg(d), 6) FROM (SELECT count(DISTINCT brand) / count(*) AS d FROM j GROUP BY "user")) AS diversity""")
def catalogue_coverage(t: Tables) -> DataFrame:
    judged = _judged(t).join(roles.items(t).select("item", "brand"), "item")
    cover = evaluation.catalog_coverage(judged, roles.items(t), "item")
    spread = evaluation.list_diversity(judged, "user", "brand")
    diversity = F.round(spread.select("diversity").scalar(), 6).alias("diversity")
    lists = spread.select("lists").scalar().alias("lists")
    return cover.select("recommended", F.round("coverage", 6).alias("coverage"), lists, diversity)
