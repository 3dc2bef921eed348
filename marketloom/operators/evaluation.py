"""Offline evaluation of recommendation lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import top_n_per_key


def active_users(events: DataFrame, user: str, min_events: int) -> DataFrame:
    """Users with at least `min_events` events."""
    return events.groupBy(user).agg(F.count("*").alias("n_events")).filter(F.col("n_events") >= min_events)


def leave_last_out(
    events: DataFrame, user: str, order: Sequence[Column], event_id: str, min_events: int
) -> tuple[DataFrame, DataFrame]:
    """(training, held-out): the newest event of every active user is hidden from training."""
    users = active_users(events, user, min_events).select(user)
    held = top_n_per_key(events.join(users, user, "left_semi"), [user], order, 1)
    return events.join(held.select(event_id), event_id, "left_anti"), held


def judge(recs: DataFrame, held: DataFrame, items: DataFrame, user: str, item: str, item_key: str, group: str) -> DataFrame:
    """Recommendations of evaluated users with `hit`: the held-out item itself or one of its group."""
    groups = items.select(F.col(item_key).alias("_id"), F.col(group).alias("_group"))
    target = held.select(F.col(user), F.col(item).alias("_target"))
    target = target.join(groups.withColumnsRenamed({"_id": "_target", "_group": "_target_group"}), "_target", "left")
    listed = recs.join(target, user).join(groups, F.col(item) == F.col("_id"), "left")
    soft = F.coalesce(F.col("_group") == F.col("_target_group"), F.lit(False))
    hit = (F.col(item) == F.col("_target")) | soft
    return listed.withColumn("hit", hit.cast("int")).drop("_id", "_target", "_target_group")


def list_metrics(judged: DataFrame, user: str, rank: str) -> DataFrame:
    """Per list: hits, hit rate, precision, recall, NDCG as defined for one relevant item, capped NDCG, diversity.

    Group hits can be several, so the one-hit NDCG may exceed 1; `ndcg_capped` divides
    by the ideal order of the hits in the list.
    """
    gain = F.col("hit") / F.log2(F.col(rank) + 1)
    per = judged.groupBy(user).agg(
        F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum(gain).alias("dcg"),
        F.try_divide(F.count_distinct("_group"), F.count("_group")).alias("_div"),
    )
    ideal = F.aggregate(
        F.when(F.col("hits") > 0, F.sequence(F.lit(1), F.col("hits").cast("int"))).otherwise(F.array().cast("array<int>")),
        F.lit(0.0),
        lambda acc, r: acc + F.lit(1.0) / F.log2(r + 1),
    )
    any_hit = F.when(F.col("hits") > 0, 1.0).otherwise(0.0)
    return per.select(
        user, "n", "hits",
        any_hit.alias("hit_rate"), (F.col("hits") / F.col("n")).alias("precision"), any_hit.alias("recall"),
        F.col("dcg").alias("ndcg"), F.when(F.col("hits") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg_capped"),
        F.coalesce(F.col("_div"), F.lit(0.0)).alias("diversity"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Means over the evaluated lists."""
    names = ("hit_rate", "precision", "recall", "ndcg", "ndcg_capped", "diversity")
    return metrics.agg(F.count("*").alias("users_evaluated"), *[F.avg(c).alias(c) for c in names])


def catalog_coverage(recs: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """Distinct recommended items over catalogue size."""
    used = recs.agg(F.count_distinct(item).alias("recommended"))
    size = items.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    return used.select("recommended", (F.col("recommended") / size).alias("coverage"))


def list_diversity(recs: DataFrame, request: str, attribute: str) -> DataFrame:
    """Label-free quality: distinct attribute values over list length, averaged over the lists."""
    value = F.coalesce(F.col(attribute), F.lit("?"))
    per = recs.groupBy(request).agg((F.count_distinct(value) / F.count("*")).alias("_ratio"))
    return per.agg(F.count("*").alias("lists"), F.avg("_ratio").alias("diversity"))
