"""Per-session and per-user state folded from event tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import top_n_per_key

# Slots a search needs before it can run, and the branch of each intent.
REQUIRED_SLOTS = ("budget_max", "body_type", "fuel_type")
INTENT_BRANCH = {
    "compare": "compare_retrieve", "analytics": "analytics_retrieve", "specs": "spec_retrieve",
    "specific": "hybrid_retrieve", "off_topic": "redirect_topic",
}


def fold_slots(updates: DataFrame, session: str, turn: str, slots: Sequence[str]) -> DataFrame:
    """Last non-null value of every slot per session, as one combinable aggregate."""
    last = [
        F.max_by(F.col(s), F.when(F.col(s).isNotNull(), F.col(turn))).alias(s) for s in slots
    ]
    return updates.groupBy(session).agg(*last)


def fold_list(updates: DataFrame, session: str, turn: str, values: str, out: str | None = None) -> DataFrame:
    """Distinct list values per session in first-seen order; NULL and '' are left out.

    Each value keeps only its first sighting before anything is collected, so repeats
    of a long session never reach the final task.
    """
    exploded = updates.select(session, turn, F.posexplode(values).alias("_pos", "_value"))
    first = exploded.filter(F.col("_value") != "").groupBy(session, "_value").agg(
        F.min(F.struct(turn, "_pos")).alias("_seen")
    )
    ordered = F.array_sort(F.collect_list(F.struct("_seen", "_value")))
    return first.groupBy(session).agg(F.transform(ordered, lambda p: p["_value"]).alias(out or values))


def fold_profile(
    updates: DataFrame, session: str, turn: str, slots: Sequence[str], lists: Sequence[str]
) -> DataFrame:
    """One profile row per session: latest slots and accumulated lists (empty when none)."""
    profile = fold_slots(updates, session, turn, slots)
    for name in lists:
        profile = profile.join(fold_list(updates, session, turn, name), session, "left")
        profile = profile.withColumn(name, F.coalesce(F.col(name), F.array().cast("array<string>")))
    return profile


def missing_slots(required: Sequence[str] = REQUIRED_SLOTS) -> Column:
    """Names of the required slots that are NULL."""
    names = [F.when(F.col(s).isNull(), F.lit(s)) for s in required]
    return F.array_compact(F.array(*names))


def route_intent(intent: Column, slots_missing: Column) -> Column:
    """Branch that answers a turn; a vague request asks for slots until none is missing."""
    table = F.create_map(*[F.lit(x) for pair in INTENT_BRANCH.items() for x in pair])
    vague = F.when(F.size(slots_missing) == 0, "hybrid_retrieve").otherwise("ask_slot")
    return F.when(intent == "vague", vague).otherwise(F.coalesce(F.try_element_at(table, intent), F.lit("consult")))


def recent_messages(messages: DataFrame, session: str, turn: Sequence[str], n: int = 10) -> DataFrame:
    """The last `n` messages of every session."""
    return top_n_per_key(messages, [session], [F.col(c).desc_nulls_last() for c in turn], n)


def current_favorites(
    actions: DataFrame, user: str, item: str, action: str, order: Sequence[Column], added: str = "add"
) -> DataFrame:
    """(user, item) pairs whose latest action is an add; repeated adds and removes are idempotent."""
    last = top_n_per_key(actions, [user, item], order, 1)
    return last.filter(F.col(action) == added)


def favorite_events(
    favorites: DataFrame, user: str, item: str, ts: str, score: float = 2.0, kind: str = "favorite"
) -> DataFrame:
    """The weighted interaction that an add emits."""
    return favorites.select(
        F.col(user).alias("user_id"), F.col(item).alias("item_id"), F.lit(kind).alias("interaction_type"),
        F.lit(score).alias("interaction_score"), F.col(ts).alias("created_at"),
    )


def normalize_events(events: DataFrame, columns: Mapping[str, Column], score: Column, default: float = 1.0) -> DataFrame:
    """Canonical interaction rows; a missing score is `default`."""
    return events.select(
        *[col.alias(name) for name, col in columns.items()],
        F.coalesce(score.cast("double"), F.lit(default)).alias("interaction_score"),
    )


def distinct_favorites(favorites: DataFrame, user: str, item: str, catalogue: DataFrame, item_key: str) -> DataFrame:
    """Distinct items per user that are still in the catalogue."""
    pairs = favorites.select(user, item).distinct()
    return pairs.join(catalogue, pairs[item] == catalogue[item_key], "left_semi")
