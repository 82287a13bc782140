"""Per-user memories: merging facts in, searching, capping and expiring. Every key holds tenant and user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import good_fact, good_update
from .maintain import delete
from .retrieval import nearest, top

OWNER = ["tenant", "user"]
# What stands around the date in the first line of remembered things.
REMEMBERED = ("关于该用户的已知信息 (截至 ", ", 可能已过时, 以用户当前说法为准):")


def operations(facts: DataFrame, stored: DataFrame) -> DataFrame:
    """What each new fact does: UPDATE the memory of its slot, NOOP where the text is there already, else ADD.

    ``facts``: tenant, user, seq, key, text, importance; of a slot's facts in one round the last
    (seq) counts. A fact without a key, or with an empty one, has no slot: it matches no memory
    and no other fact, and is an ADD of its own. Facts that say nothing are skipped. Only the
    owner's memories are looked at.
    """
    sane = facts.where(good_fact(F.col("text"), F.col("key"))).where(F.col("user") != "")
    has_slot = F.coalesce(F.col("key") != "", F.lit(False))
    newest = top(sane.where(has_slot), [*OWNER, "key"], [F.desc("seq"), F.asc("text")], 1, "n").drop("n")
    slot = stored.where(has_slot).groupBy(*OWNER, "key").agg(F.min("memory_id").alias("target_id"), F.min_by("text", "memory_id").alias("old_text"))
    op = F.when(F.col("target_id").isNull(), "ADD").when(F.col("old_text") == F.col("text"), "NOOP").when(good_update(F.col("text"), F.col("key")), "UPDATE").otherwise("SKIP")
    names = [*OWNER, "key", "seq", "text", "importance"]
    slotted = newest.join(slot, [*OWNER, "key"], "left").select(*names, "target_id", op.alias("op"))
    free = sane.where(~has_slot).select(*names, F.lit(None).cast(dict(stored.dtypes)["memory_id"]).alias("target_id"), F.lit("ADD").alias("op"))
    return slotted.unionByName(free)


def merge(stored: DataFrame, ops: DataFrame, now: Column) -> DataFrame:
    """``stored`` (tenant, user, memory_id, key, text, importance, updated_at) after the operations.

    An operation on a memory that its user doesn't own does nothing. DELETE removes; a null
    text, key or importance of an UPDATE keeps the old one. New ids come from the fact and its
    place (seq), so that a rerun gives the same ones and equal facts stay apart.
    """
    change = ops.where("op in ('UPDATE', 'DELETE')").select(*OWNER, F.col("target_id").alias("memory_id"), "op", F.col("key").alias("n_key"), F.col("text").alias("n_text"), F.col("importance").alias("n_importance"))
    kept = stored.join(change, [*OWNER, "memory_id"], "left").where(~F.col("op").eqNullSafe("DELETE"))
    updated = F.col("op").eqNullSafe("UPDATE")
    old = kept.select(
        *OWNER, "memory_id", F.coalesce("n_key", "key").alias("key"), F.coalesce("n_text", "text").alias("text"),
        F.coalesce("n_importance", "importance").alias("importance"), F.when(updated, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*OWNER, "key", "text", *(["seq"] if "seq" in ops.columns else []))]
    new_id = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 16)
    added = ops.where("op = 'ADD' and text is not null").select(*OWNER, new_id.alias("memory_id"), "key", "text", "importance", now.alias("updated_at"))
    return old.unionByName(added)


def capped(stored: DataFrame, limit: int = 200) -> DataFrame:
    """Each user's best memories by importance, then by time; exact, over all of them."""
    return top(stored, OWNER, [F.desc("importance"), F.desc("updated_at"), F.asc("memory_id")], limit, "place")


def live(stored: DataFrame, now: Column, days: int = 180) -> DataFrame:
    """Memories that were updated in the last ``days`` days; the only operation over all owners."""
    return stored.where(F.col("updated_at") >= now - F.expr(f"INTERVAL {days} DAYS")) if days else stored


def search(stored: DataFrame, queries: DataFrame, k: int, weight: float = 0.15) -> DataFrame:
    """query_id, id, similarity, boosted, place: the 4k nearest of the owner, then k by similarity + weight * importance.

    ``stored``: id, tenant (any column that names the owner), vector, importance.
    """
    near = nearest(stored, queries, 4 * k).withColumn("similarity", F.round("similarity", 4))
    boosted = near.join(stored.select("id", "importance"), "id").withColumn("boosted", F.round(F.col("similarity") + weight * F.col("importance"), 6))
    return top(boosted, "query_id", [F.desc("boosted"), F.asc("id")], k, "place").drop("rank", "importance")


def important(facts: DataFrame, least: float = 0.3) -> DataFrame:
    """Facts worth keeping; one without an importance isn't."""
    return facts.where(F.col("importance") >= least)


def fallback_importance(facts: DataFrame, by: list[str]) -> DataFrame:
    """``facts`` with the importance that an operation without its own gets: the largest of its round."""
    return facts.withColumn("fallback", F.max("importance").over(Window.partitionBy(*by)))


def newest(stored: DataFrame, n: int = 100) -> DataFrame:
    """Each user's ``n`` memories that were updated last, newest first (place)."""
    return top(stored, OWNER, [F.desc("updated_at"), F.asc("memory_id")], n, "place")


def prompt_block(found: DataFrame, today: Column) -> DataFrame:
    """query_id, prompt: what is remembered (kind, text, place) as lines below a line with today's date; no row where nothing is."""
    lines = F.array_sort(F.collect_list(F.struct("place", F.format_string("- [%s] %s", "kind", "text").alias("line"))))  # k entries a query
    head = F.concat(F.lit(REMEMBERED[0]), F.date_format(today, "yyyy-MM-dd"), F.lit(REMEMBERED[1] + "\n"))
    return found.groupBy("query_id").agg(F.concat(head, F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("prompt"))


def forget(stored: DataFrame, gone: DataFrame, one: bool = True) -> DataFrame:
    """``stored`` without the memories in ``gone`` (tenant, user, memory_id), or without all of its users' where not ``one``.

    A memory of another user stays, whatever its id, and an empty or null user removes nothing.
    """
    named = gone.where(F.col("user") != "")
    return delete(stored, named, [*OWNER, "memory_id"] if one else OWNER)


def recalled(found: DataFrame, floor: float = 0.35) -> DataFrame:
    """The floor comes after the cut to k."""
    return found.where(F.col("similarity") >= floor)


def counts(ops: DataFrame) -> DataFrame:
    """What the operations of each user's round come to."""
    kinds = {"added": "ADD", "updated": "UPDATE", "deleted": "DELETE", "skipped": "SKIP", "unchanged": "NOOP"}
    return ops.groupBy(*OWNER).agg(F.count("*").alias("extracted"), *[F.count_if(F.col("op") == v).alias(k) for k, v in kinds.items()])
