"""Merges of keyed records and folds of events into state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import first_of
from .scans import scanned

#: States of a field, from weakest to strongest claim.
STATES = ("default", "calculated", "derived", "imported", "user-modified")


def upsert_by_key(base: DataFrame, patch: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Rows of base with those of patch in their place; new keys go behind, in the patch's order."""
    place = base.select(key, F.col(seq).alias("__seq"))
    last = base.agg(F.coalesce(F.max(seq), F.lit(0)).alias("__last"))
    put = patch.join(place, key, "left").crossJoin(F.broadcast(last)).withColumn(seq, F.coalesce("__seq", F.col("__last") + F.col(seq) + 1)).drop("__seq", "__last")
    return base.join(patch.select(key), key, "left_anti").unionByName(put.select(*base.columns))


def deep_merge(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Every leaf takes the patch's value if it has one; arrays replace arrays, structs are merged leaf by leaf."""
    from pyspark.sql import types as T

    def leaf(kind, new: Column, old: Column) -> Column:
        if isinstance(kind, T.StructType):
            both = F.struct(*(leaf(f.dataType, new[f.name], old[f.name]).alias(f.name) for f in kind))
            return F.when(new.isNull() & old.isNull(), F.lit(None)).otherwise(both)
        return F.coalesce(new, old)

    a, b = base.alias("a"), patch.alias("b")
    joined = a.join(b, key, "full")
    there = {f.name for f in patch.schema}
    return joined.select(key, *(leaf(f.dataType, F.col(f"b.{f.name}"), F.col(f"a.{f.name}")).alias(f.name) if f.name in there else F.col(f"a.{f.name}") for f in base.schema if f.name != key))


def guarded_delete(rows: DataFrame, wanted: DataFrame, key: str, allowed: Column) -> DataFrame:
    """Rows without those that are wanted gone, as far as they may go."""
    gone = wanted.select(key).distinct().withColumn("__gone", F.lit(True))
    return rows.join(gone, key, "left").filter(~(F.coalesce("__gone", F.lit(False)) & allowed)).drop("__gone")


def latest_state(events: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last event of each key."""
    return first_of(events, [key], *order)


def change_only(events: DataFrame, key: str, values: list[str], *order: Column) -> DataFrame:
    """Events that change a value; an event that repeats its key's last values is dropped."""
    was = scanned(events, [key], list(order), {"__was": ("last", F.struct(*values))}, before=True)
    repeats = F.col("__was").isNotNull()
    for v in values:
        repeats = repeats & F.col(v).eqNullSafe(F.col(f"__was.{v}"))
    return was.filter(~repeats).drop("__was")


def sticky_merge(current: DataFrame, incoming: DataFrame, key: str, value: str = "value", state: str = "state", new_state: str = "derived") -> DataFrame:
    """Incoming values take the place of all but those a user has set; a value of 0 or less leaves a blank."""
    new = incoming.select(key, F.when(F.col(value) > 0, F.col(value)).alias("__v"), F.lit(True).alias("__in"))
    joined = current.join(new, key, "full")
    take = F.coalesce("__in", F.lit(False)) & ~F.col(state).eqNullSafe("user-modified")
    return joined.select(key, F.when(take, F.col("__v")).otherwise(F.col(value)).alias(value), F.when(take, F.lit(new_state)).otherwise(F.col(state)).alias(state))


def state_machine(events: DataFrame, key: str, ranks: dict[str, int], weak: str, state: str, *order: Column) -> DataFrame:
    """The state after all events of a key: each sets the state, but the weak one never takes back a stronger."""
    rank = F.coalesce(*(F.when(F.col(state) == s, F.lit(r)) for s, r in ranks.items()), F.lit(0))
    folds = {"__strong": ("max", F.when(rank > ranks[weak], F.lit(1))), "__before": ("sum", F.lit(1).cast("long"))}
    # a weak event counts only before the first strong one
    counted = scanned(events, [key], list(order), folds, before=True).filter(~(F.col("__strong").isNotNull() & F.col(state).eqNullSafe(weak)))
    return counted.groupBy(key).agg(F.max_by(state, F.coalesce("__before", F.lit(0))).alias("final_state"))


def debounced(events: DataFrame, key: str, ts: str, gap_seconds: float, *tie: Column) -> DataFrame:
    """Events after which their key is quiet for at least the gap."""
    w = W.partitionBy(key).orderBy(F.col(ts), *tie)
    wait = F.lead(F.col(ts).cast("timestamp").cast("double")).over(w) - F.col(ts).cast("timestamp").cast("double")
    return events.withColumn("__wait", wait).filter(F.col("__wait").isNull() | (F.col("__wait") >= gap_seconds)).drop("__wait")


def queue_lifecycle(events: DataFrame, key: str, kind: str, *order: Column) -> DataFrame:
    """Drafts by key: the last event decides between pending, captured, committed and gone (discarded keys have no row)."""
    last = first_of(events, [key], *order)
    state = F.when(F.col(kind) == "commit", "committed").when(F.col(kind) == "capture", "captured").when(F.col(kind) == "draft", "pending")
    return last.withColumn("queue_state", state).filter(F.col("queue_state").isNotNull())
