"""Values carried along an order, by ranges of it: no scope, however large, is one task's work.

Rows are dealt by range of (scope, order) and kept. Each range folds its own rows in windows over its part of a scope. What the
parts of one scope hand on is worked out on one row for each range, and added to the rows of the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import kept

#: How a fold goes over rows, how it joins what came before (a) with what follows (b).
_FOLDS = {
    "last": (lambda c: F.last(c, True), lambda a, b: F.coalesce(b, a)),
    "first": (lambda c: F.first(c, True), lambda a, b: F.coalesce(a, b)),
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def scanned(df: DataFrame, scope: list[str], order: list[Column], folds: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """df with a column for each fold (kind, value) over the rows of the same scope up to each row, or up to the row before.

    Kinds are last and first (that isn't null), sum, max and min; nulls are passed over, and a fold over nothing is null. The order
    should be total, else rows of equal rank come in any order. Nulls in the scope count as one."""
    values = df.withColumns({f"__v{i}": c for i, (_, c) in enumerate(folds.values())})
    by = [*(F.col(s).asc() for s in scope), *order]
    dealt = values.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = kept(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    kinds = [_FOLDS[k] for k, _ in folds.values()]
    named = list(enumerate(kinds))

    # a range's first and last part of a scope, with their folds; between ranges nothing else is handed on
    def whole(i: int) -> Column:
        v, at = F.col(f"__v{i}"), F.when(F.col(f"__v{i}").isNotNull(), F.col("__at"))
        kind = list(folds.values())[i][0]
        return F.max_by(v, at) if kind == "last" else F.min_by(v, at) if kind == "first" else kinds[i][0](v)

    parts = rows.groupBy("__part", *scope).agg(F.min("__at").alias("__from"), *(whole(i).alias(f"__f{i}") for i, _ in named))
    both = F.struct(F.struct(*scope).alias("s"), "__from", *(f"__f{i}" for i, _ in named))
    ranges = parts.groupBy("__part").agg(F.min_by(both, "__from").alias("__head"), F.max_by(both, "__from").alias("__tail"))
    up = W.orderBy("__part")
    goes_on = F.coalesce(F.col("__head.s") == F.lag("__tail.s").over(up), F.lit(False))
    linked = ranges.withColumn("__on", goes_on)
    starts = ~(F.col("__on") & (F.col("__head.__from") == F.col("__tail.__from")))
    runs = linked.withColumn("__run", F.sum(starts.cast("int")).over(up.rowsBetween(W.unboundedPreceding, 0)))
    along = W.partitionBy("__run").orderBy("__part").rowsBetween(W.unboundedPreceding, 0)
    held = runs.select("__part", "__on", *(f(F.col(f"__tail.__f{i}")).over(along).alias(f"__f{i}") for i, (f, _) in named))
    handed = held.select("__part", *(F.when(F.col("__on"), F.lag(f"__f{i}").over(up)).alias(f"__c{i}") for i, _ in named))

    own = W.partitionBy("__part", *scope).orderBy("__at")
    frame = own.rowsBetween(W.unboundedPreceding, -1 if before else 0)
    local = rows.withColumns({f"__l{i}": f(F.col(f"__v{i}")).over(frame) for i, (f, _) in named} | {"__from": F.first("__at").over(own.rowsBetween(W.unboundedPreceding, 0))})
    met = local.join(F.broadcast(handed), "__part")  # a row for each range
    carried = lambda i: F.when(F.col("__from") == 0, F.col(f"__c{i}"))
    out = [join(carried(i), F.col(f"__l{i}")).alias(name) for name, (i, (_, join)) in zip(folds, named)]
    return met.select(*(F.col(c) for c in df.columns if c not in folds), *out)


def orbit(pointers: DataFrame, starts: DataFrame, scope: str, at: str, to: str, carry: list[str]) -> DataFrame:
    """All places that the starts reach along pointers, with what the pointers carry there.

    pointers (scope, at, to, carry) lead further up only, one from each place; starts (scope, at, carry). The pointers double their reach in each step, so n
    places in a row take log n joins. carry belongs to the place that is reached."""
    reached = kept(starts.select(scope, at, *carry))
    jumps = kept(pointers.filter(F.col(to).isNotNull()).select(scope, at, to, *carry))
    everything = reached
    while True:
        new = kept(everything.select(scope, at).join(jumps, [scope, at]).select(scope, F.col(to).alias(at), *carry))
        if new.isEmpty():
            return everything
        everything = everything.union(new)
        further = jumps.select(scope, F.col(at).alias(to), F.col(to).alias("__far"), *carry)
        jumps = kept(jumps.select(scope, at, to).join(further, [scope, to]).select(scope, at, F.col("__far").alias(to), *carry))


def anchored_starts(items: DataFrame, scope: list[str], y: str, within: Column, order: list[Column]) -> DataFrame:
    """items, numbered in their scope's order (rises with y), with begins: whether one begins a cluster.

    The first item begins one, and then each that lies more than its own `within` above the item that began the current cluster. From
    a beginning at height a the next is the first item with y - a > within; these pointers are found for all heights at once by a
    scan, and followed by doubling. Items without a height are left out."""
    rows = items.filter(F.col(y).isNotNull()).withColumn("__s", F.struct(*scope) if scope else F.struct(F.lit(0).alias("all"))).withColumn("__w", within)
    rows = kept(scanned(rows, ["__s"], order, {"number": ("sum", F.lit(1).cast("long")), "__m": ("max", (F.col(y) - F.col("__w")).cast("double"))}))
    heights = kept(rows.select("__s", F.col(y).alias("__a")).distinct())
    # y - w and y - a are rounded differently: a little lower and a little higher give the same item but for ties, which are then tried one by one
    slack = 1e-9 * (1 + F.abs("__a"))
    ask = heights.select("__s", "__a", F.explode(F.array(F.struct((F.col("__a") - slack).alias("p"), F.lit(True).alias("low")), F.struct((F.col("__a") + slack).alias("p"), F.lit(False).alias("low")))).alias("q"))
    ask = ask.select("__s", "__a", F.col("q.p").cast("double").alias("__p"), F.col("q.low").alias("__low"), F.lit(None).cast("long").alias("__r"))
    there = rows.select("__s", F.lit(None).cast(rows.schema[y].dataType).alias("__a"), F.col("__m").alias("__p"), F.lit(None).cast("boolean").alias("__low"), F.col("number").alias("__r"))
    seen = scanned(ask.union(there), ["__s"], [F.desc("__p"), F.desc_nulls_first("__r")], {"__hit": ("last", F.col("__r"))}).filter("__low IS NOT NULL")
    hits = kept(seen.groupBy("__s", "__a").agg(F.max(F.when(F.col("__low"), F.col("__hit"))).alias("lo"), F.max(F.when(~F.col("__low"), F.col("__hit"))).alias("hi")))
    ends = rows.groupBy("__s").agg(F.max("number").alias("__n"))
    tied = hits.filter("NOT (lo <=> hi)").join(ends, "__s").select("__s", "__a", F.explode(F.sequence("lo", F.coalesce(F.col("hi") - 1, F.col("__n")))).alias("number"))
    tried = tied.join(rows.select("__s", "number", F.col(y).alias("__y"), "__w"), ["__s", "number"]).filter(F.col("__y") - F.col("__a") > F.col("__w")).groupBy("__s", "__a").agg(F.min("number").alias("__tie"))
    found = hits.join(tried, ["__s", "__a"], "left").select("__s", "__a", F.coalesce("__tie", "hi").alias("number")).filter("number IS NOT NULL")
    pointers = found.join(rows.select("__s", "number", F.col(y).alias("__to")), ["__s", "number"])
    first = rows.filter("number = 1").select("__s", F.col(y).alias("__a"), "number")
    begun = orbit(pointers, first, "__s", "__a", "__to", ["number"]).select("__s", "number", F.lit(True).alias("__b"))
    return rows.join(begun, ["__s", "number"], "left").select(*items.columns, "number", F.coalesce("__b", F.lit(False)).alias("begins"))


def chained_starts(items: DataFrame, scope: list[str], y: str, within: Column, order: list[Column]) -> DataFrame:
    """As anchored_starts, but an item is compared with the one before it."""
    rows = scanned(items.filter(F.col(y).isNotNull()), scope, order, {"__was": ("last", F.col(y)), "number": ("sum", F.lit(1).cast("long"))}, before=True)
    begins = F.col("__was").isNull() | (F.col(y) - F.col("__was") > within)
    return rows.select(*items.columns, (F.coalesce("number", F.lit(0)) + 1).alias("number"), begins.alias("begins"))

