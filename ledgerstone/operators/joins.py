"""Joins: lookups with priorities, range joins made into equi joins by bins, spatial and as-of matches."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import scanned


def first_of(df: DataFrame, by: list, *order: Column) -> DataFrame:
    """One row for each key, the first in a total order; tasks keep one row a key before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def spread(df: DataFrame) -> DataFrame:
    """df for a join of sorted partitions. Sizes guessed from small compressed files, or from a few columns of them, would have a table of a
    million rows gathered on the driver and sent to every executor."""
    return df.hint("merge")


def two_key_lookup(rows: DataFrame, first: DataFrame, second: DataFrame, key1: str, key2: str, values: list[str]) -> DataFrame:
    """Two left joins in order of priority, never an OR in one. first has (key1, values), second (key2, values), keys unique."""
    a = first.select(key1, *(F.col(v).alias(f"__1{v}") for v in values), F.lit(True).alias("__1"))
    b = second.select(key2, *(F.col(v).alias(f"__2{v}") for v in values))
    joined = rows.join(a, key1, "left").join(b, key2, "left")
    return joined.select(*(F.col(c) for c in rows.columns), *(F.when(F.col("__1"), F.col(f"__1{v}")).otherwise(F.col(f"__2{v}")).alias(v) for v in values))


def keyword_class(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The class of the first keyword, in the list's order, that a text contains."""
    low = F.lower(text)
    out = reduce(lambda c, r: c.when(low.contains(r[0]), F.lit(r[1])), rules[1:], F.when(low.contains(rules[0][0]), F.lit(rules[0][1])))
    return out.otherwise(F.lit(default)) if default is not None else out


def pattern_class(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """As keyword_class, with patterns."""
    out = F.when(text.rlike(rules[0][0]), F.lit(rules[0][1]))
    for p, c in rules[1:]:
        out = out.when(text.rlike(p), F.lit(c))
    return out.otherwise(F.lit(default))


def bins(low: Column, high: Column, width: float) -> Column:
    """The numbers of all bins that a range touches."""
    return F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long"))


def level_of(extent: Column, least: float = 1.0) -> Column:
    """The level of a grid whose cells, 2 ** level wide, hold the extent."""
    return F.ceil(F.log2(F.greatest(extent, F.lit(least)))).cast("int")


def cells(low: Column, high: Column, level: Column) -> Column:
    """The cells of a level that a range no wider than one of them touches: one or two."""
    width = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long"))


def smallest_container(points: DataFrame, boxes: DataFrame, inside: Column, point_key: str, scope: list[str] | None = None) -> DataFrame:
    """For each point the smallest of the shapes that hold it (area, then seq); points without one keep a null.

    points have x, y; boxes have box_id, x1, y1, x2, y2, area, seq and whatever `inside` needs. A box lies in the grid of its own size,
    in four cells at most, and a point looks into its cell of every grid that has boxes; so boxes of any sizes share a table."""
    scope = scope or []
    b = boxes.withColumn("level", level_of(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))))
    levels = [r[0] for r in b.select("level").distinct().collect() if r[0] is not None]  # as many as a double has exponents, at most
    if not levels:
        return points.withColumn("box_id", F.lit(None).cast(boxes.schema["box_id"].dataType))
    b = b.withColumn("bx", F.explode(cells(F.col("x1"), F.col("x2"), F.col("level")))).withColumn("by", F.explode(cells(F.col("y1"), F.col("y2"), F.col("level"))))
    width = F.pow(F.lit(2.0), F.col("level"))
    p = points.withColumn("level", F.explode(F.array(*(F.lit(x).cast("int") for x in sorted(levels)))))
    p = p.withColumn("bx", F.floor(F.col("x") / width).cast("long")).withColumn("by", F.floor(F.col("y") / width).cast("long"))
    hits = p.join(spread(b), ["level", "bx", "by", *scope]).filter(inside)
    best = first_of(hits.select(point_key, "box_id", "area", "seq"), [point_key], F.asc("area"), F.asc("seq"))
    return points.join(spread(best.select(point_key, "box_id")), point_key, "left")


def parallel_partners(segments: DataFrame, near: float = 3, far: float = 25, overlap: float = 40, scope: list[str] | None = None) -> DataFrame:
    """Segments (seg_id, pos, lo, hi) with another at an offset from near to far that shares at least `overlap` of their length."""
    scope = scope or []
    a = segments.withColumn("bin", F.explode(F.sequence(F.floor(F.col("pos") / far).cast("long") - 1, F.floor(F.col("pos") / far).cast("long") + 1)))
    b = segments.select(*scope, F.floor(F.col("pos") / far).cast("long").alias("bin"), F.col("seg_id").alias("o_id"), F.col("pos").alias("o_pos"), F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"))
    gap = F.abs(F.col("pos") - F.col("o_pos"))
    shared = F.least("hi", "o_hi") - F.greatest("lo", "o_lo")
    keys = ["bin", *scope]
    on = reduce(lambda x, y: x & y, (a[k] == b[k] for k in keys))
    return a.join(spread(b), on & (F.col("seg_id") != F.col("o_id")) & gap.between(near, far) & (shared >= overlap), "left_semi").drop("bin").dropDuplicates(["seg_id"])


def best_score_match(callouts: DataFrame, segments: DataFrame, max_error: float = 0.08, max_distance: float = 500.0, scope: list[str] | None = None) -> DataFrame:
    """For each callout (c_id, cx, cy, want) the segment (s_id, a whole number; x1, y1, x2, y2, length) of the best score, 0.6 for length and 0.4 for nearness.

    Both meet by bins of the logarithm of length and, in each, by cells of the plane that hold such a length and max_distance: a segment
    touches two cells, a callout looks into those within its reach. Diagonal and short segments don't take part. First wins on ties.
    One number ranks a callout's pairs, so a task holds the best pair of each callout, not all pairs in order."""
    scope = scope or []
    width = 0.1
    size = F.greatest(F.lit(float(max_distance)), F.exp((F.col("bin") + 1) * width))
    cell = lambda low, high: F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long")))
    c = callouts.withColumn("bin", F.explode(bins(F.log(F.col("want") * (1 - max_error)), F.log(F.col("want") * (1 + max_error)), width)))
    c = c.withColumn("bx", cell(F.col("cx") - max_distance, F.col("cx") + max_distance)).withColumn("by", cell(F.col("cy") - max_distance, F.col("cy") + max_distance))
    s = segments.filter("length >= 10 AND (abs(x1 - x2) < 0.5 OR abs(y1 - y2) < 0.5)").withColumn("bin", F.floor(F.log("length") / width).cast("long"))
    s = s.withColumn("bx", cell(F.least("x1", "x2"), F.greatest("x1", "x2"))).withColumn("by", cell(F.least("y1", "y2"), F.greatest("y1", "y2")))
    dx = F.greatest(F.least("x1", "x2") - F.col("cx"), F.lit(0.0), F.col("cx") - F.greatest("x1", "x2"))
    dy = F.greatest(F.least("y1", "y2") - F.col("cy"), F.lit(0.0), F.col("cy") - F.greatest("y1", "y2"))
    error = F.abs(F.col("length") - F.col("want")) / F.col("want")
    pairs = c.join(spread(s), ["bin", "bx", "by", *scope]).withColumn("error", error).withColumn("dist", F.sqrt(dx * dx + dy * dy))
    near = pairs.filter((F.col("error") <= max_error) & (F.col("dist") <= max_distance))
    scored = near.withColumn("score", 0.6 * (1 - F.col("error") / max_error) + 0.4 * (1 - F.col("dist") / max_distance))
    missing = F.round((1 - F.round("score", 9)) * 1e9).cast("decimal(10,0)")
    rank = missing * F.lit(Decimal(2 * 10**19)) + F.col("s_id").cast("decimal(20,0)")
    return scored.groupBy("c_id").agg(F.min_by("s_id", rank).alias("s_id"), F.min_by("score", rank).alias("score"))


def nearest_within(points: DataFrame, targets: DataFrame, radius: float, point_key: str = "p_id", scope: list[str] | None = None) -> DataFrame:
    """For each point (x, y) the nearest target (t_id, tx, ty) closer than the radius; smaller t_id on ties; points without one are left out."""
    scope = scope or []
    cell = lambda c: F.floor(c / radius).cast("long")
    around = lambda c: F.sequence(cell(c) - 1, cell(c) + 1)
    p = points.withColumn("bx", F.explode(around(F.col("x")))).withColumn("by", F.explode(around(F.col("y"))))
    t = targets.withColumn("bx", cell(F.col("tx"))).withColumn("by", cell(F.col("ty")))
    d = F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2))
    near = p.join(spread(t), ["bx", "by", *scope]).withColumn("distance", d).filter(F.col("distance") < radius)
    return first_of(near.select(point_key, "t_id", "distance"), [point_key], F.asc("distance"), F.asc("t_id"))


def next_candidates(rows: DataFrame, page: str, pos: str, beyond: float) -> DataFrame:
    """(page, pos, nxt): each distinct position of a page with the next one that lies more than `beyond` further.

    Positions are put in bins as wide as that: the next one is in the bin behind, or it is the first of a later bin, wherever that is."""
    own = rows.select(page, pos).distinct().withColumn("__bin", F.floor(F.col(pos) / beyond).cast("long"))
    first = own.groupBy(page, "__bin").agg(F.min(pos).alias("__low"))
    order = W.partitionBy(page).orderBy("__bin")
    later = first.withColumn("__next", F.lead("__bin").over(order)).withColumn("__next_low", F.lead("__low").over(order)).withColumn("__far_low", F.lead("__low", 2).over(order))
    far = later.select(page, "__bin", "__next", F.when(F.col("__next") > F.col("__bin") + 1, F.col("__next_low")).otherwise(F.col("__far_low")).alias("__far"))
    near = own.select(page, (F.col("__bin") - 1).alias("__bin"), F.col(pos).alias("__q"))
    behind = own.join(near, [page, "__bin"]).filter(F.col("__q") > F.col(pos) + beyond).groupBy(page, pos).agg(F.min("__q").alias("__near"))
    return own.join(far, [page, "__bin"]).join(behind, [page, pos], "left").select(page, pos, F.coalesce("__near", "__far").alias("nxt"))


def asof_header(rows: DataFrame, headers: DataFrame, scope: str, at: str = "line", n: str = "n_values") -> DataFrame:
    """For each row the nearest header at or before it with as many columns as the row has values, else the nearest at all.

    Two scans over the order carry the last header, of each number of columns and of any; no row meets a header by a join, and no scope is in one task.
    headers have (scope, at, h_id, n_cols); the rows' numbers (row_id) are unique in their scope."""
    both = rows.select(scope, at, n, F.col("row_id"), F.lit(None).cast("long").alias("h_id"), F.lit(1).alias("kind")).unionByName(
        headers.select(scope, at, F.col("n_cols").cast(rows.schema[n].dataType).alias(n), F.lit(None).cast("long").alias("row_id"), F.col("h_id").cast("long"), F.lit(0).alias("kind"))
    )
    order = [F.col(at), F.col("kind"), F.coalesce("h_id", "row_id")]
    same = scanned(both, [scope, n], order, {"same": ("last", F.col("h_id"))})
    near = scanned(same, [scope], order, {"near": ("last", F.col("h_id"))})
    return near.filter("kind = 1").select(scope, "row_id", F.coalesce("same", "near").alias("h_id"))


def two_tier_match(rows: DataFrame, known: DataFrame, key: str = "r_id") -> DataFrame:
    """Duplicates of rows among known records (k_id): first by maker and declaration, then by name and group unless both makers are set and differ.

    Text keys are trimmed lower case; empty ones never match. Of several the smallest k_id counts."""
    low = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    r = rows.select(key, *(low(c).alias(c) for c in ("maker", "declaration", "name", "grp")))
    k = known.select("k_id", *(low(c).alias(c) for c in ("maker", "declaration", "name", "grp")))
    least = lambda *by: k.groupBy(*by).agg(F.min("k_id").alias("k_id"))  # noqa: E731  only the smallest of a key counts
    one = r.join(least("maker", "declaration"), ["maker", "declaration"]).select(key, "k_id", F.lit(1).alias("tier"))
    two = r.join(least("name", "grp", "maker").withColumnRenamed("maker", "k_maker"), ["name", "grp"]).filter("maker IS NULL OR k_maker IS NULL OR maker = k_maker").select(key, "k_id", F.lit(2).alias("tier"))
    return first_of(one.union(two), [key], F.asc("tier"), F.asc("k_id"))


def drift(declared: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Keys that are declared but not loaded ('stale') or loaded but not declared ('miss')."""
    a = declared.select(key).distinct().join(loaded, key, "left_anti").select(key, F.lit("stale").alias("drift"))
    b = loaded.select(key).distinct().join(declared, key, "left_anti").select(key, F.lit("miss").alias("drift"))
    return a.union(b)
