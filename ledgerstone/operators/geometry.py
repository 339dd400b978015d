"""Geometry on arrays of {x, y}, by higher-order functions; take-off of dimensions from polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pitch_factor


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def _pairs(points: Column, closed: bool) -> Column:
    """Each vertex with the next one; a closed shape's last with its first."""
    n = F.size(points)
    last = n if closed else n - 1
    index = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.struct(F.get(points, i).alias("a"), F.get(points, (i + 1) % n).alias("b")))


def area(points: Column) -> Column:
    """Shoelace area; 0 below three vertices."""
    twice = _sum(F.transform(_pairs(points, True), lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]))
    return F.when(F.size(points) >= 3, F.abs(twice) / 2).otherwise(F.lit(0.0))


def length(points: Column, closed: bool = False) -> Column:
    """Length of the line through the vertices; the closing edge counts from three vertices on."""
    step = lambda p: F.sqrt(F.pow(p["a"]["x"] - p["b"]["x"], 2) + F.pow(p["a"]["y"] - p["b"]["y"], 2))
    line = _sum(F.transform(_pairs(points, False), step))
    return F.when(F.size(points) > 2, _sum(F.transform(_pairs(points, True), step))).otherwise(line) if closed else line


def centroid(points: Column) -> Column:
    """The mean of the vertices."""
    mean = lambda k: _sum(F.transform(points, lambda p: p[k])) / F.size(points)
    return F.when(F.size(points) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def contains(points: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point crosses the edges an odd number of times."""
    cross = lambda p: ((p["a"]["y"] > y) != (p["b"]["y"] > y)) & (x < (p["b"]["x"] - p["a"]["x"]) * F.try_divide(y - p["a"]["y"], p["b"]["y"] - p["a"]["y"]) + p["a"]["x"])
    return F.size(F.filter(_pairs(points, True), cross)) % 2 == 1


def project_on_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The nearest point of a segment."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.struct((x1 + t * dx).alias("x"), (y1 + t * dy).alias("y"))


def affine(x: Column, y: Column, m: list) -> Column:
    """A point under the matrix [a, b, c, d, e, f]."""
    a, b, c, d, e, f = m
    return F.struct((x * a + y * c + e).alias("x"), (x * b + y * d + f).alias("y"))


def next_candidate(position: Column, candidates: Column, step: float = 0.5) -> Column:
    """The next larger candidate beyond the step."""
    return F.array_min(F.filter(candidates, lambda c: c > position + step))


def is_border(x1: Column, y1: Column, x2: Column, y2: Column, wide: Column, high: Column, margin: float = 15) -> Column:
    """Whether a segment's box comes within the margin of a page edge."""
    return (F.least(x1, x2) < margin) | (F.least(y1, y2) < margin) | (F.greatest(x1, x2) > wide - margin) | (F.greatest(y1, y2) > high - margin)


def in_area_band(shape: Column, page: Column, low: float = 0.001, high: float = 0.95) -> Column:
    return shape.between(page * low, page * high)


def merge_vertex(points: Column, moved: int, near: float = 5) -> Column:
    """The vertices without the moved one, if another lies near it and more than three remain."""
    m = F.get(points, F.lit(moved))
    close = F.exists(F.transform(points, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda q: (q["i"] != moved) & (F.sqrt(F.pow(q["p"]["x"] - m["x"], 2) + F.pow(q["p"]["y"] - m["y"], 2)) < near))
    return F.when((F.size(points) > 3) & close, F.filter(points, lambda p, i: i != moved)).otherwise(points)


def measured(polygons: DataFrame, calibration: DataFrame) -> DataFrame:
    """Polygons (page, kind, vertices) with area and length in metres; null on pages without units_per_metre. Lines have no area."""
    u = F.col("units_per_metre")
    joined = polygons.join(calibration, "page", "left")
    closed = F.col("kind") != "polyline"
    return joined.withColumn("area_m2", F.when(closed, area(F.col("vertices")) / (u * u))).withColumn("length_m", F.when(closed, length(F.col("vertices"), True)).otherwise(length(F.col("vertices"))) / u)


def net_areas(polygons: DataFrame, children: DataFrame) -> DataFrame:
    """Own area less the areas of children (parent, mode, area), plus those of mode 'add'; children without an area don't count."""
    change = children.filter("area IS NOT NULL").groupBy("parent").agg(F.sum(F.when(F.col("mode") == "add", F.col("area")).otherwise(-F.col("area"))).alias("__d"))
    return polygons.join(change, polygons["poly_id"] == change["parent"], "left").withColumn("net_area", F.col("area") + F.coalesce("__d", F.lit(0.0))).drop("parent", "__d")


#: Named reducers of component_aggregate.
REDUCERS = {
    "sum_area": lambda: F.sum(F.coalesce("area", F.lit(0.0))),
    "sum_net_area": lambda: F.sum(F.coalesce("net_area", F.lit(0.0))),
    "sum_length": lambda: F.sum(F.coalesce("len", F.lit(0.0))),
    "sum_perimeter": lambda: F.sum(F.coalesce("perimeter", F.lit(0.0))),
    "sum_volume": lambda: F.sum(F.coalesce("area", F.lit(0.0)) * F.coalesce("depth", F.lit(0.0))),
}


def component_aggregate(polygons: DataFrame, specs: DataFrame, params: DataFrame) -> DataFrame:
    """For each spec (spec_id, component, fallback, reducer, param, pitch) the reduced measure of its component's polygons, or of the fallback's
    if it has none; times a parameter (missing: null and a warning) and the pitch factor. An unknown reducer gives a warning."""
    sums = polygons.groupBy("component").agg(*(r().alias(n) for n, r in REDUCERS.items()))
    long = sums.select("component", F.explode(F.create_map(*(x for n in REDUCERS for x in (F.lit(n), F.col(n))))).alias("reducer", "value"))
    own = specs.join(long, ["component", "reducer"], "left")
    back = long.select(F.col("component").alias("fallback"), "reducer", F.col("value").alias("fallback_value"))
    p = params.select(F.col("name").alias("param"), F.col("value").alias("param_value"))
    both = own.join(back, ["fallback", "reducer"], "left").join(p, "param", "left")
    raw = F.coalesce("value", "fallback_value", F.lit(0.0))
    known = F.col("reducer").isin(list(REDUCERS))
    factor = F.when(F.col("param").isNull(), 1.0).otherwise(F.col("param_value")) * F.when(F.col("pitch").isNull(), 1.0).otherwise(pitch_factor(F.col("pitch")))
    warning = F.when(~known, F.concat(F.lit("unknown reducer "), F.col("reducer"))).when(F.col("param").isNotNull() & F.col("param_value").isNull(), F.concat(F.lit("missing parameter "), F.col("param")))
    return both.select("spec_id", "component", F.when(known, raw * factor).alias("measure"), warning.alias("warning"))


def dimension_rollup(contributions: DataFrame, targets: DataFrame, dims: DataFrame) -> DataFrame:
    """Contributions (component, measure) summed for each dimension they feed; dimensions without any stay with a null."""
    summed = contributions.join(targets, "component").groupBy("dim").agg(F.sum("measure").alias("value"), F.array_sort(F.collect_set("component")).alias("contributors"))
    return dims.join(summed, "dim", "left")


def crossfeed(feeds: DataFrame, present: DataFrame) -> DataFrame:
    """Feeds (component, dim, superseded_by) whose superseding component is nowhere present."""
    return feeds.join(present.select(F.col("component").alias("superseded_by")).distinct(), "superseded_by", "left_anti")


def insert_vertex(points: Column, edge: int, point: Column) -> Column:
    """The vertices with one more on the edge that begins at the vertex of that number (from 0)."""
    return F.concat(F.slice(points, 1, edge + 1), F.array(point), F.filter(points, lambda p, i: i > edge))
