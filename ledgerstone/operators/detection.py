"""Whole-document jobs over drawing pages: building outlines, page calibration, polygons out of drawing events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import scale_ratio
from .aggregates import cluster_means, trimmed_extent
from .geometry import is_border
from .joins import first_of, parallel_partners, spread
from .layout import tolerant_pick
from .projects import orthogonal
from .scans import scanned
from .storage import kept

#: How far a detected scale may be from the declared one.
TOLERANCE = 0.03


def wrapped(segments: DataFrame, pages: DataFrame, cluster: float = 5.0) -> DataFrame:
    """(page, status, x1, y1, x2, y2, polygon, n_horizontal, n_vertical, xs, ys): for each page the rectangle about its walls, or why it has none.

    segments (page, seg_id, x1, y1, x2, y2), pages (page, width, height). Walls are long axis-parallel segments off the sheet's border
    that have a parallel partner. The outer twentieth of their places is left out on each side, and what is left is clipped to the
    box of all that is drawn off the border. status says how far it came: no_drawing, no_walls, no_horizontal_walls, no_vertical_walls,
    nothing_left (after clipping) or outlined; only then are there corners (from the lower left, in order) and places. xs and ys are the
    places of vertical and horizontal walls, those within `cluster` of the first taken together as their mean: where an edge may snap to."""
    drawn = segments.join(pages, "page").filter(~is_border(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("width"), F.col("height")))
    area = drawn.groupBy("page").agg(F.min(F.least("x1", "x2")).alias("ax1"), F.min(F.least("y1", "y2")).alias("ay1"), F.max(F.greatest("x1", "x2")).alias("ax2"), F.max(F.greatest("y1", "y2")).alias("ay2"))
    lines = orthogonal(drawn.drop("width", "height")).withColumn("pos", F.col("at"))
    flat = F.col("axis") == "h"
    lines = lines.withColumn("lo", F.when(flat, F.least("x1", "x2")).otherwise(F.least("y1", "y2"))).withColumn("hi", F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2")))
    walls = kept(parallel_partners(lines, scope=["page", "axis"]).select("page", "axis", "pos"))
    of = lambda axis, c, how=F.max: how(F.when(F.col("axis") == axis, F.col(c)))
    sides = trimmed_extent(walls, ["page", "axis"], "pos").groupBy("page").agg(of("v", "low").alias("lx"), of("h", "low").alias("ly"), of("v", "high").alias("hx"), of("h", "high").alias("hy"))
    counts = walls.groupBy("page").agg(of("h", "pos", F.count).alias("n_horizontal"), of("v", "pos", F.count).alias("n_vertical"))
    places = cluster_means(walls.select(F.struct("page", "axis").alias("side"), "pos"), "side", "pos", cluster).select("side.page", "side.axis", "anchor", "mean")
    listed = lambda axis: F.transform(F.array_sort(F.collect_list(F.when(F.col("axis") == axis, F.struct("anchor", "mean")))), lambda c: c["mean"])  # noqa: E731  a page's walls
    snaps = places.groupBy("page").agg(listed("v").alias("xs"), listed("h").alias("ys"))
    joined = pages.select("page").join(area, "page", "left").join(counts, "page", "left").join(sides, "page", "left").join(snaps, "page", "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_horizontal", "n_vertical")})
    joined = joined.withColumns({"x1": F.greatest("lx", "ax1"), "y1": F.greatest("ly", "ay1"), "x2": F.least("hx", "ax2"), "y2": F.least("hy", "ay2")})
    h, v = F.col("n_horizontal") == 0, F.col("n_vertical") == 0
    status = F.when(F.col("ax1").isNull(), "no_drawing").when(h & v, "no_walls").when(h, "no_horizontal_walls").when(v, "no_vertical_walls")
    status = status.when((F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")), "nothing_left").otherwise("outlined")
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    polygon = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))
    there = lambda c: F.when(F.col("status") == "outlined", c)
    return joined.withColumn("status", status).select("page", "status", *(there(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")), there(polygon).alias("polygon"), "n_horizontal", "n_vertical", *(there(F.col(c)).alias(c) for c in ("xs", "ys")))


def outlines(segments: DataFrame, pages: DataFrame, paths: DataFrame) -> DataFrame:
    """(page, source, x1, y1, x2, y2, path_id) of each page: the rectangle about its walls (see wrapped), else its largest closed path, else nothing.

    paths (page, path_id, area)."""
    box = wrapped(segments, pages).select("page", "x1", "y1", "x2", "y2")
    largest = first_of(paths.select("page", "path_id", "area"), ["page"], F.desc("area"), F.asc("path_id")).select("page", "path_id")
    joined = box.join(largest, "page", "left")
    walled = F.col("x1").isNotNull()
    source = F.when(walled, "walls").when(F.col("path_id").isNotNull(), "path")
    return joined.select("page", source.alias("source"), "x1", "y1", "x2", "y2", F.when(~walled, F.col("path_id")).alias("path_id"))


def calibration_readings(dims: DataFrame, segments: DataFrame) -> DataFrame:
    """(page, outcome, units_per_metre, ratio, n_callouts) of pages with paired callouts, from the dimensions that were read.

    dims (page, c_id, s_id, score, implied, declared), segments (page, s_id, x1, y1, x2, y2, length). The best callout is on a
    horizontal segment, then of the better score by more than 0.05, then on the longer segment. A declared scale within TOLERANCE of it is
    confirmed and kept; one further off disagrees and is left to the user; without one the detected scale is taken."""
    read = dims.filter("implied > 0").select("page", "c_id", "s_id", "score", "implied", "declared")
    paired = kept(read.join(spread(segments.select("page", "s_id", "x1", "y1", "x2", "y2", "length")), ["page", "s_id"]))  # read three times
    flat = F.abs(F.col("y2") - F.col("y1")) < F.abs(F.col("x2") - F.col("x1"))
    keyed = paired.withColumn("flat", flat.cast("double"))
    best = tolerant_pick(keyed.select("page", "c_id", "flat", "score", "length"), "page", [("flat", True, 0.0), ("score", True, 0.05), ("length", True, 0.0)], "c_id")
    n = paired.groupBy("page").agg(F.count(F.lit(1)).alias("n_callouts"))
    rows = best.join(spread(keyed), ["page", "c_id"]).join(spread(n), "page")
    gap = F.abs(F.col("implied") - F.col("declared")) / F.col("declared")
    outcome = F.when(F.col("declared").isNull(), "detected").when(gap <= TOLERANCE, "confirmed").otherwise("disagrees")
    unit = F.when(F.col("outcome") == "confirmed", F.col("declared")).when(F.col("outcome") == "detected", F.col("implied"))
    return rows.withColumn("outcome", outcome).select("page", "outcome", unit.alias("units_per_metre"), scale_ratio(unit).alias("ratio"), "n_callouts")


def drawn_polygons(events: DataFrame, page: str = "page") -> DataFrame:
    """(page, poly_no, kind, mode, scope, label, vertices, closed) out of drawing events (page, seq, op, kind, mode, scope, label, x, y).

    start opens a polygon, which takes the vertices up to the first close that it has enough of them for (two for a polyline, else three);
    a close before that is ignored, and so are vertices after it. Without a label a polygon is named by its kind and number."""
    start, seq = F.col("op") == "start", [F.col("seq")]
    rows = scanned(events, [page], seq, {"poly_no": ("sum", start.cast("long"))}).filter("poly_no > 0")
    at_start = lambda c: ("first", F.when(start, F.col(c)))
    vertex = (F.col("op") == "vertex").cast("long")
    own = scanned(rows, [page, "poly_no"], seq, {"kind": at_start("kind"), "mode": at_start("mode"), "scope": at_start("scope"), "label": at_start("label"), "__placed": ("sum", vertex)})
    own = own.withColumns({"kind": F.coalesce("kind", F.lit("area")), "mode": F.coalesce("mode", F.lit("net")), "scope": F.when(F.col("scope") == "garage", "garage").otherwise("building")})
    enough = (F.col("op") == "close") & (F.col("__placed") >= F.when(F.col("kind") == "polyline", 2).otherwise(3))
    ended = own.groupBy(page, "poly_no").agg(F.min(F.when(enough, F.col("seq"))).alias("__end"))
    taken = F.collect_list(F.when((F.col("op") == "vertex") & (F.col("__end").isNull() | (F.col("seq") < F.col("__end"))), F.struct("seq", "x", "y")))
    met = own.join(ended, [page, "poly_no"])
    polygons = met.groupBy(page, "poly_no", "kind", "mode", "scope", "label").agg(F.array_sort(taken).alias("v"), F.max("__end").isNotNull().alias("closed"))
    polygons = scanned(polygons, [page, "kind"], [F.col("poly_no")], {"__number": ("sum", F.lit(1).cast("long"))})
    number = F.col("__number").cast("string")
    name = F.when(F.col("kind") == "window", "Window ").when(F.col("kind") == "polyline", "Line ").otherwise("Area ")
    vertices = F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return polygons.select(page, F.col("poly_no").cast("long").alias("poly_no"), "kind", "mode", "scope", F.coalesce("label", F.concat(name, number)).alias("label"), vertices.alias("vertices"), "closed")
