"""Geometry and take-off queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction as E
from ..operators import geometry as G
from ..operators import joins as J
from .registry import query
from .tables import read

#: The first ten components of an embedding as five vertices.
_P = lambda i, c: f"CAST(embedding[{2 * i + (1 if c == 'x' else 2)}] AS DOUBLE)"
_SHOELACE = " + ".join(f"({_P(i, 'x')} * {_P((i + 1) % 5, 'y')} - {_P((i + 1) % 5, 'x')} * {_P(i, 'y')})" for i in range(5))
_EDGE = lambda i, j: f"sqrt(power({_P(i, 'x')} - {_P(j, 'x')}, 2) + power({_P(i, 'y')} - {_P(j, 'y')}, 2))"
_OPEN = " + ".join(_EDGE(i, i + 1) for i in range(4))


def vertices():
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return F.array(*(F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")) for i in range(5)))


@query("polygon_measures", f"SELECT vec_id, round(abs({_SHOELACE}) / 2, 6) AS area, round({_OPEN}, 6) AS line, round({_OPEN} + {_EDGE(4, 0)}, 6) AS perimeter, round(({' + '.join(_P(i, 'x') for i in range(5))}) / 5, 6) AS cx, round(({' + '.join(_P(i, 'y') for i in range(5))}) / 5, 6) AS cy FROM embeddings")
def _(spark, d):
    v = F.col("v")
    rows = read(spark, d, "embeddings").select("vec_id", vertices().alias("v"))
    c = G.centroid(v)
    return rows.select("vec_id", F.round(G.area(v), 6).alias("area"), F.round(G.length(v), 6).alias("line"), F.round(G.length(v, True), 6).alias("perimeter"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query("measure_sums", f"""SELECT label, round(sum(coalesce(CASE WHEN vec_id % 4 <> 3 THEN abs({_SHOELACE}) / 2 / (u * u) END, 0)), 5) AS area_m2, round(sum(coalesce((CASE WHEN vec_id % 4 = 3 THEN {_OPEN} ELSE {_OPEN} + {_EDGE(4, 0)} END) / u, 0)), 5) AS length_m
  FROM (SELECT *, CASE WHEN label % 3 = 0 THEN NULL ELSE 0.01::DOUBLE * (label + 1) END AS u FROM embeddings) GROUP BY 1""")
def _(spark, d):
    e = read(spark, d, "embeddings")
    polygons = e.select("vec_id", F.col("label").alias("page"), F.when(F.col("vec_id") % 4 == 3, "polyline").otherwise("area").alias("kind"), vertices().alias("vertices"))
    calibration = e.select(F.col("label").alias("page")).distinct().filter("page % 3 <> 0").withColumn("units_per_metre", 0.01 * (F.col("page") + 1))
    m = G.measured(polygons, calibration)
    return m.groupBy(F.col("page").alias("label")).agg(F.round(F.sum(F.coalesce("area_m2", F.lit(0.0))), 5).alias("area_m2"), F.round(F.sum(F.coalesce("length_m", F.lit(0.0))), 5).alias("length_m"))


@query("net_area", """SELECT o_orderkey AS poly_id, round(o_totalprice + coalesce(d, 0), 4) AS net_area FROM orders LEFT JOIN (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE -l_quantity END) AS d FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1) ON o_orderkey = l_orderkey""")
def _(spark, d):
    children = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), F.when(F.col("l_returnflag") == "A", "add").otherwise("cut").alias("mode"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("area"))
    polygons = read(spark, d, "orders").select(F.col("o_orderkey").alias("poly_id"), F.col("o_totalprice").alias("area"))
    return G.net_areas(polygons, children).select("poly_id", F.round("net_area", 4).alias("net_area"))


_BOXES = "(SELECT p_partkey AS box_id, p_partkey // 500 AS page, (p_partkey * 37 % 1000)::DOUBLE AS x1, (p_partkey * 53 % 800)::DOUBLE AS y1, (p_partkey * 37 % 1000 + 5 + p_size)::DOUBLE AS x2, (p_partkey * 53 % 800 + 8 + p_size)::DOUBLE AS y2, CAST((5 + p_size) * (8 + p_size) AS DOUBLE) AS area FROM part)"
_POINTS = "(SELECT c_custkey AS p_id, c_custkey // 500 AS page, (c_custkey * 17 % 1000)::DOUBLE + 0.5 AS x, (c_custkey * 29 % 800)::DOUBLE + 0.5 AS y FROM customer)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = read(spark, d, "part").select(k.alias("box_id"), F.floor(k / 500).cast("long").alias("page"), (k * 37 % 1000).cast("double").alias("x1"), (k * 53 % 800).cast("double").alias("y1"), (k * 37 % 1000 + 5 + s).cast("double").alias("x2"), (k * 53 % 800 + 8 + s).cast("double").alias("y2"), ((5 + s) * (8 + s)).cast("double").alias("area"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return rows.withColumn("vertices", F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))).withColumn("seq", F.col("box_id"))


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("p_id"), F.floor(k / 500).cast("long").alias("page"), ((k * 17 % 1000).cast("double") + 0.5).alias("x"), ((k * 29 % 800).cast("double") + 0.5).alias("y"))


@query("smallest_container", f"SELECT p.p_id, b.box_id FROM {_POINTS} p LEFT JOIN (SELECT p_id, box_id, row_number() OVER (PARTITION BY p_id ORDER BY area, box_id) AS r FROM {_POINTS} p JOIN {_BOXES} b ON p.page = b.page AND x > x1 AND x < x2 AND y > y1 AND y < y2) b ON p.p_id = b.p_id AND r = 1")
def _(spark, d):
    return J.smallest_container(points(spark, d), boxes(spark, d), G.contains(F.col("vertices"), F.col("x"), F.col("y")), "p_id", scope=["page"]).select("p_id", "box_id")


_SEGMENTS = "(SELECT p_partkey AS seg_id, p_partkey // 500 AS page, (p_partkey * 131 % 2000)::DOUBLE / 2 AS pos, (p_partkey * 71 % 300)::DOUBLE AS lo, (p_partkey * 71 % 300 + 30 + p_size * 3)::DOUBLE AS hi FROM part)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("seg_id"), F.floor(k / 500).cast("long").alias("page"), ((k * 131 % 2000).cast("double") / 2).alias("pos"), (k * 71 % 300).cast("double").alias("lo"), (k * 71 % 300 + 30 + F.col("p_size") * 3).cast("double").alias("hi"))


@query("parallel_semi", f"SELECT seg_id FROM {_SEGMENTS} a WHERE EXISTS (SELECT 1 FROM {_SEGMENTS} b WHERE a.page = b.page AND a.seg_id <> b.seg_id AND abs(a.pos - b.pos) BETWEEN 3 AND 25 AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 40)")
def _(spark, d):
    return J.parallel_partners(segments(spark, d), scope=["page"]).select("seg_id")


@query("border_peel", """SELECT page, CAST(count(*) FILTER (border) AS BIGINT) AS n_border, CAST(count(*) FILTER (NOT border) AS BIGINT) AS n_drawing, min(x1) FILTER (NOT border) AS min_x, max(x2) FILTER (NOT border) AS max_x FROM
  (SELECT *, least(x1, x2) < 15 OR least(y, y) < 15 OR greatest(x1, x2) > 485 OR y > 985 AS border FROM (SELECT page, lo AS x1, hi AS x2, pos AS y FROM """ + _SEGMENTS + """)) GROUP BY 1""")
def _(spark, d):
    rows = segments(spark, d).withColumn("border", G.is_border(F.col("lo"), F.col("pos"), F.col("hi"), F.col("pos"), F.lit(500.0), F.lit(1000.0)))
    inner = ~F.col("border")
    return rows.groupBy("page").agg(F.count(F.when(F.col("border"), 1)).alias("n_border"), F.count(F.when(inner, 1)).alias("n_drawing"), F.min(F.when(inner, F.col("lo"))).alias("min_x"), F.max(F.when(inner, F.col("hi"))).alias("max_x"))


@query("area_band_filter", f"SELECT box_id, area FROM {_BOXES} WHERE area BETWEEN 40000 * 0.01::DOUBLE AND 40000 * 0.05::DOUBLE")
def _(spark, d):
    b = boxes(spark, d)
    return b.withColumn("area", G.area(F.col("vertices"))).filter(G.in_area_band(F.col("area"), F.lit(40000.0), 0.01, 0.05)).select("box_id", "area")


@query("shrink_wrap", f"""WITH s AS (SELECT a.* FROM {_SEGMENTS} a WHERE hi - lo >= 50 AND EXISTS (SELECT 1 FROM {_SEGMENTS} b WHERE b.hi - b.lo >= 50 AND a.page = b.page AND a.seg_id <> b.seg_id AND abs(a.pos - b.pos) BETWEEN 3 AND 25 AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 40)),
  r AS (SELECT page, pos AS v, row_number() OVER (PARTITION BY page ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY page) AS n FROM s)
  SELECT page, max(CASE WHEN i = CASE WHEN n < 4 THEN 0 ELSE floor(n * 0.05::DOUBLE) END THEN v END) AS low, max(CASE WHEN i = CASE WHEN n < 4 THEN n - 1 ELSE ceil(n * 0.95::DOUBLE) - 1 END THEN v END) AS high FROM r GROUP BY 1""")
def _(spark, d):
    from ..operators.aggregates import trimmed_extent

    walls = J.parallel_partners(segments(spark, d).filter("hi - lo >= 50"), scope=["page"])
    return trimmed_extent(walls, ["page"], "pos")


@query("best_score_match", f"""SELECT c_id, s_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY c_id ORDER BY round(score, 9) DESC, s_id) AS r FROM (
  SELECT c_id, seg_id AS s_id, 0.6::DOUBLE * (1 - e / 0.08::DOUBLE) + 0.4::DOUBLE * (1 - dist / 500::DOUBLE) AS score FROM (SELECT c.p_id AS c_id, s.seg_id, abs(s.hi - s.lo - c.want) / c.want AS e, sqrt(power(greatest(s.lo - c.x, 0, c.x - s.hi), 2) + power(greatest(s.pos - c.y, 0, c.y - s.pos), 2)) AS dist
  FROM (SELECT *, 40 + p_id % 90 AS want FROM {_POINTS}) c JOIN {_SEGMENTS} s ON c.page = s.page) WHERE e <= 0.08::DOUBLE AND dist <= 500)) WHERE r = 1""")
def _(spark, d):
    c = points(spark, d).select(F.col("p_id").alias("c_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), (40 + F.col("p_id") % 90).cast("double").alias("want"), F.floor(F.col("p_id") / 500).cast("long").alias("page"))
    s = segments(spark, d).select(F.col("seg_id").alias("s_id"), "page", F.col("lo").alias("x1"), F.col("pos").alias("y1"), F.col("hi").alias("x2"), F.col("pos").alias("y2"), (F.col("hi") - F.col("lo")).alias("length"))
    return J.best_score_match(c, s, scope=["page"]).select("c_id", "s_id", F.round("score", 6).alias("score"))


@query("nearest_within", f"""SELECT p_id, t_id, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY p_id ORDER BY dist, t_id) AS r FROM (SELECT p.p_id, b.box_id AS t_id, sqrt(power(p.x - b.x1, 2) + power(p.y - b.y1, 2)) AS dist FROM {_POINTS} p JOIN {_BOXES} b ON p.page = b.page AND abs(p.x - b.x1) < 12 AND abs(p.y - b.y1) < 12) WHERE dist < 12) WHERE r = 1""")
def _(spark, d):
    t = boxes(spark, d).select(F.col("box_id").alias("t_id"), "page", F.col("x1").alias("tx"), F.col("y1").alias("ty"))
    return J.nearest_within(points(spark, d), t, 12.0, scope=["page"]).select("p_id", "t_id", F.round("distance", 6).alias("distance"))


@query("next_candidate", f"SELECT p.page, p.pos, (SELECT min(q.pos) FROM {_SEGMENTS} q WHERE q.page = p.page AND q.pos > p.pos + 0.5) AS nxt FROM (SELECT DISTINCT page, pos FROM {_SEGMENTS}) p")
def _(spark, d):
    return J.next_candidates(segments(spark, d), "page", "pos", 0.5)


@query("endpoint_dedupe", f"SELECT rx, ry, min(seg_id) AS first_id FROM (SELECT seg_id, CAST(floor(lo + 0.5) AS BIGINT) AS rx, CAST(floor(pos + 0.5) AS BIGINT) AS ry FROM {_SEGMENTS}) GROUP BY 1, 2")
def _(spark, d):
    r = lambda c: F.floor(F.col(c) + 0.5).cast("long")
    return segments(spark, d).groupBy(r("lo").alias("rx"), r("pos").alias("ry")).agg(F.min("seg_id").alias("first_id"))


@query("asof_header", """SELECT event_id AS row_id, coalesce((SELECT arg_max(h.event_id, (h.ts, h.event_id)) FROM events h WHERE h.user_id = e.user_id AND h.event_type = 'login' AND (h.ts, h.event_id) < (e.ts, e.event_id) AND h.event_id % 3 = e.event_id % 3), (SELECT arg_max(h.event_id, (h.ts, h.event_id)) FROM events h WHERE h.user_id = e.user_id AND h.event_type = 'login' AND (h.ts, h.event_id) < (e.ts, e.event_id))) AS h_id FROM events e WHERE event_type = 'purchase'""")
def _(spark, d):
    e = read(spark, d, "events").withColumn("line", F.struct("ts", "event_id")).withColumn("n_values", F.col("event_id") % 3)
    rows = e.filter("event_type = 'purchase'").withColumn("row_id", F.col("event_id"))
    headers = e.filter("event_type = 'login'").select("user_id", "line", F.col("event_id").alias("h_id"), F.col("n_values").alias("n_cols"))
    return J.asof_header(rows, headers, "user_id").select("row_id", "h_id")


_SPECS = [("s1", "LARGE", "SMALL", "sum_area", None, None), ("s2", "NOTHING", "SMALL", "sum_perimeter", None, 30.0), ("s3", "ECONOMY", None, "sum_volume", "height", None), ("s4", "ECONOMY", None, "sum_area", "unset", None), ("s5", "LARGE", None, "no_such", None, None), ("s6", "SMALL", None, "sum_net_area", "height", 45.0)]
_SPEC_SQL = ",".join("(" + ",".join("NULL" if x is None else (f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE") for x in s) + ")" for s in _SPECS)


@query("component_aggregate", f"""WITH sp(spec_id, component, fallback, reducer, param, pitch) AS (VALUES {_SPEC_SQL}), g AS (SELECT p_type, sum(p_retailprice) AS sum_area, sum(CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_retailprice - p_size END) AS sum_net_area, sum(p_size::DOUBLE) AS sum_perimeter, sum(p_retailprice * p_size) AS sum_volume FROM part GROUP BY 1),
  l AS (SELECT p_type, 'sum_area' AS r, sum_area AS v FROM g UNION ALL SELECT p_type, 'sum_net_area', sum_net_area FROM g UNION ALL SELECT p_type, 'sum_perimeter', sum_perimeter FROM g UNION ALL SELECT p_type, 'sum_volume', sum_volume FROM g)
  SELECT spec_id, round(CASE WHEN reducer <> 'no_such' THEN coalesce(a.v, b.v, 0) * CASE WHEN param IS NULL THEN 1 WHEN param = 'height' THEN 2.5::DOUBLE END * CASE WHEN pitch IS NULL THEN 1 ELSE 1 / cos(radians(pitch)) END END, 3) AS measure,
  CASE WHEN reducer = 'no_such' THEN 'unknown reducer no_such' WHEN param = 'unset' THEN 'missing parameter unset' END AS warning FROM sp LEFT JOIN l a ON a.p_type = component AND a.r = reducer LEFT JOIN l b ON b.p_type = fallback AND b.r = reducer""")
def _(spark, d):
    size = F.col("p_size").cast("double")
    polygons = read(spark, d, "part").select(F.col("p_type").alias("component"), F.col("p_retailprice").alias("area"), F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice") - size).alias("net_area"), size.alias("len"), size.alias("perimeter"), size.alias("depth"))
    specs = spark.createDataFrame(_SPECS, "spec_id string, component string, fallback string, reducer string, param string, pitch double")
    params = spark.createDataFrame([("height", 2.5)], "name string, value double")
    return G.component_aggregate(polygons, specs, params).select("spec_id", F.round("measure", 3).alias("measure"), "warning")


_TARGETS = [("LARGE", "dim_wall"), ("LARGE", "dim_roof"), ("SMALL", "dim_wall"), ("ECONOMY", "dim_slab"), ("MEDIUM", "dim_roof")]


@query("dimension_rollup", f"""SELECT dim, round(v, 3) AS value, coalesce(c, '') AS contributors FROM (VALUES ('dim_wall'),('dim_roof'),('dim_slab'),('dim_window')) d(dim) LEFT JOIN (SELECT t.t, sum(m) AS v, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS c FROM (SELECT p_type, sum(p_retailprice) AS m FROM part GROUP BY 1) JOIN (VALUES {",".join(str(x) for x in _TARGETS)}) t(p, t) ON p_type = p GROUP BY 1) ON t = dim""")
def _(spark, d):
    sums = read(spark, d, "part").groupBy(F.col("p_type").alias("component")).agg(F.sum("p_retailprice").alias("measure"))
    dims = spark.createDataFrame([("dim_wall",), ("dim_roof",), ("dim_slab",), ("dim_window",)], "dim string")
    out = G.dimension_rollup(sums, spark.createDataFrame(_TARGETS, "component string, dim string"), dims)
    return out.select("dim", F.round("value", 3).alias("value"), F.coalesce(F.array_join("contributors", ","), F.lit("")).alias("contributors"))


@query("crossfeed_supersede", "SELECT component, dim FROM (VALUES ('LARGE','dim_wall','MEDIUM'),('SMALL','dim_slab','NOTHING'),('ECONOMY','dim_roof','ABSENT'),('PROMO','dim_roof','SMALL')) f(component, dim, sup) WHERE sup NOT IN (SELECT p_type FROM part)")
def _(spark, d):
    feeds = spark.createDataFrame([("LARGE", "dim_wall", "MEDIUM"), ("SMALL", "dim_slab", "NOTHING"), ("ECONOMY", "dim_roof", "ABSENT"), ("PROMO", "dim_roof", "SMALL")], "component string, dim string, superseded_by string")
    return G.crossfeed(feeds, read(spark, d, "part").select(F.col("p_type").alias("component"))).select("component", "dim")


@query("row_cluster", """WITH RECURSIVE v AS (SELECT user_id, value AS y, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS i FROM events WHERE event_type = 'click' AND value IS NOT NULL),
  c AS (SELECT user_id, i, y, y AS anchor, CAST(1 AS BIGINT) AS k, event_id FROM v WHERE i = 1 UNION ALL SELECT v.user_id, v.i, v.y, CASE WHEN v.y - c.anchor > 3 THEN v.y ELSE c.anchor END, CASE WHEN v.y - c.anchor > 3 THEN c.k + 1 ELSE c.k END, v.event_id FROM c JOIN v ON v.user_id = c.user_id AND v.i = c.i + 1)
  SELECT event_id, user_id, k AS row_no FROM c""")
def _(spark, d):
    from ..operators.layout import row_clusters

    items = read(spark, d, "events").filter("event_type = 'click' AND value IS NOT NULL").select("user_id", "event_id", F.col("value").alias("y"), F.lit(0.0).alias("x"))
    return row_clusters(items, "user_id", tolerance=3.0, anchored=True, item="event_id").select("event_id", "user_id", "row_no")


@query("gap_word_join", """SELECT l_orderkey, string_agg(piece, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_text FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN g IS NOT NULL AND (g > 20 OR g < -2) THEN ' ' ELSE '' END || 'w' || CAST(l_linenumber AS VARCHAR) AS piece FROM
  (SELECT *, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS g FROM lineitem)) GROUP BY 1""")
def _(spark, d):
    from pyspark.sql import Window as W

    order = (F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice"))
    gap = F.col("l_quantity") - F.lag("l_quantity").over(W.partitionBy("l_orderkey").orderBy(*order))
    words = read(spark, d, "lineitem").withColumn("w", F.concat(F.lit("w"), F.col("l_linenumber").cast("string")))
    return E.joined_words(words, ["l_orderkey"], gap, 20.0, "w", *order)


@query("stop_at_sentinel", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, max(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM lineitem) WHERE s = 0")
def _(spark, d):
    return E.until_sentinel(read(spark, d, "lineitem"), ["l_orderkey"], F.col("l_quantity") > 40, F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")).select("l_orderkey", "l_linenumber", "l_partkey")
