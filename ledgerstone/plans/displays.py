"""Queries on numbers as text, scale systems, workbook cells, recorded sources and page calibrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as D
from ..operators import geometry as G
from ..operators import projects as P
from ..operators import sheets as H
from ..sources import readers
from .registry import query
from .tables import read


@query("number_formats", r"""SELECT p_partkey, format('{:,}', CAST(floor(p_retailprice * 10 + 0.5) AS BIGINT)) AS kg,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE printf('%.2f', p_retailprice) END AS qty,
  CASE p_size % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN 'none' WHEN 2 THEN '0.00' ELSE format('{:,.2f}', p_retailprice) END AS cell,
  p_size || '%' AS share,
  CASE WHEN p_size % 5 = 0 THEN '0' ELSE regexp_replace(printf('%.2e', p_size / 1000000.0), 'e([+-])0+', 'e\1') END AS factor FROM part""")
def _(spark, d):
    price, size = F.col("p_retailprice"), F.col("p_size")
    text = F.when(size % 7 == 0, "n/a").when(size % 7 == 1, "none").when(size % 7 == 2, " ").otherwise(F.concat(F.lit("$"), F.format_string("%.2f", price)))
    small = F.when(size % 5 == 0, 0.0).otherwise(size / 1000000.0)
    share = D.shown((size / 100).cast("string"), "percent")
    return read(spark, d, "part").select("p_partkey", D.whole_kg(price * 10).alias("kg"), D.quantity(F.when(size % 5 != 0, price)).alias("qty"), D.shown(text, "number-2dp-comma").alias("cell"), share.alias("share"), D.factor(small).alias("factor"))


@query("scale_system", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 OR p_size IN (12, 16, 32, 64, 96, 128, 192) THEN 'imperial' ELSE 'metric' END AS system FROM part""")
def _(spark, d):
    label = F.when(F.col("p_partkey") % 3 == 0, "1/4\" = 1'-0\"").when(F.col("p_partkey") % 3 == 1, "1:50")
    return read(spark, d, "part").select("p_partkey", H.scale_system(F.col("p_size"), label).alias("system"))


@query("workbook_fields", """WITH m AS (SELECT n_nationkey, 'f' || n_regionkey AS field FROM nation), c AS (
  SELECT field, n_nationkey AS seq, CASE WHEN n_nationkey % 4 IN (0, 3) THEN NULL WHEN n_nationkey % 4 = 1 THEN n_nationkey * 100.0 ELSE n_nationkey END AS number,
    CASE WHEN n_nationkey % 4 = 3 THEN n_name END AS text FROM m JOIN nation USING (n_nationkey))
  SELECT field, CAST(arg_max({'n': number}, seq).n AS DOUBLE) AS number, arg_max({'t': text}, seq).t AS text FROM c WHERE number IS NOT NULL OR text IS NOT NULL GROUP BY field""")
def _(spark, d):
    nation, k = read(spark, d, "nation"), F.col("n_nationkey")
    at = [F.lit("PROJECT").alias("tab"), F.concat(F.lit("D"), k.cast("string")).alias("cell")]
    number = F.when((k % 4).isin(1, 2), k.cast("double"))
    text = F.when(k % 4 == 0, "#NAME?").when(k % 4 == 3, F.col("n_name"))
    cells = nation.select(*at, number.alias("number"), text.alias("text"), F.when(k % 4 == 1, "0.0%").otherwise("General").alias("format"))
    mapping = nation.select(*at, F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("field"), k.alias("seq"))
    return readers.workbook_fields(cells, mapping)


@query("sources_after_edits", """SELECT p_partkey AS field, p_brand AS source FROM part p WHERE p_partkey % 7 <> 3
  AND NOT (p_partkey % 10 = 0 AND EXISTS (SELECT 1 FROM part c WHERE c.p_partkey % 7 = 3 AND c.p_partkey - c.p_partkey % 10 = p.p_partkey))""")
def _(spark, d):
    part, k = read(spark, d, "part"), F.col("p_partkey")
    sources = part.select(k.alias("field"), F.col("p_brand").alias("source"))
    parents = part.select(k.alias("field"), (k - k % 10).alias("parent"))
    return P.sources_left(sources, part.filter(k % 7 == 3).select(k.alias("field")), parents)


@query("page_calibration", """WITH r AS (SELECT s_suppkey % 5 AS page, s_suppkey AS seq, s_suppkey % 3 AS kind, CAST(s_suppkey AS DOUBLE) AS unit FROM supplier),
  last AS (SELECT page, arg_max(unit, seq) AS unit, arg_max(50.0, seq) FILTER (kind = 1) AS ratio FROM r WHERE kind > 0 AND unit > 0 GROUP BY page)
  SELECT CAST(page AS BIGINT) AS page, coalesce(unit, 1.5) AS units_per_metre, CAST(coalesce(ratio, 100.0) AS DOUBLE) AS ratio,
  CASE WHEN unit IS NOT NULL THEN 'auto-calibrated' END AS label, CASE WHEN unit IS NOT NULL THEN 'verified' ELSE 'pending' END AS state
  FROM (SELECT n_nationkey AS page FROM nation) LEFT JOIN last USING (page)""")
def _(spark, d):
    k = F.col("s_suppkey")
    unit = F.when(k % 3 == 0, float("nan")).otherwise(k.cast("double"))
    readings = read(spark, d, "supplier").select((k % 5).cast("long").alias("page"), unit.alias("units_per_metre"), F.when(k % 3 == 1, 50.0).otherwise(0.0).alias("ratio"), F.lit("").alias("label"), k.alias("seq"))
    pages = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("page"), F.lit(1.5).alias("units_per_metre"), F.lit(100.0).alias("ratio"), F.lit(None).cast("string").alias("label"), F.lit("pending").alias("state"))
    return P.calibrated(pages, readings)


@query("vertex_insert", "SELECT p_partkey, 5 AS n_vertices, CAST(p_size + 1 AS DOUBLE) * 3 AS area FROM part")
def _(spark, d):
    w = F.col("p_size") + F.lit(1.0)
    point = lambda x, y: F.struct(x.alias("x"), F.lit(float(y)).alias("y"))
    box = F.array(point(w * 0, 0), point(w, 0), point(w, 3), point(w * 0, 3))
    more = G.insert_vertex(box, 0, point(w / 2, 0))
    return read(spark, d, "part").select("p_partkey", F.size(more).alias("n_vertices"), G.area(more).alias("area"))
