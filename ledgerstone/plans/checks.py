"""Queries of whole jobs whose expected rows are worked out from the tables' own numbers: outlines of pages, documents against a schema, sheets of formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detection as X
from ..operators import layout as B
from ..operators import schemas as H
from .registry import query
from .tables import read

_DRAWN = """(SELECT k // 40 AS page, k AS seg_id, k % 2 = 0 AS flat, pos, lo, lo + CASE WHEN k // 40 % 7 = 5 THEN 20 ELSE 50 + 3 * s END AS hi FROM
  (SELECT p_partkey AS k, p_size AS s, (p_partkey * 131 % 500)::DOUBLE AS pos, (p_partkey * 71 % 300)::DOUBLE + 100 AS lo FROM part) WHERE k // 40 % 11 <> 7 AND (k // 40 % 7 <> 3 OR k % 2 = 0))"""


def _drawn(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    page = F.floor(k / 40).cast("long")
    rows = read(spark, d, "part").select(page.alias("page"), k.alias("seg_id"), (k * 131 % 500).cast("double").alias("pos"), ((k * 71 % 300).cast("double") + 100).alias("lo"), s.alias("s"))
    rows = rows.filter((F.col("page") % 11 != 7) & ((F.col("page") % 7 != 3) | (F.col("seg_id") % 2 == 0))).withColumn("hi", F.col("lo") + F.when(F.col("page") % 7 == 5, 20).otherwise(50 + 3 * F.col("s")))
    flat = F.col("seg_id") % 2 == 0
    at = lambda a, b: F.when(flat, F.col(a)).otherwise(F.col(b))
    segments = rows.select("page", "seg_id", at("lo", "pos").alias("x1"), at("pos", "lo").alias("y1"), at("hi", "pos").alias("x2"), at("pos", "hi").alias("y2"))
    return segments, read(spark, d, "part").select(page.alias("page")).distinct().withColumns({"width": F.lit(900.0), "height": F.lit(900.0)})


@query("page_outlines", f"""WITH RECURSIVE drawn AS (SELECT * FROM {_DRAWN} WHERE pos >= 15), area AS (
  SELECT page, min(CASE WHEN flat THEN lo ELSE pos END) AS ax1, min(CASE WHEN flat THEN pos ELSE lo END) AS ay1, max(CASE WHEN flat THEN hi ELSE pos END) AS ax2, max(CASE WHEN flat THEN pos ELSE hi END) AS ay2 FROM drawn GROUP BY page),
w AS (SELECT page, flat, pos, row_number() OVER (PARTITION BY page, flat ORDER BY pos, seg_id) AS i, count(*) OVER (PARTITION BY page, flat) AS n FROM drawn a WHERE hi - lo >= 50 AND EXISTS (
  SELECT 1 FROM drawn b WHERE b.hi - b.lo >= 50 AND a.page = b.page AND a.flat = b.flat AND a.seg_id <> b.seg_id AND abs(a.pos - b.pos) BETWEEN 3 AND 25 AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 40)),
side AS (SELECT page, flat, any_value(n) AS n, max(CASE WHEN i - 1 = CASE WHEN n < 4 THEN 0 ELSE floor(n * 0.05::DOUBLE) END THEN pos END) AS low, max(CASE WHEN i - 1 = CASE WHEN n < 4 THEN n - 1 ELSE ceil(n * 0.95::DOUBLE) - 1 END THEN pos END) AS high FROM w GROUP BY page, flat),
c AS (SELECT page, flat, i, pos, pos AS anchor FROM w WHERE i = 1 UNION ALL SELECT w.page, w.flat, w.i, w.pos, CASE WHEN w.pos - c.anchor > 5 THEN w.pos ELSE c.anchor END FROM c JOIN w ON w.page = c.page AND w.flat = c.flat AND w.i = c.i + 1),
snap AS (SELECT page, flat, string_agg(printf('%.3f', m), ' ' ORDER BY anchor) AS places FROM (SELECT page, flat, anchor, avg(pos) AS m FROM c GROUP BY ALL) GROUP BY page, flat),
r AS (SELECT p.page, ax1, coalesce(h.n, 0) AS nh, coalesce(v.n, 0) AS nv, greatest(v.low, ax1) AS x1, greatest(h.low, ay1) AS y1, least(v.high, ax2) AS x2, least(h.high, ay2) AS y2, sv.places AS xs, sh.places AS ys FROM (SELECT DISTINCT p_partkey // 40 AS page FROM part) p
  LEFT JOIN area ON area.page = p.page LEFT JOIN side h ON h.page = p.page AND h.flat LEFT JOIN side v ON v.page = p.page AND NOT v.flat LEFT JOIN snap sh ON sh.page = p.page AND sh.flat LEFT JOIN snap sv ON sv.page = p.page AND NOT sv.flat),
t AS (SELECT *, CASE WHEN ax1 IS NULL THEN 'no_drawing' WHEN nh = 0 AND nv = 0 THEN 'no_walls' WHEN nh = 0 THEN 'no_horizontal_walls' WHEN nv = 0 THEN 'no_vertical_walls' WHEN x2 <= x1 OR y2 <= y1 THEN 'nothing_left' ELSE 'outlined' END AS status FROM r)
SELECT page, status, CASE WHEN status = 'outlined' THEN x1 END AS x1, CASE WHEN status = 'outlined' THEN y1 END AS y1, CASE WHEN status = 'outlined' THEN x2 END AS x2, CASE WHEN status = 'outlined' THEN y2 END AS y2, CAST(nh AS BIGINT) AS n_horizontal, CAST(nv AS BIGINT) AS n_vertical,
  CASE WHEN status = 'outlined' THEN xs END AS xs, CASE WHEN status = 'outlined' THEN ys END AS ys, CASE WHEN status = 'outlined' THEN (x2 - x1) * (y2 - y1) END AS area FROM t""")
def _(spark, d):
    from ..operators.geometry import area

    got = X.wrapped(*_drawn(spark, d))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.3f", x)), " ")
    return got.select("page", "status", "x1", "y1", "x2", "y2", "n_horizontal", "n_vertical", shown("xs").alias("xs"), shown("ys").alias("ys"), F.when(F.col("polygon").isNotNull(), area(F.col("polygon"))).alias("area"))


_PART_SCHEMA = {
    "type": "object",
    "required": ["id", "sizes"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1},
        "name": {"type": "string", "minLength": 8, "pattern": "^[a-z]"},
        "kind": {"enum": ["LARGE", "SMALL", "ECONOMY", "STANDARD"]},
        "sizes": {"type": "array", "maxItems": 2, "items": {"$ref": "#/$defs/size"}},
    },
    "$defs": {"size": {"type": "object", "required": ["n"], "properties": {"n": {"type": ["number", "null"], "maximum": 40}}}},
}


@query("schema_errors", """WITH p AS (SELECT p_partkey, lower(p_name) AS name, p_type AS kind, p_size AS s, p_retailprice AS price FROM part)
SELECT p_partkey, concat_ws('; ',
  CASE WHEN s % 11 = 0 THEN '$ required sizes' END, CASE WHEN s % 7 = 0 THEN '$ additionalProperties price' END, CASE WHEN s % 13 = 0 THEN '$.id type "integer"' WHEN p_partkey < 1 THEN '$.id minimum 1' END,
  CASE WHEN length(name) < 8 THEN '$.name minLength 8' END, CASE WHEN NOT regexp_matches(name, '^[a-z]') THEN '$.name pattern ^[a-z]' END, CASE WHEN kind NOT IN ('LARGE', 'SMALL', 'ECONOMY', 'STANDARD') THEN '$.kind enum ["LARGE", "SMALL", "ECONOMY", "STANDARD"]' END,
  CASE WHEN s % 11 <> 0 AND s % 3 = 2 THEN '$.sizes maxItems 2' END, CASE WHEN s % 11 <> 0 AND s > 40 THEN '$.sizes[0].n maximum 40' END, CASE WHEN s % 11 <> 0 AND s % 5 = 0 THEN '$.sizes[1] required n' WHEN s % 11 <> 0 AND s % 5 = 1 THEN '$.sizes[1].n type ["number", "null"]' END,
  CASE WHEN s % 11 <> 0 AND s % 3 = 2 THEN '$.sizes[2] type "object"' END) AS errors FROM p""")
def _(spark, d):
    s = F.col("p_size")
    size = lambda i: F.concat(F.lit('{"n": '), i, F.lit("}"))
    second = F.when(s % 5 == 0, "{}").when(s % 5 == 1, '{"n": "x"}').otherwise('{"n": null}')
    sizes = F.concat_ws(", ", size(s.cast("string")), second, F.when(s % 3 == 2, "7"))
    text = F.concat(
        F.lit('{"id": '), F.when(s % 13 == 0, "1.5").otherwise(F.col("p_partkey").cast("string")), F.lit(', "_note": 1, "name": "'), F.lower("p_name"), F.lit('", "kind": "'), F.col("p_type"), F.lit('"'),
        F.when(s % 7 == 0, F.concat(F.lit(', "price": '), F.col("p_retailprice").cast("string"))).otherwise(""), F.when(s % 11 == 0, "").otherwise(F.concat(F.lit(', "sizes": ['), sizes, F.lit("]"))), F.lit("}"),
    )
    errors = H.schema_errors(H.parsed(text), _PART_SCHEMA)
    return read(spark, d, "part").select("p_partkey", F.array_join(F.transform(errors, lambda e: F.concat_ws(" ", e["path"], e["rule"], e["wanted"])), "; ").alias("errors"))


@query("sheet_formulas", """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part), v AS (SELECT p_partkey, a, a * 2 - 1 AS c, a * 2 - 1 + b AS d, CASE WHEN a <> 7 THEN (a * 2 - 1 + b) / (a - 7) END AS e FROM p)
SELECT p_partkey, cell, round(value, 4) AS value, CASE WHEN cell IN ('G', 'H') THEN 'cycle' WHEN value IS NULL THEN 'error' ELSE 'ok' END AS status FROM (
  SELECT p_partkey, unnest(['C', 'D', 'E', 'F', 'G', 'H', 'I']) AS cell, unnest([c, d, e, coalesce(e, 0) * 3, 9, 9, NULL]) AS value FROM v)""")
def _(spark, d):
    cells = {"A": F.col("p_size").cast("string"), "B": F.col("p_retailprice").cast("string"), "C": "=A2*2-1", "D": "=C2+B2", "E": "=$D$2/(A2-7)", "F": "=E2*3", "G": "=G2+1", "H": "=G2+1", "I": "=SUM(A2)"}
    rows = read(spark, d, "part").select("p_partkey", F.create_map(*(x for k, v in cells.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str) else v))).alias("cells"))
    found = rows.select("p_partkey", F.explode(B.formulas(F.col("cells"))).alias("cell", "r"))
    return found.select("p_partkey", "cell", F.round("r.value", 4).alias("value"), "r.status")
