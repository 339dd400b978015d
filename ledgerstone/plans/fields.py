"""Queries on scalar fields: numbers, labels, places, dates, envelopes, formulas, and on records of the importer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as Y
from ..functions import labels as L
from ..functions import scalars as S
from ..operators import declarations as D
from ..operators import importing as I
from ..operators import layout as B
from ..operators import projects as P
from ..sources import readers as R
from ..sources import writers as K
from .registry import query
from .tables import read

_K = "CAST(p_partkey AS VARCHAR)"


def _pick(column, *values):
    """A value of a list by a number modulo its length."""
    return F.get(F.array(*(F.lit(v) for v in values)), (column % len(values)).cast("int"))


@query("label_fields", f"""SELECT p_partkey, 'T1_' || {_K} || '_x' AS dom, CASE p_size % 3 WHEN 0 THEN 'cast in ' || lower(p_type) WHEN 1 THEN '—' ELSE p_type END AS category,
  contains(lower(p_name), lower(substr(p_type, 1, 3))) AS has_type, CASE WHEN p_size % 2 = 0 THEN 'dims.' || lower(p_type) || '.source' END AS source_path, lower('P' || {_K}) AS rid, CAST(27 AS INTEGER) AS col_ab,
  CASE p_size % 4 WHEN 0 THEN '03-concrete.json' WHEN 1 THEN '08-openings.json' WHEN 2 THEN '31-earthwork.json' END AS file FROM part""")
def _(spark, d):
    p, s = read(spark, d, "part"), F.col("p_size")
    key = F.col("p_partkey").cast("string")
    category = F.when(s % 3 == 0, F.concat(F.lit("03_cast_in_"), F.lower("p_type"))).when(s % 3 == 1, "").otherwise(F.col("p_type"))
    path = F.when(s % 2 == 0, F.concat(F.lit("dims."), F.lower("p_type"), F.lit(".value"))).otherwise(F.lit("value"))
    return p.select("p_partkey", L.dom_key(F.concat(F.lit("T1|"), key, F.lit("|x"))).alias("dom"), L.pretty_category(category).alias("category"), L.contains_text(F.col("p_name"), F.substring("p_type", 1, 3)).alias("has_type"), L.sibling_source(path).alias("source_path"), L.record_id(F.concat(F.lit("P"), key)).alias("rid"), F.lit(I.column_number("AB")).alias("col_ab"), L.group_file(_pick(s, "03", "08", "31", "99")).alias("file"))


@query("number_fields", """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN -7.5::DOUBLE ELSE p_retailprice END AS parsed,
  CASE WHEN p_size % 5 >= 3 THEN p_retailprice WHEN p_size % 5 = 2 THEN NULL END AS cell, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END AS text,
  'last ' || CAST(p_partkey AS VARCHAR) AS fallback, p_size * 0.5::DOUBLE * 2 AS vol, CASE WHEN p_size % 7 = 0 THEN NULL ELSE floor(p_retailprice / (p_size % 7 * 0.5::DOUBLE) * 10000 + 0.5) / 10000 END AS len,
  CASE WHEN p_size % 6 = 0 THEN 1.0::DOUBLE ELSE least(p_size * 4, 100) / 100.0::DOUBLE END AS share,
  CASE WHEN p_size % 2 = 0 THEN floor(p_retailprice * 1.0001::DOUBLE * 1000 + 0.5) / 1000 ELSE floor(p_retailprice * 1.0001::DOUBLE * 100 + 0.5) / 100 END AS shown FROM part""")
def _(spark, d):
    p, s, price = read(spark, d, "part"), F.col("p_size"), F.col("p_retailprice")
    shown = F.format_string("%.2f", price)
    raw = F.when(s % 5 == 0, "n/a").when(s % 5 == 1, " ").when(s % 5 == 2, "-7.5 each").otherwise(F.concat(F.lit("$"), F.concat(F.substring(shown, 1, 1), F.lit(","), F.substring(shown, 2, 30))))
    cell = F.when(s % 5 == 2, "none").when(s % 5 >= 3, F.concat(F.lit(" "), shown))
    return p.select(
        "p_partkey", S.parse_numeric(raw).alias("parsed"), I.number(cell).alias("cell"), I.flag(_pick(s, " true", "FALSE", "maybe")).alias("flag"), I.text(F.when(s % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_type"))).alias("text"),
        I.fallback_of(F.concat(F.lit('=IFERROR(VLOOKUP("x", A1), "last '), F.col("p_partkey").cast("string"), F.lit('")'))).alias("fallback"),
        L.volume(s.cast("double"), F.lit(0.5), F.lit(2.0)).alias("vol"), L.length_of_volume(price, (s % 7).cast("double"), F.lit(0.5)).alias("len"),
        S.percent_share(F.when(s % 6 != 0, (s * 4).cast("double"))).alias("share"), L.display_value(F.when(s % 2 == 0, "dim_columns_piers").otherwise("dim_area"), price * 1.0001).alias("shown"),
    )


@query("places", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'British Columbia' WHEN 1 THEN 'Ontario' WHEN 2 THEN 'Quebec' END AS province, CASE s_suppkey % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'US' WHEN 2 THEN 'US' END AS country,
  CASE s_suppkey % 3 WHEN 0 THEN 13 WHEN 1 THEN 50 ELSE 0 END AS n_options, CASE s_suppkey % 3 WHEN 0 THEN 'Alberta' WHEN 1 THEN 'Alabama' END AS first_option,
  CASE s_suppkey % 5 WHEN 0 THEN 'CAN,USA' WHEN 1 THEN 'EUR' WHEN 2 THEN 'DEU,FRA' WHEN 3 THEN 'CAN,USA' ELSE '' END AS markets FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    options = L.province_options(_pick(k, "Canada", "United States", "Peru"))
    markets = _pick(k, "North America", "Western part aside, all Europe".replace("Western part aside, all ", ""), "DEU; FRA, x", "Canada, United States", "Eastern Europe")
    return read(spark, d, "supplier").select("s_suppkey", L.province(_pick(k, "bc", " Ontario ", "QC", "Bavaria")).alias("province"), L.country_code(_pick(k, "canada", "USA", " us", "de")).alias("country"), F.size(options).alias("n_options"), F.get(options, F.lit(0)).alias("first_option"), F.array_join(D.market_codes(markets), ",").alias("markets"))


@query("operator_names", """SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'EPD International AB' WHEN 1 THEN 'IBU' WHEN 2 THEN 'CSA Group' WHEN 3 THEN 'ASTM International' WHEN 4 THEN 'AWC & CWC' WHEN 5 THEN 'UL Environment' END AS operator,
  'Maker ' || CAST(s_suppkey % 9 AS VARCHAR) || ' Group' AS tidy FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    said = _pick(k, "by EPD  International\nAB, Box 1", "Institut Bauen und Umwelt e.V.", "the CSA group", "ASTM International 100 Barr", "American Wood Council and others", "UL ENVIRONMENT", "nobody ibu")
    name = F.concat(F.lit("Maker "), (k % 9).cast("string"), F.lit(" Group"), _pick(k, " https://example.org/x", " 333 Road", ""))
    return read(spark, d, "supplier").select("s_suppkey", D.program_operator(said).alias("operator"), D.tidy_operator(name).alias("tidy"))


@query("dates_behind_labels", """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '2021-05-03' WHEN 1 THEN '2020-0' || CAST(s_suppkey % 9 + 1 AS VARCHAR) || '-11' END AS issued, CASE WHEN s_suppkey % 2 = 0 THEN '2025-10-2' || CAST(s_suppkey % 10 AS VARCHAR) END AS loose,
  CASE s_suppkey % 4 WHEN 0 THEN 'just now' WHEN 1 THEN '30m ago' WHEN 2 THEN '3h ago' ELSE '2024-04-01 09:40' END AS ago FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, "a\nDate of Issue:  3 May 2021\n").when(k % 3 == 1, F.concat(F.lit("Date of Issue 11/"), (k % 9 + 1).cast("string"), F.lit("/2020"))).otherwise("Issued 2020-01-01")
    loose = F.when(k % 2 == 0, F.concat(F.lit("Publication date : 202 5 - 10 - 2 "), (k % 10).cast("string")))
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    at = _pick(k, "2024-05-01 11:59:50", "2024-05-01 11:30:00", "2024-05-01 09:10:00", "2024-04-01 09:40:00").cast("timestamp")
    return read(spark, d, "supplier").select("s_suppkey", S.date_after(text, r"Date\s+of\s+Issue").alias("issued"), S.loose_date_after(loose, r"Publication\s+date\s*:?").alias("loose"), S.relative_time(at, now).alias("ago"))


@query("provenance_envelopes", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'pdf-parser' END AS type, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN 'project-level parameter' END AS summary, CASE WHEN p_size % 3 = 0 THEN 'A2.01,A' || CAST(p_size AS VARCHAR) ELSE '' END AS sheets FROM part""")
def _(spark, d):
    s = F.col("p_size")
    made = L.provenance(F.lit("u1"), F.array("p_brand"), F.col("p_name"), F.array(F.lit("A2.01"), F.concat(F.lit("A"), s.cast("string"))))
    got = L.read_provenance(F.when(s % 3 == 0, made).when(s % 3 == 1, "pdf:param").otherwise("pdf"))
    return read(spark, d, "part").select("p_partkey", got["type"].alias("type"), got["summary"].alias("summary"), F.array_join(got["sheets"], ",").alias("sheets"))


@query("cell_formulas", """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_size * 2 + 1.5::DOUBLE WHEN 1 THEN (p_size + 10.0::DOUBLE) / 4 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE -(p_size * 2 + 1.5::DOUBLE) END AS value FROM part""")
def _(spark, d):
    s = F.col("p_size")
    formula = _pick(s, "=A1*2+1.5", "=(A1 + B1)/4", "=A1/0", "=SUM(A1)", "=-C1")
    cells = F.create_map(F.lit("A"), s.cast("string"), F.lit("B"), F.lit("10"), F.lit("C"), F.lit("=A1*2+1.5"))
    return read(spark, d, "part").select("p_partkey", B.evaluated(formula, cells).alias("value"))


_AT = {"id": "A", "name": "B", "category": "C", "manufacturer": "D", "country": "E", "stated": "F", "divisor": "G", "unit": "H", "density": "I", "thickness": "J", "bio": "K", "carbon": "L", "retention": "M", "expiry": "N", "standards": "O", "hidden": "P"}
_GROUPS = [("bolt", "05"), ("plate", "05"), ("ring", "03"), ("gear", "06")]


def _records(spark, d):
    p, s = read(spark, d, "part"), F.col("p_size")
    cells = [
        F.when(s % 10 == 0, " ").otherwise(F.concat(F.lit("P"), F.col("p_partkey").cast("string"))), F.col("p_name"), F.col("p_type"), F.when(s % 3 == 0, "").otherwise(F.col("p_brand")), _pick(s, "Canada", " usa", "Mars"),
        F.format_string("%.2f", "p_retailprice"), _pick(s, "2", "4", "x"), _pick(s, "M2", "m³", "kg of it"), s.cast("string"), F.lit("0.5"), F.lit("0.5"), F.lit("0.4"), F.lit("0.25"),
        _pick(s, "2027", "45292", "12"), _pick(s, "ISO 14025; EN 15804", "", " a ,b"), _pick(s, "TRUE", "FALSE"),
    ]
    rows = p.select(*(c.alias(f"c{i}") for i, c in enumerate(cells)))
    countries = spark.createDataFrame([("canada", ["CAN"]), ("usa", ["USA"])], "country string, codes array<string>")
    return I.material_record(rows, _AT, _GROUPS, countries)


_RECORD_SQL = """(SELECT 'p' || CAST(p_partkey AS VARCHAR) AS id, p_name AS display_name, p_type AS category, CASE WHEN contains(lower(p_name || ' ' || p_type), 'bolt') OR contains(lower(p_name || ' ' || p_type), 'plate') THEN '05' WHEN contains(lower(p_name || ' ' || p_type), 'ring') THEN '03' WHEN contains(lower(p_name || ' ' || p_type), 'gear') THEN '06' END AS group_prefix,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS manufacturer, ['CAN', 'USA', ''][p_size % 3 + 1] AS countries, CASE p_size % 3 WHEN 2 THEN NULL ELSE floor(round(p_retailprice, 2) / (CASE p_size % 3 WHEN 0 THEN 2 ELSE 4 END)::DOUBLE * 100 + 0.5) / 100 END AS gwp,
  ['m2', 'm3', 'kg'][p_size % 3 + 1] AS functional_unit, p_size % 2 = 0 AS hidden, floor((p_size * 0.5::DOUBLE * 0.5 * 0.4) * 3.67::DOUBLE * 100 + 0.5) / 100 AS full_carbon, ['2027-12-31', '2024-01-01', '0012-12-31'][p_size % 3 + 1] AS expiry,
  ['ISO 14025|EN 15804', '', 'a|b'][p_size % 3 + 1] AS standards FROM part WHERE p_size % 10 <> 0)"""


@query("material_records", f"SELECT id, display_name, category, group_prefix, manufacturer, countries, gwp, functional_unit, CASE WHEN hidden THEN 'hidden' ELSE 'listed' END AS visibility, full_carbon, expiry, standards FROM {_RECORD_SQL}")
def _(spark, d):
    r = _records(spark, d)
    return r.select("id", "naming.display_name", "classification.category", "classification.group_prefix", F.col("manufacturer.name").alias("manufacturer"), F.array_join("manufacturer.countries", ",").alias("countries"), F.col("carbon.common_value").alias("gwp"), "carbon.functional_unit", "status.visibility", "carbon.biogenic.full_carbon", F.col("epd.expiry_date").alias("expiry"), F.array_join("epd.standards", "|").alias("standards"))


@query("listed_index", f"SELECT id, display_name, category, group_prefix, manufacturer, countries, gwp, functional_unit FROM {_RECORD_SQL} WHERE NOT hidden")
def _(spark, d):
    return I.index_entries(_records(spark, d), listed_only=True).withColumn("countries", F.array_join("countries", ","))


@query("detail_lines", f"""SELECT id, block, label, shown FROM (SELECT id, unnest(['identity', 'identity', 'identity', 'identity', 'provenance', 'provenance', 'physical']) AS block, unnest(['id', 'display_name', 'group', 'product_type', 'manufacturer', 'visibility', 'density']) AS label,
  unnest([id, display_name, coalesce(group_prefix, '—'), '—', coalesce(manufacturer, '—'), CASE WHEN hidden THEN 'hidden' ELSE 'listed' END, '—']) AS shown FROM {_RECORD_SQL})""")
def _(spark, d):
    lines = Y.detail_lines(_records(spark, d))
    return lines.filter(F.col("label").isin("id", "display_name", "group", "product_type", "manufacturer", "visibility", "density")).drop("line_no")


@query("file_checks", """WITH r AS (SELECT p_brand AS path, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END AS rid, p_size - 3 AS gwp, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place FROM part)
  SELECT path, CAST(place AS INTEGER) AS place, rid AS record_id, concat_ws('; ', CASE WHEN rid IS NULL THEN 'id is required' END, CASE WHEN gwp < 0 THEN 'gwp is at least 0' END) AS errors FROM r WHERE rid IS NULL OR gwp < 0
  UNION ALL SELECT 'empty', NULL, NULL, 'id is required'""")
def _(spark, d):
    record = F.struct("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") - 3).alias("gwp"))
    files = read(spark, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.array_sort(F.collect_list(record)).alias("records"))
    none = spark.createDataFrame([("empty", None)], "path string, records array<struct<p_partkey:bigint,id:string,gwp:int>>")
    got = P.file_errors(files.union(none), {"id is required": F.col("r.id").isNotNull(), "gwp is at least 0": F.col("r.gwp") >= 0})
    return got.withColumn("errors", F.array_join("errors", "; "))


@query("trusted_fields", """WITH n AS (SELECT CASE WHEN max(s_suppkey % 7) >= 0 THEN arg_max(s_nationkey, (s_suppkey % 7, s_nationkey)) END AS project FROM supplier), f AS (SELECT 'd' || CAST(s_suppkey % 50 AS VARCHAR) AS dim, max(s_acctbal) AS v FROM supplier, n WHERE s_nationkey = project AND s_suppkey % 3 <> 0 GROUP BY 1),
  c AS (SELECT 'd' || CAST(n_nationkey AS VARCHAR) AS dim, n_nationkey * 1.0::DOUBLE AS v FROM nation) SELECT coalesce(f.dim, c.dim) AS field_id, coalesce(f.v, c.v) AS value, CASE WHEN f.v IS NOT NULL THEN 'imported' ELSE 'derived' END AS state FROM f FULL JOIN c ON f.dim = c.dim""")
def _(spark, d):
    s, k = read(spark, d, "supplier"), F.col("s_suppkey")
    previews = s.groupBy(F.col("s_nationkey").alias("project"), F.concat(F.lit("d"), (k % 50).cast("string")).alias("dim")).agg(F.max(F.when(k % 3 != 0, F.col("s_acctbal"))).alias("value"))
    projects = s.groupBy(F.col("s_nationkey").alias("project")).agg(F.max(k % 7).alias("updated"))
    current = read(spark, d, "nation").select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("field_id"), F.col("n_nationkey").cast("double").alias("value"), F.lit("derived").alias("state"))
    return P.trusted_import(previews, projects, current)


@query("feeding_components", """SELECT 'd' || CAST(n_nationkey AS VARCHAR) AS dim, coalesce(c, '') AS components FROM nation LEFT JOIN (SELECT dim, string_agg(DISTINCT component, ',' ORDER BY component) AS c FROM
  (SELECT p_type AS component, unnest(['d' || CAST(p_size % 20 AS VARCHAR), 'd' || CAST(p_size % 7 AS VARCHAR)]) AS dim FROM part) GROUP BY 1) ON dim = 'd' || CAST(n_nationkey AS VARCHAR)""")
def _(spark, d):
    dim = lambda c: F.concat(F.lit("d"), c.cast("string"))
    targets = read(spark, d, "part").select(F.col("p_type").alias("component"), F.array(dim(F.col("p_size") % 20), dim(F.col("p_size") % 7)).alias("dims"))
    got = P.components_of(targets, read(spark, d, "nation").select(dim(F.col("n_nationkey")).alias("dim")))
    return got.withColumn("components", F.array_join("components", ","))


@query("requirement_rows", """SELECT p_partkey FROM part WHERE (p_size % 4 = 0 OR p_size % 4 = 1 OR p_size % 4 = 2) AND (p_size % 3 IN (0, 2))""")
def _(spark, d):
    s = F.col("p_size")
    project = F.when(s % 4 == 0, F.array(F.lit("house"), F.lit("shop"))).when(s % 4 == 1, F.array().cast("array<string>")).when(s % 4 == 3, F.array(F.lit("shop")))
    size = F.when(s % 3 == 0, F.array(F.lit("small"))).when(s % 3 == 1, F.array(F.lit("large")))
    rows = read(spark, d, "part").select("p_partkey", project.alias("project"), size.alias("size"))
    return P.applicable(rows, {"project": "house", "size": "small"}).select("p_partkey")


@query("coverage_report", """SELECT CAST(0 AS INTEGER) AS line_no, '| p_brand | n_rows | n_big |' AS line UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT 2, '| ' || p_brand || ' | ' || CAST(count(*) AS VARCHAR) || ' | ' || CAST(count(*) FILTER (WHERE p_size > 20) AS VARCHAR) || ' |' FROM part GROUP BY p_brand""")
def _(spark, d):
    matrix = read(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("p_size") > 20, 1)).alias("n_big"))
    return K.coverage_lines(matrix, "p_brand").withColumn("line", F.regexp_replace("line", r"^\| --- \| --- \| --- \|$|^\|( --- \|)+$", "| --- | --- | --- |"))


@query("state_pairs", """SELECT c_custkey, 'name' AS field_id, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'seg', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'key', CAST(c_custkey AS VARCHAR) FROM customer""")
def _(spark, d):
    c = read(spark, d, "customer")
    bare = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg")))
    dump = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"fields": '), bare, F.lit("}"))).otherwise(bare)
    from_json = c.select("c_custkey", F.explode(R.state_json(dump)).alias("e")).select("c_custkey", F.col("e.key").alias("field_id"), F.col("e.value").alias("value"))
    pairs = R.state_csv(F.array(F.lit("key: the customer's")), F.array(F.col("c_custkey").cast("string")))
    return from_json.union(c.select("c_custkey", F.explode(pairs).alias("e")).select("c_custkey", "e.field_id", "e.value"))
