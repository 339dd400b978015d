"""Text queries: numbers, dimensions, dates, escapes, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from .registry import query
from .tables import read


def _num(expr: str) -> str:
    bare = f"trim(regexp_replace({expr}, '[$£€¥,]', '', 'g'))"
    return f"CASE WHEN upper({bare}) IN ('', 'N/A') THEN 0 ELSE coalesce(TRY_CAST(nullif(regexp_extract({bare}, '^([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE), 0) END"


_PRICES = """(SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '$' || printf('%.2f', p_retailprice) WHEN 1 THEN ' 1,' || CAST(p_size + 100 AS VARCHAR) || ' kg' WHEN 2 THEN 'N/A' WHEN 3 THEN '' WHEN 4 THEN '-' || CAST(p_size AS VARCHAR) || 'e2x' WHEN 5 THEN 'abc' ELSE '€' || CAST(p_size AS VARCHAR) || '.' END AS t FROM part)"""


def _prices(spark, d):
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 7
    t = F.when(k == 0, F.concat(F.lit("$"), F.format_string("%.2f", "p_retailprice"))).when(k == 1, F.concat(F.lit(" 1,"), (F.col("p_size") + 100).cast("string"), F.lit(" kg"))).when(k == 2, "N/A").when(k == 3, "").when(k == 4, F.concat(F.lit("-"), size, F.lit("e2x"))).when(k == 5, "abc").otherwise(F.concat(F.lit("€"), size, F.lit(".")))
    return read(spark, d, "part").select("p_partkey", t.alias("t"))


@query("parse_numeric", f"SELECT p_partkey, {_num('t')} AS n FROM {_PRICES}")
def _(spark, d):
    return _prices(spark, d).select("p_partkey", S.parse_numeric(F.col("t")).alias("n"))


@query("euro_number", "SELECT p_partkey, TRY_CAST(CASE WHEN contains(t, '.') AND contains(t, ',') THEN replace(t, ',', '') ELSE replace(t, ',', '.') END AS DOUBLE) AS n FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '1,' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '.5' WHEN 1 THEN CAST(p_size AS VARCHAR) || ',25' ELSE CAST(p_size AS VARCHAR) || '.75' END AS t FROM part)")
def _(spark, d):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    t = F.when(k == 0, F.concat(F.lit("1,"), F.lpad(size, 3, "0"), F.lit(".5"))).when(k == 1, F.concat(size, F.lit(",25"))).otherwise(F.concat(size, F.lit(".75")))
    return read(spark, d, "part").select("p_partkey", S.euro_number(t).alias("n"))


@query("number_tokens", """SELECT p_partkey, array_to_string(regexp_extract_all(t, '(?:^|[^0-9.,])((?:[0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]+)?|[0-9]+\\.[0-9]+|[0-9]{3,})(?:[eE][+-]?[0-9]+)?)', 1), '|') AS tokens FROM (SELECT p_partkey, 'gwp ' || printf('%.2f', p_retailprice) || ' in ' || CAST(p_size AS VARCHAR) || ' of 3,490.16 and ' || CAST(p_partkey + 100 AS VARCHAR) || ' 1.5E-03' AS t FROM part)""")
def _(spark, d):
    t = F.concat(F.lit("gwp "), F.format_string("%.2f", "p_retailprice"), F.lit(" in "), F.col("p_size").cast("string"), F.lit(" of 3,490.16 and "), (F.col("p_partkey") + 100).cast("string"), F.lit(" 1.5E-03"))
    return read(spark, d, "part").select("p_partkey", F.array_join(S.number_tokens(t), "|").alias("tokens"))


@query("dimension_parse", """SELECT p_partkey, round(CASE WHEN imperial BETWEEN 0.05 AND 100 THEN imperial END, 6) AS imperial_m, round(CASE WHEN metric BETWEEN 0.05 AND 100 THEN metric END, 6) AS metric_m FROM (SELECT p_partkey, p_size * 0.3048::DOUBLE + (p_partkey % 12 + 0.5::DOUBLE) * 0.0254::DOUBLE AS imperial,
  CASE p_partkey % 4 WHEN 0 THEN p_size / 1000::DOUBLE WHEN 1 THEN CASE WHEN p_size < 30 THEN p_size + 0.5::DOUBLE ELSE (p_size + 0.5::DOUBLE) / 1000 END WHEN 2 THEN p_size * 100 / 1000::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS metric FROM part)""")
def _(spark, d):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    feet = F.concat(size, F.lit("'-"), (F.col("p_partkey") % 12).cast("string"), F.lit(' 1/2"'))
    metric = F.when(k == 0, size).when(k == 1, F.concat(size, F.lit(".5"))).when(k == 2, F.concat((F.col("p_size") * 100).cast("string"), F.lit(" mm"))).otherwise(F.concat(size, F.lit(" m")))
    return read(spark, d, "part").select("p_partkey", F.round(S.parse_imperial(feet), 6).alias("imperial_m"), F.round(S.parse_metric(metric), 6).alias("metric_m"))


@query("distance_parse", """SELECT p_partkey, round(CASE p_partkey % 6 WHEN 0 THEN p_size + 6 / 12::DOUBLE WHEN 5 THEN NULL ELSE CAST(p_size AS DOUBLE) END, 6) AS value, CASE p_partkey % 6 WHEN 0 THEN 'ft' WHEN 1 THEN 'mm' WHEN 2 THEN 'm' WHEN 3 THEN 'in' END AS unit FROM part""")
def _(spark, d):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    t = F.when(k == 0, F.concat(size, F.lit("' 6\""))).when(k == 1, F.concat(size, F.lit("mm"))).when(k == 2, F.concat(size, F.lit(" metres"))).when(k == 3, F.concat(size, F.lit('"'))).when(k == 4, size).otherwise(F.concat(size, F.lit(" cubits")))
    got = S.parse_distance(t)
    return read(spark, d, "part").select("p_partkey", F.round(got["value"], 6).alias("value"), got["unit"].alias("unit"))


_RATIOS = (1, 2, 5, 10, 20, 24, 25, 48, 50, 64, 96, 100, 128, 192, 200, 250, 500, 1000)


@query("scale_detect", f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CASE WHEN p_size IN {_RATIOS} THEN p_size WHEN 50 IN {_RATIOS} AND p_partkey % 2 = 0 THEN 50 ELSE p_size END END AS ratio, CASE WHEN p_partkey % 5 = 0 THEN 'nts' ELSE 'metric' END AS kind FROM part""")
def _(spark, d):
    size = F.col("p_size").cast("string")
    t = F.when(F.col("p_partkey") % 5 == 0, "SCALE: N.T.S.").otherwise(F.concat(F.lit("plan 1:"), size, F.when(F.col("p_partkey") % 2 == 0, " detail 1:50").otherwise("")))
    return read(spark, d, "part").select("p_partkey", t.alias("t")).select("p_partkey", detected_scale(F.col("t")).alias("ratio"), F.when(F.col("t").rlike(r"(?i)n\.?t\.?s"), "nts").otherwise("metric").alias("kind"))


def detected_scale(text):
    """The drawing scale that a text names: the first of the usual ratios, else the first at all; none where it says 'not to scale'."""
    all_ = F.transform(F.regexp_extract_all(text, F.lit(r"1\s*:\s*(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    usual = F.filter(all_, lambda x: x.isin(*_RATIOS))
    return F.when(text.rlike(r"(?i)n\.?t\.?s"), F.lit(None).cast("int")).otherwise(F.coalesce(F.get(usual, F.lit(0)), F.get(all_, F.lit(0))))


_SERIAL = "CASE WHEN s >= 30000 THEN strftime(DATE '1899-12-30' + CAST(s AS INTEGER), '%Y-%m-%d') END"


@query("excel_date", f"SELECT o_orderkey, {_SERIAL} AS iso, CASE WHEN e < 3000 THEN lpad(CAST(e AS VARCHAR), 4, '0') || '-12-31' ELSE {_SERIAL.replace('s >=', 'e >=').replace('CAST(s', 'CAST(e')} END AS expiry FROM (SELECT o_orderkey, 29000 + o_orderkey % 20000 AS s, CASE o_orderkey % 3 WHEN 0 THEN 2000 + o_orderkey % 40 WHEN 1 THEN 12000 ELSE 44000 + o_orderkey % 900 END AS e FROM orders)")
def _(spark, d):
    k = F.col("o_orderkey")
    e = F.when(k % 3 == 0, 2000 + k % 40).when(k % 3 == 1, 12000).otherwise(44000 + k % 900)
    return read(spark, d, "orders").select("o_orderkey", S.excel_serial_to_iso(29000 + k % 20000).alias("iso"), S.expiry_to_iso(e).alias("expiry"))


@query("date_multi_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN strftime(o_orderdate, '%Y-%m') || '-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def _(spark, d):
    k, t = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(t, "'issued' yyyy-MM-dd")).when(k == 1, F.date_format(t, "d/M/yyyy")).when(k == 2, F.date_format(t, "d MMMM yyyy")).when(k == 3, F.date_format(t, "MMMM d, yyyy")).otherwise(F.date_format(t, "MMMM yyyy"))
    return read(spark, d, "orders").select("o_orderkey", S.parse_date(text).alias("iso"))


@query("json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing.leaf') AS leaf FROM events")
def _(spark, d):
    v = F.try_parse_json("props")
    return read(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing.leaf", "string").alias("leaf"))


@query("sparse_prune", """SELECT c_custkey, '{' || array_to_string(list_filter(['"id":' || CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN '"name":"' || c_name || '"' END, CASE WHEN c_custkey % 3 = 0 THEN '"epd":{"segment":"' || c_mktsegment || '"}' END, '"tags":[]'], lambda x: x IS NOT NULL), ',') || '}' AS record FROM customer""")
def _(spark, d):
    k = F.col("c_custkey")
    record = F.struct(k.alias("id"), F.when(k % 2 == 0, F.col("c_name")).alias("name"), F.when(k % 3 == 0, F.struct(F.col("c_mktsegment").alias("segment"), F.lit(None).cast("string").alias("none"))).alias("epd"), F.array().cast("array<string>").alias("tags"))
    return read(spark, d, "customer").select("c_custkey", F.to_json(record, {"ignoreNullFields": "true"}).alias("record"))


@query("split_clean", "SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_name || ', ;' || p_type || ' ;  ' || p_brand || ',', '[,;]\\s*'), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM part")
def _(spark, d):
    t = F.concat("p_name", F.lit(", ;"), "p_type", F.lit(" ;  "), "p_brand", F.lit(","))
    return read(spark, d, "part").select("p_partkey", F.array_join(S.split_clean(t), "|").alias("items"))


@query("footnote_split", "SELECT p_partkey, trim(split_part(t, '*', 1)) AS prim, trim(regexp_replace(t, '^[^*]*\\*?', '')) AS suffix, regexp_matches(trim(regexp_replace(t, '^[^*]*\\*?', '')), '(?i)^expired') AS expired FROM (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' * Expired 2020' WHEN 1 THEN ' *see note' ELSE '' END AS t FROM part)")
def _(spark, d):
    k = F.col("p_partkey") % 3
    t = F.concat("p_name", F.when(k == 0, " * Expired 2020").when(k == 1, " *see note").otherwise(""))
    suffix = F.trim(F.regexp_replace(t, r"^[^*]*\*?", ""))
    return read(spark, d, "part").select("p_partkey", F.trim(F.substring_index(t, "*", 1)).alias("prim"), suffix.alias("suffix"), suffix.rlike("(?i)^expired").alias("expired"))


@query("clean_line", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(S.clean_line(F.col("text"))).alias("h"))


@query("html_escape", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS h FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(S.html_escape(F.col("html"))).alias("h"))


@query("csv_escape", """SELECT k, CASE WHEN regexp_matches(v, '[,"\\n]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS cell FROM (SELECT k, CASE WHEN regexp_matches(t, '^-?[0-9,]+(\\.[0-9]+)?$') THEN replace(t, ',', '') ELSE t END AS v FROM
  (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '1,' || CAST(o_orderkey AS VARCHAR) || '.5' WHEN 1 THEN o_orderpriority || ', "x"' WHEN 2 THEN 'a' || chr(10) || 'b' ELSE o_orderstatus END AS t FROM orders))""")
def _(spark, d):
    k = F.col("o_orderkey")
    t = F.when(k % 4 == 0, F.concat(F.lit("1,"), k.cast("string"), F.lit(".5"))).when(k % 4 == 1, F.concat("o_orderpriority", F.lit(', "x"'))).when(k % 4 == 2, "a\nb").otherwise(F.col("o_orderstatus"))
    return read(spark, d, "orders").select(k.alias("k"), S.csv_escape(t).alias("cell"))


@query("csv_parse", """SELECT c_custkey, c_name || ', "' || c_mktsegment || '"' AS c1, printf('%.2f', c_acctbal) AS c2 FROM customer""")
def _(spark, d):
    from ..sources.readers import csv_line

    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", quoted(F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))), F.format_string("%.2f", "c_acctbal"))
    cells = csv_line(F.col("line"), 2)
    return read(spark, d, "customer").select("c_custkey", line.alias("line")).select("c_custkey", cells[0].alias("c1"), cells[1].alias("c2"))


