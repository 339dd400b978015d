"""Queries on declaration texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import extraction as E
from .registry import query
from .tables import read

#: Parts as declaration texts of several lines.
_DECL = """(SELECT p_partkey, 'EPD' || chr(10) || p_name || ' product by ' || p_brand || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'Declared unit:   1 m²' ELSE 'Functional unit: 2.5 Tonnes' END || chr(10) || 'Owner : ' || p_brand || '  Ltd' || chr(10)
  || 'Stage A1 A2 A3 C1' || chr(10) || 'GWP total ' || printf('%.2f', p_retailprice) || chr(10) || 'Ozone ' || printf('%.1f', p_size * 1000.0) || chr(10) || 'values ' || printf('%.2f', p_retailprice) || ' ' || printf('%.1f', p_size + 0.5) || ' 0.25 7.75' AS t FROM part)"""


def declarations(spark, d):
    size = F.col("p_size")
    t = F.concat_ws("\n", F.lit("EPD"), F.concat("p_name", F.lit(" product by "), "p_brand"), F.when(F.col("p_partkey") % 2 == 0, "Declared unit:   1 m²").otherwise("Functional unit: 2.5 Tonnes"), F.concat(F.lit("Owner : "), "p_brand", F.lit("  Ltd")), F.lit("Stage A1 A2 A3 C1"), F.concat(F.lit("GWP total "), F.format_string("%.2f", "p_retailprice")), F.concat(F.lit("Ozone "), F.format_string("%.1f", size * 1000.0)), F.concat(F.lit("values "), F.format_string("%.2f", "p_retailprice"), F.lit(" "), F.format_string("%.1f", size + F.lit(0.5)), F.lit(" 0.25 7.75")))
    return read(spark, d, "part").select("p_partkey", t.alias("t"))


@query("label_value_extract", f"SELECT p_partkey, trim(regexp_replace(regexp_extract(t, 'Owner : ([^\\n]+)', 1), '\\s+', ' ', 'g')) AS owner, nullif(regexp_extract(t, 'Declared unit:\\s*([^\\n]+)', 1), '') AS unit_text FROM {_DECL}")
def _(spark, d):
    return declarations(spark, d).select("p_partkey", E.label_value(F.col("t"), "owner").alias("owner"), E.label_value(F.col("t"), "declared unit").alias("unit_text"))


@query("declared_unit", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE ELSE 2.5::DOUBLE END AS amount, CASE WHEN p_partkey % 2 = 0 THEN 'm2' ELSE 't' END AS unit FROM part")
def _(spark, d):
    t = F.coalesce(E.label_value(F.col("t"), "declared unit"), E.label_value(F.col("t"), "functional unit"))
    got = E.declared_unit(t)
    return declarations(spark, d).select("p_partkey", got["amount"].alias("amount"), got["unit"].alias("unit"))


@query("first_line_pick", "SELECT p_partkey, p_name || ' product by ' || p_brand AS title FROM part")
def _(spark, d):
    return declarations(spark, d).select("p_partkey", E.first_line(F.col("t")).alias("title"))


@query("indicator_totals", "SELECT p_partkey, round(p_retailprice, 2) AS gwp, p_size * 1000::DOUBLE AS ozone, NULL::DOUBLE AS smog FROM part")
def _(spark, d):
    slots = {"gwp": ["global warming", "gwp"], "ozone": ["odp", "ozone"], "smog": ["smog"]}
    return declarations(spark, d).select("p_partkey", *E.indicator_totals(F.col("t"), slots))


@query("stage_headers", "SELECT p_partkey, 4 AS line, 'A1,A2,A3,C1' AS stages FROM part")
def _(spark, d):
    return E.stage_headers(E.lines_of(declarations(spark, d), "p_partkey", "t")).select("p_partkey", "line", F.array_join("stages", ",").alias("stages"))


@query("stage_zip", """SELECT p_partkey, stage, CASE stage WHEN 'A1' THEN round(p_retailprice, 2) WHEN 'A2' THEN p_size + 0.5::DOUBLE WHEN 'A3' THEN 0.25::DOUBLE ELSE 7.75::DOUBLE END AS value FROM part, (VALUES ('A1'),('A2'),('A3'),('C1')) s(stage)""")
def _(spark, d):
    lines = E.lines_of(declarations(spark, d), "p_partkey", "t").withColumn("stages", E.stage_codes(F.col("line_text")))
    values = F.when(F.col("line_text").startswith("values"), F.transform(S.number_tokens(F.col("line_text")), lambda x: x.cast("double")))
    return E.zip_stages(lines, "p_partkey", values)


@query("ground_truth_eval", """SELECT verdict, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN got IS NULL THEN 'missing' WHEN abs(got - want) <= greatest(1e-12, 0.01::DOUBLE * abs(want)) THEN 'match' ELSE 'wrong' END AS verdict FROM (SELECT p_retailprice AS want, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN p_retailprice * 1.05::DOUBLE ELSE p_retailprice * 1.005::DOUBLE END AS got FROM part)) GROUP BY 1""")
def _(spark, d):
    p = read(spark, d, "part")
    found = p.filter("p_partkey % 11 <> 0").select("p_partkey", (F.col("p_retailprice") * F.when(F.col("p_partkey") % 7 == 0, 1.05).otherwise(1.005)).alias("got"))
    return E.against_truth(p.select("p_partkey", F.col("p_retailprice").alias("want")), found, ["p_partkey"]).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
