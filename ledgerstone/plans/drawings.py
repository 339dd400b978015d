"""Queries on drawing sheets, declaration records and project fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import declarations as D
from ..operators import projects as P
from ..operators import sheets as H
from .registry import query
from .tables import read

#: Sheets from parts: a number of six kinds and a title of seven.
_TITLES = ("Main floor plan", "Roof plan", "Site plan", "East elevation", "Section A-A", "Door schedule", "")
_TITLE_SQL = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TITLES)) + " END"


def sheets(spark, d):
    k = F.col("p_partkey")
    title = F.get(F.array(*map(F.lit, _TITLES)), (k % 7).cast("int"))
    number = F.concat(F.when(k % 4 == 0, "S").otherwise("A"), (k % 10).cast("string"), F.lit(".01"))
    return read(spark, d, "part").select("p_partkey", "p_size", number.alias("number"), title.alias("title"))


@query("sheet_classify", """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'plan' WHEN 1 THEN 'plan' WHEN 2 THEN 'site' WHEN 3 THEN 'elevation' WHEN 4 THEN 'section' WHEN 5 THEN 'schedule'
  ELSE CASE WHEN p_partkey % 4 = 0 THEN 'structural' ELSE ['general', 'site', 'plan', 'plan', 'elevation', 'section', 'detail', 'interior', 'schedule', '3d'][p_partkey % 10 + 1] END END AS cls FROM part""")
def _(spark, d):
    return sheets(spark, d).select("p_partkey", H.sheet_class(F.col("number"), F.col("title")).alias("cls"))


@query("title_phrase", f"SELECT p_partkey, CASE WHEN p_partkey % 7 IN (5, 6) THEN NULL ELSE {_TITLE_SQL} END AS title FROM part")
def _(spark, d):
    line = F.concat_ws(" ", F.lit("WHITE FASCIA:"), "title", F.lit("/ 12"))
    return sheets(spark, d).select("p_partkey", H.title_phrase(line).alias("title"))


@query("auto_tags", """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'slab_above_grade' WHEN p_partkey % 7 = 1 THEN 'roof_plan' WHEN p_partkey % 7 = 3 THEN 'wall_exterior'
  WHEN p_partkey % 7 = 6 AND p_partkey % 4 <> 0 AND p_partkey % 10 IN (2, 3) AND p_size % 5 = 0 THEN 'slab_above_grade' WHEN p_partkey % 7 = 6 AND p_partkey % 4 <> 0 AND p_partkey % 10 = 4 THEN 'wall_exterior' END AS component,
  CASE WHEN p_size % 5 = 0 THEN 'garage' ELSE 'building' END AS scope FROM part""")
def _(spark, d):
    page = F.when(F.col("p_size") % 5 == 0, "Attached GARAGE below").otherwise("all rooms")
    tag = H.auto_tag(H.sheet_class(F.col("number"), F.col("title")), F.col("title"), page)
    return sheets(spark, d).select("p_partkey", tag["component"].alias("component"), tag["scope"].alias("scope"))


_R = f"{tuple(sorted({*H.METRIC_RATIOS, *H.IMPERIAL_RATIOS}))}"


@query("scale_correct", f"""SELECT p_partkey, CAST(CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_size IN {_R} THEN p_size ELSE coalesce((SELECT min(x) FROM (SELECT unnest({list(sorted({*H.METRIC_RATIOS, *H.IMPERIAL_RATIOS}))}) AS x) WHERE x // 10 = p_size), p_size) END AS DOUBLE) AS ratio,
  CASE WHEN p_partkey % 5 = 0 THEN 'nts' ELSE 'metric' END AS kind FROM part""")
def _(spark, d):
    t = F.when(F.col("p_partkey") % 5 == 0, "Scale: N.T.S.").otherwise(F.concat(F.lit("Scale: 1:"), F.col("p_size").cast("string")))
    got = H.detected_scale(t)
    return read(spark, d, "part").select("p_partkey", got["ratio"].alias("ratio"), got["kind"].alias("kind"))


def declared(spark, d):
    """Suppliers' declarations of four families."""
    k = F.col("s_suppkey")
    date = F.concat(F.lit("20"), F.lpad((k % 30).cast("string"), 2, "0"), F.lit("-05-06"))
    name = F.concat(F.lit("Maker "), k.cast("string"))
    lead = F.when(k % 4 == 0, F.concat(F.lit("Programme operator\nS - P - "), F.lpad(k.cast("string"), 6, "0"), F.lit("\nfrom\n"), name, F.lit("\nPublication date: "), date))
    lead = lead.when(k % 4 == 1, F.concat(F.lit("NSF International\nEPD Commissioner and Owner: "), name, F.lit("\nDate of Issue: "), date))
    lead = lead.when(k % 4 == 2, F.concat(F.lit("Owner of the Declaration "), name, F.lit("\nIssue date "), date))
    lead = lead.otherwise(F.concat(F.lit("Program operator CSA Group\nDeclaration Holder: "), name, F.lit("\nDate of Issue: "), date))
    size = F.format_string("%d.25", k % 500)
    rows = F.concat(F.lit("\nstages A1-A3 A1 A2 A3\nGlobal warming potential kg CO2 eq "), size, F.lit(" 100.5 200.5 300.5\nA1 A2 A3 A4 A5\nEutrophication potential kg N eq 1.5 "), size, F.lit(" 3.5"))
    return read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Glulam beams of all sizes\n"), lead, rows).alias("t"))


@query("declaration_records", """SELECT s_suppkey, ['epd_intl', 'nsf', 'eu_ibu', 'na'][s_suppkey % 4 + 1] AS family, 'Wood | Glulam' AS display_name, 'Maker ' || CAST(s_suppkey AS VARCHAR) AS manufacturer,
  CASE WHEN s_suppkey % 4 = 0 THEN 'S-P-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') END AS epd_id, ['EPD International AB', 'NSF International', 'IBU', 'CSA Group'][s_suppkey % 4 + 1] AS program_operator,
  '20' || lpad(CAST(s_suppkey % 30 AS VARCHAR), 2, '0') || '-05-06' AS published, s_suppkey % 500 + 0.25::DOUBLE AS gwp_kgco2e, 1.5::DOUBLE AS eutrophication_kgneq FROM supplier""")
def _(spark, d):
    got = D.records(declared(spark, d), "s_suppkey", "t", [("Glulam", "06", "Wood")])
    return got.select("s_suppkey", "family", "display_name", "manufacturer", "epd_id", "program_operator", "published", "gwp_kgco2e", "eutrophication_kgneq")


@query("stage_values", """SELECT s_suppkey, indicator, stage, value FROM (SELECT s_suppkey, 'gwp_kgco2e' AS indicator, unnest(['A1', 'A2', 'A3']) AS stage, unnest([100.5::DOUBLE, 200.5::DOUBLE, 300.5::DOUBLE]) AS value FROM supplier
  UNION ALL SELECT s_suppkey, 'eutrophication_kgneq', unnest(['A1', 'A2', 'A3']), unnest([1.5::DOUBLE, s_suppkey % 500 + 0.25::DOUBLE, 3.5::DOUBLE]) FROM supplier)""")
def _(spark, d):
    return D.by_stage(declared(spark, d), "s_suppkey", "t")


def _minted() -> str:
    """SQL of the ids: four attempts, each for those that lost the one before, then a longer id."""
    steps = ["u0 AS (SELECT '000000' AS rid)", "l0 AS (SELECT c_custkey AS k FROM customer)"]
    for n in range(4):
        steps.append(f"w{n} AS (SELECT rid, min(k) AS k FROM (SELECT k, substr(sha256(CAST(k AS VARCHAR) || ':{n}'), 1, 6) AS rid FROM l{n}) WHERE rid NOT IN (SELECT rid FROM u{n}) GROUP BY rid)")
        steps.append(f"u{n + 1} AS (SELECT rid FROM u{n} UNION SELECT rid FROM w{n}), l{n + 1} AS (SELECT k FROM l{n} WHERE k NOT IN (SELECT k FROM w{n}))")
    won = " UNION ALL ".join(f"SELECT k, rid FROM w{n}" for n in range(4))
    return f"WITH {', '.join(steps)} SELECT k AS c_custkey, rid AS id FROM ({won} UNION ALL SELECT k, sha256(CAST(k AS VARCHAR)) FROM l4)"


@query("id_mint", _minted())
def _(spark, d):
    return P.with_ids(read(spark, d, "customer").select("c_custkey"), "c_custkey", spark.createDataFrame([("000000",)], "id string"))


@query("dependent_reset", """SELECT c_custkey AS field_id, parent_value, CASE WHEN bad THEN '' ELSE value END AS value, CASE WHEN bad THEN 'calculated' END AS new_state FROM
  (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS parent_value, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE v END AS value, c_custkey % 3 <> 0 AND r <> c_nationkey % 5 AS bad FROM (SELECT *, 'r' || CAST(r AS VARCHAR) AS v FROM (SELECT *, c_custkey % 5 AS r FROM customer)))""")
def _(spark, d):
    k = F.col("c_custkey")
    children = read(spark, d, "customer").select(k.alias("field_id"), F.col("c_nationkey").cast("string").alias("parent_value"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("r"), (k % 5).cast("string"))).alias("value"))
    options = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("parent_value"), F.concat(F.lit("r"), (F.col("n_nationkey") % 5).cast("string")).alias("option"))
    return P.invalid_choices(children, options)


@query("quiet_batches", """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, CAST(count(*) AS BIGINT) AS n_events FROM events GROUP BY 1, 2""")
def _(spark, d):
    events = read(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return P.quiet_batches(events, "user_id", "event_type", F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "n_events")


@query("group_defaults", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS metallic, CASE p_size % 4 WHEN 1 THEN 'combustible' WHEN 2 THEN 'non_combustible' END AS fire, CASE p_size % 4 WHEN 0 THEN '05-metals.json' WHEN 1 THEN '06-wood.json' WHEN 2 THEN '03-concrete.json' END AS file FROM part""")
def _(spark, d):
    prefix = F.get(F.array(*map(F.lit, ("05", "06", "03", "99"))), F.col("p_size") % 4)
    return read(spark, d, "part").select("p_partkey", L.rendering(prefix)["metallic"].alias("metallic"), L.combustibility(prefix, F.col("p_type")).alias("fire"), L.group_file(prefix).alias("file"))


@query("class_counts", """SELECT p_brand, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE p_size % 3 <> 0) AS BIGINT) AS n_nonzero FROM part GROUP BY 1""")
def _(spark, d):
    return P.class_counts(read(spark, d, "part").withColumn("f", (F.col("p_size") % 3).cast("double")), ["p_brand"], "f")
