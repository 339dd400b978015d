"""Queries on whole documents: declarations by family, page layouts, drawings, and files of each kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import declarations as D
from ..operators import detection as X
from ..operators import geometry as G
from ..operators import layout as B
from ..operators import projects as P
from ..operators import sheets as H
from ..operators.storage import kept, new_folder, text_file
from ..sources import readers as R
from ..sources import writers as K
from .drawings import sheets
from .registry import query
from .tables import read

# -- declarations ----------------------------------------------------------------------------------------------

_N = "CAST(s_suppkey AS VARCHAR)"
_FIELDS = ("family", "title", "material_type", "manufacturer", "epd_id", "program_operator", "per_unit", "density_kg_m3", "pcr", "published", "expires", "epd_type", "verification", "n_anchors")


def _lines(*parts):
    return F.concat_ws("\n", *parts)


def _text(spark, d, *parts):
    return read(spark, d, "supplier").select("s_suppkey", _lines(*parts).alias("t"))


def _pick(k, *values):
    return F.get(F.array(*(v if not isinstance(v, str) else F.lit(v) for v in values)), (k % len(values)).cast("int"))


def _fields(docs):
    got = D.records(docs, "s_suppkey", "t")
    return got.select("s_suppkey", *_FIELDS, F.array_join("standards", "|").alias("standards"), F.array_join("markets", "|").alias("markets"))


@query("declaration_fields_na", f"""SELECT s_suppkey, 'na' AS family, 'Beams of kind ' || CAST(s_suppkey % 7 AS VARCHAR) AS title, ['Glulam', 'LVL', 'Framing', 'Steel'][s_suppkey % 4 + 1] AS material_type,
  ['Acme Timber ' || {_N}, 'Maker No. ' || {_N}, 'Northern Mills'][s_suppkey % 3 + 1] AS manufacturer, ['EPD ' || {_N}, 'AB-' || {_N} || '.101.1'][s_suppkey % 2 + 1] AS epd_id, ['UL Environment', 'CSA Group', 'ASTM International', NULL][s_suppkey % 4 + 1] AS program_operator,
  ['1 m³', '2.5 metric ton', '1 m²'][s_suppkey % 3 + 1] AS per_unit, CASE s_suppkey % 3 WHEN 0 THEN 400.0 + s_suppkey % 200 WHEN 1 THEN 512.5 ELSE 300.0 + s_suppkey % 100 END::DOUBLE AS density_kg_m3,
  ['Structural and Architectural Wood', 'Guidance of ' || {_N}][s_suppkey % 2 + 1] AS pcr, ['2023-02-20', '2019-11-05', '2020-04-01'][s_suppkey % 3 + 1] AS published, ['2028-02-20', '2024-11-05', NULL][s_suppkey % 3 + 1] AS expires,
  ['product_specific', 'industry_average', 'generic', NULL][s_suppkey % 4 + 1] AS epd_type, ['external', 'internal', NULL][s_suppkey % 3 + 1] AS verification,
  CAST(9 - CASE WHEN s_suppkey % 4 = 3 THEN 1 ELSE 0 END - CASE WHEN s_suppkey % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) AS n_anchors,
  ['ISO 14025|EN 15804+A1', 'ISO 14025:2006|ISO 21930:2017', ''][s_suppkey % 3 + 1] AS standards, ['CAN|USA', 'CAN', 'EUR'][s_suppkey % 3 + 1] AS markets FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    n = k.cast("string")
    docs = _text(
        spark, d,
        F.lit("E nvironmental P roduct D eclaration"), _pick(k, "as per ISO 14025 and EN 15804+A1", "in accordance with ISO 14025:2006, ISO 21930:2017", "EPD"), F.concat(F.lit("Beams of kind "), (k % 7).cast("string")),
        F.lit("P ROGRAM O PERATOR"), _pick(k, "UL Environment, 333 Road", "CSA  Group", "ASTM International", "someone"), _pick(k, "about glulam and CLTs", "laminated veneer lumber here", "soft-wood lumber", "hot-rolled steel"),
        _pick(k, F.concat(F.lit("D ECLARATION H OLDER: Acme Timber "), n), F.concat(F.lit("Manufacturer name and address : Maker No. "), n), F.lit("made of wood produced by Northern Mills in the west")),
        _pick(k, F.concat(F.lit("D eclaration N umber: EPD "), n, F.lit(" Declared Product of it")), F.concat(F.lit("EPD Registration Number # AB-"), n, F.lit(".101.1 Scope"))),
        _pick(k, F.concat(F.lit("DECLARED UNIT: 1 m of beam, "), (400 + k % 200).cast("string"), F.lit(" kg/m3")), F.lit("Declared unit: 2,5 tonnes of it"), F.lit("FUNCTIONAL UNIT: 1 m^2 of wall")),
        _pick(k, F.lit("volumes in m³"), F.lit("a density of 512.5 kg/m3"), F.concat(F.lit("Mass (including moisture) kg "), (300 + k % 100).cast("string"))),
        _pick(k, F.lit("Pa rt B: Structural and Architectural Wood"), F.concat(F.lit("Reference PCR and version number: Guidance of "), n)),
        _pick(k, "Date of Issue & Validity Period: 20 Feb 2023 and on", "Publication date: 2019-11-05", "Issue date\n01/04/2020"), _pick(k, "Period of validity\n5 years until 20 February 2028", "Valid until 2024-11-05", "no end"),
        _pick(k, "EPD type: Product-specific", "EPD type: Industry average one", "EPD type: generic", "EPD kind: other"), _pick(k, "Markets of applicability: North America", "Region covered: Canada", "Region covered: all of Europe"), _pick(k, "x EXTERNAL", "Internal verification", "checked"),
    )
    return _fields(docs)


@query("declaration_fields_ibu", f"""SELECT s_suppkey, 'eu_ibu' AS family, 'Mineral wool slabs no. ' || {_N} AS title, 'Mineral wool' AS material_type, 'Wool ' || {_N} || ' GmbH' AS manufacturer, 'EPD-WOL-' || {_N} || '-1' AS epd_id, 'IBU' AS program_operator, '1 t of wool' AS per_unit,
  CASE WHEN s_suppkey % 2 = 0 THEN 85.5::DOUBLE ELSE 90.0::DOUBLE END AS density_kg_m3, CASE WHEN s_suppkey % 3 <> 2 THEN 'Mineral insulating materials, 12.2018' END AS pcr, '2020-02-01' AS published, CASE WHEN s_suppkey % 2 = 0 THEN '2025-01-31' END AS expires,
  NULL::VARCHAR AS epd_type, ['external', 'external', 'internal'][s_suppkey % 3 + 1] AS verification, CAST(9 - CASE WHEN s_suppkey % 3 = 2 THEN 1 ELSE 0 END - CASE WHEN s_suppkey % 2 = 1 THEN 1 ELSE 0 END AS INTEGER) AS n_anchors, '' AS standards, NULL::VARCHAR AS markets FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    n = k.cast("string")
    docs = _text(
        spark, d, F.lit("Programme holder"), F.concat(F.lit("Mineral wool slabs no. "), n), _pick(k, F.concat(F.lit("Owner of the Declaration Wool "), n, F.lit(" GmbH")), F.concat(F.lit("Owner of the declaration\n  Wool "), n, F.lit(" GmbH"))),
        F.concat(F.lit("Declaration number EPD-WOL-"), n, F.lit("-1")), F.lit("Issue date 01/02/2020"), _pick(k, "Valid to 31/01/2025", "Valid to the end"), _pick(k, "internally x externally", "x externally", "x internally"),
        _pick(k, "an average weighted density of 85,5 kg/m³", "with density of 90 kg/m3"), F.lit("This Declaration refers to 1 t of wool"),
        _pick(k, "based on the product category rules:\nMineral insulating materials, 12.2018 (PCR checked)", "product category rules: Mineral insulating materials, 12.2018", "no rules"),
    )
    return _fields(docs)


@query("declaration_fields_registry", f"""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 4 THEN 'unknown' ELSE 'epd_intl' END AS family, 'Boards and panels of ' || {_N} AS title, NULL::VARCHAR AS material_type, CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE 'Nordic Boards ' || {_N} END AS manufacturer,
  'S-P-' || lpad(CAST(s_suppkey % 100000 AS VARCHAR), 5, '0') AS epd_id, CASE WHEN s_suppkey % 5 <> 4 THEN 'EPD International AB' END AS program_operator, CASE WHEN s_suppkey % 5 <> 4 THEN '1 kg of board' END AS per_unit, NULL::DOUBLE AS density_kg_m3,
  CASE WHEN s_suppkey % 5 = 4 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'PCR 2012:01 v2.33' ELSE 'Product Category Rules (PCR): Construction products' END AS pcr, CASE WHEN s_suppkey % 5 <> 4 THEN '2025-10-20' END AS published, CASE WHEN s_suppkey % 5 <> 4 THEN '2030-01-09' END AS expires,
  NULL::VARCHAR AS epd_type, NULL::VARCHAR AS verification, CAST(CASE WHEN s_suppkey % 5 = 4 THEN 2 ELSE 8 END AS INTEGER) AS n_anchors, 'EN 15804:2012' AS standards, NULL::VARCHAR AS markets FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    n = k.cast("string")
    operator = F.when(k % 5 == 4, "Somebody").otherwise("P rogramme operator: somebody")
    docs = _text(
        spark, d, F.concat(F.lit("Boards and panels of "), n), operator, F.concat(F.lit("S - P - "), F.lpad((k % 100000).cast("string"), 5, "0")), F.lit("Information from"), F.concat(F.lit("Nordic Boards "), n),
        F.lit("Publication date: 202 5 - 10 - 2 0"), F.lit("Valid until: 2030-1-9"), F.lit("Functional unit / declared unit: 1 kg of board"), _pick(k, "see PCR 2012:01 v2.33 for it", "Product Category Rules (PCR): Construction products"), F.lit("of EN 15804:2012 alone"),
    )
    return _fields(docs)


@query("declaration_fields_nsf", f"""SELECT s_suppkey, 'nsf' AS family, 'Portland cement of a plant' AS title, 'Portland Cement' AS material_type, 'Cement Works ' || {_N} AS manufacturer, CASE WHEN s_suppkey % 2 = 0 THEN 'S-P-12345' END AS epd_id, 'NSF International' AS program_operator,
  '1 metric ton of cement' AS per_unit, NULL::DOUBLE AS density_kg_m3, 'Cements of ' || {_N} AS pcr, '2021-05-03' AS published, NULL::VARCHAR AS expires, NULL::VARCHAR AS epd_type, CASE WHEN s_suppkey % 2 = 0 THEN 'external' END AS verification,
  CAST(6 + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_anchors, '' AS standards, NULL::VARCHAR AS markets FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    n = k.cast("string")
    return _fields(_text(spark, d, F.lit("NSF International"), F.lit("Portland cement of a plant"), F.concat(F.lit("EPD Commissioner and Owner: Cement Works "), n), _pick(k, "Date of Issue: 3 May 2021", "Date of Issue & Validity Period: 03/05/2021 on"), F.lit("Declared Unit: 1 metric ton of cement"), F.concat(F.lit("Product Category Rules (PCR): Cements of "), n), _pick(k, "S-P-12345 External verification", "none")).withColumn("t", F.regexp_replace("t", "^NSF", "By NSF")).withColumn("t", F.regexp_replace("t", "^By NSF International\n", "NSF\nInternational\n")))


_TOTALS = list(D.INDICATORS)


@query("declaration_totals", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN NULL ELSE s_suppkey + 0.5 END::DOUBLE AS gwp_kgco2e, CASE s_suppkey % 4 WHEN 0 THEN -3.25 WHEN 1 THEN 0.75 END::DOUBLE AS gwp_bio_kgco2e,
  CASE s_suppkey % 4 WHEN 0 THEN 1.5e-6 WHEN 1 THEN 2.5e-7 WHEN 2 THEN 3e-8 END::DOUBLE AS ozone_depletion_kgcfc11eq, CASE s_suppkey % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 1.25 WHEN 2 THEN 2.25 END::DOUBLE AS acidification_kgso2eq,
  CASE s_suppkey % 4 WHEN 0 THEN 0.31 WHEN 1 THEN 0.5 END::DOUBLE AS eutrophication_kgneq, CASE s_suppkey % 4 WHEN 0 THEN 7.5 WHEN 1 THEN 8.5 WHEN 2 THEN 9.5 END::DOUBLE AS smog_kgo3eq,
  CASE s_suppkey % 4 WHEN 0 THEN 1200 WHEN 1 THEN 1300 WHEN 2 THEN 1400 END::DOUBLE AS abiotic_depletion_fossil_mj, CASE s_suppkey % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 0.37 WHEN 2 THEN 0.6 WHEN 3 THEN 2.75 END::DOUBLE AS water_consumption_m3,
  CASE s_suppkey % 4 WHEN 0 THEN 2000 WHEN 1 THEN 2100.5 WHEN 3 THEN 3490.16 END::DOUBLE AS primary_energy_nonrenewable_mj, CASE s_suppkey % 4 WHEN 0 THEN 500 WHEN 1 THEN 600.5 WHEN 3 THEN 1234.5 END::DOUBLE AS primary_energy_renewable_mj FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    value = F.concat(k.cast("string"), F.lit(".5"))
    codes = _lines(
        F.lit("GWP TRACI kg CO2 eq TRACI 2.1 V1.02"), F.concat(F.lit("GWP-fossil [kg CO 2 eq] "), value, F.lit(" 1 2")), F.lit("GWPBIO kg CO2e - 3.25"), F.lit("ODP kg CFC-11 eq 1.5 E -06 1"), F.lit("AP kg SO2 eq 0.25"), F.lit("EP kg N eq 0,31 0,1"),
        F.lit("SFP kg O3 eq 7.5 ]"), F.lit("ADPf [MJ] 1200 1"), F.lit("WDP m3 0.4"), F.lit("PENR MJ, NCV 2000"), F.lit("PER MJ 500"),
    )
    names = _lines(
        F.lit("Global warming potential – Biogenic kg CO2e 0.75"), F.concat(F.lit("Global warming potential – Total kg CO2e "), value), F.lit("Ozone depletion potential kg CFC-11 eq 2.5E-07"), F.lit("Acidification potential of soil and water sources kg SO2e 1.25"),
        F.lit("Eutrophication potential kg Ne 0.5"), F.lit("Smog potential kg O 3 eq 8.5"), F.lit("Abiotic depletion potential (ADPfossil) MJ, NCV 1300"), F.lit("Consumption of freshwater resources m3 0.37"), F.lit("Non-renewable, fossil MJ 2100.5"), F.lit("Renewable, biomass MJ 600.5"),
    )
    bracketed = _lines(
        F.concat(F.lit("Global warming potential [kg CO 2 -Eq.] "), value), F.lit("Depletion potential of the stratospheric ozone layer kg"), F.lit("CFC11e"), F.lit("3e-08 1"), F.lit("Acidification potential of land [kg SO 2 -Eq.] 2.25"),
        F.lit("Formation potential of tropospheric ozone kg O3 eq 9.5"), F.lit("Abiotic depletion potential for fossil resources [MJ] 1400"), F.lit("Use of net fresh water [m 3 ] 0.6"),
    )
    iso = _lines(F.lit("NRPR E [MJ, LHV] 3,490.16 1"), F.lit("RPR E [MJ, LHV] 1,234.5"), F.lit("FW [m 3 ]"), F.lit("2.75 1.1"))
    docs = read(spark, d, "supplier").select("s_suppkey", _pick(k, codes, names, bracketed, iso).alias("t"))
    return docs.select("s_suppkey", *D.totals(F.col("t")))


# -- page layouts ----------------------------------------------------------------------------------------------

#: Parts as rows of a page of ten.
_PAGE, _ROW = "p_partkey // 10", "p_partkey % 10"


def _items(spark, d, *parts):
    """Text items of pages; parts are (text, x, y below the row, width, height)."""
    k = F.col("p_partkey")
    row = (k % 10).cast("double") * 100
    item = lambda s, x, dy, w, h: F.struct(s.cast("string").alias("str"), x.cast("double").alias("x"), (row + dy).alias("y"), w.cast("double").alias("width"), h.cast("double").alias("height"))
    p = read(spark, d, "part").select("p_partkey", F.floor(k / 10).cast("long").alias("page"), F.explode(F.filter(F.array(*(item(*x) for x in parts)), lambda z: z["str"].isNotNull())).alias("g"))
    return p.select("page", "g.*")


def _l(*values):
    return [v if not isinstance(v, (int, float, str)) else F.lit(v) for v in values]


@query("glyph_runs", f"""SELECT {_PAGE} AS page, unnest(CASE WHEN p_size <= 2 THEN ['ABC'] ELSE ['AB', 'C'] END) AS text, unnest(CASE WHEN p_size <= 2 THEN [0.0::DOUBLE] ELSE [0.0::DOUBLE, 10.0 + p_size] END) AS x, unnest(CASE WHEN p_size <= 2 THEN [{_ROW} * 100.0::DOUBLE] ELSE [{_ROW} * 100.0::DOUBLE, {_ROW} * 100.0::DOUBLE + 1] END) AS y, unnest(CASE WHEN p_size <= 2 THEN [15.0::DOUBLE + p_size] ELSE [10.0::DOUBLE, 5.0] END) AS width FROM part""")
def _(spark, d):
    return B.glyph_runs(_items(spark, d, _l("A", 0, 0, 5, 8), _l("B", 5, 0.5, 5, 8), _l("C", 10 + F.col("p_size"), 1, 5, 8)))


@query("table_cells", f"""SELECT {_PAGE} AS page, CAST({_ROW} - min({_ROW}) OVER (PARTITION BY {_PAGE}) + 1 AS BIGINT) AS row_no, unnest(CASE WHEN p_size <= 10 THEN [0, 1] ELSE [0, 1, 2] END)::BIGINT AS cell_no,
  unnest(CASE WHEN p_size <= 1 THEN [p_brand, 'ab'] WHEN p_size <= 10 THEN [p_brand, 'a b'] ELSE [p_brand, 'a', 'b'] END) AS text FROM part""")
def _(spark, d):
    return B.table_cells(_items(spark, d, _l(F.col("p_brand"), 0, 0, 40, 8), _l("a", 60, 1, 10, 8), _l("b", 70 + F.col("p_size"), 2, 10, 8)))


@query("stacked_fractions", f"""SELECT {_PAGE} AS page, CAST(p_size AS BIGINT) AS num, CAST(16 AS BIGINT) AS den, 100.0::DOUBLE AS x, {_ROW} * 100.0::DOUBLE AS y FROM part WHERE p_size % 12 BETWEEN 2 AND 8 AND p_size % 7 <= 5""")
def _(spark, d):
    s = F.col("p_size")
    return B.paired_fractions(_items(spark, d, _l(s, 100, 0, 4, 4), (F.lit("16"), 100 + s % 7, (s % 12).cast("double"), F.lit(4), F.lit(4)), _l("x1", 100, 3, 4, 4)))


@query("drawn_segments", """SELECT p_partkey, unnest([0, 1, 2, 3, 4, 5])::BIGINT AS seg, unnest([10.0 + p_size, 10.0, 10.0 + 2 * p_size, 10.0 + 2 * p_size, 10.0, 1.0])::DOUBLE AS x1, unnest([20.0, 20.0, 20.0, 26.0, 26.0, 2.0])::DOUBLE AS y1,
  unnest([10.0 + 3 * p_size, 10.0 + 2 * p_size, 10.0 + 2 * p_size, 10.0, 10.0, p_size])::DOUBLE AS x2, unnest([22.0, 20.0, 26.0, 26.0, 20.0, 2.0])::DOUBLE AS y2 FROM part""")
def _(spark, d):
    s, k = F.col("p_size").cast("double"), F.col("p_partkey")
    step = lambda i, op, *args: F.struct(F.lit(i).alias("seq"), F.lit(op).alias("op"), F.array(*(F.lit(float(a)) if not hasattr(a, "alias") else a for a in args)).cast("array<double>").alias("args"))
    ops = F.array(step(0, "save"), step(1, "transform", 2, 0, 0, 2, 10, 20), step(2, "move", s / 2, 0), step(3, "curve", 1, 1, 2, 2, s * 1.5, 1), step(4, "rect", 0, 0, s, 3), step(5, "restore"), step(6, "move", 1, 2), step(7, "line", s, 2))
    rows = read(spark, d, "part").select(k.alias("page"), F.explode(ops).alias("o")).select("page", "o.*")
    return B.drawn_segments(rows).withColumnRenamed("page", "p_partkey")


@query("affine_points", "SELECT p_partkey, p_size * 2 + p_retailprice * 0.5::DOUBLE + 10 AS x, p_size * 0.25::DOUBLE - p_retailprice + 20 AS y FROM part")
def _(spark, d):
    at = G.affine(F.col("p_size").cast("double"), F.col("p_retailprice"), [2.0, 0.25, 0.5, -1.0, 10.0, 20.0])
    return read(spark, d, "part").select("p_partkey", at["x"].alias("x"), at["y"].alias("y"))


@query("long_axis_segments", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'h' ELSE 'v' END AS axis, p_size * 1.0::DOUBLE AS at FROM part WHERE p_size % 3 <> 2 AND p_size >= 25""")
def _(spark, d):
    s = F.col("p_size").cast("double")
    flat, up = F.col("p_size") % 3 == 0, F.col("p_size") % 3 == 1
    rows = read(spark, d, "part").select("p_partkey", F.when(flat, F.lit(0.0)).when(up, s).otherwise(0.0).alias("x1"), F.when(flat, s).otherwise(0.0).alias("y1"), F.when(flat, s * 2).when(up, s + 0.25).otherwise(s * 2).alias("x2"), F.when(flat, s + 0.25).otherwise(s * 2).alias("y2"))
    return P.orthogonal(rows).select("p_partkey", "axis", "at")


@query("traceable_sheets", "SELECT p_partkey, p_partkey % 7 IN (0, 1, 3) OR (p_partkey % 7 = 6 AND p_partkey % 4 <> 0 AND p_partkey % 10 IN (2, 3, 4)) AS traceable FROM part")
def _(spark, d):
    return sheets(spark, d).select("p_partkey", H.traceable(H.sheet_class(F.col("number"), F.col("title"))).alias("traceable"))


@query("room_areas", """SELECT CAST(0 AS BIGINT) AS page, CAST(p_partkey AS INTEGER) AS num, 'Room ' || p_brand AS name, p_size + 0.5::DOUBLE AS area FROM part WHERE p_partkey < 8 AND p_partkey > 0""")
def _(spark, d):
    k = F.col("p_partkey")
    head = F.when(k % 10 == 0, "Room").when(k == 8, "Grand total").otherwise(F.concat(F.lit("Room "), "p_brand"))
    first = F.when(k % 10 == 0, "No.").otherwise((k % 10).cast("string"))
    area = F.when(k % 10 == 0, "Area (m2)").otherwise(F.concat((F.col("p_size") + 0.5).cast("string"), F.lit(" m2")))
    items = _items(spark, d, _l(first, 0, 0, 20, 8), _l(head, 60, 0, 60, 8), _l(area, 180, 0, 40, 8))
    return H.room_schedule(items).select("page", "num", "name", "area")


def _dimension_pages(spark, d):
    """Callouts of p_size / 2 metres, drawn at 1 : 50 with an error of some pages, each above its segment."""
    k = F.col("p_partkey")
    page, row = F.floor(k / 10).cast("long").alias("page"), (k % 10).cast("double") * 600
    metres = F.col("p_size") / 2 + 2
    unit = 1 / ((25.4 / 72) * 50 / 1000)
    length = metres * unit * F.when(F.floor(k / 10) % 3 == 1, 1.05).otherwise(1.0)
    p = read(spark, d, "part")
    found = p.select(page, k.alias("c_id"), F.lit("t").alias("text"), metres.alias("metres"), F.lit(0.0).alias("cx"), row.alias("cy"))
    segs = p.select(page, k.alias("s_id"), F.lit(0.0).alias("x1"), (row + 5).alias("y1"), length.alias("x2"), (row + 5).alias("y2"), length.alias("length"))
    scales = p.select(page).distinct().filter("page % 4 <> 3").withColumn("ratio", F.lit(50.0))
    return found, segs, scales


_DIM_SQL = """(SELECT p_partkey AS c_id, p_partkey // 10 AS page, p_partkey % 10 AS r, p_size / 2.0 + 2 AS metres, CASE WHEN p_partkey // 10 % 3 = 1 THEN 1.05 ELSE 1.0 END::DOUBLE AS f, 1 / ((25.4::DOUBLE / 72) * 50 / 1000) AS u FROM part)"""


@query("page_dimensions", f"""WITH p AS {_DIM_SQL}, s AS (SELECT a.page, a.c_id, b.c_id AS s_id, 0.6::DOUBLE * (1 - abs(b.metres * b.f * b.u - a.metres * a.u) / (a.metres * a.u) / 0.08::DOUBLE) + 0.4::DOUBLE * (1 - abs((b.r - a.r) * 600 + 5) / 500::DOUBLE) AS score,
    abs(b.metres * b.f * b.u - a.metres * a.u) / (a.metres * a.u) AS e FROM p a JOIN p b ON a.page = b.page WHERE a.page % 4 <> 3 AND abs((b.r - a.r) * 600 + 5) <= 500)
  SELECT p.c_id, s_id, round(p.metres, 6) AS metres, round(score, 6) AS score FROM p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY c_id ORDER BY round(score, 9) DESC, s_id) AS rn FROM s WHERE e <= 0.08::DOUBLE) b ON p.c_id = b.c_id AND rn = 1""")
def _(spark, d):
    got = H.dimensions(*_dimension_pages(spark, d))
    return got.select("c_id", "s_id", F.round("metres", 6).alias("metres"), F.round("score", 6).alias("score"))


@query("calibration_readings", f"""WITH p AS {_DIM_SQL} SELECT page, CASE WHEN f > 1 THEN 'disagrees' ELSE 'confirmed' END AS outcome, CASE WHEN f > 1 THEN NULL ELSE round(max(u), 6) END AS units_per_metre, CASE WHEN f > 1 THEN NULL ELSE 50.0::DOUBLE END AS ratio, CAST(count(*) AS BIGINT) AS n_callouts FROM p WHERE page % 4 <> 3 GROUP BY page, f""")
def _(spark, d):
    found, segs, scales = _dimension_pages(spark, d)
    got = X.calibration_readings(H.dimensions(found, segs, scales), segs)
    return got.withColumn("units_per_metre", F.round("units_per_metre", 6))


@query("building_outlines", """WITH g AS (SELECT DISTINCT p_partkey // 10 AS page FROM part) SELECT page, CASE page % 3 WHEN 0 THEN 'walls' WHEN 1 THEN 'path' END AS source, CASE WHEN page % 3 = 0 THEN 100.0 + page % 5 END::DOUBLE AS x1, CASE WHEN page % 3 = 0 THEN 200.0 END::DOUBLE AS y1,
  CASE WHEN page % 3 = 0 THEN 410.0 + page % 5 END::DOUBLE AS x2, CASE WHEN page % 3 = 0 THEN 510.0 END::DOUBLE AS y2, CASE WHEN page % 3 = 1 THEN (SELECT arg_max(p_partkey, (p_size, -p_partkey)) FROM part WHERE p_partkey // 10 = page) END AS path_id FROM g""")
def _(spark, d):
    page = F.floor(F.col("p_partkey") / 10).cast("long").alias("page")
    p = read(spark, d, "part")
    pages = p.select(page).distinct().select("page", F.lit(600.0).alias("width"), F.lit(700.0).alias("height"))
    left = 100.0 + F.col("page") % 5
    seg = lambda i, x1, y1, x2, y2: F.struct(F.lit(i).alias("n"), *(v.cast("double").alias(c) if hasattr(v, "alias") else F.lit(float(v)).alias(c) for c, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))))
    walls = [seg(0, left, 200, left, 500), seg(1, left + 10, 200, left + 10, 500), seg(2, left + 300, 200, left + 300, 500), seg(3, left + 310, 200, left + 310, 500), seg(4, 100, 200, 400, 200), seg(5, 100, 210, 400, 210), seg(6, 100, 500, 400, 500), seg(7, 100, 510, 400, 510), seg(8, 5, 0, 5, 700), seg(9, 50, 0, 80, 3)]
    drawn = pages.filter("page % 3 = 0").select("page", F.explode(F.array(*walls)).alias("s")).select("page", (F.col("page") * 100 + F.col("s.n")).alias("seg_id"), "s.x1", "s.y1", "s.x2", "s.y2")
    paths = p.select(page, F.col("p_partkey").alias("path_id"), F.col("p_size").cast("double").alias("area")).filter("page % 3 <> 2")
    return X.outlines(drawn, pages, paths)


@query("drawn_polygons", """SELECT p_partkey // 10 AS page, CAST(p_partkey % 10 - min(p_partkey % 10) OVER (PARTITION BY p_partkey // 10) + 1 AS BIGINT) AS poly_no, ['area', 'polyline', 'window'][p_size % 3 + 1] AS kind, CASE WHEN p_size % 5 = 0 THEN 'cut' ELSE 'net' END AS mode, CASE WHEN p_size % 4 = 0 THEN 'garage' ELSE 'building' END AS scope,
  p_name AS label, CAST(p_size % 5 AS INTEGER) AS n_vertices, p_size % 5 >= CASE WHEN p_size % 3 = 1 THEN 2 ELSE 3 END AS closed FROM part""")
def _(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    event = lambda i, op, x=None: F.struct((k % 10 * 100 + i).alias("seq"), F.lit(op).alias("op"), F.lit(x).cast("double").alias("x"))
    close = F.array(event(90, "close"), event(91, "close"))
    late = F.when(s % 5 >= 3, F.array(event(95, "vertex", 9.0))).otherwise(F.array().cast("array<struct<seq:bigint,op:string,x:double>>"))
    vertices = F.transform(F.slice(F.sequence(F.lit(1), F.lit(5)), 1, s % 5), lambda i: F.struct((k % 10 * 100 + i).alias("seq"), F.lit("vertex").alias("op"), i.cast("double").alias("x")))
    typed = F.concat(F.array(event(0, "start")), vertices, close, late)
    rows = read(spark, d, "part").select(F.floor(k / 10).cast("long").alias("page"), F.col("p_name").alias("label"), s.alias("s"), F.explode(typed).alias("e"))
    start = F.col("e.op") == "start"
    of = lambda c: F.when(start, c)
    events = rows.select("page", "e.seq", "e.op", of(F.get(F.array(F.lit(None).cast("string"), F.lit("polyline"), F.lit("window")), F.col("s") % 3)).alias("kind"), of(F.when(F.col("s") % 5 == 0, "cut")).alias("mode"), of(F.when(F.col("s") % 4 == 0, "garage").when(F.col("s") % 4 == 1, "shed")).alias("scope"), of(F.col("label")).alias("label"), "e.x", F.col("e.x").alias("y"))
    return X.drawn_polygons(events).select("page", "poly_no", "kind", "mode", "scope", "label", F.size("vertices").alias("n_vertices"), "closed")


# -- files -----------------------------------------------------------------------------------------------------


def _folder(spark, name):
    return new_folder(spark, name)


@query("csv_sheet", """SELECT CAST(p_partkey AS VARCHAR) AS c0, p_name AS c1, CASE WHEN p_size % 3 = 0 THEN 'say "' || p_type || '", twice' WHEN p_size % 3 = 1 THEN '' ELSE p_type END AS c2 FROM part""")
def _(spark, d):
    quoted = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('"say ""'), "p_type", F.lit('"", twice"'))).when(F.col("p_size") % 3 == 1, "").otherwise(F.col("p_type"))
    lines = read(spark, d, "part").select(F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), "p_name", F.lit('"')), quoted).alias("value"))
    return R.csv_cells(spark, text_file(lines, "csv"), 3).drop("row_index")


@query("csv_line_cells", """SELECT p_partkey, p_name AS name, 'b, "' || p_type || '"' AS quoted, '' AS blank FROM part""")
def _(spark, d):
    line = F.concat(F.lit("  "), "p_name", F.lit(' , "b, ""'), "p_type", F.lit('""", '))
    cells = R.csv_line(line, 3)
    return read(spark, d, "part").select("p_partkey", cells[0].alias("name"), cells[1].alias("quoted"), cells[2].alias("blank"))


@query("picker_tabs", """WITH r AS (SELECT *, p_partkey // 50 AS tab, p_partkey % 50 AS i FROM part), g AS (SELECT tab, min(i) AS first, arg_min(p_brand, i) AS brand, arg_min(p_size, i) AS size FROM r GROUP BY 1)
  SELECT r.tab, 'h' || CAST(p_partkey AS VARCHAR) AS hash, g.brand AS group_name, CASE WHEN i % 7 = 0 THEN 'Sub ' || CAST(i AS VARCHAR) ELSE (SELECT 'Sub ' || CAST(max(x.i) AS VARCHAR) FROM r x WHERE x.tab = r.tab AND x.i < r.i AND x.i % 7 = 0) END AS sub_name,
  CASE WHEN g.size % 2 = 0 THEN 'THICKNESS' END AS setting, CASE WHEN g.size % 2 = 0 THEN g.size * 1000.5 END::DOUBLE AS amount FROM r JOIN g ON r.tab = g.tab""")
def _(spark, d):
    p, k, s = read(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    rows = p.select(F.floor(k / 50).cast("long").alias("tab"), (k % 50).alias("i"), "p_partkey", "p_brand", s.alias("s"))
    first = rows.groupBy("tab").agg(F.min_by(F.struct("p_brand", "s"), "i").alias("f"), F.min("i").alias("i0"))
    blank = F.lit("")
    cell = lambda at, c0, c2, c3, code: F.struct(at.alias("row_index"), c0.alias("c0"), c2.alias("c2"), c3.alias("c3"), code.alias("c13"))
    label = F.when(F.col("f.s") % 2 == 0, " THICKNESS ").otherwise("")
    banner = first.select("tab", F.lit(-1).cast("long").alias("row_index"), F.concat(F.lit(" "), "f.p_brand").alias("c0"), label.alias("c2"), F.format_string("%,.1f", F.col("f.s") * 1000.5).alias("c3"), F.lit("T01|C01").alias("c13"))
    i = F.col("i")
    sub = rows.filter("i % 7 = 0").select("tab", cell(i * 10, F.concat(F.lit("Sub "), i.cast("string")), blank, blank, F.lit("T01|C01|S01")).alias("z")).select("tab", "z.*")
    item = rows.select("tab", cell(i * 10 + 5, blank, F.lit("x"), blank, F.concat(F.lit(" T01|C01|S01|h"), F.col("p_partkey").cast("string"))).alias("z")).select("tab", "z.*")
    cells = banner.unionByName(sub).unionByName(item)
    for n in (1, 4, 5, 6, 7, 8, 9, 10, 11, 12):
        cells = cells.withColumn(f"c{n}", F.lit("in" if n == 4 else ""))
    return R.picker_rows(cells).select("tab", "hash", "group_name", "sub_name", F.col("setting.label").alias("setting"), F.col("setting.value").alias("amount"))


@query("catalogue_by_group", """SELECT g AS group_prefix, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_hashed, round(sum(p_retailprice), 2) AS total FROM (SELECT *, CASE p_size % 4 WHEN 3 THEN 'zz' ELSE 'g' || CAST(p_size % 4 AS VARCHAR) END AS g FROM part) GROUP BY 1""")
def _(spark, d):
    s = F.col("p_size") % 4
    records = read(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.when(s != 3, F.concat(F.lit("g"), s.cast("string"))).alias("group_prefix"), F.col("p_retailprice").alias("gwp"))
    folder = _folder(spark, "catalogue")
    K.write_catalogue(records, folder, [F.col("gwp")])
    back = spark.read.schema("id string, gwp double, group_prefix string").json(f"{folder}/materials")
    index = spark.read.parquet(f"{folder}/index").filter("length(sha256) = 64").select("id", "sha256")
    return back.join(index, "id").groupBy("group_prefix").agg(F.count(F.lit(1)).alias("n"), F.count("sha256").alias("n_hashed"), F.round(F.sum("gwp"), 2).alias("total"))


@query("catalogue_files", """SELECT CAST(n_regionkey AS VARCHAR) AS group_prefix, n_name AS id, CAST(n_nationkey AS DOUBLE) AS gwp FROM nation WHERE n_regionkey <> 2""")
def _(spark, d):
    groups = read(spark, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("group_prefix")).agg(F.collect_list(F.struct(F.col("n_name").alias("id"), F.col("n_nationkey").cast("double").alias("gwp"))).alias("records"))
    line = F.to_json(F.struct("group_prefix", "records"))
    folder = _folder(spark, "groups")
    broken = F.when(F.col("group_prefix") == "2", F.concat(F.lit("{"), line)).otherwise(line)
    groups.select(F.col("group_prefix").alias("file"), broken.alias("value")).write.partitionBy("file").text(folder)
    return R.catalogue_files(spark, [f"{folder}/file={k}" for k in range(5)], "id string, gwp double").select("group_prefix", "id", "gwp")


@query("lookup_tables", "SELECT 'types' AS name, n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation UNION ALL SELECT 'regions', r_name, CAST(r_regionkey AS VARCHAR) FROM region")
def _(spark, d):
    files = {}
    for name, table, key, value, under in (("types", "nation", "n_name", "n_regionkey", "map"), ("regions", "region", "r_name", "r_regionkey", None)):
        entries = read(spark, d, table).agg(F.map_from_entries(F.collect_list(F.struct(key, F.col(value).cast("string")))).alias("map"))
        files[name] = (text_file(entries.select(F.to_json(F.struct("map") if under else F.col("map")).alias("value")), "json"), under)
    types, regions = (t.select(F.lit(n).alias("name"), "key", "value") for n, t in R.lookups(spark, files).items())
    return types.union(regions)


@query("material_xml", "SELECT p_brand AS grp, p_name AS name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS density FROM part")
def _(spark, d):
    density = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("<density>"), F.col("p_retailprice").cast("string"), F.lit("</density>"))).otherwise("")
    row = F.concat(F.lit('<m grp="'), "p_brand", F.lit('"><name>'), "p_name", F.lit("</name>"), density, F.lit("</m>"))
    folder = _folder(spark, "xml")
    groups = read(spark, d, "part").groupBy(F.col("p_brand").alias("file")).agg(F.concat(F.lit("<r>"), F.array_join(F.collect_list(row), ""), F.lit("</r>")).alias("value"))
    groups.write.partitionBy("file").text(folder)
    return R.flat_xml(spark, folder, "m", "_grp string, name string, density double").select(F.col("_grp").alias("grp"), "name", "density")


@query("project_polygons", """SELECT 'f' || CAST(n_nationkey AS VARCHAR) AS "fileName", n_regionkey + i AS page, 'poly' || CAST(i AS VARCHAR) AS poly_id, 'area' AS kind, CASE WHEN i = 1 THEN 'cut' ELSE 'net' END AS mode, CASE WHEN n_nationkey % 2 = 0 THEN 'garage' ELSE 'building' END AS scope, 'A' || CAST(i AS VARCHAR) AS sheet_id, 'plan' AS sheet_class, 4 AS n_vertices
  FROM nation, (VALUES (0), (1)) v(i)""")
def _(spark, d):
    n = F.col("n_nationkey")
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    polygon = lambda i: F.struct(F.lit(f"poly{i}").alias("id"), F.lit("L").alias("label"), F.array(point(0, 0), point(4, 0), point(4, 3), point(0, 3)).alias("vertices"), F.lit("cut" if i else None).cast("string").alias("mode"), F.when(n % 2 == 0, "garage").alias("scope"))
    page = lambda i: F.struct((F.col("n_regionkey") + i).cast("int").alias("pageNum"), F.lit("plan").alias("classification"), F.lit(f"A{i}").alias("sheetId"), F.array(polygon(i)).alias("polygons"))
    folder = _folder(spark, "projects")
    projects = read(spark, d, "nation").select(n.alias("file"), F.to_json(F.struct(F.concat(F.lit("f"), n.cast("string")).alias("fileName"), F.array(page(0), page(1)).alias("pages"))).alias("value"))
    projects.write.partitionBy("file").text(folder)
    polygons = R.projects(spark, folder).withColumn("sheet_id", F.lit(None).cast("string")).withColumn("sheet_class", F.lit(None).cast("string"))
    pages = spark.read.schema(R.PROJECT).option("multiLine", True).json(folder).select("fileName", F.explode("pages").alias("p")).select("fileName", F.col("p.pageNum").alias("page"), F.col("p.sheetId").alias("sheet_id"), F.col("p.classification").alias("classification"), F.lit(None).cast("string").alias("title"))
    flat = P.flat_polygons(polygons.drop("classification"), pages, ["fileName", "page"])
    return flat.select("fileName", F.col("page").cast("long").alias("page"), "poly_id", "kind", "mode", "scope", "sheet_id", "sheet_class", F.size("vertices").alias("n_vertices"))


@query("files_by_suffix", "SELECT 'name' AS field_id, n_name AS value, 'json' AS suffix FROM nation UNION ALL SELECT n_name, CAST(n_nationkey AS VARCHAR), 'csv' FROM nation")
def _(spark, d):
    n = read(spark, d, "nation")
    folder = _folder(spark, "states")
    n.select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"))).alias("value")).write.partitionBy("n_nationkey").text(f"{folder}.json")
    n.coalesce(1).select(F.col("n_name").alias("field_id"), F.col("n_nationkey").cast("string").alias("value")).write.option("header", True).csv(f"{folder}.csv")
    both = [R.by_suffix(spark, f"{folder}.{s}").select("field_id", F.col("value").cast("string").alias("value"), F.lit(s).alias("suffix")) for s in ("json", "csv")]
    return both[0].union(both[1])


@query("file_listing", "SELECT CAST(n_regionkey AS VARCHAR) AS region, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS n_files FROM nation GROUP BY 1")
def _(spark, d):
    folder = _folder(spark, "listing")
    read(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("k"), F.col("n_name").alias("value")).write.partitionBy("n_regionkey", "k").text(folder)
    found = kept(R.listed(spark, folder, "*.txt"))
    return found.groupBy(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).alias("region")).agg(F.count(F.lit(1)).alias("n_files"))
