import pytest

from pyspark.sql import functions as F

from ledgerstone.functions import scalars as S
from ledgerstone.operators import declarations as D
from ledgerstone.operators.extraction import declared_quantity

NA = """Environmental Product Declaration
as per ISO 14025 and EN 15804+A1
Glulam beams from the west coast
Program operator UL Environment
Declaration Holder: Acme Timber Co.
Declaration Number: AB-1234.101.1 Scope of it
Declared unit: 1 m of glulam, density of 520 kg/m3
Product made of CLT and glulam, volumes in m³
Date of Issue: 20 Feb 2023
Period of validity
5 years until 20 February 2028
Part B: Structural and Architectural Wood
EPD type: Product-specific
Markets of applicability: Canada, United States
x EXTERNAL
Indicator unit A1-A3 A1 A2 A3
Global warming potential kg CO2 eq 100.5 50.25 25.25 25.0
GWP TRACI kg CO2 eq TRACI 2.1 V1.02
Ozone depletion potential kg CFC-11 eq 1.5E-06 1.0E-06 2.5E-07 2.5E-07
stages A1 A2 A3
Eutrophication potential kg N eq 0,31 0.1 0.2 0.01
"""
INTL = "Acme panels and boards\nProgramme operator: somebody\nS - P - 10278\nInformation from\nNordic Boards AB\nPublication date: 202 5 - 10 - 2 0\nValid until: 2030-1-9\nFunctional unit / declared unit: 1 kg of board\n"
IBU = "Mineral wool slabs\nOwner of the Declaration Wool GmbH\nDeclaration number EPD-WOL-2020-1\nIssue date 01/02/2020\nValid to 31/01/2025\ninternally x externally\naverage weighted density of 85,5 kg/m3\nThis Declaration refers to 1 t of wool\n"
NSF = "Portland cement of a plant\nNSF International\nEPD Commissioner and Owner: Cement Inc\nDate of Issue: 3 May 2021\nDeclared Unit: 1 metric ton\n"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, NA), (2, INTL), (3, IBU), (4, NSF), (5, None), (6, "")], "doc_id long, text string")


def test_records_by_family(docs):
    got = {r.doc_id: r for r in D.records(docs, groups=[("Glulam", "06", "Wood")]).collect()}
    a = got[1]
    assert (a.family, a.title, a.material_type, a.display_name, a.group_prefix) == ("na", "Glulam beams from the west coast", "Glulam", "Wood | Glulam", "06")
    assert (a.manufacturer, a.epd_id, a.program_operator, a.per_unit, a.density_kg_m3) == ("Acme Timber Co.", "AB-1234.101.1", "UL Environment", "1 m³", 520.0)
    assert (a.published, a.expires, a.epd_type, a.markets, a.verification) == ("2023-02-20", "2028-02-20", "product_specific", ["CAN", "USA"], "external")
    assert a.standards == ["ISO 14025", "EN 15804+A1"] and a.pcr == "Structural and Architectural Wood"
    assert a.gwp_kgco2e == 100.5 and a.ozone_depletion_kgcfc11eq == 1.5e-6 and a.smog_kgo3eq is None and a.n_anchors == 9
    b = got[2]
    assert (b.family, b.epd_id, b.program_operator, b.manufacturer, b.published, b.expires, b.per_unit) == ("epd_intl", "S-P-10278", "EPD International AB", "Nordic Boards AB", "2025-10-20", "2030-01-09", "1 kg of board")
    c = got[3]
    assert (c.family, c.manufacturer, c.epd_id, c.published, c.expires, c.verification, c.density_kg_m3, c.material_type) == ("eu_ibu", "Wool GmbH", "EPD-WOL-2020-1", "2020-02-01", "2025-01-31", "external", 85.5, "Mineral wool")
    d = got[4]
    assert (d.family, d.manufacturer, d.published, d.per_unit, d.program_operator) == ("nsf", "Cement Inc", "2021-05-03", "1 metric ton", "NSF International")
    assert got[5].family == got[6].family == "unknown" and got[5].n_anchors == got[6].n_anchors == 0


def test_values_by_stage(docs):
    got = {(r.indicator, r.stage): r.value for r in D.by_stage(docs.filter("doc_id IN (1, 5, 6)")).collect()}
    gwp = {s: v for (i, s), v in got.items() if i == "gwp_kgco2e"}
    assert gwp == {"A1": 50.25, "A2": 25.25, "A3": 25.0}
    assert got["ozone_depletion_kgcfc11eq", "A2"] == 2.5e-7
    # three decimals ('0,31' is none) go under the nearest header with three stages
    assert {s: v for (i, s), v in got.items() if i == "eutrophication_kgneq"} == {"A1": 0.1, "A2": 0.2, "A3": 0.01}


def test_small_columns(spark):
    at = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert at(D.tidy_operator(F.lit("UL Environment 333 Pfingsten Road"))) == "UL Environment"
    assert at(D.market_codes(F.lit("North America"))) == ["CAN", "USA"] and at(D.market_codes(F.lit("DEU; FRA, x"))) == ["DEU", "FRA"] and at(D.market_codes(F.lit("Eastern Europe"))) == []
    assert at(declared_quantity(F.lit("2,5 tonnes of steel"), F.lit(""))) == "2.5 metric ton" and at(declared_quantity(F.lit("one bag"), F.lit(""))) is None
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    ago = lambda t: at(S.relative_time(F.lit(t).cast("timestamp"), now))
    assert [ago(x) for x in ("2024-05-01 11:59:50", "2024-05-01 11:30:00", "2024-05-01 09:40:00", "2024-04-01 09:40:00", None)] == ["just now", "30m ago", "2h ago", "2024-04-01 09:40", "just now"]
