import pytest
from pyspark.sql import functions as F

from ledgerstone.functions import display as D
from ledgerstone.operators import geometry as G
from ledgerstone.operators import projects as P
from ledgerstone.operators import sheets as H
from ledgerstone.sources import readers


def each(spark, values, f, kind="double"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_numbers_as_text(spark):
    odd = [None, 0.0, float("nan"), float("inf")]
    assert each(spark, [*odd, 12345.6, -1234.2], D.whole_kg) == ["0"] * 4 + ["12,346", "-1,234"]
    assert each(spark, [*odd, 12.3], D.quantity) == [""] * 4 + ["12.30"]
    assert each(spark, [None, 123.4, 12.34, 1.234, -500.0], D.potential) == ["—", "123", "12.3", "1.23", "-500.00"]
    assert each(spark, [0.0, 1234.5678, -12.3456, 0.0123, 0.00012], D.measure) == ["0", "1235", "-12.35", "0.012", "1.20e-4"]
    assert each(spark, [None, 0.0, 0.00001234, 2.5, 3.0, 0.123456], D.factor) == ["—", "0", "1.23e-5", "2.5", "3", "0.123456"]


@pytest.mark.parametrize(
    "style,want",
    [
        ("number-2dp", ["1234.50", "0.00", "x", "N/A", "N/A"]),
        ("number-1dp-comma", ["1,234.5", "0.00", "x", "N/A", "N/A"]),
        ("integer", ["1,235", "0.00", "x", "N/A", "N/A"]),
        ("percent", ["123,450%", "0.00", "x", "N/A", "N/A"]),
        ("percent-1dp", ["123,450.0%", "0.00", "x", "N/A", "N/A"]),
        ("raw", ["$1,234.5", "", "x", "N/A", "N/A"]),
    ],
)
def test_styles(spark, style, want):
    assert each(spark, ["$1,234.5", "", "x", " n/a", None], lambda t: D.shown(t, style), "string") == want


def test_scale_system(spark):
    df = spark.createDataFrame([(48, "1:48"), (48, "1/4\" = 1'-0\""), (96, None), (24, ""), (100, "1:100"), (None, None)], "r int, t string")
    assert [x.v for x in df.select(H.scale_system(F.col("r"), F.col("t")).alias("v")).collect()] == ["metric", "imperial", "imperial", "metric", "metric", "metric"]


def test_insert_vertex(spark):
    square = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0))))
    new = F.struct(F.lit(9.0).alias("x"), F.lit(9.0).alias("y"))
    xs = lambda e: [p.x for p in spark.range(1).select(G.insert_vertex(square, e, new).alias("v")).first().v]
    assert xs(0) == [0, 9, 2, 2] and xs(2) == [0, 2, 2, 9]


def test_workbook_fields(spark):
    cells = spark.createDataFrame([("P", "D1", 0.25, None, "0%"), ("P", "D2", None, "#NAME?", None), ("P", "D3", None, "oak", None), ("P", "D4", 7.0, None, None), ("Q", "D1", 5.0, None, None)], "tab string, cell string, number double, text string, format string")
    mapping = spark.createDataFrame([("P", "D1", "share", 1), ("P", "D2", "n", 2), ("P", "D3", "kind", 3), ("P", "D4", "n", 4), ("P", "D3", "n", 5), ("P", "D9", "gone", 6)], "tab string, cell string, field string, seq int")
    got = {r.field: (r.number, r.text) for r in readers.workbook_fields(cells, mapping).collect()}
    assert got == {"share": (25.0, None), "kind": (None, "oak"), "n": (None, "oak")}
    assert readers.workbook_fields(cells.limit(0), mapping).count() == 0


def test_sources_left(spark):
    sources = spark.createDataFrame([("len", "a"), ("vol", "b"), ("area", "c"), (None, "d")], "field string, source string")
    edits = spark.createDataFrame([("len",), ("len",), (None,)], "field string")
    parents = spark.createDataFrame([("len", "vol"), ("high", "other")], "field string, parent string")
    assert sorted(r.source for r in P.sources_left(sources, edits, parents).collect()) == ["c", "d"]


def test_calibrated(spark):
    pages = spark.createDataFrame([(1, 10.0, 50.0, "1:50", "accepted"), (2, None, None, None, "none"), (3, 4.0, 20.0, "1:20", "pending")], "page int, units_per_metre double, ratio double, label string, state string")
    kind = "page int, units_per_metre double, ratio double, label string, seq int"
    readings = spark.createDataFrame([(1, 11.0, 0.0, "", 1), (2, 5.0, 75.0, "", 1), (2, 6.0, None, None, 2), (3, -1.0, 9.0, "x", 1), (3, float("nan"), 9.0, "x", 2), (3, float("inf"), 9.0, "x", 3), (4, 8.0, None, None, 1)], kind)
    got = {r.page: tuple(r)[1:] for r in P.calibrated(pages, readings).collect()}
    assert got == {1: (11.0, 50.0, "1:50", "verified"), 2: (6.0, 75.0, "auto-calibrated", "verified"), 3: (4.0, 20.0, "1:20", "pending"), 4: (8.0, None, "auto-calibrated", "verified")}
