import pytest
from pyspark.sql import functions as F

from ledgerstone.functions.scalars import units_per_metre
from ledgerstone.operators import sheets as H


def each(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_titles_and_classes(spark):
    assert each(spark, ["2/6 SCALE: 3/16 UPPER FLOOR PLAN 6 3", "WHITE FASCIA EAST ELEVATION", "SECTION A-A", "12", "nothing", None], H.title_phrase) == ["UPPER FLOOR PLAN", "EAST ELEVATION", "SECTION A-A", None, None, None]
    rows = spark.createDataFrame([("A2.44", None, "plan"), ("A5.01", "Main floor plan", "plan"), ("S1.0", None, "structural"), (None, None, "other"), ("Z9", "Wall assemblies", "general"), ("A1.1", "", "site")], "n string, t string, want string")
    assert all(r.got == r.want for r in rows.select("want", H.sheet_class(F.col("n"), F.col("t")).alias("got")).collect())


def test_scales(spark):
    got = each(spark, ["Scale: 1:50 and 1:7", "1:7 then 1:100", "3/16\"=1'-0\"", "1 : 4", "N.T.S.", "1:50 NTS", "none", None, "1:7"], H.detected_scale)
    assert [tuple(g) if g else None for g in got] == [(50.0, "metric"), (100.0, "metric"), (64.0, "imperial"), (48.0, "metric"), (None, "nts"), (50.0, "metric"), None, None, (75.0, "metric")]


def test_pages(spark):
    items = spark.createDataFrame([(1, 1, "A2.01"), (1, 2, "A9.99"), (2, 3, "x")], "page long, item_id long, str string")
    lines = spark.createDataFrame(
        [(1, 1, "SITE PLAN", 8.0, 10.0, 50.0), (1, 2, "MAIN FLOOR PLAN", 12.0, 500.0, 90.0), (1, 3, "see garage 1:50", 5.0, 9.0, 9.0), (2, 1, "A4.01 callout", 6.0, 10.0, 5.0), (2, 2, "A4.02", 14.0, 900.0, 5.0), (3, 1, "", 1.0, 1.0, 1.0)],
        "page long, line_no long, line_text string, font double, y double, x_max double",
    )
    got = {r.page: r for r in H.classified_pages(items, lines).collect()}
    assert (got[1].sheet_id, got[1].title, got[1].cls, got[1].scale.ratio) == ("A2.01", "MAIN FLOOR PLAN", "plan", 50.0)
    assert tuple(got[1].tag) == ("slab_above_grade", "garage", None)
    assert (got[2].sheet_id, got[2].cls, tuple(got[2].tag)) == ("A4.02", "elevation", ("wall_exterior", "building", "wood_2x6"))
    assert (got[3].sheet_id, got[3].cls, got[3].scale) == (None, "other", None)
    assert {r.page: r.t for r in spark.createDataFrame([(1, "plan"), (2, "section"), (3, None)], "page long, c string").select("page", H.traceable(F.col("c")).alias("t")).collect()} == {1: True, 2: False, 3: False}


def test_dimensions(spark):
    glyphs = [("p", s, 100.0 + 5 * i, 50.0, 5.0, 8.0) for i, s in enumerate("12'-6\"")] + [("p", "3.5", 300.0, 90.0, 15.0, 8.0), ("p", "words", 10.0, 400.0, 30.0, 8.0)]
    items = spark.createDataFrame(glyphs, "page string, str string, x double, y double, width double, height double")
    found = H.callouts(items)
    assert [(r.text, round(r.metres, 3), r.format) for r in found.orderBy("c_id").collect()] == [("12'-6\"", 3.81, "imperial"), ("3.5", 3.5, "metric")]
    per_metre = spark.range(1).select(units_per_metre(F.lit(50.0)).alias("v")).first().v
    segs = [("p", 1, 80.0, 60.0, 80.0 + 3.81 * per_metre, 60.0), ("p", 2, 250.0, 100.0, 250.0 + 3.5 * per_metre * 1.01, 100.0), ("q", 3, 80.0, 60.0, 80.0 + 3.81 * per_metre, 60.0)]
    segments = spark.createDataFrame(segs, "page string, s_id long, x1 double, y1 double, x2 double, y2 double").withColumn("length", F.abs(F.col("x2") - F.col("x1")))
    got = {r.text: r for r in H.dimensions(found, segments, spark.createDataFrame([("p", 50.0)], "page string, ratio double")).collect()}
    assert got["12'-6\""].s_id == 1 and got["3.5"].s_id == 2 and got["3.5"].implied == pytest.approx(per_metre * 1.01)
    assert got["3.5"].agreement == pytest.approx(0.99, abs=1e-6)
    bare = H.dimensions(found, segments, spark.createDataFrame([], "page string, ratio double")).collect()
    assert len(bare) == 2 and all(r.s_id is None for r in bare)


def test_fraction_joins_its_word(spark):
    rows = [("p", "12'-6", 100.0, 50.0, 25.0, 8.0), ("p", "1", 127.0, 47.0, 4.0, 4.0), ("p", "2", 127.0, 53.0, 4.0, 4.0)]
    got = H.callouts(spark.createDataFrame(rows, "page string, str string, x double, y double, width double, height double")).filter("format = 'imperial'").collect()
    assert [r.text for r in got] == ["12'-6 1/2\""] and got[0].metres == pytest.approx(12 * 0.3048 + 6.5 * 0.0254)


def test_room_schedule(spark):
    cells = [(2, y, x, s) for y, row in enumerate([("No.", "Room", "Area (m2)"), ("1", "Kitchen", "12.5 m2"), ("2", "Bath", "x"), ("", "Total", "99"), ("3", "Late", "1")]) for x, s in enumerate(row) if s]
    cells += [(3, 0, 0, "Room"), (3, 1, 0, "Hall"), (1, 0, 0, "none")]
    items = spark.createDataFrame([(p, s, 100.0 * x, 20.0 * y, 40.0, 8.0) for p, y, x, s in cells], "page long, str string, x double, y double, width double, height double")
    got = [(r.page, r.num, r.name, r.area) for r in H.room_schedule(items).orderBy("row_no").collect()]
    # a blank first cell moves the others left, as cells are told apart by gaps alone
    assert got[:2] == [(2, 1, "Kitchen", 12.5), (2, 2, "Bath", None)]
