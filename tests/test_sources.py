import json

import pytest
from pyspark.sql import functions as F

from ledgerstone.operators import geometry as G
from ledgerstone.sources import readers as R
from ledgerstone.sources import writers as K
from ledgerstone.streaming import jobs


def test_csv_with_quotes_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"a ""b"", c"\r\n,"two\nlines"\r\nlast,\r\n')
    rows = R.csv_cells(spark, str(tmp_path / "a.csv"), 2).orderBy("row_index").collect()
    assert [(r.c0, r.c1.replace("\r", "")) for r in rows] == [("x", 'a "b", c'), ("", "two\nlines"), ("last", "")]
    line = spark.createDataFrame([(' a , "b, ""c""",',)], "l string")
    assert line.select(R.csv_line(F.col("l"), 3).alias("v")).first().v == ["a", 'b, "c"', ""]


def test_picker_tab_follows_the_order_of_banners(spark):
    def row(i, name, code, *more):
        c = [name, *more, *[""] * (12 - len(more)), code]
        return (i, *c)

    rows = [row(0, "Walls", "T01|C01", "", "THICKNESS", "4", "in"), row(1, "Wood", "T01|C01|S01"), row(2, "", "T01|C01|S01|h1", "TRUE", "12"), row(3, "noise", "x"), row(4, "Steel", "T01|C01|S02"), row(5, "", "T01|C01|S09|h2", "FALSE", "3"), row(6, "Named", "T01|C01|S02|h3")]
    cells = spark.createDataFrame(rows, "row_index long, " + ", ".join(f"c{i} string" for i in range(14)))
    got = R.picker_rows(cells).orderBy("row_index").collect()
    assert [(r.hash, r.group_name, r.sub_name, r.setting.label, r.setting.value, r.setting.unit) for r in got] == [("h1", "Walls", "Wood", "THICKNESS", 4.0, "in"), ("h2", "Walls", "Steel", "THICKNESS", 4.0, "in")]


def test_drawing_project(spark, tmp_path):
    box = [{"x": 0, "y": 0}, {"x": 4, "y": 0}, {"x": 4, "y": 3}, {"x": 0, "y": 3}]
    (tmp_path / "p.json").write_text(json.dumps({"fileName": "f", "pages": [{"pageNum": 9, "calibration": {"pdfUnitsPerMetre": 2.0}, "polygons": [{"id": "a", "label": "A", "vertices": box}]}, {"pageNum": 10, "polygons": [{"id": "b", "label": "B", "vertices": box, "scope": "garage"}]}]}))
    p = R.projects(spark, str(tmp_path / "p.json"))
    cal = p.select("page", "units_per_metre").distinct()
    got = {r.poly_id: (r.area_m2, r.length_m, r.scope, r.closed) for r in G.measured(p.drop("units_per_metre"), cal).collect()}
    assert got == {"a": (3.0, 7.0, "building", True), "b": (None, None, "garage", True)}


def test_states_catalogue_and_suffixes(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"fields": {"a": "1", "b": "x"}}')
    assert {(r.field_id, r.value) for r in R.by_suffix(spark, str(tmp_path / "s.json")).collect()} == {("a", "1"), ("b", "x")}
    with pytest.raises(ValueError):
        R.by_suffix(spark, "x.pdf")
    pair = spark.createDataFrame([(["a: first", "b"], ["1", "2"])], "h array<string>, v array<string>").select(R.state_csv(F.col("h"), F.col("v")).alias("p")).first().p
    assert [tuple(x) for x in pair] == [("a", "1"), ("b", "2")]
    rec = spark.createDataFrame([("m1", "06", 1.5, None), ("m2", None, None, "n")], "id string, group_prefix string, gwp double, note string")
    K.write_catalogue(rec, str(tmp_path / "cat"), [F.col("gwp")])
    back = spark.read.json(str(tmp_path / "cat/materials"))
    assert {(r.id, r.group_prefix) for r in back.select("id", F.col("group_prefix").cast("string").alias("group_prefix")).collect()} in ({("m1", "06"), ("m2", "zz")}, {("m1", "6"), ("m2", "zz")})
    assert spark.read.parquet(str(tmp_path / "cat/index")).filter("length(sha256) = 64").count() == 2
    (tmp_path / "x.xml").write_text("<r><m><n>a</n><d>2.5</d></m><m><n>b</n></m></r>")
    assert {(r.n, r.d) for r in R.flat_xml(spark, str(tmp_path / "x.xml"), "m", "n string, d double").collect()} == {("a", 2.5), ("b", None)}


def test_measurement_report(spark):
    walls = spark.createDataFrame([("s1", 1, "W1", 10.0), ("s1", 2, "W2", None), ("s2", 3, "W3", 5.0)], "sheet string, poly_id int, label string, area double")
    windows = spark.createDataFrame([("s1", 11, 1, "win", 2.5), ("s2", 12, None, "lost", 1.0)], "sheet string, poly_id int, parent int, label string, area double")
    rows = [(r.sheet, r.label, r.gross, r.net) for r in K.measurement_report(walls, windows).orderBy(F.col("sheet").asc_nulls_last(), "sort_key").collect()]
    assert rows == [("s1", "W1", "10.00", "7.50"), ("s1", "  win", "2.50", ""), ("s1", "W2", "", ""), ("s1", "TOTAL s1", "10.00", "7.50"), ("s2", "W3", "5.00", "5.00"), ("s2", "lost", "1.00", ""), ("s2", "TOTAL s2", "5.00", "5.00"), (None, "TOTAL", "15.00", "12.50")]


def _drain(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    events = [("a", "1", "imported", 1, 0), ("a", "1", "imported", 2, 5), ("a", "2", "imported", 3, 700), ("b", "x", "default", 4, 1)]
    (folder / "e.json").write_text("\n".join(json.dumps({"field_id": f, "value": v, "state": s, "seq": n, "ts": f"2024-01-01T00:{t // 60:02d}:{t % 60:02d}Z"}) for f, v, s, n, t in events))
    _drain(jobs.changed_fields(jobs.field_events(spark, str(folder))), "changed")
    assert {r.seq for r in spark.table("changed").collect()} == {1, 3, 4}
    batch = spark.read.schema("field_id string, value string, state string, seq long, ts timestamp").json(str(folder))
    assert sorted((r.field_id, r.seq) for r in jobs.quiet_values(batch, "60 seconds").collect()) == [("a", 2), ("a", 3), ("b", 4)]
    drafts = tmp_path / "drafts"
    drafts.mkdir()
    for i, rows in enumerate([[("f1", "draft", "p1", 1), ("f2", "draft", "p2", 2)], [("f1", "capture", "p3", 3), ("f2", "discard", None, 4), ("f3", "draft", "p5", 5)]]):
        (drafts / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("source_file", "kind", "payload", "seq"), r))) for r in rows))
        jobs.commit_queue(spark.readStream.schema("source_file string, kind string, payload string, seq long").json(str(drafts)), str(tmp_path / "queue"), str(tmp_path / "ck")).awaitTermination()
    last = jobs.queue_table(spark, str(tmp_path / "queue"), jobs.DRAFTS)
    assert {(r.source_file, r.kind) for r in last.collect()} == {("f1", "capture"), ("f3", "draft")}
