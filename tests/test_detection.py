from pyspark.sql import functions as F

from ledgerstone.functions import display as Y
from ledgerstone.operators import aggregates as A
from ledgerstone.operators import declarations as D
from ledgerstone.operators import detection as X
from ledgerstone.operators import graphs as G
from ledgerstone.operators import joins as J
from ledgerstone.sources import readers as R


def test_drawing_events(spark):
    rows = [
        (1, 1, "vertex", None, None, 1.0), (1, 2, "start", "polyline", None, None), (1, 3, "vertex", None, None, 1.0), (1, 4, "close", None, None, None), (1, 5, "vertex", None, None, 2.0), (1, 6, "close", None, None, None), (1, 7, "vertex", None, None, 3.0),
        (1, 8, "start", None, "garage", None), (1, 9, "vertex", None, None, 1.0), (1, 10, "start", None, "shed", None), (2, 1, "close", None, None, None),
    ]
    df = spark.createDataFrame(rows, "page long, seq long, op string, kind string, scope string, x double").withColumns({"mode": F.lit(None).cast("string"), "label": F.lit(None).cast("string"), "y": F.col("x")})
    got = [(r.poly_no, r.kind, r.mode, r.scope, r.label, [v.x for v in r.vertices], r.closed) for r in X.drawn_polygons(df).orderBy("page", "poly_no").collect()]
    assert got == [(1, "polyline", "net", "building", "Line 1", [1.0, 2.0], True), (2, "area", "net", "garage", "Area 1", [1.0], False), (3, "area", "net", "building", "Area 2", [], False)]


def test_readings_prefer_flat_then_sure_then_long(spark):
    dims = spark.createDataFrame([(1, 1, 1, 0.95, 50.0, None), (1, 2, 2, 0.70, 60.0, None), (1, 3, 3, 0.72, 61.0, None), (2, 1, 1, 0.9, 100.0, 101.0), (3, 1, 1, 0.9, 100.0, 150.0), (4, 1, None, None, None, 1.0)], "page long, c_id long, s_id long, score double, implied double, declared double")
    upright, flat = (0.0, 0.0, 0.0, 300.0, 300.0), (0.0, 0.0, 90.0, 0.0, 90.0)
    segs = spark.createDataFrame([(1, 1, *upright), (1, 2, *flat), (1, 3, 0.0, 0.0, 120.0, 0.0, 120.0), (2, 1, *flat), (3, 1, *flat)], "page long, s_id long, x1 double, y1 double, x2 double, y2 double, length double")
    got = {r.page: (r.outcome, r.units_per_metre, r.n_callouts) for r in X.calibration_readings(dims, segs).collect()}
    assert got == {1: ("detected", 61.0, 3), 2: ("confirmed", 101.0, 1), 3: ("disagrees", None, 1)}


def test_outlines_of_empty_pages(spark):
    pages = spark.createDataFrame([(1, 600.0, 700.0), (2, 600.0, 700.0)], "page long, width double, height double")
    none = spark.createDataFrame([], "page long, seg_id long, x1 double, y1 double, x2 double, y2 double")
    paths = spark.createDataFrame([(2, 7, 3.0), (2, 8, 9.0), (2, 9, 9.0)], "page long, path_id long, area double")
    assert {r.page: (r.source, r.path_id) for r in X.outlines(none, pages, paths).collect()} == {1: (None, None), 2: ("path", 8)}


def test_wrapped_pages(spark):
    """A status for each page, corners clipped to what is drawn, places of both axes."""
    seg = []
    wall = lambda page, axis, pos, lo, hi: seg.append((page, len(seg), *((lo, pos, hi, pos) if axis == "h" else (pos, lo, pos, hi))))
    for pos in (100.0, 104.0, 108.0, 400.0, 410.0):
        wall(1, "v", pos, 100.0, 300.0)
    for pos in (100.0, 110.0, 300.0, 304.0):
        wall(1, "h", pos, 90.0, 500.0)
    wall(2, "v", 100.0, 100.0, 300.0), wall(2, "v", 110.0, 100.0, 300.0), wall(2, "h", 200.0, 100.0, 300.0)
    wall(3, "h", 100.0, 100.0, 300.0), wall(3, "h", 120.0, 100.0, 300.0)
    wall(4, "h", 100.0, 100.0, 300.0), wall(4, "h", 140.0, 100.0, 300.0)
    wall(5, "h", 5.0, 100.0, 300.0)
    df = spark.createDataFrame(seg, "page long, seg_id long, x1 double, y1 double, x2 double, y2 double")
    pages = spark.createDataFrame([(i, 600.0, 700.0) for i in range(1, 7)], "page long, width double, height double")
    got = {r.page: r for r in X.wrapped(df, pages).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "outlined", 2: "no_horizontal_walls", 3: "no_vertical_walls", 4: "no_walls", 5: "no_drawing", 6: "no_drawing"}
    r = got[1]
    assert (r.x1, r.y1, r.x2, r.y2) == (100.0, 100.0, 410.0, 304.0) and (r.n_horizontal, r.n_vertical) == (4, 5)
    assert [(p.x, p.y) for p in r.polygon] == [(100.0, 100.0), (410.0, 100.0), (410.0, 304.0), (100.0, 304.0)]
    assert r.xs == [102.0, 108.0, 400.0, 410.0] and r.ys == [100.0, 110.0, 302.0]
    assert got[2].polygon is None and got[2].xs is None and (got[2].n_horizontal, got[2].n_vertical) == (0, 2)


def test_places_in_groups(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("b", 5.0), (None, 1.0), (None, 2.0), ("c", None)], "g string, v double").repartition(5)
    got = {r.g: (r.low, r.high) for r in A.trimmed_extent(df, ["g"], "v").collect()}
    assert got == {"a": (5.0, 95.0), "b": (5.0, 5.0), None: (1.0, 2.0)}
    assert {r.g: r.median for r in A.upper_median(df, ["g"], "v").collect()} == {"a": 50.0, "b": 5.0, None: 2.0}
    assert A.upper_median(df.limit(0), ["g"], "v").collect() == []


def test_next_candidates(spark):
    xs = [0.0, 0.3, 0.5, 0.51, 0.9, 7.0, 7.2, 7.5, 7.6]
    df = spark.createDataFrame([(1, x) for x in xs + xs[:2]] + [(2, 3.0)], "page long, pos double")
    got = {(r.page, r.pos): r.nxt for r in J.next_candidates(df, "page", "pos", 0.5).collect()}
    assert got == {(1, x): min((y for y in xs if y > x + 0.5), default=None) for x in xs} | {(2, 3.0): None}


def test_clusters_over_runs(spark):
    xs = [1.0, 2.0, 5.5, 9.0, 9.1, 30.0, 31.0, 37.0]
    df = spark.createDataFrame([("u", x) for x in xs] + [("w", 1.0)], "u string, x double").repartition(4)
    got = {}
    for r in A.cluster_means(df, "u", "x", 5.0).orderBy("u", "anchor").collect():
        got.setdefault(r.u, []).append(round(r["mean"], 6))
    assert got == {"u": [round(8.5 / 3, 6), 9.05, 30.5, 37.0], "w": [1.0]}


def test_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(31)] + [("n31", "n0"), ("n3", "m")], "src string, dst string")
    got = {r.node: r.depth for r in G.reached(edges, spark.createDataFrame([("n0",)], "node string")).collect()}
    assert got == {f"n{i}": i for i in range(32)} | {"m": 4}
    assert {r.node for r in G.reached(edges, spark.createDataFrame([("n0",)], "node string"), 3).collect()} == {"n0", "n1", "n2", "n3"}


def test_grammar(spark):
    at = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    for text in ("Declaration Holder : Acme & Co", "D ECLARATION H OLDER\nAcme & Co", "declaration  holder#Acme & Co"):
        assert at(D.after_label(F.lit(text), "declaration holder", "name")) == "Acme & Co"
    assert at(D.after_label(F.lit("predeclaration holder: Acme"), "declaration holder", "name")) is None
    row = lambda s, kind="code": at(D.row_value(F.lit(s), ["GWP"], ["kg CO2 e"], kind, ["bio"]))
    assert row("GWP kg CO2 eq TRACI 2.1 V1.02") is None and row("GWP kg CO2 eq 12.5") == 12.5 and row("GWP-bio kg CO2 eq 1") is None
    assert row("GWP [kg CO 2 - eq.] 1,234.5 2") == 1234.5 and row("XGWP kg CO2 eq 1") is None
    assert at(D.identifier(F.lit("EPD 296 Declared Product Glulam 3"))) == "EPD 296" and at(D.identifier(F.lit("#AB-12c Owner"))) == "AB-12c" and at(D.identifier(F.lit("none at all"))) is None
    assert at(D.row_numbers(F.lit("GWP kg CO2 V1.02 1,200.5 -3.25 7 123 1e-3"))) == [1200.5, -3.25, 123.0, 0.001]


def test_value_rules(spark):
    text = "made of wood produced by Northern Mills in the west\nDeclared unit: 1 m of beam Valid until 2024-11-05\nsee PCR 2012:01 v2.33 for it\nProduct Category Rules (PCR): Cements of 5\nOwner of the declaration Wool (of 2) GmbH\nEPD type: " + "long " * 90
    cases = [("produced by", "capitals"), ("declared unit", "line"), ("PCR", "code"), ("product category rules (PCR)", "cited"), ("owner of the declaration", "name"), ("EPD type", "line"), ("no label", "line")]
    row = spark.createDataFrame([(text,)], "t string").select(*(F.trim(D.after_label(F.col("t"), *c)).alias(f"c{i}") for i, c in enumerate(cases))).first()
    assert list(row) == ["Northern Mills", "1 m of beam", "PCR 2012:01 v2.33", "Product Category Rules (PCR): Cements of 5", "Wool", ("long " * 90).strip(), None]


def test_lookups_and_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"Glulam": "06", "Steel": "05"}')
    (tmp_path / "b.json").write_text('{"aliases": {"CLT": "Wood"}, "more": 1}')
    got = R.lookups(spark, {"types": (str(tmp_path / "a.json"), None), "aliases": (str(tmp_path / "b.json"), "aliases")})
    assert {(n, r.key, r.value) for n, t in got.items() for r in t.collect()} == {("types", "Glulam", "06"), ("types", "Steel", "05"), ("aliases", "CLT", "Wood")}
    (tmp_path / "ok.json").write_text('{"group_prefix": "03", "records": [{"id": "x"}]}')
    (tmp_path / "bad.json").write_text('{"group_prefix": "03", "records": [')
    both = [str(tmp_path / "ok.json"), str(tmp_path / "bad.json")]
    assert [tuple(r) for r in R.catalogue_files(spark, both, "id string").collect()] == [("03", "x")]
    assert [r.path.rsplit("/", 1)[-1] for r in R.unreadable_files(spark, both, "id string").collect()] == ["bad.json"]


def test_detail_lines(spark):
    df = spark.createDataFrame([("m1", ("Beam",), (["a", "b"], True), (12.345,)), ("m2", None, None, None)], "id string, naming struct<display_name:string>, rendering struct<typical:array<string>,has_grain:boolean>, physical struct<mass_per_unit_kg:double>")
    got = {(r.id, r.block, r.label): r.shown for r in Y.detail_lines(df).collect()}
    assert got["m1", "identity", "display_name"] == "Beam" and got["m1", "identity", "rendering.grain"] == "yes" and got["m1", "physical", "mass_per_unit_kg"] == "12.35" and got["m1", "physical", "density"] == "—"
    assert got["m2", "identity", "display_name"] == "—" and len(got) == 2 * sum(map(len, Y.DETAIL_BLOCKS.values()))
