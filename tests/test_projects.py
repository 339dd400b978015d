from pyspark.sql import functions as F

from ledgerstone.functions import labels as L
from ledgerstone.operators import projects as P


def each(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_labels(spark):
    assert each(spark, ["bc", " Ontario ", "Bavaria", None], L.province) == ["British Columbia", "Ontario", None, None]
    assert each(spark, ["USA", "canada", "x", None], L.country_code) == ["US", "CA", None, None]
    assert [len(v) for v in each(spark, ["Canada", "United States", "Peru", None], L.province_options)] == [13, 50, 0, 0]
    assert each(spark, ["03_cast_concrete", "", None], L.pretty_category) == ["cast concrete", "—", "—"]
    assert each(spark, ["06", "99", None], L.group_file) == ["06-wood.json", None, None]
    assert each(spark, ["a.b.value", "value", None], L.sibling_source) == ["a.b.source", None, None]
    assert each(spark, ["T1|2|3"], L.dom_key) == ["T1_2_3"]
    assert each(spark, ["05", "77"], lambda x: L.rendering(x)["metallic"]) == [0.85, 0.0]
    assert each(spark, ["06", "03", "07", None], lambda x: L.combustibility(x, F.lit("Board"))) == ["combustible", "non_combustible", None, None]
    assert each(spark, [12.0, None], lambda x: L.length_of_volume(x, F.lit(0.5), F.lit(0.7)), "double") == [34.2857, None]
    assert each(spark, ["dim_columns_piers", "area"], lambda x: L.display_value(x, F.lit(1.23456))) == [1.235, 1.23]


def test_provenance_round_trip(spark):
    made = each(spark, ["p1"], lambda x: L.provenance(x, F.array(F.lit("a")), F.lit(None).cast("string"), F.array(F.lit("A2.01"))))[0]
    got = each(spark, [made, "pdf:param", "pdf", None], L.read_provenance)
    assert [(g.type, g.summary, g.sheets) if g else None for g in got] == [("pdf-parser", "", ["A2.01"]), (None, "project-level parameter", []), (None, None, []), None]


def test_polygons(spark):
    polys = spark.createDataFrame([(1, "a", None, None, "shed", None, "plan"), (1, "b", "polyline", "add", "garage", "X", None), (9, "c", None, None, None, None, None)], "page long, poly_id string, kind string, mode string, scope string, sheet_id string, sheet_class string")
    pages = spark.createDataFrame([(1, "A2.01", "elevation", "T")], "page long, sheet_id string, classification string, title string")
    got = {r.poly_id: (r.kind, r.mode, r.scope, r.sheet_id, r.sheet_class, r.sheet_title) for r in P.flat_polygons(polys, pages, ["page"]).collect()}
    assert got == {"a": ("area", "net", "building", "A2.01", "plan", "T"), "b": ("polyline", "add", "garage", "X", "elevation", "T"), "c": ("area", "net", "building", None, None, None)}
    assert each(spark, [[1, 2], [1], None], lambda v: P.closable(F.lit("polyline"), v), "array<int>") == [True, False, False]
    segs = spark.createDataFrame([(0.0, 5.0, 60.0, 5.2), (3.0, 0.0, 3.0, -80.0), (0.0, 0.0, 60.0, 60.0), (0.0, 0.0, 49.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    assert sorted((r.axis, r["at"]) for r in P.orthogonal(segs).collect()) == [("h", 5.0), ("v", 3.0)]
    targets = spark.createDataFrame([("slab", ["a", "b", "a"]), ("wall", ["b"])], "component string, dims array<string>")
    assert {r.dim: r.components for r in P.components_of(targets, spark.createDataFrame([("a",), ("b",), ("c",)], "dim string")).collect()} == {"a": ["slab"], "b": ["slab", "wall"], "c": []}


def test_imports_and_choices(spark):
    previews = spark.createDataFrame([("old", "d1", 1.0), ("new", "d1", 2.0), ("new", "d2", None), ("new", "d3", 3.0)], "project string, dim string, value double")
    projects = spark.createDataFrame([("old", 1), ("new", 2)], "project string, updated long")
    current = spark.createDataFrame([("d1", 9.0, "user-modified"), ("d2", 8.0, "derived")], "field_id string, value double, state string")
    assert {r.field_id: (r.value, r.state) for r in P.trusted_import(previews, projects, current).collect()} == {"d1": (2.0, "imported"), "d2": (8.0, "derived"), "d3": (3.0, "imported")}
    assert P.trusted_import(previews, projects.limit(0), current).count() == 2
    children = spark.createDataFrame([("p", "Canada", "Ohio"), ("q", "Canada", "Quebec"), ("r", "Canada", "")], "field_id string, parent_value string, value string")
    options = spark.createDataFrame([("Canada", "Quebec"), ("United States", "Ohio")], "parent_value string, option string")
    assert {r.field_id: (r.value, r.new_state) for r in P.invalid_choices(children, options).collect()} == {"p": ("", "calculated"), "q": ("Quebec", None), "r": ("", None)}
    assert each(spark, [["imported", "default"], ["odd"], None], P.strongest, "array<string>") == ["imported", None, None]


def test_ids_are_unique_and_stable(spark):
    rows = spark.range(3000).withColumnRenamed("id", "k")
    taken = rows.filter("k < 5").select(L.minted_id(F.col("k")).alias("id"))
    a = {r.k: r.id for r in P.with_ids(rows, "k", taken).collect()}
    assert len(a) == 3000 == len(set(a.values())) and not set(a.values()) & {r.id for r in taken.collect()}
    assert a == {r.k: r.id for r in P.with_ids(rows.repartition(7), "k", taken).collect()}


def test_batches_files_and_matrices(spark):
    events = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 2, "y"), (1, "b", 3, "z"), (2, "a", 4, "w")], "b long, f string, seq long, v string")
    assert sorted((r.b, r.f, r.v, r.n_events) for r in P.quiet_batches(events, "b", "f", F.desc("seq")).collect()) == [(1, "a", "y", 2), (1, "b", "z", 1), (2, "a", "w", 1)]
    files = spark.createDataFrame([("f1", [("i1", 5.0), (None, -1.0)]), ("f2", []), ("f3", None)], "path string, records array<struct<id:string,gwp:double>>")
    rules = {"id is required": F.col("r.id").isNotNull(), "gwp is at least 0": F.col("r.gwp") >= 0}
    got = {(r.path, r.place): r.errors for r in P.file_errors(files, rules).collect()}
    assert got == {("f1", 1): ["id is required", "gwp is at least 0"], ("f2", None): ["id is required"], ("f3", None): ["id is required"]}
    rows = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", None)], "c string, f double")
    assert {r.c: (r.n, r.n_nonzero) for r in P.class_counts(rows, ["c"], "f").collect()} == {"a": (2, 1), "b": (1, 0)}
    matrix = spark.createDataFrame([("r1", ["house"]), ("r2", None), ("r3", ["shop"])], "rid string, project array<string>")
    assert sorted(r.rid for r in P.applicable(matrix, {"project": "house", "actor": None}).collect()) == ["r1", "r2"]
