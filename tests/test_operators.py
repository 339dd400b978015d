import json
import math
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerstone.functions import scalars as S
from ledgerstone.operators import aggregates as A
from ledgerstone.operators import extraction as E
from ledgerstone.operators import geometry as G
from ledgerstone.operators import graphs, importing, layout, merging
from ledgerstone.operators import joins as J
from ledgerstone.operators.storage import numbered
from ledgerstone.plans.calculator import biogenic_carbon
from ledgerstone.plans.catalog import infer_jurisdiction, jurisdiction_match


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def each(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_numbers(spark):
    assert each(spark, ["$1,234.50", "12abc", "N/A", "", "-3e2", "abc", None, "5."], S.parse_numeric) == [1234.5, 12.0, 0.0, 0.0, -300.0, 0.0, 0.0, 5.0]
    assert each(spark, ["1,234.5", "3,5", "7.25", "x"], S.euro_number) == [1234.5, 3.5, 7.25, None]
    assert each(spark, ["3,490.16 and 1,200 or 12 and 5.5 and 300 1.2E-3"], S.number_tokens) == [["3,490.16", "1,200", "5.5", "300", "1.2E-3"]]
    assert each(spark, [0.285, -0.285, 1.005, 2.5], lambda x: S.js_round(x, 2), "double") == [0.28, -0.28, 1.0, 2.5]
    assert each(spark, [1.0, 25.0, 1200.0, None], S.format_band, "double") == ["1.000", "25.0", "1200", "—"]


def test_units_and_scales(spark):
    assert each(spark, ['m2 at 3.5"', " M² ", "m²•RSI", None], S.normalize_unit) == ["m2", "m2", "m2*rsi", None]
    q = lambda unit, label, cfg, cu="in": one(spark, S.convert_quantity(F.lit(10.0), F.lit("m2"), F.lit(unit), F.lit(label), F.lit(cfg).cast("double"), F.lit(cu)))
    assert q("m2", "", 0) == 10 and q("m3", "THICKNESS", 4) == pytest.approx(1.016) and q("m2·RSI", "R-VALUE", 5.678) == pytest.approx(10)
    assert q("m3", "THICKNESS", 0) is None and q("kg", "THICKNESS", 1) is None
    assert one(spark, S.scale_ratio(S.units_per_metre(F.lit(48.0)))) == 48
    assert one(spark, S.pitch_factor(F.lit(60.0))) == pytest.approx(2) and one(spark, S.pitch_factor(F.lit(90.0))) is None
    assert each(spark, [150.0, -5.0, None], S.percent_share, "double") == [1.0, 0.0, 1.0]


def test_worked_carbon_example(spark):
    c = biogenic_carbon(F.lit(69.96), F.lit(11.249), F.lit(406.13), F.lit(0.1), F.lit(1.0), F.lit(0.5), F.lit(0.9))
    assert one(spark, c["common"]) == 6.22 and one(spark, c["factor"]) == 0.088897
    assert one(spark, c["full_carbon"]) == pytest.approx(74.53, abs=0.02) and one(spark, c["stored"]) == pytest.approx(67.08, abs=0.02) and one(spark, c["kg_carbon"]) == 20.31


def test_dates_and_dimensions(spark):
    assert each(spark, ["on 2020-05-06", "6/5/2020", "6 May 2020", "May 6, 2020", "may 2020", "31/02/2020", "none"], S.parse_date) == ["2020-05-06"] * 4 + ["2020-05-01", "2020-02-31", None]
    assert each(spark, [44000, 2024, 10, 12000], S.expiry_to_iso, "int") == ["2020-06-18", "2024-12-31", "0010-12-31", None]
    assert each(spark, ["12'-6 1/2\"", "3'", "x", "900'"], S.parse_imperial) == [pytest.approx(12 * 0.3048 + 6.5 * 0.0254), pytest.approx(0.9144), None, None]
    assert each(spark, ["2.5", "2500", "350 mm", "0.01 m"], S.parse_metric) == [2.5, 2.5, 0.35, None]
    got = each(spark, ["5' 6\"", "12 mm", "3.5", "9 parsecs"], S.parse_distance)
    assert [tuple(g) if g else None for g in got] == [(5.5, "ft"), (12.0, "mm"), (3.5, None), None]


def test_text(spark):
    assert each(spark, ["a , b;; c ,"], S.split_clean) == [["a", "b", "c"]]
    assert each(spark, ["1,234.5", 'say "x", y', "a\nb", "plain"], S.csv_escape) == ["1234.5", '"say ""x"", y"', '"a\nb"', "plain"]
    assert each(spark, ["<a href='x'>&\"</a>"], S.html_escape) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;&lt;/a&gt;"]
    keys = each(spark, ["item 10", "Item 9", "item 2b"], S.natural_key)
    assert sorted(range(3), key=keys.__getitem__) == [2, 1, 0]
    assert each(spark, ["x – CANADA", "thing (DEU)", "of Europe", "none"], infer_jurisdiction) == ["CAN", "DEU", "EUR", None]
    m = lambda c, p: one(spark, jurisdiction_match(F.lit(c), F.lit(p), "CAN", "BC", ["BC", "ON"]))
    assert [m(None, None), m("USA", None), m("CAN", "BC"), m("CAN", "ON"), m("CAN", "CA-wide"), m("CAN", "ZZ")] == [True, False, True, False, True, True]


def test_geometry(spark):
    def shape(*pts):
        return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts))

    box = shape((0, 0), (4, 0), (4, 3), (0, 3))
    assert one(spark, G.area(box)) == 12 and one(spark, G.length(box, True)) == 14 and one(spark, G.length(box)) == 11
    two = shape((0, 0), (3, 4))
    assert one(spark, G.area(two)) == 0 and one(spark, G.length(two, True)) == 5
    assert tuple(one(spark, G.centroid(box))) == (2, 1.5)
    assert one(spark, G.contains(box, F.lit(1.0), F.lit(1.0))) and not one(spark, G.contains(box, F.lit(5.0), F.lit(1.0)))
    assert tuple(one(spark, G.project_on_segment(F.lit(9.0), F.lit(3.0), F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(0.0)))) == (4, 0)
    assert len(one(spark, G.merge_vertex(shape((0, 0), (1, 0), (9, 9), (0, 9)), 1))) == 3 and len(one(spark, G.merge_vertex(box, 1))) in (3, 4)
    assert one(spark, G.next_candidate(F.lit(3.0), F.array(F.lit(3.4), F.lit(9.0), F.lit(7.0)))) == 7
    assert tuple(one(spark, G.affine(F.lit(1.0), F.lit(2.0), [F.lit(float(x)) for x in (2, 0, 0, 3, 10, 20)]))) == (12, 26)


def test_clusters_and_medians(spark):
    assert each(spark, [[11.0, 0.0, 4.0, 5.0, 9.0, 10.0], []], lambda x: A.anchored_clusters(x, 5.0), "array<double>") == [[3.0, 10.0], []]
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 41)] + [("b", 2.0), ("b", 9.0)], "g string, v double")
    assert {r.g: (r.low, r.high) for r in A.trimmed_extent(rows, ["g"], "v").collect()} == {"a": (3.0, 38.0), "b": (2.0, 9.0)}
    assert {r.g: r.median for r in A.upper_median(rows, ["g"], "v").collect()} == {"a": 21.0, "b": 9.0}
    assert {r.g: r.v for r in A.lower_median_row(rows, ["g"], "v").collect()} == {"a": 20.0, "b": 2.0}
    peers = spark.createDataFrame([(i, "s", f, v) for i, (f, v) in enumerate([(True, None), (False, 8.515), (False, 8.466), (False, 4.672), (False, 3.742), (False, 1.927), (True, 7.0)])] + [(9, "t", True, None)], "i int, sub string, flag boolean, v double")
    got = {r.i: (r.v, r.n_peers) for r in A.impute_peer_average(peers, ["sub"], "v", "flag").collect()}
    assert got[0] == (pytest.approx(5.4644), 5) and got[6] == (7.0, 0) and got[9] == (None, 0)


def test_numbered_equals_a_plain_order(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 7919 % 101)
    got = [(r.rn, r.id) for r in numbered(df, F.desc("v"), F.asc("id")).collect()]
    want = sorted(range(1000), key=lambda i: (-(i * 7919 % 101), i))
    assert sorted(got) == list(enumerate(want, 1))


def test_merges(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, seq int")
    patch = spark.createDataFrame([(2, "B", 0), (7, "n", 1)], "k int, v string, seq int")
    once = merging.upsert_by_key(base, patch, "k")
    assert sorted(map(tuple, once.select("k", "v", "seq").collect())) == [(1, "a", 1), (2, "B", 2), (7, "n", 4)]
    old = spark.createDataFrame([Row(k=1, r=Row(a=1, b="x"), t=["p"])], "k int, r struct<a:int,b:string>, t array<string>")
    new = spark.createDataFrame([Row(k=1, r=Row(a=None, b="y"), t=["q"]), Row(k=2, r=None, t=None)], "k int, r struct<a:int,b:string>, t array<string>")
    merged = {r.k: (r.r, r.t) for r in merging.deep_merge(old, new, "k").collect()}
    assert merged == {1: (Row(a=1, b="y"), ["q"]), 2: (None, None)}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {r.node: r.depth for r in graphs.reached(edges, spark.createDataFrame([("a",)], "node string")).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.drift + r.k for r in J.drift(spark.createDataFrame([("p",), ("q",)], "k string"), spark.createDataFrame([("q",), ("z",)], "k string"), "k").collect()} == {"stalep", "missz"}


def test_extraction(spark):
    df = spark.createDataFrame([(1, "Title of it\nA1 A2 A3\ngwp 1.5 2.5 3.5\nA1 A2 C1\nodp 0.25 9.75 8.5\n")], "k int, t string")
    lines = E.lines_of(df, "k", "t").withColumn("stages", E.stage_codes(F.col("line_text")))
    values = F.when(F.size("stages") == 0, F.transform(S.number_tokens(F.col("line_text")), lambda x: x.cast("double")))
    got = {r.stage: r.value for r in E.zip_stages(lines, "k", F.when(F.size(values) > 0, values)).collect()}
    assert got == {"A1": 1.5, "A2": 2.5, "A3": 3.5, "C1": 8.5}
    assert one(spark, E.first_line(F.lit("x\nab cd ef\n"))) == "ab cd ef"
    assert [tuple(x) for x in each(spark, ["1 m²", "2.5 Tonnes", "kg"], E.declared_unit)] == [(1.0, "m2"), (2.5, "t"), (1.0, "kg")]


def test_layout(spark):
    items = spark.createDataFrame([(1, i, float(y), 0.0) for i, y in enumerate([0, 2, 4, 6, 20])], "page int, item_id int, y double, x double")
    rows = lambda **k: [r.row_no for r in layout.row_clusters(items, "page", **k).orderBy("item_id").collect()]
    assert rows(anchored=True) == [1, 1, 2, 2, 3] and rows(anchored=False) == [1, 1, 1, 1, 2]
    words = spark.createDataFrame([(1, "1", 0.0, 0.0, 5.0, 8.0), (1, "2", 5.5, 0.5, 5.0, 8.0), (1, "x", 40.0, 0.0, 5.0, 8.0), (1, "4", 0.0, 5.0, 5.0, 8.0)], "page int, str string, x double, y double, width double, height double")
    assert {r.text for r in layout.glyph_runs(words).collect()} == {"12", "x", "4"}
    assert {(r.row_no, r.cell_no, r.text) for r in layout.table_cells(words).collect()} == {(1, 0, "12"), (1, 1, "x"), (2, 0, "4")}
    assert [(r.num, r.den) for r in layout.paired_fractions(words).collect()] == [(1, 4)]
    ops = spark.createDataFrame([(1, 0, "save", []), (1, 1, "transform", [2.0, 0.0, 0.0, 2.0, 1.0, 1.0]), (1, 2, "rect", [0.0, 0.0, 1.0, 1.0]), (1, 3, "restore", []), (1, 4, "move", [0.0, 0.0]), (1, 5, "line", [3.0, 0.0])], "page int, seq int, op string, args array<double>")
    seg = [(r.x1, r.y1, r.x2, r.y2) for r in layout.drawn_segments(ops).orderBy("seg").collect()]
    assert seg[0] == (1, 1, 3, 1) and seg[-1] == (0, 0, 3, 0) and len(seg) == 5
    picks = spark.createDataFrame([(1, 0, 0.80, 5.0), (1, 1, 0.82, 9.0), (1, 2, 0.70, 99.0)], "page int, id int, conf double, len double")
    assert layout.tolerant_pick(picks, "page", [("conf", True, 0.05), ("len", True, 0.0)], "id").first().id == 1


def test_formulas(spark):
    cells = F.create_map(F.lit("A"), F.lit("2"), F.lit("B"), F.lit("=A1*3"), F.lit("C"), F.lit("text"))
    got = each(spark, ["=A7+B2", "=(A1-C1)/0", "=__import__('os')", "=2*-3", "=C1+1", None], lambda x: layout.evaluated(x, cells))
    assert got == [8.0, None, None, -6.0, 1.0, None]


def test_new_dirty_nodes(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(80)}
    edges = spark.createDataFrame(sorted(pairs), "src int, dst int")

    def closure(seeds):
        seen, todo = set(), list(seeds)
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [b for a, b in pairs if a == n]
        return seen

    before = closure([1, 2])
    nodes = lambda xs: spark.createDataFrame([(x,) for x in xs], "node int")
    got = [r.node for r in graphs.newly_reached(edges, nodes([1, 7, 8, 99]), nodes(sorted(before))).collect()]
    assert len(got) == len(set(got)) and set(got) == closure([1, 7, 8, 99]) - before
    assert graphs.newly_reached(edges, nodes(sorted(before)), nodes(sorted(before))).collect() == []


def by_recursion(formula, cells, depth=0):
    """One formula at a time, from the outside in."""
    if depth > 8:
        return None

    def cell(m):
        raw = (cells.get(m[1]) or "").strip()
        v = by_recursion(raw, cells, depth + 1) if raw.startswith("=") else layout._plain(raw)
        return f"({v or 0.0!r})"

    try:
        v = eval(re.sub(r"([A-Z]+)\d+", cell, formula[1:]))  # noqa: S307  made below
    except (ZeroDivisionError, OverflowError, SyntaxError, NameError):
        return None
    return v if math.isfinite(v) else None


def test_formulas_that_name_formulas(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(120):
        cells = {c: rng.choice(["", "3", "-2.5", "1,200", "text"]) for c in "ABCDEF"}
        for c in "GHIJKLMNOPQR":
            cells[c] = "=" + rng.choice(["{}1+{}2", "({}1-{}3)*2", "{}9/4+{}1", "-{}1+{}1", "1+{}1*{}1/8"]).format(*(rng.choice("ABCDEFGHIJKLMNOPQR") for _ in "ab"))
        rows.append(cells)
    chain = {"A": "1", **{chr(66 + i): f"={chr(65 + i)}1+1" for i in range(12)}}
    rows += [chain, {"A": "=B1", "B": "=A1+1", "C": "=B1*2", "D": "=D1"}, {"A": "=1/0", "B": "=A1+2", "C": "=SUM(A1)"}, {}]
    got = layout.sheet_values(rows)
    for cells, found in zip(rows, got):
        want = {k: by_recursion(f, cells) for k, f in cells.items() if f.startswith("=")}
        assert found.keys() == want.keys()
        for k, v in want.items():
            assert found[k][0] == v or math.isclose(found[k][0], v, rel_tol=1e-9), (cells, k)
    status = lambda i: {k: s for k, (_, s) in got[i].items()}
    assert [status(120)[c] for c in "BJK"] == ["ok", "ok", "deep"]
    assert status(121) == dict.fromkeys("ABCD", "cycle") and status(122) == {"A": "error", "B": "ok", "C": "error"} and got[122]["B"][0] == 2.0
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(999, None)], "i int, cells map<string,string>")
    same = {r.i: {k: (v.value, v.status) for k, v in r.f.items()} for r in df.select("i", layout.formulas(F.col("cells")).alias("f")).collect()}
    assert same == {**dict(enumerate(got)), 999: {}}


def test_import(spark):
    rows = spark.createDataFrame([("LAM011", "Glulam beam", "wood", "Acme", "Canada", "69.96", "11.249", "m3", "406.13", "0.1", "1", "0.5", "0.9", "2026", "ISO 1; ISO 2", "FALSE"), ("", *[""] * 15)], ", ".join(f"c{i} string" for i in range(16)))
    at = dict(zip("id name category manufacturer country stated divisor unit density thickness bio carbon retention expiry standards hidden".split(), "ABCDEFGHIJKLMNOP"))
    rec = importing.material_record(rows, at, [("glulam", "06")], spark.createDataFrame([("canada", ["CAN"])], "country string, codes array<string>"))
    r = rec.collect()
    assert len(r) == 1 and r[0].id == "lam011" and r[0].carbon.common_value == 6.22 and r[0].carbon.conversion_factor == 0.088897 and r[0].carbon.biogenic.kg_carbon == 20.31
    assert r[0].manufacturer.countries == ["CAN"] and r[0].epd.expiry_date == "2026-12-31" and r[0].epd.standards == ["ISO 1", "ISO 2"] and r[0].classification.group_prefix == "06"
    e = importing.index_entries(rec, True).first()
    assert e.gwp == 6.22 and e.functional_unit == "m3" and json.loads(rec.select(F.to_json("status").alias("j")).first().j) == {"visibility": "listed"}
    assert importing.column_number("AA") == 26 and math.isclose(r[0].physical.density_lb_ft3, 406.13 * 0.06243)
