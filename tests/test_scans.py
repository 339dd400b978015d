"""Scans over ranges of an order, clusters by pointers, grids of many sizes."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerstone.operators import aggregates as A
from ledgerstone.operators import joins as J
from ledgerstone.operators import layout
from ledgerstone.operators import scans as S


@pytest.fixture
def many_ranges(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def folded(values, kind, before):
    out, seen = [], []
    for v in values:
        if not before and v is not None:
            seen.append(v)
        pick = {"last": lambda: seen[-1], "first": lambda: seen[0], "sum": lambda: sum(seen), "max": lambda: max(seen), "min": lambda: min(seen)}[kind]
        out.append(pick() if seen else None)
        if before and v is not None:
            seen.append(v)
    return out


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("scopes", [1, 3, 200])
def test_folds_of_any_scope(spark, many_ranges, scopes, before):
    rng = random.Random(scopes)
    rows = [((None if rng.random() < 0.2 else rng.randrange(scopes)) if scopes > 1 else 7, i, rng.choice([None, None, rng.randrange(100)])) for i in range(400)]
    df = spark.createDataFrame(rows, "s int, i int, v int").repartition(5)
    kinds = ["last", "first", "sum", "max", "min"]
    got = S.scanned(df, ["s"], [F.desc("i")], {k: (k, F.col("v")) for k in kinds}, before).collect()
    assert len(got) == len(rows)
    by = {}
    for r in sorted(rows, key=lambda r: -r[1]):
        by.setdefault(r[0], []).append(r)
    want = {}
    for own in by.values():
        for k in kinds:
            for r, x in zip(own, folded([r[2] for r in own], k, before)):
                want.setdefault(r[1], {})[k] = x
    assert {r.i: {k: r[k] for k in kinds} for r in got} == want


def test_one_scope_lies_in_many_ranges(spark, many_ranges):
    df = spark.range(5000).select(F.lit("one").alias("s"), F.col("id"))
    got = S.scanned(df, ["s"], [F.col("id")], {"n": ("sum", F.lit(1).cast("long"))})
    assert got.filter("n <> id + 1").isEmpty()
    from ledgerstone.operators.storage import kept  # the ranges that hold its rows

    tasks = kept(got).select(F.input_file_name().alias("f")).distinct().count()
    assert tasks > 6


def test_empty(spark):
    df = spark.createDataFrame([], "s int, v int")
    assert S.scanned(df, ["s"], [F.col("v")], {"n": ("sum", F.col("v"))}).collect() == []
    assert S.anchored_starts(df, ["s"], "v", F.lit(1), [F.col("v")]).collect() == []


def anchors(items, anchored):
    """(begins) of sorted (y, within)."""
    out, at = [], None
    for y, w in items:
        new = at is None or y - at > w
        out.append(new)
        if new or not anchored:
            at = y
    return out


@pytest.mark.parametrize("anchored", [True, False])
@pytest.mark.parametrize("step", [0.1, 1.0, 0.037])
def test_starts_equal_a_fold(spark, many_ranges, anchored, step):
    """Heights on a grid that makes ties with the tolerance, of one dense scope and some small ones."""
    rng = random.Random(int(step * 1000))
    rows = [(0, rng.randrange(1500) * step, i, rng.choice([3.0, 3.0, 0.3, 4.1])) for i in range(700)]
    rows += [(s, rng.randrange(60) * step, 1000 + 10 * (s or 0) + i, 3.0) for s in (1, 2, None) for i in range(8)] + [(3, None, 5000, 1.0)]
    rows = [(s, y, i if s is not None else i + 5000, w) for s, y, i, w in rows]
    df = spark.createDataFrame(rows, "s int, y double, i int, w double").repartition(4)
    f = S.anchored_starts if anchored else S.chained_starts
    got = {r.i: (r.number, r.begins) for r in f(df, ["s"], "y", F.col("w"), [F.col("y"), F.col("i")]).collect()}
    by, want = {}, {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    for own in by.values():
        for n, (r, b) in enumerate(zip(own, anchors([(r[1], r[3]) for r in own], anchored)), 1):
            want[r[2]] = (n, b)
    assert got == want


def test_dense_clusters(spark, many_ranges):
    """One group without any gap above the tolerance."""
    df = spark.range(20_000).select(F.lit("u").alias("u"), (F.col("id") % 10_000 / 100).alias("x"))
    got = sorted((r.anchor, r.n) for r in A.cluster_means(df, "u", "x", 5.0).collect())
    want, at = [], None
    for i in range(10_000):
        x = i / 100
        if at is None or x - at > 5.0:
            at = x
            want.append([x, 0])
        want[-1][1] += 2
    assert got == [tuple(w) for w in want]


def test_rows_by_size_of_type(spark):
    items = spark.createDataFrame([("p", i, y, 0.0, f) for i, (y, f) in enumerate([(0.0, 10.0), (3.1, 10.0), (3.1, 20.0), (6.0, 20.0), (6.3, 10.0)])], "page string, item_id int, y double, x double, size double")
    rows = [r.row_no for r in layout.row_clusters(items, "page", font="size").orderBy("item_id").collect()]
    assert rows == [1, 2, 2, 2, 3]


def test_boxes_of_all_sizes(spark):
    rng = random.Random(9)
    boxes = []
    for i in range(120):
        size = 10 ** rng.uniform(0, 6)
        x, y, h = rng.uniform(-5e5, 5e5), rng.uniform(-5e5, 5e5), size * rng.choice([1, 0.01])
        boxes.append((i, rng.randrange(2), x, y, x + size, y + h, size * h, i))
    boxes.append((500, 0, 3.0, 3.0, 3.0, 3.0, 0.0, 500))
    points = [(i, rng.randrange(2), rng.uniform(-5e5, 5e5), rng.uniform(-5e5, 5e5)) for i in range(200)] + [(200 + i, b[1], b[2] + (b[4] - b[2]) / 3, b[3] + (b[5] - b[3]) / 3) for i, b in enumerate(boxes[:60])]
    p = spark.createDataFrame(points, "p_id int, page int, x double, y double")
    b = spark.createDataFrame(boxes, "box_id int, page int, x1 double, y1 double, x2 double, y2 double, area double, seq int")
    inside = (F.col("x") > F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") > F.col("y1")) & (F.col("y") < F.col("y2"))
    got = {r.p_id: r.box_id for r in J.smallest_container(p, b, inside, "p_id", scope=["page"]).collect()}
    for i, page, x, y in points:
        hits = [(k[6], k[7]) for k in boxes if k[1] == page and k[2] < x < k[4] and k[3] < y < k[5]]
        assert got[i] == (min(hits)[1] if hits else None)
    assert {r.box_id for r in J.smallest_container(p, b.limit(0), inside, "p_id", scope=["page"]).collect()} == {None}


def test_callouts_meet_near_segments_only(spark):
    """Segments of one length all over a page: as many pairs as lie near, and the best of all by brute force."""
    rng = random.Random(2)
    segments = [(i, *p, p[0] + 100.0, p[1], 100.0) for i, p in enumerate((rng.uniform(0, 50_000), rng.uniform(0, 50_000)) for _ in range(1500))]
    segments += [(3000, 0.0, 10.0, 40_000.0, 10.0, 40_000.0), (3001, 7.0, 0.0, 7.0, 20.0, 20.0), (3002, 0.0, 0.0, 90.0, 90.0, 127.0)]
    callouts = [(i, rng.uniform(0, 50_000), rng.uniform(0, 50_000), rng.choice([97.0, 104.0])) for i in range(300)] + [(900, 35_000.0, 30.0, 40_100.0), (901, 9.0, 9.0, 20.5)]
    c = spark.createDataFrame(callouts, "c_id int, cx double, cy double, want double")
    s = spark.createDataFrame(segments, "s_id int, x1 double, y1 double, x2 double, y2 double, length double")
    got = {r.c_id: r.s_id for r in J.best_score_match(c, s).collect()}
    for i, x, y, want in callouts:
        best = []
        for k, x1, y1, x2, y2, n in segments:
            d = (max(min(x1, x2) - x, 0, x - max(x1, x2)) ** 2 + max(min(y1, y2) - y, 0, y - max(y1, y2)) ** 2) ** 0.5
            e = abs(n - want) / want
            if e <= 0.08 and d <= 500 and min(abs(x1 - x2), abs(y1 - y2)) < 0.5:
                best.append((-round(0.6 * (1 - e / 0.08) + 0.4 * (1 - d / 500), 9), k))
        assert got.get(i) == (min(best)[1] if best else None)
    assert got[900] == 3000 and got[901] == 3001


def test_headers_in_one_large_scope(spark, many_ranges):
    rng = random.Random(4)
    lines = [(i, rng.choice("hrr"), rng.randrange(3)) for i in range(600)]
    rows = spark.createDataFrame([("d", i, n, i) for i, k, n in lines if k == "r"], "s string, line int, n_values int, row_id long")
    headers = spark.createDataFrame([("d", i, i, n) for i, k, n in lines if k == "h"], "s string, line int, h_id long, n_cols int")
    got = {r.row_id: r.h_id for r in J.asof_header(rows, headers, "s").collect()}
    for i, k, n in lines:
        if k == "r":
            above = [(j, m) for j, kk, m in lines[:i] if kk == "h"]
            same = [j for j, m in above if m == n]
            assert got[i] == (same[-1] if same else above[-1][0] if above else None)


