"""Plans and steps that must hold on tables much larger than these: what is sent where, and what a task holds."""

import re

from pyspark.sql import functions as F

from ledgerstone.operators import aggregates as A
from ledgerstone.operators import detection as X
from ledgerstone.operators import joins as J
from ledgerstone.operators import layout, schemas
from ledgerstone.operators import sheets as H


def test_tables_with_small_files_are_not_broadcast(spark, tmp_path):
    """Sizes guessed from files say that the whole table fits a broadcast; the driver then had to hold it."""
    spark.range(2000).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    page, row = F.floor(F.col("k") / 10).alias("page"), (F.col("k") % 10).cast("double") * 600
    found = t.select(page, F.col("k").alias("c_id"), F.lit("t").alias("text"), F.lit(5.0).alias("metres"), F.lit(0.0).alias("cx"), row.alias("cy"))
    segs = t.select(page, F.col("k").alias("s_id"), F.lit(0.0).alias("x1"), row.alias("y1"), F.lit(283.0).alias("x2"), row.alias("y2"), F.lit(283.46).alias("length"))
    dims = H.dimensions(found, segs, t.select(page).distinct().withColumn("ratio", F.lit(50.0)))
    boxes = t.select(page, F.col("k").alias("box_id"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(9.0).alias("x2"), F.lit(9.0).alias("y2"), F.lit(81.0).alias("area"), F.col("k").alias("seq"))
    held = J.smallest_container(t.select(page, F.col("k").alias("p_id"), F.lit(3.0).alias("x"), F.lit(3.0).alias("y")), boxes, F.lit(True), "p_id", scope=["page"])
    rooms = H.room_schedule(t.select(page, F.lit("Room").alias("str"), F.lit(0.0).alias("x"), F.col("k").cast("double").alias("y"), F.lit(9.0).alias("width"))).drop("area")
    for df in (dims, X.calibration_readings(dims, segs), held, rooms):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert set(re.findall(r"BroadcastHashJoin \[(\w+)#", plan)) <= {"page" if df is rooms else "__part"}  # one row, or a scan's row for each partition
    assert dims.filter("s_id = c_id").count() == 2000


def test_best_pairs_are_kept_by_hash(spark):
    """A task holds one pair a callout: no sort of all pairs. Equal scores go to the smaller s_id, negative ones too."""
    c = spark.createDataFrame([(1, 0.0, 0.0, 100.0), (2, 0.0, 900.0, 100.0)], "c_id int, cx double, cy double, want double")
    ids = [2**62, 7, -(2**62), 9]
    s = spark.createDataFrame([(i, 0.0, 5.0, 100.0, 5.0, 100.0) for i in ids] + [(-(2**63), 0.0, 6.0, 100.0, 6.0, 100.0)], "s_id long, x1 double, y1 double, x2 double, y2 double, length double")
    got = J.best_score_match(c, s)
    assert [(r.c_id, r.s_id, round(r.score, 6)) for r in got.collect()] == [(1, -(2**62), 0.996)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Window" not in plan


def test_pages_are_streams(spark):
    """No call for each page, and a page may lie in many record batches."""
    ops = spark.range(300).select((F.col("id") % 2).alias("page"), F.col("id").alias("seq"), F.when(F.col("id") < 2, "move").otherwise("line").alias("op"), F.array(F.col("id"), F.lit(1)).alias("args"))
    cells = spark.range(300).select(F.lit(7).alias("page"), F.col("id").cast("string").alias("str"), (F.col("id") % 3 * 50.0).alias("x"), F.floor(F.col("id") / 3).cast("double").alias("y"), F.lit(5.0).alias("width"))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        drawn = layout.drawn_segments(ops)
        plan = drawn._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan
        got = sorted((r.page, r.seg, r.x1, r.x2) for r in drawn.collect())
        assert got == [(p, k, p + 2.0 * k, p + 2.0 * k + 2) for p in (0, 1) for k in range(149)]
        assert [(r.page, r.row_no, r.cell_no, r.text) for r in layout.table_cells(cells, tolerance=0.5).orderBy("row_no", "cell_no").collect()] == [(7, k // 3 + 1, k % 3, str(k)) for k in range(300)]
        last = layout.tolerant_pick(spark.range(50).select(F.lit("a").alias("page"), "id", F.when(F.col("id") % 2 == 1, F.col("id") * 1.0).alias("v")), "page", [("v", True, 0.0)], "id")
        assert [tuple(r) for r in last.collect()] == [("a", 0)]  # nothing beats a row without a value
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_shared_parts_are_worked_out_once(spark):
    """A title's words are looked for once, and a document's fields are taken out once."""
    plan = lambda c: spark.range(1).select(F.col("id").cast("string").alias("t")).select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(H.title_phrase(F.col("t"))).count("regexp_extract_all(") == 1
    deep = {"type": "object", "properties": {"n": {"type": "number", "maximum": 3}}, "required": ["n"]}
    for _ in range(3):
        deep = {"type": "object", "properties": {"a": deep}, "required": ["a"]}
    assert len(plan(schemas.schema_errors(schemas.parsed(F.col("t")), deep))) < 40_000
    df = spark.createDataFrame([('{"a": {"a": {"a": {"n": 4}}}}',), ('{"a": {"a": {}}}',), ('{"a": 1}',), ("{",)], "t string")
    got = [[tuple(e) for e in r.e] for r in df.select(schemas.schema_errors(schemas.parsed(F.col("t")), deep).alias("e")).collect()]
    assert got == [[("$.a.a.a.n", "maximum", "3")], [("$.a.a", "required", "a")], [("$.a", "type", '"object"')], [("$", "json", "a document")]]


def test_amounts_add_up_exactly(spark):
    """Doubles added one by one leave the second place after some million rows, and in another order leave it otherwise."""
    df = spark.range(0, 2_000_000, 1, 4).select(F.when(F.col("id") % 2 == 0, 140_000.1).otherwise(140_000.12).alias("v"))
    assert df.agg(A.exact_sum(F.col("v")).alias("s")).first().s == 280_000_220_000.0
    odd = spark.createDataFrame([(1, 1.5), (1, None), (2, float("inf")), (2, 1.0), (3, 1e-9), (3, 1.0), (4, None)], "k int, v double")
    assert {r.k: r.s for r in odd.groupBy("k").agg(A.exact_sum(F.col("v")).alias("s")).collect()} == {1: 1.5, 2: float("inf"), 3: 1 + 1e-9, 4: None}
