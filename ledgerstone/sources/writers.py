"""Sinks: catalogue by group with an index, measurement report, state dumps, key-value tables, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import csv_escape
from ..operators.merging import upsert_by_key


def write_catalogue(records: DataFrame, folder: str, index: list[Column]) -> None:
    """Records as JSON by group (unresolved ones under zz), and a flat index with a hash of each record's source. Null leaves aren't written."""
    grouped = records.withColumn("group_prefix", F.coalesce(F.col("group_prefix"), F.lit("zz")))
    grouped.repartition("group_prefix", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").option("ignoreNullFields", True).partitionBy("group_prefix").json(f"{folder}/materials")
    hashed = F.sha2(F.to_json(F.struct(*(F.col(c) for c in grouped.columns))), 256).alias("sha256")
    grouped.select("id", "group_prefix", *index, hashed).write.mode("overwrite").parquet(f"{folder}/index")


def import_warnings(rows: DataFrame, country_known: Column, group: Column) -> DataFrame:
    """(id, warning) of rows with an unmapped country, no group or a blank id."""
    found = F.array(F.when(~F.coalesce(country_known, F.lit(True)), "unmapped country"), F.when(group.isNull(), "unresolved group"), F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "blank id"))
    return rows.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("warning"))


def measurement_report(walls: DataFrame, windows: DataFrame) -> DataFrame:
    """Report rows (sheet, sort_key, label, gross, net): walls with their windows indented below, windows without a wall, totals by sheet and of all.

    walls: (sheet, poly_id, label, area); windows: (sheet, poly_id, parent, label, area). Two decimals; null areas are blank and add nothing."""
    two = lambda c: F.when(c.isNotNull(), F.format_string("%.2f", c)).otherwise(F.lit(""))
    holes = windows.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("poly_id")).agg(F.sum("area").alias("holes"))
    w = walls.join(holes, "poly_id", "left").withColumn("net", F.col("area") - F.coalesce("holes", F.lit(0.0)))
    key = lambda *parts: F.concat_ws("/", *parts)
    pad = lambda c: F.lpad(c.cast("string"), 12, "0")
    detail = w.select("sheet", key(F.lit("1"), pad(F.col("poly_id"))).alias("sort_key"), "label", two(F.col("area")).alias("gross"), two(F.col("net")).alias("net"))
    inner = windows.join(walls.select(F.col("poly_id").alias("parent")), "parent", "left_semi")
    child = inner.select("sheet", key(F.lit("1"), pad(F.col("parent")), pad(F.col("poly_id"))).alias("sort_key"), F.concat(F.lit("  "), "label").alias("label"), two(F.col("area")).alias("gross"), F.lit("").alias("net"))
    orphan = windows.join(walls.select(F.col("poly_id").alias("parent")), "parent", "left_anti").select("sheet", key(F.lit("2"), pad(F.col("poly_id"))).alias("sort_key"), "label", two(F.col("area")).alias("gross"), F.lit("").alias("net"))
    sums = w.rollup("sheet").agg(F.sum(F.coalesce("area", F.lit(0.0))).alias("g"), F.sum(F.coalesce("net", F.lit(0.0))).alias("n"), F.grouping("sheet").alias("all"))
    total = sums.select(F.when(F.col("all") == 0, F.col("sheet")).alias("sheet"), F.when(F.col("all") == 1, "4").otherwise("3").alias("sort_key"), F.when(F.col("all") == 1, "TOTAL").otherwise(F.concat(F.lit("TOTAL "), "sheet")).alias("label"), two(F.col("g")).alias("gross"), two(F.col("n")).alias("net"))
    return detail.unionByName(child).unionByName(orphan).unionByName(total)


def state_dump(fields: DataFrame) -> DataFrame:
    """(field_id, line): CSV lines of a field state, cells escaped; numbers lose their thousands commas."""
    return fields.select("field_id", F.concat_ws(",", csv_escape(F.col("field_id")), csv_escape(F.coalesce("value", F.lit("")))).alias("line"))


def put(base: DataFrame, rows: DataFrame, key: str, folder: str) -> None:
    """A key-value table with rows put in; written beside the old one, since Parquet has no merge."""
    upsert_by_key(base, rows, key).write.mode("overwrite").parquet(folder)


def coverage_lines(matrix: DataFrame, group: str) -> DataFrame:
    """A coverage matrix as markdown lines (line_no, line)."""
    cells = [c for c in matrix.columns if c != group]
    head = matrix.sparkSession.createDataFrame([(0, "| " + " | ".join([group, *cells]) + " |"), (1, "|" + " --- |" * (len(cells) + 1))], "line_no int, line string")
    body = matrix.select(F.lit(2).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", group, *(F.col(c).cast("string") for c in cells)), F.lit(" |")).alias("line"))
    return head.union(body)
