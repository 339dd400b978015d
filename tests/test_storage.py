import os

from pyspark.sql import functions as F

from ledgerstone.operators import storage


def test_folders_can_be_released(spark):
    df = storage.kept(spark.range(5))
    where = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    path = storage.text_file(spark.range(3).select(F.col("id").cast("string")), "csv").removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(where) and os.path.isdir(path)
    storage.release(spark)
    assert not os.path.isdir(where) and not os.path.isdir(path)
    assert storage.kept(spark.range(2)).count() == 2


def test_a_table_is_stored_once(spark, tmp_path):
    spark.range(40).select("id", (F.col("id") % 4).alias("g")).write.parquet(str(tmp_path / "t"))
    read = lambda: spark.read.parquet(str(tmp_path / "t"))
    a, b = storage.stored_by(read(), "g"), storage.stored_by(read(), "g")
    assert sorted(a.inputFiles()) == sorted(b.inputFiles()) and b.filter("g = 3").count() == 10
    assert len(a.filter("g = 3").select("id").collect()) == 10
    assert storage.stored_by(read().filter("id > 20"), "g").count() == 19 and a.count() == 40
    storage.release(spark)
    assert storage.stored_by(read(), "g").count() == 40
