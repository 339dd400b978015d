import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerstone.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
def test_frequent_keys_are_dealt(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT", 10)
    rows = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(600)] + [(None, -1)], "k long, v long").repartition(5)
    other = spark.createDataFrame([(7, "a"), (7, "b"), (3, "c"), (9, "d"), (None, "e")], "k long, x string")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = common.join_dealt(rows, other, "k", common.Stage(spark, "test"), counts, 600, 600, how)
    want = rows.join(other, "k", how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stages_can_be_released(spark):
    stage = common.Stage(spark, "test")
    df = stage.write(spark.range(10))
    assert df.count() == 10
    local = df._stage_path.removeprefix("file:")
    assert os.path.isdir(local)
    common.release(spark)
    assert not os.path.isdir(local)
    assert common.Stage(spark, "test").write(spark.range(3)).count() == 3


def test_no_local_folder_on_a_cluster():
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(far)
