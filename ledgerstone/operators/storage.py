"""Tables kept in the shared folder until they are released, and row numbers over a whole table."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where it names none and is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerstone-"))
    return sc.getCheckpointDir().rstrip("/")


#: Folders that this process has made, for release().
_MADE: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the shared one."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Deletes all folders that this process has made. Results that still read them can't be used after this."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written now: later steps don't compute them again."""
    path = new_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, read from a table with one folder for each value of the columns: filters on these read only their folders.

    The table is written once for the same files, plan and columns in a shared folder; later calls read what is there."""
    spark = df.sparkSession
    of = "\n".join([*sorted(df.inputFiles()), str(df.schema.simpleString()), *columns, df._jdf.queryExecution().optimizedPlan().canonicalized().toString()])
    path = f"{shared_folder(spark)}/by-{hashlib.sha256(of.encode()).hexdigest()}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        _MADE.append(path)
        df.write.mode("overwrite").partitionBy(*columns).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_file(rows: DataFrame, suffix: str = "txt") -> str:
    """The path of a folder with the rows' one string column as lines of text files."""
    path = f"{new_folder(rows.sparkSession, 'text')}.{suffix}"
    _MADE[-1] = path
    rows.write.text(path)
    return path


def numbered(df: DataFrame, *order: Column, name: str = "rn") -> DataFrame:
    """Row numbers from 1 over a total order, without one task for all rows.

    Rows are dealt by range and numbered in each range; the ranges' sizes (one number for each partition) shift them."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = kept(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = local.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("__part", before.alias("__before"))
    return local.join(F.broadcast(shift), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")
