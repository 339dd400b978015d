"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None
#: Folders of stages, for release().
_BASES: list[str] = []
#: Rows and bytes of an Arrow batch: batches of whole texts are held on both sides of the pipe.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_ROWS and BATCH_BYTES, unless the user has set bounds."""
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the system: idle workers stay alive for a while."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerstone-"))
    return sc.getCheckpointDir().rstrip("/")


class Stage:
    """Tables written in the shared folder to cut lineage: a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _BASES.append(self.base)

    def write(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        schema = df.schema
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df._stage_path)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes all stage folders of this process. Results that still read them can't be used after this."""
    while _BASES:
        _delete(spark, _BASES.pop())


#: A key with more rows is dealt over several tasks.
HOT = 10_000


def join_dealt(rows: DataFrame, other: DataFrame, key: str, stage: Stage, counts: DataFrame, total: int, most: int, how: str = "inner") -> DataFrame:
    """rows joined with other, which has few rows for a key. counts (key, n) says how often rows name a key, `most` how often they can; a key with more than
    HOT, and more than one in 50,000 of total, is dealt over parts, so that at most 50,000 keys are broadcast (100,000 where counts are up to twice the truth). The part depends on the row alone, so a task that runs again deals its rows as before."""
    hot = max(HOT, total // 50_000)
    if most <= hot:
        return rows.join(other, key, how)
    hubs = stage.write(counts.filter(F.col("n") > hot).select(key, F.ceil(F.col("n") / hot).cast("int").alias("parts")))
    if hubs.isEmpty():
        return rows.join(other, key, how)
    dealt = rows.join(F.broadcast(hubs), key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    copies = other.join(F.broadcast(hubs), key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, [key, "part"], how).drop("part")


def in_chunks(texts: list, max_chars: int = 1_000_000):
    """Slices of a list of strings that hold about max_chars; one long text makes a slice of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > max_chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat positions of the ranges [start, start + length), one after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - first, lengths)
