"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def field_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of field events (field_id, value, state, seq, ts) from JSON files."""
    return spark.readStream.schema("field_id string, value string, state string, seq long, ts timestamp").json(folder)


def changed_fields(events: DataFrame) -> DataFrame:
    """Events that change their field's value or state; a repeat is dropped, within a batch and across batches."""

    def keep(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = tuple(state.get) if state.exists else None
        out = []
        for r in pd.concat(batches).sort_values("seq").itertuples(index=False):
            now = (r.value, r.state)
            if now != last:
                out.append((key[0], r.value, r.state, r.seq))
                last = now
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["field_id", "value", "state", "seq"])

    return events.groupBy("field_id").applyInPandasWithState(keep, "field_id string, value string, state string, seq long", "value string, state string", "append", GroupStateTimeout.NoTimeout)


def quiet_values(events: DataFrame, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """The last value of each field's run of events; a run ends when the field is quiet for the gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.session_window("ts", gap), "field_id").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


#: Parts of a queue table; a batch rewrites only those its keys fall into.
BUCKETS = 64


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return fs, names


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole versions of a queue, in order."""
    fs, names = _files(spark, f"{folder}/manifest")
    done = lambda v: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/v{v}/_SUCCESS"))
    return sorted(v for v in (int(n[1:]) for n in names) if done(v))


def _parts(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    """Which version's files hold each bucket; at most BUCKETS rows."""
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{folder}/manifest/v{version}").collect()}


def merge_into(batch: DataFrame, folder: str, key: str, order: str, version: int, gone: Column) -> None:
    """Merges a batch into the queue table in folder: each key's last row by `order` takes the place of the row before, and keys whose row is `gone` leave.

    Only the buckets of the batch's keys are read and rewritten. A manifest, written last, names the files of all buckets, so readers see whole versions, and a
    batch that runs again (the same version) writes what it wrote before. The version before is kept for readers that are still at it; older files go."""
    spark = batch.sparkSession
    columns = batch.columns
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    last = batch.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("e")).select("e.*")
    kept = [v for v in _manifests(spark, folder) if v < version]
    parts = _parts(spark, folder, kept[-1]) if kept else {}
    touched = [r["b"] for r in last.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS
    before = [f"{folder}/data/v{parts[b]}/bucket={b}" for b in touched if b in parts]
    old = spark.read.schema(batch.schema).parquet(*before) if before else spark.createDataFrame([], batch.schema)
    merged = old.join(last.select(key), key, "left_anti").select(*columns).unionByName(last.filter(~F.coalesce(gone, F.lit(False))))
    merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/data/v{version}")
    written = {int(n.split("=")[1]) for n in _files(spark, f"{folder}/data/v{version}")[1] if n.startswith("bucket=")}
    now = {b: v for b, v in parts.items() if b not in touched} | dict.fromkeys(written, version)
    spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/v{version}")
    # files that neither this version nor the one before names
    named = set(now.items()) | set(parts.items())
    fs, versions = _files(spark, f"{folder}/data")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for v in (int(n[1:]) for n in versions):
        for b in (int(n.split("=")[1]) for n in _files(spark, f"{folder}/data/v{v}")[1] if n.startswith("bucket=")):
            if (b, v) not in named:
                fs.delete(path(f"{folder}/data/v{v}/bucket={b}"), True)
    for v in kept[:-1]:
        fs.delete(path(f"{folder}/manifest/v{v}"), True)


def queue_table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest whole version of a queue table."""
    versions = _manifests(spark, folder)
    parts = _parts(spark, folder, versions[-1]) if versions else {}
    paths = [f"{folder}/data/v{v}/bucket={b}" for b, v in sorted(parts.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


DRAFTS = "source_file string, kind string, payload string, seq long"


def commit_queue(drafts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Draft events (source_file, kind, payload, seq) merged into a queue table (see queue_table): the last event of a file decides; discarded and committed files leave it."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_into(batch, folder, "source_file", "seq", batch_id, F.col("kind").isin("discard", "commit"))

    return drafts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
