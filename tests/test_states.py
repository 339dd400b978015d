"""Streams with state: the same end as one fold over all events, whatever the order and the batches; expiry; the queue's merge."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerstone.streaming import jobs, states

START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def stores(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    states.use_state_store(spark)
    yield
    spark.conf.set(key, was)


def streamed(spark, tmp_path, make, batches, schema):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        file = folder / f"{i:03d}.json"
        file.write_text("\n".join(map(json.dumps, rows)))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # a batch for each file, in this order
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    out = []
    query = make(source).writeStream.foreachBatch(lambda df, n: out.extend((n, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return out


def at(seconds):
    return (START + datetime.timedelta(seconds=seconds)).isoformat() + "Z"


def test_sticky_fields(spark, tmp_path, stores):
    rng = random.Random(1)
    events = [{"field_id": f"f{rng.randrange(6)}", "value": str(rng.randrange(5)), "state": rng.choice(["derived", "imported", "derived", "user-modified"]), "source": rng.choice(["plan", None]), "seq": i, "ts": at(i)} for i in range(40)]
    late = events[:]
    rng.shuffle(late)
    got = streamed(spark, tmp_path, lambda s: states.sticky_fields(s, 10_000), [late[:15], late[15:30], late[30:]], "field_id string, value string, state string, source string, seq long, ts timestamp")
    last = {}
    for _, field, value, state, source, expired in got:
        last[field] = (value, state, source, expired)
    want = {}
    for f in {e["field_id"] for e in events}:
        own = [e for e in events if e["field_id"] == f]
        user = [e for e in own if e["state"] == "user-modified"]
        other = [e for e in own if e["state"] != "user-modified"]
        e = (user or other)[-1]
        source = other[-1]["source"] if other and not (user and user[-1]["seq"] > other[-1]["seq"]) else None
        want[f] = (e["value"], e["state"], source, False)
    assert last == want


def test_scales_and_expiry(spark, tmp_path, stores):
    event = lambda page, state, seq, t: {"page": page, "state": state, "seq": seq, "ts": at(t)}
    batches = [
        [event("a", "pending", 1, 0), event("b", "pending", 2, 1), event("c", "none", 3, 2)],
        [event("a", "verified", 5, 5), event("a", "pending", 4, 4), event("b", "none", 6, 6)],
        [event("a", "pending", 7, 8), event("c", "pending", 8, 9)],
        [event("z", "none", 9, 5000)],
        [event("z", "pending", 10, 9000)],
    ]
    got = streamed(spark, tmp_path, lambda s: states.scale_states(s, 100, "1 second"), batches, "page string, state string, seq long, ts timestamp")
    seen = [(page, state) for _, page, state, expired in got if not expired]
    assert sorted(seen) == [("a", "pending"), ("a", "verified"), ("b", "none"), ("b", "pending"), ("c", "none"), ("c", "pending"), ("z", "none"), ("z", "pending")]
    gone = {(page, state) for _, page, state, expired in got if expired}
    assert {("a", "verified"), ("b", "none"), ("c", "pending")} <= gone


def test_queue_rewrites_touched_buckets_only(spark, tmp_path):
    folder = str(tmp_path / "queue")
    rng, want = random.Random(2), {}
    put = lambda rows, version: jobs.merge_into(spark.createDataFrame(rows, jobs.DRAFTS), folder, "source_file", "seq", version, F.col("kind").isin("discard", "commit"))
    held = lambda: {r.source_file: (r.kind, r.payload) for r in jobs.queue_table(spark, folder, jobs.DRAFTS).collect()}
    assert held() == {}
    for version in range(4):
        rows = [(f"s{rng.randrange(300)}", rng.choice(["draft", "capture", "discard", "commit"]), f"p{version}.{i}", version * 1000 + i) for i in range(200 if version == 0 else 3)]
        put(rows, version)
        if version == 2:
            put(rows, version)  # a batch that runs again
        for s, kind, payload, _ in rows:
            want.pop(s, None)
            if kind in ("draft", "capture"):
                want[s] = (kind, payload)
        assert held() == want
    written = [p for p in (tmp_path / "queue/data/v3").iterdir() if p.name.startswith("bucket=")]
    assert len(written) <= 3 and len(list((tmp_path / "queue/manifest").iterdir())) == 2
