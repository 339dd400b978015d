import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerstone.llm import simhash

WORDS = "river stone market window evening letter garden music winter bridge paper orange silver cloud".split()
SEED = np.random.default_rng(4)


def english():
    return " ".join(SEED.choice(WORDS, 40))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(120):
        toxic = i % 4 == 0
        t = english() + (" you vile gremlin" if toxic else "")
        rows.append((i, t, "en", f"src{i % 3}", len(t)))
        labels.append((i, 1, int(toxic)))
    same = english()
    rows += [(200 + k, same, "en", "src1", len(same)) for k in range(5)]
    rows += [(300, "write to jo@mail.example.com " + english(), "en", "src1", 9), (301, None, "en", "src2", 0), (302, "", "en", "src2", 0), (303, "漢字 かな 交じり 文 です " * 9, None, "src2", 40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages_take_effect(spark, corpus):
    d, rows = corpus
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, d).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    ids = {r[0] for r in rows}
    assert ids - kept["language"].keys() == {303}
    assert kept["language"].keys() - kept["toxicity"].keys() == {i for i in range(0, 120, 4)}
    # brute force over all pairs of what came in
    left = sorted(kept["toxicity"])
    fp = {i: simhash.fingerprint(kept["toxicity"][i] or "") for i in left}
    label = {i: i for i in left}
    for _ in range(len(left)):
        for a in left:
            for b in left:
                if bin(fp[a] ^ fp[b]).count("1") <= 2:
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[a]] == label[a] for a in left):
            break
    assert set(kept["near_duplicates"]) == {a for a in left if label[a] == a}
    assert {200} == kept["near_duplicates"].keys() & set(range(200, 205)) and 302 not in kept["near_duplicates"]
    assert kept["pii"].keys() == kept["near_duplicates"].keys()
    assert kept["pii"][300].startswith("write to [EMAIL] ") and not any(re.search("@", t or "") for t in kept["pii"].values())


def test_stages_leave_columns_of_the_same_name_alone(spark, corpus):
    d, rows = corpus
    names = ["language", "confidence", "rejected", "severity", "toxic", "row", "key", "node", "fp", "n", "bands", "root", "label", "declared", "host", "suffix", "ll", "seen", "post", "prior", "n_tokens"]
    plain = spark.read.parquet(f"{d}/documents.parquet")
    docs = plain.select("*", *(F.concat(F.lit(x), F.col("doc_id").cast("string")).alias(x) for x in names))
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs, plain = step(spark, docs, d).cache(), step(spark, plain, d).cache()
        assert docs.columns == [*plain.columns, *names], name
        assert all(r[x] == f"{x}{r.doc_id}" for r in docs.collect() for x in names), name
        assert {(r.doc_id, r.text) for r in docs.collect()} == {(r.doc_id, r.text) for r in plain.collect()}, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == corpus_pipeline.STAGES[-1][1](spark, plain, d).count()


def test_stages_with_nulls_repeats_and_empty_tables(spark, corpus):
    d, rows = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = spark.createDataFrame([(None, rows[1][1], "en", None, None), (None, None, None, None, None), (1, rows[1][1], "en", "src1", 5), (1, "another text of that id " + rows[2][1], "en-GB", "", 5), (None, rows[1][1], "EN", "src1", None)], docs.schema)
    mixed = docs.union(odd)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, mixed.limit(0), d).collect() == [], name
        mixed = step(spark, mixed, d).cache()
        if name == "near_duplicates":
            texts = [r.text for r in mixed.collect()]
            assert len(texts) == len(set(texts)) and rows[1][1] in texts
    assert mixed.count() > 0


def test_run_packs_what_is_left(spark, corpus):
    d, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, d)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(lib.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in got} == texts.keys()
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
