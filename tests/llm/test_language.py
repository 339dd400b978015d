import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerstone.llm import language

EN = "the old bridge over the river was closed for the winter and they had to wait with the others "
SV = "det var en gång en liten flicka som bodde i skogen och hon tyckte om att läsa böcker varje kväll "


def test_a_rare_language_is_known(spark):
    rows = [(i, EN * 20, "en", "a") for i in range(900)] + [(1000 + i, SV, "sv", "b") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = language.identify(df, declared="lang", host="source")
    got = {r.doc_id: (r.language, r.rejected) for r in out.select("doc_id", "language", "rejected").filter("doc_id > 898").collect()}
    assert got == {899: ("en", False), **{1000 + i: ("sv", False) for i in range(3)}}


def test_suffix_comes_from_the_host(spark, tmp_path):
    hosts = [("x.example.de",), ("https://x.de/a?b=c.fr",), (" X.DE ",), ("src1",), ("10.0.0.1",), (None,)]
    assert [r[0] for r in spark.createDataFrame(hosts, "h string").select(language.host_suffix(F.col("h"))).collect()] == ["de", "de", "de", None, None, None]
    rows = [(i, EN if i % 2 else SV, "en" if i % 2 else "sv", "plain") for i in range(40)] + [(100, "", None, "one.sv"), (101, "", None, "two.en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.language for r in language.op5_language_fusion(spark, str(tmp_path)).filter("doc_id >= 100").collect()}
    assert got == {100: "sv", 101: "en"}


def test_language_codes(spark):
    tags = [("en-GB", "en"), (" DEU ", "de"), ("fil", "fil"), ("haw_US", "haw"), ("zh-Hans-CN", "zh"), ("english", None), ("", None), (None, None), ("e", None)]
    df = spark.createDataFrame(tags, "tag string, want string")
    assert all(r.got == r.want for r in df.select("want", language.language_code(F.col("tag")).alias("got")).collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_accuracy_by_evidence(spark):
    """Rows outside the training sample, with each kind of evidence alone and all together."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").dropDuplicates(["text"])
    held = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    sample = docs.join(held.select("doc_id"), "doc_id", "left_anti")
    model = language.train(sample.select(F.col("doc_id").cast("string").alias("id"), "text", language.language_code(F.col("lang")).alias("declared")), 300)
    noisy = held.withColumn("empty", F.lit("")).withColumn("declared", F.when(F.col("doc_id") % 10 == 1, "de").otherwise(F.col("lang"))).withColumn("suffix", F.when(F.col("doc_id") % 5 == 1, "fr").otherwise(F.col("lang")))
    noisy = noisy.withColumn("host", F.concat("lang", (F.col("doc_id") % 3).cast("string"))).cache()

    def accuracy(**evidence):
        got = language.identify(noisy, model=model, **evidence)
        return got.select(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]

    text, all_ = accuracy(), accuracy(declared="declared", suffix="suffix", host="host")
    declared, suffix = accuracy(text="empty", declared="declared"), accuracy(text="empty", suffix="suffix")
    print(f"held out: text {text:.3f}, declaration {declared:.3f}, suffix {suffix:.3f}, all {all_:.3f}")
    assert text > 0.97 and all_ > 0.97 and declared > 0.85 and suffix > 0.7


def test_pages_by_markup_suffix_and_host(spark, tmp_path):
    rows = [(i, f"https://a{i % 3}.example.{'sv' if i % 2 else 'com'}/x", f"<html lang='{'sv-SE' if i % 2 else 'en'}'><script>var x = 1;</script><p>{SV if i % 2 else EN}</p>") for i in range(40)] + [(100, "https://z.example.sv", "<html></html>"), (101, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.language for r in language.page_languages(spark, str(tmp_path)).collect()}
    assert len(got) == 42 and got[1] == "sv" and got[2] == "en" and got[100] == "sv"


def test_sparse_scores_equal_dense_ones():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 4, (5, language.BUCKETS)) * (rng.random((5, language.BUCKETS)) < 0.1)
    lang, bucket = np.nonzero(counts)
    model = language.TextModel(list("abcde"), lang, bucket, counts[lang, bucket].astype(float))
    smooth = counts + 0.05
    dense = np.log(np.r_[smooth / smooth.sum(1, keepdims=True), np.full((1, language.BUCKETS), 1 / language.BUCKETS)])
    for text in (EN, SV * 30, "a", ""):
        t = language.trigrams(text)
        want = dense[:, t].sum(1) * min(1.0, language.EVIDENCE / max(len(t), 1))
        assert np.allclose(model.score(text), want - want.max())


def test_a_thousand_codes_of_noise(spark):
    """Wrong codes on texts of two languages: the rows of the two are still told apart, in time that follows the codes."""
    code = lambda i: "q" + chr(97 + i // 26 % 26) + chr(97 + i % 26) if i < 676 else "x" + chr(97 + i // 26 % 26) + chr(97 + i % 26)
    rows = [(i, EN if i % 2 else SV, "en" if i % 2 else "sv", f"h{i % 7}") for i in range(1500)] + [(5000 + i, EN if i % 2 else SV, code(i % 1000), f"h{i % 7}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    start = time.time()
    out = language.identify(df, declared="lang", host="source").select("doc_id", "language", "lang").collect()
    assert time.time() - start < 240 and len(out) == 3000
    assert all(r.language == r.lang for r in out if r.doc_id < 1500)


def test_names_that_clash_are_replaced(spark):
    df = spark.createDataFrame([(1, EN, "en", "q", 1, 2, 3)], "doc_id long, text string, lang string, language string, seen int, n int, of int")
    r = language.identify(df, declared="lang").collect()[0]
    assert r.asDict().keys() == {"doc_id", "text", "lang", "seen", "n", "of", "language", "confidence", "rejected"} and r.language == "en" and (r.seen, r.n) == (1, 2)
