import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerstone.llm.common import Stage
from ledgerstone.llm import language, toxicity

EN = "the river and the stone were under that old bridge when winter came with its silver cloud"
DE = "der fluss und der stein lagen unter jener alten brücke als der winter mit seiner wolke kam"
FR = "la rivière et la pierre étaient sous ce vieux pont quand vint cet hiver avec son nuage gris"


def corpus(n=90):
    rng = np.random.default_rng(8)
    out = []
    for i in range(n):
        lang, base = (("en", EN), ("de", DE), ("fr", FR))[i % 3]
        out.append((i, " ".join(rng.permutation(base.split())), lang, f"host{i % 3}.{lang}", lang))
    return out


SCHEMA = "doc_id long, text string, lang string, host string, tld string"


def test_evidence_is_fused(spark):
    rows = corpus() + [
        (900, " ".join(DE.split()[::-1]), "en", "host1.de", "de"),  # declared wrongly
        (901, "", "fr", None, None),
        (902, None, None, "host0.en", "en"),
        (903, "漢字 かな 交じり 文 です " * 20, None, "other", None),
        (None, EN, None, None, None),
        (5, rows5 := " ".join(FR.split()), "fr", "host2.fr", "fr"),
        (5, rows5, "fr", "host2.fr", "fr"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(1)).withColumn("language", F.lit("?"))
    got = language.identify(df, declared="lang", host="host", suffix="tld").collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {*df.columns, "confidence", "rejected"}
    by = {r.doc_id: r for r in got}
    assert all(by[i].language == lang and not by[i].rejected for i, _, lang, *_ in corpus() if i != 5)
    assert by[900].language == "de" and by[901].language == "fr" and by[902].language == "en" and by[None].language == "en"
    assert by[903].rejected and by[903].language == "und"
    assert language.identify(df.limit(0), declared="lang", host="host").collect() == []


def test_priors_are_smoothed_down_the_hierarchy(spark):
    seen = spark.createDataFrame([("a", "x", [0.0, -50.0])] * 200 + [("b", "x", [-50.0, 0.0])] + [("c", "y", [-50.0, 0.0])] * 100, "host string, suffix string, seen array<double>")
    priors = language.host_priors(seen, 2, Stage(spark, "test"))
    up = {r.suffix: language.Priors.mixed(np.array([r.n]), [r["of"]], [r.s], priors.root[None])[0] for r in priors.suffixes.collect()}
    p = {r.host: language.Priors.mixed(np.array([r.n]), [r["of"]], [r.s], up[r.suffix][None])[0] for r in priors.hosts.collect()}
    root = np.array([201, 102]) / 303
    x = (np.array([200, 1]) + 20 * root) / 221
    assert np.allclose(p["a"], (np.array([200, 0]) + 20 * x) / 220) and np.allclose(p["b"], (np.array([0, 1]) + 20 * x) / 21)
    assert p["a"][0] > p["b"][0] > p["c"][0]


def test_many_hosts_take_the_salted_join(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), SCHEMA)
    a = {r.doc_id: (r.language, round(r.confidence, 9)) for r in language.identify(df, declared="lang", host="host").collect()}
    monkeypatch.setattr(language, "BROADCAST_NUMBERS", 1)
    assert {r.doc_id: (r.language, round(r.confidence, 9)) for r in language.identify(df, declared="lang", host="host").collect()} == a


def test_page_evidence(spark):
    df = spark.createDataFrame([("https://a.b.de/x", '<html class=x lang="de-AT">'), (None, None)], "url string, html string")
    r = language.page_evidence(df).collect()
    assert (r[0].declared, r[0].host, r[0].suffix) == ("de", "a.b.de", "de") and r[1].declared is None


def labelled(n=400):
    rng = np.random.default_rng(9)
    words = EN.split()
    docs, labels = [], []
    for i in range(n):
        k = int(rng.integers(0, 6)) if i % 3 == 0 else 0
        t = list(rng.choice(words, 30)) + [str(rng.choice(["vile", "gremlin", "zotstuff", "zotling"])) for _ in range(k)]
        rng.shuffle(t)
        docs.append((i, " ".join(t)))
        labels.append((i, 1, int(k > 0)))
    return docs, labels


def test_held_out_accuracy_and_order_of_grades(spark):
    docs, labels = labelled()
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels[:250] + [(None, 1, 1), (999, None, 1)], "doc_id long, quality int, toxic int")
    d = d.union(spark.createDataFrame([(None, None), (5000, ""), (5001, "a zotnew word"), (5001, "a zotnew word")], d.schema)).withColumn("toxic", F.lit("x"))
    got = toxicity.with_toxicity(d, lab).collect()
    assert len(got) == len(docs) + 4
    by = {r.doc_id: r for r in got}
    truth = {i: t for i, _, t in labels}
    held = range(250, 400)
    assert np.mean([by[i].toxic == bool(truth[i]) for i in held]) > 0.97
    assert not by[None].toxic and not by[5000].toxic and by[5001].severity > 3 * by[5000].severity  # a new word with a known beginning
    uses = {i: sum(w in ("vile", "gremlin") or w.startswith("zot") for w in t.split()) for i, t in docs}
    means = [np.mean([by[i].severity for i in held if lo <= uses[i] <= hi]) for lo, hi in ((0, 0), (1, 2), (3, 9))]
    assert means[0] < means[1] < means[2] <= 2
    nothing = toxicity.with_toxicity(d, lab.filter("toxic = 0")).agg(F.max("severity").alias("s"), F.bool_or("toxic").alias("t")).first()
    assert not nothing.t and nothing.s < 1e-9
    assert toxicity.with_toxicity(d.limit(0), lab).collect() == []


def test_fit_follows_the_likelihood():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 3))
    z = x @ [1.5, -1.0, 0.0]
    grade = (rng.logistic(size=4000) + z > 0.5).astype(int) + 0
    u = rng.uniform(size=4000)
    up = 1 / (1 + np.exp(-(z[:, None] - np.array([0.5, 2.0]))))
    grade = (u[:, None] < up).sum(1)
    w, cuts = toxicity.fit_cumulative_link(x, grade, l2=0.01, steps=800)
    assert np.allclose(w, [1.5, -1.0, 0.0], atol=0.15) and np.allclose(cuts, [0.5, 2.0], atol=0.15)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_held_out_labels(spark):
    """Labelled documents outside the sample, whose texts aren't in it either."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(1500)
    model = toxicity.train(sample, docs, 1500)
    known = docs.join(sample, "doc_id", "left_semi").select("text")
    held = docs.join(labels.join(sample.select("doc_id"), "doc_id", "left_anti"), "doc_id").join(known, "text", "left_anti")
    got = held.select("toxic", (toxicity.severity_column(F.col("text"), model) > model.threshold).alias("said")).groupBy("toxic").agg(F.avg(F.col("said").cast("int")).alias("share"), F.count(F.lit(1)).alias("n")).collect()
    share = {r.toxic: r.share for r in got}
    print({r.toxic: (r.n, r.share) for r in got})
    assert share[0] < 0.01 and share[1] > 0.95


def test_repeated_ids_leave_the_sample_bounded(spark):
    rows = [(i % 7, f"word {i} {'vile' if i % 7 < 3 else 'kind'}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(7)] * 3, "doc_id long, toxic int")
    assert toxicity.with_toxicity(docs, labels).count() == 700
    assert language.identify(docs.withColumn("lang", F.lit("en")), declared="lang").count() == 700
