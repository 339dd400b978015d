"""Operator 10: toxicity as graded severity by cumulative-link ordinal regression.

Grades: 0 not toxic, 1 toxic, 2 toxic with at least HEAVY uses of toxic terms. P(grade > k) = sigmoid(w.x - c[k]) with one
weight vector for both ordered thresholds; the result is the expected severity, from 0 to 2.

Features are the logarithms of how often a term comes in PER words of a text, so that a long text isn't toxic by its length and a short one
counts as much; terms are words and word beginnings of PREFIXES letters. Terms are chosen, and the
model fitted, on a bounded sample of labelled rows: at most SAMPLE labels, taken in the order of a hash of their id, with their
whole texts (documented parameter). Equal texts count once there, and an id that repeats gives one of its texts. Scoring reads the whole text of every document. A null text counts as empty; null or repeated ids keep their rows.
Without usable labels (none, or of one class only) the severity is 0 and nothing is toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, table, trim

SAMPLE, TERMS, LEAST_TEXTS, HEAVY, PREFIXES, PER = 6000, 512, 8, 3, (3, 4, 5, 6), 1000
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    terms: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray
    threshold: float

    def severity(self, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Expected severity for rows of term counts and the texts' numbers of words."""
        z = rates(counts, words) @ self.weights
        return (1 / (1 + np.exp(np.clip(self.cuts[None, :] - z[:, None], -500, 500)))).sum(1)


def rates(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.log1p(counts * (PER / np.maximum(words, 1))[:, None])


def features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def term_counts(text: str) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall(text.lower())).items():
        for f in features(w):
            out[f] += n
    return out


def fit_cumulative_link(x: np.ndarray, grade: np.ndarray, l2: float = 0.3, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts that maximise the penalised likelihood, by Adam on full batches; the gaps between cuts are exponentials, so their order holds."""
    n, d = x.shape
    k = int(grade.max())
    share = np.array([np.clip((grade > j).mean(), 1e-4, 1 - 1e-4) for j in range(k)])
    c = np.log((1 - share) / share)
    p = np.r_[np.zeros(d), c[0], np.log(np.maximum(np.diff(c), 1e-2))]
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -500, 500)))
    rows = np.arange(n)
    for t in range(1, steps + 1):
        cuts = p[d] + np.r_[0, np.cumsum(np.exp(p[d + 1 :]))]
        z = x @ p[:d]
        above = np.c_[np.ones(n), sig(z[:, None] - cuts), np.zeros(n)]
        slope = above * (1 - above)
        prob = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-9)
        lo, hi = slope[rows, grade] / prob, slope[rows, grade + 1] / prob
        gz = hi - lo  # of the negative log likelihood
        gc = np.array([(lo[grade == j + 1]).sum() - (hi[grade == j]).sum() for j in range(k)])
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.r_[(x.T @ gz) + l2 * p[:d], tail[0], tail[1:] * np.exp(p[d + 1 :])] / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:d], p[d] + np.r_[0, np.cumsum(np.exp(p[d + 1 :]))]


NOTHING = Model({}, np.zeros(0), np.array([500.0, 500.0]), np.inf)


def fit(terms: dict[str, int], strong: np.ndarray, counts: np.ndarray, words: np.ndarray, y: np.ndarray) -> Model:
    """A model of labelled term counts in texts of so many words; strong marks the terms whose use makes a grade."""
    grade = y * (1 + (counts[:, strong].sum(1) >= HEAVY))
    if len(np.unique(grade)) < 2:
        return NOTHING
    weights, cuts = fit_cumulative_link(rates(counts, words), grade.astype(int))
    model = Model(terms, weights, cuts, np.inf)
    s = model.severity(counts, words)
    edges = np.unique(s)
    if len(edges) > 1:  # the cut between two severities that tells the labels apart best
        between = (edges[1:] + edges[:-1]) / 2
        place = np.searchsorted(edges, s)
        hits, misses = (np.bincount(place[y == t], minlength=len(edges)) for t in (1, 0))
        gain = np.cumsum(hits[::-1])[::-1][1:] / max(int(y.sum()), 1) - np.cumsum(misses[::-1])[::-1][1:] / max(int((1 - y).sum()), 1)
        model.threshold = float(between[int(np.argmax(gain))])
    return model


def train(labels: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model on at most `sample` labelled documents. Spark's tasks count terms and their texts; the driver gets the chosen terms
    (at most TERMS) and their counts in the sample."""
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # one text of each id, so that ids that repeat leave the sample bounded
    first = F.min_by("text", F.xxhash64("text")).alias("text")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(first).join(F.broadcast(chosen), "doc_id")
    once = rows.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trim()
            texts = batch.column(0).to_pylist()
            counted = [term_counts(t) for t in texts]
            words = pa.array([len(_WORD.findall(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([list(c) for c in counted], pa.list_(pa.string())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32())), words, batch.column(1)], ["terms", "n", "words", "toxic"])

    held = Stage(docs.sparkSession, "toxic").write(once.mapInArrow(bags, "terms array<string>, n array<int>, words long, toxic int"))
    total = held.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos")).first()
    n, pos = total["n"], total["pos"] or 0
    if not 0 < pos < n:
        return NOTHING
    x = F.log1p(F.col("t.n") * PER / F.greatest(F.col("words"), F.lit(1)))
    each = held.select(F.explode(F.arrays_zip("terms", "n")).alias("t"), "toxic", "words").select(F.col("t.terms").alias("term"), "toxic", x.alias("x"))
    sums = {"df": F.count(F.lit(1)), "hits": F.sum("toxic"), "s": F.sum("x"), "ss": F.sum(F.col("x") * F.col("x")), "sp": F.sum(F.col("x") * F.col("toxic"))}
    seen = each.groupBy("term").agg(*(c.alias(k) for k, c in sums.items())).filter(F.col("df") >= LEAST_TEXTS)
    # how far the mean rate of toxic texts lies above that of others, in standard errors (all texts' variance)
    variance = F.greatest(F.col("ss") / n - F.pow(F.col("s") / n, 2), F.lit(1e-9))
    z = (F.col("sp") / pos - (F.col("s") - F.col("sp")) / (n - pos)) / F.sqrt(variance * (1 / pos + 1 / (n - pos)))
    best = seen.withColumn("z", z).filter("z > 5").orderBy(F.desc("z"), "term").limit(TERMS).collect()
    if not best:
        return NOTHING
    terms = {r["term"]: i for i, r in enumerate(best)}
    few = F.transform(F.arrays_zip("terms", "n"), lambda x: F.when(x["terms"].isin(list(terms)), x))
    got = held.select("toxic", "words", F.filter(few, lambda x: x.isNotNull()).alias("bag")).collect()
    counts = np.zeros((len(got), len(terms)))
    for i, r in enumerate(got):
        for t, k in r["bag"]:
            counts[i, terms[t]] = k
    return fit(terms, np.array([r["hits"] > 0.7 * r["df"] for r in best]), counts, np.array([r["words"] for r in got]), np.array([r["toxic"] for r in got]))


def severity_column(text: Column, model: Model) -> Column:
    """The expected severity of a string column; a null text counts as empty."""
    terms = model.terms

    @F.pandas_udf("double")
    def severity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        neutral: set[str] = set()  # words without a term, so far
        for s in batches:
            trim()
            rows, cols, n = [], [], []
            size = np.zeros(len(s), np.int64)
            for i, t in enumerate(s.tolist()):
                words = Counter(_WORD.findall(t.lower()))
                size[i] = words.total()
                bag: Counter = Counter()
                for w in words.keys() - neutral:
                    mine = [terms[f] for f in features(w) if f in terms]
                    if mine:
                        for c in mine:
                            bag[c] += words[w]
                    elif len(w) <= 64:
                        neutral.add(w)
                if len(neutral) > 500_000:
                    neutral.clear()
                rows += [i] * len(bag)
                cols += bag.keys()
                n += bag.values()
            counts = np.zeros((len(s), len(terms)))
            counts[rows, cols] = n
            yield pd.Series(model.severity(counts, size))

    return severity(F.coalesce(text, F.lit("")))


def with_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with severity (0 to 2) and toxic."""
    model = train(labels, docs, sample)
    return docs.withColumn("severity", severity_column(F.col("text"), model)).withColumn("toxic", F.col("severity") > F.lit(model.threshold))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns as they are."""
    model = train(labels, docs, sample)
    return docs.filter(severity_column(F.col("text"), model) <= F.lit(model.threshold))


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", F.round("severity", 6).alias("severity"), "toxic")
