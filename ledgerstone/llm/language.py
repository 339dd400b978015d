"""Operator 5: language by Bayesian fusion of four kinds of evidence.

posterior(l) ~ p(text | l) * p(declared | l) * p(suffix | l) * p(l | host)

* text: letter trigrams, with counts per language from a bounded sample of rows (SAMPLE rows with a declared language, taken in
  the order of a hash of their id; documented parameter), and of the first RARE rows of each declared language in that order, so
  that every declared language with text is in the model, however rare. The likelihood is tempered, since neighbouring trigrams depend on
  each other, and one more class, "und", stands for text of no known language. The whole text is read, once.
* declared: the language that markup or metadata states, without its region, three-letter codes as two-letter ones where
  there is one. It is right with the probability TRUST.
* suffix: the address suffix (top-level domain); where it names a known language, it is right with the probability SUFFIX_TRUST.
* host: priors smoothed down a hierarchy: all rows -> suffix -> host. Each level's counts, made by a grouped aggregation of the
  text evidence over all rows, are mixed with STRENGTH rows of its parent's prior.

A document is rejected when "und" wins or no language reaches LEAST. Texts without letters rest on the other evidence. Null
texts count as empty, null hosts as one host, an unknown or null declaration says nothing. Repeated rows give repeated rows.
Any number of languages may be declared. The model holds counts that aren't zero, by bucket; priors are rows with the language as
a key; evidence is fused and normalised for a batch at once, in time linear in languages. Host counts are aggregated before they are
shuffled; the priors are joined by broadcast only if they hold at most BROADCAST_NUMBERS numbers (counted first), else by a merge join
in which each host's rows are dealt over SALTS keys. Columns named language, confidence and rejected are replaced by identify.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stage, ragged_index, table, trim

SAMPLE, RARE, BUCKETS = 4000, 200, 1 << 16
TRUST, SUFFIX_TRUST, STRENGTH, LEAST = 0.97, 0.8, 20.0, 0.5
#: A text counts as this many independent trigrams at most.
EVIDENCE = 60.0
BROADCAST_NUMBERS, SALTS = 500_000, 64
#: Shares of a host below this count as none. Numbers of hosts that a task adds up before it sends them.
LEAST_SHARE, HELD = 1e-9, 2_000_000
UNKNOWN = "und"
_SPACE = re.compile(r"[\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """Hashed letter trigrams of the whole text, words padded with blanks."""
    a = np.frombuffer((" " + _SPACE.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    h = (a[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (a[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (a[2:] * np.uint64(0x165667B19E3779F9))
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


class TextModel:
    """Log likelihoods of trigrams by language, and "und", in which all buckets are alike. Counts are kept by bucket, and only those that aren't zero."""

    def __init__(self, languages: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        """lang, bucket and n are the counts, one entry for each language and bucket that has any."""
        self.languages = [*languages, UNKNOWN]
        total = np.bincount(lang, weights=n, minlength=len(languages)) + 0.05 * BUCKETS
        order = np.lexsort((lang, bucket))
        self.lang, self.more = lang[order].astype(np.int32), np.log((n[order] + 0.05) / 0.05)
        self.starts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        self.base = np.r_[np.log(0.05 / total), -np.log(BUCKETS)]  # of a trigram that a language doesn't have

    def score(self, text: str) -> np.ndarray:
        """Log likelihoods, the best at 0."""
        t = trigrams(text)
        if not len(t):
            return np.zeros(len(self.languages))
        bucket, n = np.unique(t, return_counts=True)
        total = self.base * len(t)
        for a in range(0, len(bucket), 4096):  # a bucket has an entry for each language at most
            start, stop = self.starts[bucket[a : a + 4096]], self.starts[bucket[a : a + 4096] + 1]
            at = ragged_index(start, stop - start)
            total += np.bincount(self.lang[at], weights=self.more[at] * np.repeat(n[a : a + 4096], stop - start), minlength=len(total))
        total *= min(1.0, EVIDENCE / len(t))
        return total - total.max()


def train(rows: DataFrame, sample: int = SAMPLE) -> TextModel:
    """A model from at most `sample` rows (id, text, declared) and RARE more of each language; trigrams are counted by Spark's tasks and added up by language."""
    known = rows.filter(F.col("declared").isNotNull() & F.col("text").isNotNull())
    chosen = known.select("id").orderBy(F.xxhash64("id"), "id").limit(sample)
    nth = F.row_number().over(W.partitionBy("declared").orderBy(F.xxhash64("id"), "id"))
    rare = known.select("id", "declared").withColumn("nth", nth).filter(F.col("nth") <= RARE).select("id")
    chosen = chosen.union(rare).distinct()
    # one row of each id, so that ids that repeat leave the sample bounded
    first = F.min_by(F.struct("text", "declared"), F.xxhash64("text", "declared")).alias("x")
    few = known.join(F.broadcast(chosen), "id", "left_semi").groupBy("id").agg(first).select("id", "x.*")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got.setdefault(lang, np.zeros(BUCKETS, np.int64))
                got[lang] += np.bincount(trigrams(t), minlength=BUCKETS)
        for lang, c in got.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])

    counts = few.select("text", "declared").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c"))  # at most BUCKETS numbers for each language of the sample
    got = packed.select("lang", F.transform("c", lambda x: x["bucket"]).alias("bucket"), F.transform("c", lambda x: x["n"]).alias("n")).orderBy("lang").toArrow()
    names, sizes = got.column(0).to_pylist(), np.array([len(x) for x in got.column(1)], np.int64)
    whole = lambda c: np.concatenate([x.values.to_numpy() for x in got.column(c)]) if names else np.zeros(0, np.int64)
    return TextModel(names, np.repeat(np.arange(len(names)), sizes), whole(1).astype(np.int64), whole(2).astype(np.float64))


def softmax(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def declared_evidence(named: list, languages: list[str], trust: float) -> np.ndarray:
    """Log likelihoods of declarations, a row for each; one that names no known language says nothing."""
    n = max(len(languages) - 1, 1)
    place = {x: k for k, x in enumerate(languages[:-1])}
    out = np.zeros((len(named), len(languages)))
    at = [(i, place[x]) for i, x in enumerate(named) if x in place]
    if at:
        rows, columns = np.array(at).T
        out[rows] = np.log((1 - trust) / n)
        out[rows, columns] = np.log(trust)
        out[rows, -1] = np.log(1 / (n + 1))
    return out


def evidence(text: Column, declared: Column, suffix: Column, model: TextModel) -> Column:
    """Log likelihoods of text, declaration and suffix together, one for each language and "und"."""

    @F.pandas_udf("array<double>")
    def seen(texts: pd.Series, said: pd.Series, ends: pd.Series) -> pd.Series:
        trim()
        ll = np.array([model.score(t) for t in texts]).reshape(len(texts), len(model.languages))
        return pd.Series(list(ll + declared_evidence(said.tolist(), model.languages, TRUST) + declared_evidence(ends.tolist(), model.languages, SUFFIX_TRUST)), dtype=object)

    return seen(F.coalesce(text, F.lit("")), declared, suffix)


@dataclass
class Priors:
    """Counts by language number, smoothed from all rows over the suffix to the host: hosts (host, suffix, n, of, s), with of and s the
    languages that have any rows; suffixes alike; the whole table's shares on the driver, one for each language."""

    hosts: DataFrame
    suffixes: DataFrame
    root: np.ndarray

    @staticmethod
    def mixed(n: np.ndarray, of: list, s: list, parent: np.ndarray) -> np.ndarray:
        """Priors of rows with n counts, by languages of with counts s, from their parents'."""
        out = STRENGTH * parent
        size = np.fromiter((0 if x is None else len(x) for x in of), np.int64, len(of))
        if size.any():
            rows = np.repeat(np.arange(len(of)), size)
            out[rows, np.concatenate([x for x in of if x is not None and len(x)])] += np.concatenate([x for x in s if x is not None and len(x)])
        return out / (n + STRENGTH)[:, None]


def host_priors(scored: DataFrame, languages: int, stage: Stage) -> Priors:
    """Priors from rows (host, suffix, seen). Tasks add up the rows' shares by host, for languages that have any (LEAST_SHARE or more), and
    languages are keys of rows from there on: their number adds rows, not columns."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out():
            sums, n = np.array([x[0] for x in held.values()]), [x[1] for x in held.values()]
            row, lang = np.nonzero(sums >= LEAST_SHARE)
            keys = list(held)
            # the rows' number goes with language -1
            at, lang_, s = [*row.tolist(), *range(len(keys))], np.r_[lang, np.full(len(keys), -1)], np.r_[sums[row, lang], n]
            return pa.RecordBatch.from_arrays([pa.array([keys[i][k] for i in at], pa.string()) for k in (0, 1)] + [pa.array(lang_, pa.int32()), pa.array(s, pa.float64())], ["host", "suffix", "lang", "s"])

        for batch in batches:
            trim()
            p = softmax(np.array(batch.column(2).to_pylist(), np.float64).reshape(batch.num_rows, languages))
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                mine = held.setdefault(key, [np.zeros(languages), 0])
                mine[0] += p[i]
                mine[1] += 1
            if len(held) * languages > HELD:
                yield out()
                held = {}
        if held:
            yield out()

    each = scored.select("host", "suffix", "seen").mapInArrow(add, "host string, suffix string, lang int, s double")
    rows = stage.write(each.groupBy("host", "suffix", "lang").agg(F.sum("s").alias("s")))
    by_suffix = stage.write(rows.groupBy("suffix", "lang").agg(F.sum("s").alias("s")))
    whole = {r["lang"]: r["s"] for r in by_suffix.groupBy("lang").agg(F.sum("s").alias("s")).collect()}  # a row for each language
    root = (np.array([whole.get(k, 0.0) for k in range(languages)]) + 1) / (whole.get(-1, 0.0) + languages)

    def packed(df: DataFrame, *by: str) -> DataFrame:
        any_ = F.col("lang") >= 0
        pairs = F.collect_list(F.when(any_, F.struct("lang", "s")))
        out = df.groupBy(*by).agg(F.sum(F.when(~any_, F.col("s"))).alias("n"), pairs.alias("c"))
        return stage.write(out.select(*by, "n", F.transform("c", lambda x: x["lang"]).alias("of"), F.transform("c", lambda x: x["s"]).alias("s")))

    return Priors(packed(rows, "host", "suffix"), packed(by_suffix, "suffix"), root)


def fused(joined: DataFrame, row: str, languages: list[str], root: np.ndarray) -> DataFrame:
    """(row, language, confidence) of rows with seen and the counts of their host (n, of, s) and suffix (up_n, up_of, up_s)."""

    @F.pandas_udf("language string, confidence double")
    def best(seen: pd.Series, n: pd.Series, of: pd.Series, s: pd.Series, up_n: pd.Series, up_of: pd.Series, up_s: pd.Series) -> pd.DataFrame:
        trim()
        parent = np.repeat(root[None], len(seen), 0)
        up = Priors.mixed(up_n.fillna(0).to_numpy(np.float64), up_of.tolist(), up_s.tolist(), parent)
        prior = Priors.mixed(n.fillna(0).to_numpy(np.float64), of.tolist(), s.tolist(), up)
        post = softmax(np.array(seen.tolist(), np.float64).reshape(len(seen), len(languages)) + np.log(prior))
        at = post.argmax(1)
        return pd.DataFrame({"language": [languages[k] for k in at.tolist()], "confidence": post[np.arange(len(at)), at]})

    return joined.select(row, best("seen", "n", "of", "s", "up_n", "up_of", "up_s").alias("b")).select(row, "b.language", "b.confidence")


#: Languages by their three-letter codes.
_THREE_LETTERS = {
    "afr": "af", "alb": "sq", "sqi": "sq", "ara": "ar", "arm": "hy", "hye": "hy", "baq": "eu", "eus": "eu", "bel": "be", "ben": "bn", "bos": "bs", "bul": "bg",
    "cat": "ca", "chi": "zh", "zho": "zh", "hrv": "hr", "cze": "cs", "ces": "cs", "dan": "da", "dut": "nl", "nld": "nl", "eng": "en", "est": "et", "fin": "fi",
    "fre": "fr", "fra": "fr", "glg": "gl", "geo": "ka", "kat": "ka", "ger": "de", "deu": "de", "gre": "el", "ell": "el", "heb": "he", "hin": "hi", "hun": "hu",
    "ice": "is", "isl": "is", "ind": "id", "gle": "ga", "ita": "it", "jpn": "ja", "kor": "ko", "lat": "la", "lav": "lv", "lit": "lt", "mac": "mk", "mkd": "mk",
    "may": "ms", "msa": "ms", "nor": "no", "nob": "nb", "nno": "nn", "per": "fa", "fas": "fa", "pol": "pl", "por": "pt", "rum": "ro", "ron": "ro", "rus": "ru",
    "srp": "sr", "slo": "sk", "slk": "sk", "slv": "sl", "spa": "es", "swa": "sw", "swe": "sv", "tam": "ta", "tha": "th", "tur": "tr", "ukr": "uk", "urd": "ur",
    "vie": "vi", "wel": "cy", "cym": "cy",
}


def language_code(declared: Column) -> Column:
    """The language subtag of a tag such as en-GB or deu_AT, in two letters where it has such a code; null for anything else."""
    code = F.regexp_extract(F.lower(F.trim(declared.cast("string"))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    two = F.create_map(*(F.lit(x) for pair in _THREE_LETTERS.items() for x in pair))
    return F.nullif(F.coalesce(two[code], code), F.lit(""))


def identify(df: DataFrame, text: str = "text", declared: str | None = None, host: str | None = None, suffix: str | None = None, key: str = "doc_id", sample: int = SAMPLE, keep: list[str] | None = None, model: TextModel | None = None) -> DataFrame:
    """df, or its columns `keep`, with language, confidence and rejected. declared, host and suffix name columns of evidence; without
    one it says nothing. A model may be given, else it is trained on df."""
    columns = [c for c in (keep or df.columns) if c not in ("language", "confidence", "rejected")]
    found = _judged(df, F.struct(*columns) if columns else F.struct(F.lit(0)), text, declared, host, suffix, key, sample, model)
    return found.select(*(F.col("row")[c].alias(c) for c in columns), "language", "confidence", "rejected")


def known_language(df: DataFrame, text: str = "text", declared: str | None = None, host: str | None = None, suffix: Column | None = None, key: str = "doc_id") -> DataFrame:
    """The rows of df that aren't rejected, with all their columns as they are."""
    found = _judged(df, F.struct("*"), text, declared, host, suffix, key, SAMPLE, None)
    return found.filter(~F.col("rejected")).select("row.*")


def _judged(df: DataFrame, row: Column, text: str, declared: str | None, host: str | None, suffix: str | Column | None, key: str, sample: int, model: TextModel | None) -> DataFrame:
    """(row, language, confidence, rejected). Texts are scored once: their scores are stored beside the rows."""
    spark = df.sparkSession
    none = F.lit(None).cast("string")
    col = lambda c: F.lower(F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))) if c is not None else none
    says = language_code(F.col(declared)) if declared else none
    model = model or train(df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), says.alias("declared")), sample)
    languages = model.languages
    stage = Stage(spark, "language")
    tagged = df.select(row.alias("row"), F.col(text).alias("text"), says.alias("declared"), F.coalesce(col(host), F.lit("")).alias("host"), F.coalesce(col(suffix), F.lit("")).alias("suffix"))
    scored = stage.write(tagged.withColumn("seen", evidence(F.col("text"), F.col("declared"), F.col("suffix"), model)).drop("text", "declared"))
    priors = host_priors(scored, len(languages), stage)
    up = priors.suffixes.select("suffix", F.col("n").alias("up_n"), F.col("of").alias("up_of"), F.col("s").alias("up_s"))
    size = priors.hosts.agg(F.sum(1 + F.size("of")).alias("n")).first()["n"] or 0  # suffixes have no more
    if size <= BROADCAST_NUMBERS:
        joined = scored.join(F.broadcast(priors.hosts), ["host", "suffix"], "left").join(F.broadcast(up), "suffix", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = scored.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        joined = salted.join(priors.hosts.withColumn("salt", salts).hint("merge"), ["host", "suffix", "salt"], "left").join(up.withColumn("salt", salts).hint("merge"), ["suffix", "salt"], "left")
    found = fused(joined, "row", languages, priors.root)
    return found.withColumn("rejected", (F.col("language") == UNKNOWN) | (F.col("confidence") < LEAST))


def host_suffix(host: Column) -> Column:
    """The address suffix of a host or address, or null where it has none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(host.cast("string"))), r"^(?:[a-z]+://)?[^/:?#]*\.([a-z]{2,})(?:[/:?#].*)?$", 1), F.lit(""))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages with declared (the html element's lang), host and suffix (of the address)."""
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://([^/:?#]+)", 1)
    return pages.withColumn("declared", language_code(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3}(?:-[a-z0-9-]+)?)", 1))).withColumn("host", host).withColumn("suffix", F.regexp_extract(host, r"\.([a-z]+)$", 1))


def op5_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = identify(docs.withColumn("suffix", host_suffix(F.col("source"))), declared="lang", host="source", suffix="suffix", keep=["doc_id"])
    return found.select("doc_id", "language", F.round("confidence", 6).alias("confidence"), "rejected")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on pages: declared in the markup, host and suffix from the address, text without tags, scripts and styles."""
    pages = page_evidence(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*+>", " ")
    found = identify(pages.withColumn("text", plain), declared="declared", host="host", suffix="suffix", key="page_id", keep=["page_id", "url"])
    return found.select("page_id", "url", "language", F.round("confidence", 6).alias("confidence"), "rejected")
