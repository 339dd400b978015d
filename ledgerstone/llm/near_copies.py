"""Near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

1. Texts with equal sets become one node. A task makes each node's minhashes over its distinct shingles (words compared as in simhash) and
   folds them into BANDS keys of ROWS minhashes each. Nodes that share a key are candidates. A pair at 0.8 shares none
   with the probability (1 - 0.8 ** ROWS) ** BANDS = 0.00007, and less above.
2. Candidates are confirmed on their full sets as in minhash_join: rounds in which the nodes of a key meet one leader, then what
   is still in different components in blocks that merge the postings of differences. Sets travel once to each leader and once to each block;
   frequent keys and leaders are dealt over tasks. No group is capped, and no pairs of a group are put out.
3. Fingerprints within the radius of simhash are linked as well. Components grow by smallest labels.

A null text counts as empty. Columns of any name are kept as they are. Texts of fewer than five words have one shingle, the whole text: they are near copies of equal texts only, or by their fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash_join, simhash
from .common import Stage, trim

WORDS, PERCENT, BANDS, ROWS = 5, 80, 24, 5
_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_FOLD = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def band_keys(h: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 4096):
        low = np.minimum(low, (h[a : a + 4096, None] * _MULTIPLY + _ADD).min(0))
    return _mix((_mix(low).reshape(BANDS, ROWS) * _FOLD).sum(1, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(key, copy, node, n, fp, sig) of a table (key, copy, text): the number of its set, its size, fingerprint and band keys. Sets too small to be like another one have no keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trim()
            node, n, fp, sig = [], [], [], []
            for t in batch.column(2):
                text = t.as_py()
                h = minhash_join.shingle_set(text, WORDS)
                node.append(minhash_join.set_number(h))
                n.append(len(h))
                fp.append(simhash.fingerprint(text))
                sig.append(band_keys(h) if (100 - PERCENT) * len(h) >= PERCENT else np.zeros(0, np.int64))
            arrays = [pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sig, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["key", "copy", "node", "n", "fp", "sig"])

    return docs.select("key", "copy", "text").mapInArrow(work, "key long, copy long, node long, n long, fp long, sig array<long>")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, one of each component: that with the smallest key. A null key counts as a large number made from its text."""
    stage = Stage(docs.sparkSession, "copies")
    words = F.coalesce(F.col(text), F.lit(""))
    number = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1) - F.pmod(F.xxhash64(text), F.lit(1 << 40)))
    mine = docs.select(F.struct("*").alias("row"), number.alias("key"), F.xxhash64(words).alias("copy"), words.alias("text"))
    rows = stage.write(sketches(mine))
    nodes = stage.write(rows.groupBy("node").agg(F.min(F.struct("key", "copy")).alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    # fingerprints within the radius, as links of the smallest node of each
    prints = rows.select("fp", "node").distinct()
    by_fp = stage.write(prints.groupBy("fp").agg(F.min("node").alias("one")))
    near = simhash.link_fingerprints(by_fp.select("fp"), stage)
    ends = near.join(by_fp, "fp").select("to", F.col("one").alias("a")).join(by_fp.select(F.col("fp").alias("to"), F.col("one").alias("b")), "to").select(F.col("a").alias("fp"), F.col("b").alias("to"))
    same = prints.join(by_fp, "fp").filter("node <> one").select(F.col("node").alias("fp"), F.col("one").alias("to"))
    links = stage.write(ends.union(same))

    lists = minhash_join.shared_lists(nodes.select("node", "n", F.explode(F.array_distinct("sig")).alias("key")), stage)
    wanted = stage.write(nodes.join(lists.select("node").distinct(), "node", "left_semi").select("node", F.col("low.key").alias("key"), "sig"))
    sets = minhash_join.full_sets(mine, wanted.select("key", "node"), stage, WORDS)
    roots = minhash_join.links_of(lists, wanted, sets, stage, PERCENT, 1, links)

    whole = nodes.select("node", "low").join(roots.withColumnRenamed("fp", "node"), "node", "left")
    kept = stage.write(whole.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("low").alias("k")).select("k.key", "k.copy"))
    held = mine.select("row", "key", "copy").join(kept.hint("merge"), ["key", "copy"], "left_semi")
    return held.dropDuplicates(["key", "copy"]).select("row.*")
