"""Operator 4: SimHash fingerprints linked within a Hamming radius by BK-trees.

1. A task computes each text's fingerprint; equal fingerprints become one node with its smallest doc_id.
2. Two fingerprints that differ in at most 2 of 64 bits agree in at least 2 of 4 blocks of 16 bits. Each of the 6
   pairs of blocks gives a shard key of 32 bits; all fingerprints with one key make a shard. A crowded shard is
   divided again, by the same argument on its 32 free bits (4 blocks of 8): 48 bits are then fixed, so that no shard
   can hold more than 2**16 distinct fingerprints. Nothing is capped: every link lies inside some shard.
3. In each shard a BK-tree (children keyed by their integer Hamming distance to the parent) is built once and given
   to all of the shard's queries, which follow only edges within the radius. A task handles the trees of all its
   shards level by level in numpy arrays. The links of a shard leave it as a spanning forest.
4. Components grow by smallest labels with pointer jumping, on distinct fingerprints that have a link at all.

A null text counts as empty: it has no words and the fingerprint zero, which links like any other. Null ids keep
their rows; component_id is the smallest id that is not null. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage, join_dealt, ragged_index, table, trim

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 2
#: A shard with more fingerprints is divided once more.
CROWDED = 4096
#: Queries that search at once, which bounds a task's memory.
QUERIES = 4096


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) < words:
        h = np.array([xxh64_intdigest(joined, SEED)], np.uint64)
        return int(h[0])
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(parts) - words + 1].tolist()
    counts, n = np.zeros(64, np.int64), len(start)
    stops = end[words - 1 :].tolist()
    for a in range(0, n, 100_000):
        h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(start[a : a + 100_000], stops[a : a + 100_000])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    trim()
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprint_column(text: Column) -> Column:
    """The fingerprint's 64 bits as a long."""
    return _fingerprints(F.coalesce(text, F.lit("")))


# -- BK-trees ------------------------------------------------------------------------------------------------


def build_trees(codes: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees of all shards: the root of each code's shard, and all edges as sorted keys (parent * 65 + distance) with their children."""
    n = len(codes)
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    root = np.repeat(first, np.diff(np.r_[first, n]))
    at, todo = root.copy(), np.setdiff1d(np.arange(n), first, assume_unique=True)
    keys, children = [], []
    while len(todo):
        edge = at[todo] * 65 + np.bitwise_count(codes[todo] ^ codes[at[todo]]).astype(np.int64)
        key, lead, group = np.unique(edge, return_index=True, return_inverse=True)
        child = todo[lead]
        keys.append(key), children.append(child)
        at[todo] = child[group]
        todo = todo[at[todo] != todo]
    if not keys:
        return root, np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return root, key[order], child[order]


def search_trees(codes: np.ndarray, root: np.ndarray, key: np.ndarray, child: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) within the radius; a query follows only edges whose distance lies within the radius of its own distance to the parent."""
    q, node = queries, root[queries]
    found_q, found_n = [], []
    while len(q):
        d = np.bitwise_count(codes[q] ^ codes[node]).astype(np.int64)
        hit = (d <= radius) & (node != q)
        found_q.append(q[hit]), found_n.append(node[hit])
        lo = np.searchsorted(key, node * 65 + np.maximum(d - radius, 0), "left")
        hi = np.searchsorted(key, node * 65 + np.minimum(d + radius, 64), "right")
        n = hi - lo
        q, node = np.repeat(q, n), child[ragged_index(lo, n)]
    return np.concatenate(found_q) if found_q else q, np.concatenate(found_n) if found_n else q


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the labels of a and b, and shortens all chains."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def shard_links(codes: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, parent) of the links inside each shard; codes are sorted by shard and distinct there."""
    root, key, child = build_trees(codes, shard)
    label = np.arange(len(codes))
    for a in range(0, len(codes), QUERIES):
        _settle(label, *search_trees(codes, root, key, child, np.arange(a, min(a + QUERIES, len(codes))), radius))
    linked = np.flatnonzero(label != np.arange(len(codes)))
    return codes[linked], codes[label[linked]]


def _block_keys(code: Column, bits: list[int], width: int, tag: int) -> Column:
    """One key for each pair of blocks: the pair's number and the bits of both blocks."""
    block = lambda b: F.shiftrightunsigned(code, b).bitwiseAND((1 << width) - 1)
    return F.array(*(F.shiftleft(F.shiftleft(block(a), width).bitwiseOR(block(b)), 8).bitwiseOR(F.lit(tag + k)) for k, (a, b) in enumerate(combinations(bits, 2))))


def link_fingerprints(nodes: DataFrame, stage: Stage, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """Links (fp, to) that join all distinct fingerprints (fp) within the radius."""
    if not 0 <= radius <= 2:
        raise ValueError("two of four blocks agree for a radius of 2 at most")
    coarse = nodes.select("fp", F.explode(_block_keys(F.col("fp"), [0, 16, 32, 48], 16, 0)).alias("shard"))
    sizes = stage.write(coarse.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded))
    # a crowded shard may hold a large share of all fingerprints until it is divided
    n = nodes.count()
    marked = join_dealt(coarse, sizes.select("shard", F.lit(True).alias("dense")), "shard", stage, sizes, 6 * n, n, "left")
    pairs = list(combinations([0, 16, 32, 48], 2))

    def finer(k: int) -> Column:
        fixed = pairs[k]
        free = [b for b in (0, 8, 16, 24, 32, 40, 48, 56) if not any(f <= b < f + 16 for f in fixed)]
        return _block_keys(F.col("fp"), free, 8, 0)

    number = F.col("shard").bitwiseAND(255)
    sub = F.when(F.col("dense"), F.coalesce(*(F.when(number == k, finer(k)) for k in range(len(pairs))))).otherwise(F.array(F.lit(-1).cast("long")))
    shards = marked.select("fp", "shard", F.explode(sub).alias("sub"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(fp, key):
            a, b = shard_links(fp.view(np.uint64), key, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["fp", "to"])

        def numbered(parts):
            fp, shard, sub = (np.concatenate([p[i] for p in parts]) for i in range(3))
            key = np.cumsum(np.r_[0, (shard[1:] != shard[:-1]) | (sub[1:] != sub[:-1])]) if len(fp) else fp
            return fp, shard, sub, key

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            if sum(len(p[0]) for p in held) < 50_000:
                continue
            fp, shard, sub, key = numbered(held)
            done = int(np.searchsorted(key, key[-1]))  # the last shard may go on
            if done:
                yield solve(fp[:done], key[:done])
            held = [(fp[done:], shard[done:], sub[done:])]
        if held:
            fp, _, _, key = numbered(held)
            if len(fp):
                yield solve(fp, key)

    grouped = shards.repartition("shard", "sub").sortWithinPartitions("shard", "sub")
    return stage.write(grouped.mapInArrow(links, "fp long, to long").distinct())


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """(fp, root) of all fingerprints with a link; root is the smallest fingerprint reachable."""
    both = links.select("fp", "to").union(links.select(F.col("to").alias("fp"), F.col("fp").alias("to")))
    edges = stage.write(both.distinct())
    label = stage.write(edges.groupBy("fp").agg(F.min("to").alias("m")).select("fp", F.least("fp", "m").alias("root")))

    def step(label: DataFrame) -> DataFrame:
        """The smallest label among the neighbours, then one jump along the labels; `was` stays."""
        near = edges.join(label.select(F.col("fp").alias("to"), "root"), "to").groupBy("fp").agg(F.min("root").alias("near"))
        via = label.join(near, "fp").select("fp", F.least("root", "near").alias("via"), "was")
        jump = via.join(label.select(F.col("fp").alias("via"), F.col("root").alias("far")), "via")
        return jump.select("fp", F.least("via", "far").alias("root"), "was")

    while True:
        two = step(step(label.select("fp", "root", F.col("root").alias("was"))))  # two steps for each table that is written
        new = stage.write(two.select("fp", "root", (F.col("root") < F.col("was")).alias("moved")))
        done = new.filter("moved").isEmpty()
        stage.drop(label)
        label = new
        if done:
            return label.select("fp", "root")


def near_duplicate_components(keyed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, fp) with component_id, the smallest doc_id reachable over links of fingerprints, and the component's root fingerprint."""
    spark = keyed.sparkSession
    stage = Stage(spark, "simhash")
    rows = stage.write(keyed.select("doc_id", "fp"))
    nodes = stage.write(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    links = link_fingerprints(nodes.select("fp"), stage, radius)
    roots = components(links, stage)
    linked = roots.join(nodes, "fp").select("fp", "root", "low")
    low = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 4)
    # only fingerprints of several rows need a lookup; salting deals out the rows of a frequent one
    alone = nodes.filter("n > 1").join(roots.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("low").alias("component_id"))
    of = stage.write(linked.select("fp", "root").join(low, "root").select("fp", "root", "component_id").union(alone))
    spread = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.col("doc_id"), F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    return salted.join(spread.hint("merge"), ["fp", "salt"], "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs, one of each component: that with the smallest key. A null key counts as a large number made from its text."""
    number = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1) - F.pmod(F.xxhash64(text), F.lit(1 << 40)))
    mine = docs.select(F.struct("*").alias("row"), number.alias("key"), fingerprint_column(F.col(text)).alias("fp"))
    found = near_duplicate_components(mine.select(F.col("key").alias("doc_id"), "fp"), radius)
    first = found.filter("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("fp").alias("fp")).select(F.col("doc_id").alias("key"), "fp")
    return mine.join(first.hint("merge"), ["key", "fp"], "left_semi").dropDuplicates(["key", "fp"]).select("row.*")


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", fingerprint_column(F.col("text")).alias("fp"))
    found = near_duplicate_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
