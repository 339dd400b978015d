"""Operator 12: importance resampling toward a target distribution over hashed word n-grams.

1. Tasks cut texts into words and gather them in blocks: a block's distinct words, and for each text their numbers by position.
2. Integer dictionary: (block, number, word) rows are dealt by range of words. A task meets equal words one after the other and
   gives each distinct word an id, in order; the ids go back to their blocks, combined by block.
3. In a block, n-grams of one or two words are tuples of ids, counted once for each distinct tuple. Tuples are dealt over
   partitions by a hash of their words, packed with the block's part of the dictionary.
4. A partition merges equal tuples of all blocks, puts each distinct tuple's bytes together and hashes them once (crc32), and adds up its
   buckets' counts for the raw and the target texts. The buckets go back to the blocks.
5. Gains (one number for each bucket, BUCKETS of them on the driver) are added up for each text in its block.
6. Gumbel noise from the id makes the scores; rows are dealt by range of scores and numbered through the ranges' sizes.

A word has one row in a block and a tuple one place in a block's pack, however frequent they are, so no key gets more than there
are blocks. Blocks hold BLOCK_CHARS characters of text (or one longer text).

A null text has no words. A text without words has weight 0. Null or repeated ids keep their rows; a null id counts as the
empty string in the noise, and ranks last among equals. Rows that are equal in everything get different ranks. An empty
target counts no feature. Other columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_codec import NUMBER_BITS, _planes, _unplaned, block_words, kept_blocks, word_blocks
from .common import Stage, ragged_index, table, trim

BUCKETS, LEAST_WORDS, DRAWN_PERCENT, SEED = 10_000, 20, 25, 7
BLOCK_CHARS = 14_000_000
#: Ids of this many words are combined by block before they leave a task.
COMBINED_WORDS = 500_000
#: ASCII but digits and letters separates words; A-Z become lower case, other bytes stay.
_BYTES = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256))


def cut_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


# -- word ids ------------------------------------------------------------------------------------------------


def word_ids(blocks: DataFrame) -> DataFrame:
    """(block_id, numbers, ids): an id for each distinct word of all blocks, ids in the order of words; a row has some of a block's words."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        last, next_id, held, n_held = None, TaskContext.get().partitionId() << 40, [], 0

        def combined():
            place, ids = (np.concatenate([h[k] for h in held]) for k in range(2))
            order = np.argsort(place, kind="stable")
            place, ids = place[order], ids[order]
            block = place >> NUMBER_BITS
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            parts = [(int(block[a]), _planes(place[a:b] & ((1 << NUMBER_BITS) - 1)), _planes(ids[a:b])) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(block)])]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), *(pa.array([p[k] for p in parts], pa.binary()) for k in (1, 2))], ["block_id", "numbers", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(1).dictionary_encode()
            goes_on = coded.dictionary[0].as_py() == last  # sorted: the word of the last batch comes first
            ids = coded.indices.to_numpy().astype(np.int64) + (next_id - goes_on)
            next_id += len(coded.dictionary) - goes_on
            last = coded.dictionary[len(coded.dictionary) - 1].as_py()
            held.append((batch.column(0).to_numpy(), ids))
            n_held += len(ids)
            if n_held >= COMBINED_WORDS:
                yield combined()
                held, n_held = [], 0
                trim()
        if held:
            yield combined()

    by_word = block_words(blocks).repartitionByRange("word").sortWithinPartitions("word")
    return by_word.mapInArrow(name, "block_id long, numbers binary, ids binary")


# -- tuples --------------------------------------------------------------------------------------------------


class Tuples:
    """A block's n-grams. keys are its distinct tuples, first word * (words + 1) + second word + 1 (0: none), words numbered in their order;
    all has each n-gram's key and doc its text; part deals the keys out by their words alone."""

    def __init__(self, words: list[bytes], sizes: np.ndarray, numbers: np.ndarray, parts: int):
        from pyarrow import compute
        from xxhash import xxh64_intdigest

        order = compute.sort_indices(pa.array(words, pa.binary())).to_numpy().astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.order, self.words = order, [words[i] for i in order.tolist()]
        width = len(words) + 1
        seq, doc = place[numbers], np.repeat(np.arange(len(sizes)), sizes)
        pair = doc[1:] == doc[:-1]
        self.doc = np.r_[doc, doc[1:][pair]]
        self.all = np.r_[seq * width, seq[:-1][pair] * width + seq[1:][pair] + 1]
        ordered = np.sort(self.all)
        begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        self.keys, self.counts = ordered[begins], np.diff(np.r_[begins, len(ordered)])
        self.first, self.second = np.divmod(self.keys, width)
        h = np.zeros(width, np.uint64)
        h[1:] = np.fromiter((xxh64_intdigest(w, 12) for w in self.words), np.uint64, len(words))
        mixed = (h[self.first + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[self.second] * np.uint64(0xD6E8FEB86659FD93))
        self.part = ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(parts)).astype(np.int64)
        self.by_part = np.argsort(self.part.astype(np.uint16) if parts <= 1 << 16 else self.part, kind="stable")
        self.ends = np.r_[0, np.cumsum(np.bincount(self.part, minlength=parts))]

    def each(self, values: np.ndarray) -> np.ndarray:
        """Values of the keys, for every n-gram."""
        out = np.empty(len(self.all), values.dtype)
        out[np.argsort(self.all)] = np.repeat(values, self.counts)  # keys and counts are in this order
        return out

    @classmethod
    def of_row(cls, row, parts: int) -> Tuples:
        return cls(list(row["words"]), _unplaned(row["sizes"]), _unplaned(row["numbers"]), parts)


def pack_tuples(blocks: DataFrame, ids: DataFrame, parts: int) -> DataFrame:
    """Packs (part, block_id, ids, words, first, second, counts): a block's tuples of one part, over the part of the dictionary that they use."""

    def pack(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        trim()
        number = np.concatenate([_unplaned(x) for x in right["numbers"]]) if len(right) else np.zeros(0, np.int64)
        given = np.concatenate([_unplaned(x) for x in right["ids"]]) if len(right) else number
        named = np.full(len(number), -1)
        named[number] = given
        rows = []
        for _, row in left.iterrows():
            t = Tuples.of_row(row, parts)
            if len(t.words) != len(named) or (named < 0).any():
                raise ValueError("a block lost some of its words")
            of_word = named[t.order]
            for p in np.flatnonzero(np.diff(t.ends)).tolist():
                mine = t.by_part[t.ends[p] : t.ends[p + 1]]
                first, second = t.first[mine], t.second[mine]
                used = np.unique(np.r_[first, second[second > 0] - 1])
                a, b = np.searchsorted(used, first), np.where(second > 0, np.searchsorted(used, second - 1) + 1, 0)
                text = zstandard.ZstdCompressor(level=3).compress(b" ".join([t.words[i] for i in used.tolist()]))
                rows.append((p, int(row["block_id"]), _planes(np.diff(of_word[used], prepend=0), 3), text, _planes(np.diff(a, prepend=0), 3), _planes(b, 3), _planes(t.counts[mine], 3)))
        return pd.DataFrame(rows, columns=["part", "block_id", "ids", "words", "first", "second", "counts"])

    met = blocks.groupBy("block_id").cogroup(ids.groupBy("block_id"))
    return met.applyInPandas(pack, "part int, block_id long, ids binary, words binary, first binary, second binary, counts binary")


def hash_tuples(packs: DataFrame, parts: int, buckets: int) -> DataFrame:
    """For each pack of raw texts (block_id, part, places): its tuples' buckets, in its order. And rows without a block: a part's counts (bucket, raw, target)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held: list[dict] = []

        def out(block_id, part, places=None, counts=((), (), ())):
            arrays = [pa.array([c], pa.list_(pa.int64())) for c in counts]
            return pa.RecordBatch.from_arrays([pa.array([block_id], pa.int64()), pa.array([part], pa.int32()), pa.array([places], pa.binary()), *arrays], ["block_id", "part", "places", "bucket", "raw", "target"])

        def solve():
            trim()
            ids = [np.cumsum(_unplaned(p["ids"])) for p in held]
            known, at = np.unique(np.concatenate(ids), return_index=True)
            words: list[bytes] = []  # of known, each from the first pack that has it
            lo = 0
            order = np.argsort(at)
            sorted_at, in_order = at[order], []
            for p, i in zip(held, ids):
                mine = sorted_at[np.searchsorted(sorted_at, lo) : np.searchsorted(sorted_at, lo + len(i))] - lo
                if len(mine):
                    text = zstandard.ZstdDecompressor().decompress(p["words"]).split(b" ")
                    in_order += [text[j] for j in mine.tolist()]
                lo += len(i)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            words = [in_order[j] for j in place.tolist()]
            keys, counts, width = [], [], len(known) + 1
            for p, i in zip(held, ids):
                local = np.r_[-1, np.searchsorted(known, i)]
                keys.append(local[np.cumsum(_unplaned(p["first"])) + 1] * width + local[_unplaned(p["second"])] + 1)
                counts.append(_unplaned(p["counts"]))
            distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
            first, second = np.divmod(distinct, width)
            crc = zlib.crc32
            bucket = np.fromiter((crc(words[a] + b" " + words[b - 1] if b else words[a]) % buckets for a, b in zip(first.tolist(), second.tolist())), np.int64, len(distinct))
            sums = np.zeros((2, buckets), np.int64)
            at = 0
            for p, n in zip(held, counts):
                mine = bucket[of[at : at + len(n)]]
                at += len(n)
                np.add.at(sums[int(p["block_id"] < 0)], mine, n)
                if p["block_id"] >= 0:
                    yield out(p["block_id"], p["part"], _planes(mine, 3))
            seen = np.flatnonzero(sums.any(0))
            yield out(None, held[0]["part"], None, (seen, sums[0][seen], sums[1][seen]))

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield from solve()
                    held = []
                held.append(row)
        if held:
            yield from solve()

    dealt = packs.repartitionById(parts, "part").sortWithinPartitions("part", "block_id")
    return dealt.mapInArrow(merge, "block_id long, part int, places binary, bucket array<long>, raw array<long>, target array<long>")


def bucket_gains(counts: DataFrame, parts: int, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of target to raw) for each bucket, from rows (part, bucket, raw, target) of arrays, one for each part.

    About sqrt(parts) tasks add up as many rows each before buckets become rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            at = batch.column(0).flatten().to_numpy()
            for k in (0, 1):
                np.add.at(sums[k], at, batch.column(1 + k).flatten().to_numpy())
        seen = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, sums[0][seen], sums[1][seen])], ["bucket", "raw", "target"])

    groups = math.isqrt(parts) + 1
    added = counts.repartitionById(groups, F.col("part") % groups).select("bucket", "raw", "target").mapInArrow(add, "bucket long, raw long, target long")
    both = np.zeros((2, buckets), np.int64)
    for r in added.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # at most a row for each bucket
        both[:, r["bucket"]] = r["raw"], r["target"]
    (s, t), (total_s, total_t) = both.tolist(), both.sum(1).tolist()
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (total_s + buckets) / ((float(a) + 1) * (total_t + buckets)))) for a, b in zip(s, t)], np.int64)


def text_weights(blocks: DataFrame, places: DataFrame, gains: np.ndarray, parts: int) -> DataFrame:
    """(doc_id, n_features, weight) of all texts of blocks; weight is the mean gain, rounded down."""

    def weigh(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        trim()
        frames = []
        for _, row in left.iterrows():
            t = Tuples.of_row(row, parts)
            bucket = np.full(len(t.keys), -1)
            for p, x in zip(right["part"].tolist(), right["places"]):
                bucket[t.by_part[t.ends[p] : t.ends[p + 1]]] = _unplaned(x)
            if (bucket < 0).any():
                raise ValueError("a block lost some of its tuples")
            docs = np.frombuffer(row["doc_ids"], "<i8")
            n = np.bincount(t.doc, minlength=len(docs))
            total = np.zeros(len(docs), np.int64)
            np.add.at(total, t.doc, t.each(gains[bucket]))
            ids = pd.array([d if k else None for d, k in zip(docs.tolist(), row["known"])], "Int64")
            frames.append(pd.DataFrame({"doc_id": ids, "n_features": n, "weight": total // np.maximum(n, 1)}))
        return pd.concat(frames) if frames else pd.DataFrame({"doc_id": pd.array([], "Int64"), "n_features": np.zeros(0, np.int64), "weight": np.zeros(0, np.int64)})

    return blocks.groupBy("block_id").cogroup(places.groupBy("block_id")).applyInPandas(weigh, "doc_id long, n_features long, weight long")


def feature_weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_features, weight) of docs (doc_id, text): how much likelier their words and word pairs are under the texts of target (text)."""
    spark = docs.sparkSession
    stage = Stage(spark, "importance")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    raw = word_blocks(docs.select("doc_id", "text"), lambda: cut_words, block_chars, "binary")
    aim = word_blocks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), lambda: cut_words, block_chars, "binary")
    blocks = kept_blocks(raw.union(aim.withColumn("block_id", -1 - F.col("block_id"))), stage)
    held = blocks.select("block_id", "doc_ids", "known", "sizes", "numbers", "words")
    packs = pack_tuples(held, word_ids(blocks), parts)
    hashed = stage.write(hash_tuples(packs, parts, buckets))
    gains = bucket_gains(hashed.filter("block_id IS NULL").select("part", "bucket", "raw", "target"), parts, buckets)
    return stage.write(text_weights(held.filter("block_id >= 0"), hashed.filter("block_id IS NOT NULL").select("block_id", "part", "places"), gains, parts))


# -- drawing -------------------------------------------------------------------------------------------------


def drawn(weighted: DataFrame, least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, n_features, weight) with score, and rank for the drawn ones: the highest scores of texts with enough words, without replacement."""
    stage = Stage(weighted.sparkSession, "drawn")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighted.withColumn("score", F.col("weight") + noise).withColumn("fits", F.col("n_features") >= 2 * least_words - 1)  # n words have 2n - 1 features
    order = [F.desc("fits"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    local = stage.write(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = local.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fits").cast("long")).alias("fit"))  # a row for each partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("fit").over(W.partitionBy()).alias("all_fit"))
    number = F.col("before") + F.col("at") + 1
    # those that fit come first, and fewer are drawn than fit
    rank = F.when(number <= F.floor(F.col("all_fit") * percent / 100), number)
    return local.join(F.broadcast(before), "part").select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return drawn(feature_weights(docs, table(spark, sf_dir, "benchmark").select("text")))


ORACLE_SQL = {
    "op12_importance": """
WITH crc_table AS (
  SELECT list(list_reduce(list_concat([CAST(i AS UINTEGER)], list_transform(range(8), lambda b: CAST(b AS UINTEGER))),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UINTEGER)) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) t(i)),
texts AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
w AS (SELECT side, doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
f AS MATERIALIZED (SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w),
g AS MATERIALIZED (SELECT side, r, g, count(*) AS n FROM f GROUP BY ALL),
d AS MATERIALIZED (SELECT DISTINCT g FROM g),
hashed AS MATERIALIZED (
  SELECT g, xor(list_reduce(list_concat([CAST(4294967295 AS UINTEGER)], list_transform(range(1, 1 + octet_length(encode(g))), lambda i: CAST(('0x' || hex(encode(g))[2 * i - 1 : 2 * i]) AS UINTEGER))),
    lambda c, x: xor(c >> 8, crc[1 + xor(c & 255, x)])), CAST(4294967295 AS UINTEGER)) % 10000 AS bucket FROM d, crc_table),
b AS (SELECT g.side, h.bucket, g.r, g.n FROM g JOIN hashed h ON g.g = h.g),
c AS (SELECT k AS bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM range(10000) x(k) LEFT JOIN b ON b.bucket = k GROUP BY k),
gain AS (SELECT bucket, floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS gain FROM c),
per AS (SELECT r, sum(n) AS n, sum(n * gain) AS total FROM b JOIN gain ON b.bucket = gain.bucket WHERE side = 0 GROUP BY r),
scored AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight, len(w) >= 20 AS fits,
    CAST(coalesce(floor(total / n), 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || left(sha256('7:' || doc_id), 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN per ON w.r = per.r WHERE side = 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY fits DESC, score DESC, doc_id) AS rn, sum(CAST(fits AS INT)) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN rn <= 25 * fit // 100 THEN rn END AS rank FROM numbered""",
}
