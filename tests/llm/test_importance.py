import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerstone.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:])), len(w)


def brute(docs, target, buckets=10_000):
    place = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for g, n in grams(x)[0].items():
                side[place(g)] += n
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (total_s + buckets) / ((float(s[b]) + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        bag, words = grams(x)
        n = sum(bag.values())
        weight = sum(gain[place(g)] * k for g, k in bag.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= 20))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    k = 25 * len(order) // 100
    return sorted([(*r[:4], j + 1 if j < k else None) for j, r in enumerate(order)] + [(*r[:4], None) for r in rows if not r[4]], key=str)


def run(spark, docs, target, block, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS part", "'x' AS words").repartition(parts)
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    return sorted(map(tuple, I.drawn(I.feature_weights(df, aim, block_chars=block)).collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(2)
    words = ["the", "The", "of", "x9", "Éa", "é", "naïve", "日本", "7", "a_b", "don't", *("w%d" % i for i in range(300))]
    some = lambda n: " ".join(words[min(int(x), len(words) - 1)] for x in rng.exponential(30, n))
    docs = [(int(i), some(rng.integers(0, 80))) for i in rng.permutation(200)]
    docs += [(1000 + i, docs[0][1]) for i in range(40)] + [(500, None), (501, ""), (502, "the " * 30_000), (503, "one"), (None, some(40)), (None, some(5)), (7, docs[3][1]), (7, docs[3][1])]
    return docs, [some(60) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("block", [300, 20_000_000])
def test_equals_brute_force(spark, texts, block):
    docs, target = texts
    assert run(spark, docs, target, block) == brute(docs, target)


def test_odd_tables(spark):
    assert run(spark, [], ["a b"], 1000) == []
    docs = [(1, "a b c"), (2, None)]
    assert run(spark, docs, [], 1000) == brute(docs, [])


def test_ids_follow_words(spark):
    from ledgerstone.llm.bpe_codec import _unplaned, word_blocks

    df = spark.createDataFrame([(i, f"b{i % 7} a c{i} b1") for i in range(60)], "doc_id long, text string").repartition(4)
    blocks = word_blocks(df, lambda: I.cut_words, 50, "binary").cache()
    words = {r.block_id: r.words for r in blocks.collect()}
    ids: dict = {}
    for r in I.word_ids(blocks).collect():
        for number, x in zip(_unplaned(r["numbers"]), _unplaned(r["ids"])):
            assert ids.setdefault(bytes(words[r["block_id"]][number]), x) == x
    assert len(set(ids.values())) == len(ids) == 68 and sorted(ids) == sorted(ids, key=ids.get)


def test_each_ngram_gets_its_keys_value():
    words, numbers = [b"b", b"a", b"c"], np.array([0, 1, 0, 1, 2, 2, 0, 1])
    t = I.Tuples(words, np.array([5, 3]), numbers, 3)
    values = np.arange(len(t.keys)) * 7
    assert t.each(values).tolist() == [values[t.keys.tolist().index(k)] for k in t.all.tolist()]
    assert I.Tuples([], np.array([0]), np.zeros(0, np.int64), 3).each(np.zeros(0, np.int64)).tolist() == []
