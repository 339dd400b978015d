import random

import numpy as np
from xxhash import xxh64_intdigest

from ledgerstone.llm import simhash
from ledgerstone.llm.common import Stage


def brute(fps):
    """Component label (smallest index) of each code by comparing all pairs."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 2:
                    m = min(label[i], label[j])
                    if (label[i], label[j]) != (m, m):
                        label[i] = label[j] = m
                        changed = True
    return label


def family(rng, size, flips):
    base, out = rng.getrandbits(64), []
    for _ in range(size):
        x = base
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


def test_fingerprint_by_hand():
    def plain(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for c in "\t\n\v\f\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        if not words:
            return 0
        sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        h = [xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    for t in ["", " \n ", "One", "one TWO", "É a b\tc  d É", "a b c a b c a b c", "x\x1cy z\xa0w q", "a " * 5000]:
        assert simhash.fingerprint(t) == plain(t), t


def test_trees_find_all_links():
    rng = random.Random(3)
    codes = sorted({c for _ in range(20) for c in family(rng, 12, 4)})
    a = np.array(codes, np.uint64)
    root, key, child = simhash.build_trees(a, np.zeros(len(a), np.int64))
    q, n = simhash.search_trees(a, root, key, child, np.arange(len(a)), 2)
    assert set(zip(q.tolist(), n.tolist())) == {(i, j) for i in range(len(a)) for j in range(len(a)) if i != j and bin(codes[i] ^ codes[j]).count("1") <= 2}


def test_components_equal_brute_force(spark):
    rng = random.Random(7)
    fps = [c for _ in range(30) for c in family(rng, 8, 4)] + [0, 0, 1, 7]
    chain = [0xABCDEF << 20]
    for i in range(40):
        chain.append(chain[-1] ^ (1 << (i % 60)) ^ (1 << ((i * 7 + 3) % 60)))
    fps += chain
    rows = [(i * 3, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    want = {i * 3: 3 * m for i, m in enumerate(brute(fps))}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicate_components(df).collect()} == want


def test_crowded_shards_are_divided_without_loss(spark):
    rng = random.Random(5)
    fps = sorted({(0xFFFF << 48) | (0xAAAA << 16) | rng.getrandbits(7) | rng.getrandbits(6) << 32 for _ in range(400)})
    df = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    for crowded in (10, 4096):
        stage = Stage(spark, "t")
        links = simhash.link_fingerprints(df.select("fp"), stage, crowded=crowded)
        roots = {r.fp: r.root for r in simhash.components(links, stage).collect()}
        label = brute(fps)
        mine = [roots.get(int(np.uint64(f).view(np.int64)), None) for f in fps]
        assert all((label[i] == label[j]) == (mine[i] == mine[j] and mine[i] is not None) for i in range(len(fps)) for j in range(i))


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(5, None), (None, ""), (9, "one two three four"), (9, "one two three four"), (None, "single")], "doc_id long, text string")
    keyed = df.select("doc_id", simhash.fingerprint_column(df.text).alias("fp"))
    rows = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicate_components(keyed).collect()), key=str)
    assert rows == [(5, 5), (9, 9), (9, 9), (None, 5), (None, None)]
    assert simhash.near_duplicate_components(keyed.limit(0)).collect() == []
