import numpy as np

import corpus_pipeline
from ledgerstone.llm import minhash_join, near_copies, simhash


def plain(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_stage_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(vocabulary, 150)) for _ in range(20)]
    for t in texts[:12]:  # copies with one to eight changed words, then copies of copies
        for n in range(1, 9):
            w = t.split()
            for i in rng.choice(len(w), n, replace=False):
                w[i] = str(rng.choice(vocabulary))
            texts.append(t := " ".join(w))
    texts += ["one two", "one two", "One  TWO", "", "three four five six", None]
    sets, fp = [plain(t or "") for t in texts], [simhash.fingerprint(t or "") for t in texts]
    label, pairs, wide = list(range(len(texts))), 0, 0
    for i in range(len(texts)):
        for j in range(i):
            near = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            close = bin(fp[i] ^ fp[j]).count("1") <= 2
            pairs, wide = pairs + near, wide + (near and not close)
            if near or close:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert wide > 20  # these were kept by the fingerprints alone
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5])], "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, df, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(label))


def test_candidates_and_empty_tables(spark):
    rng = np.random.default_rng(1)
    words = [b"%d" % i for i in range(400)]
    missed = 0
    for _ in range(150):
        other = list(words)
        for i in rng.choice(400, 8, replace=False):
            other[i] = b"x%d" % rng.integers(1 << 40)
        a, b = (minhash_join.shingle_set(b" ".join(x).decode(), near_copies.WORDS) for x in (words, other))
        assert minhash_join.alike(a, b, near_copies.PERCENT)
        missed += not (near_copies.band_keys(a) == near_copies.band_keys(b)).any()
    assert missed == 0
    assert near_copies.keep_one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_group_of_thousands(spark):
    """Copies with many and few changes about one text, most of them not alike one another, and copies of these."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(3000):
        w = list(base)
        for i in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            w[i] = f"x{rng.integers(6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(r.doc_id for r in near_copies.keep_one_of_each(df).collect())
    sets, fp = [frozenset(plain(t)) for t in texts], [simhash.fingerprint(t) for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    ids = {}
    rows = np.zeros((len(first), 1 + max(ids.setdefault(g, len(ids)) for s in first for g in s)), np.float32)
    for r, s in enumerate(first):
        rows[r, [ids[g] for g in s]] = 1
    both, n = rows @ rows.T, rows.sum(1)
    near = both >= 0.8 * (n[:, None] + n[None] - both) - 1e-6
    place = {s: r for r, s in enumerate(first)}
    prints = {}
    for s, f in zip(sets, fp):
        prints.setdefault(f, set()).add(place[s])
    names = np.array(sorted(prints), np.uint64)
    close = np.bitwise_count(names[:, None] ^ names[None]) <= 2
    for a, b in zip(*np.nonzero(close)):
        for x in prints[int(names[a])]:
            for y in prints[int(names[b])]:
                near[x, y] = near[y, x] = True
    label = np.arange(len(first))
    while True:
        new = np.array([label[m].min() for m in near])
        if (new == label).all():
            break
        label = new
    order = list(first.values())
    assert got == sorted({min(order[r] for r in np.flatnonzero(label == x)) for x in set(label.tolist())})
