import random

import numpy as np
import pytest

from ledgerstone.llm import common
from ledgerstone.llm import minhash_join as M

SCHEMA = "doc_id long, text string"


def brute(rows, words=3, percent=85):
    """Sets of strings, all pairs."""
    sets = []
    for _, t in rows:
        w = bytes(t or "", "utf-8").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    distinct = {}
    for i, s in enumerate(sets):
        if s:
            j = distinct.setdefault(frozenset(s), i)
            root[find(i)] = find(j)
    items = list(distinct.items())
    for x, (a, i) in enumerate(items):
        for b, j in items[:x]:
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)), d == low.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS key", "'x' AS node").repartition(parts)
    return sorted(map(tuple, M.near_duplicates(df.select("doc_id", "text")).collect()), key=str)


def made(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n)]


def changed(rng, words, k):
    out = list(words)
    for i in rng.sample(range(len(out)), k):
        out[i] = made(rng, 1)[0]
    return out


def test_groups_equal_brute_force(spark):
    """A dense group about a middle, one without its middle, chains, shared passages, copies, short and long texts."""
    rng, rows = random.Random(3), []
    base, other, passage = made(rng, 150), made(rng, 120), made(rng, 40)
    rows += [" ".join(base)] + [" ".join(changed(rng, base, rng.randint(1, 9))) for _ in range(150)]
    rows += [" ".join(changed(rng, other, rng.randint(2, 5))) for _ in range(80)]
    chain = made(rng, 200)
    for _ in range(25):
        rows.append(" ".join(chain))
        chain = changed(rng, chain, 3)
    rows += [" ".join(made(rng, rng.randint(5, 60)) + passage + made(rng, rng.randint(5, 60))) for _ in range(60)]
    rows += ["one two", "ONE  two", "one\ttwo", "a", "x y z", "x y z q", "É à b", "é à b", "", "  \n", None, None]
    rows += [" ".join(made(rng, 7)) for _ in range(5)] * 3 + [" ".join(base)] * 40 + [" ".join(made(rng, 30_000))] * 2
    rng.shuffle(rows)
    rows = [(i * 3 % 1009, t) for i, t in enumerate(rows)] + [(None, " ".join(base)), (None, "lone text of a null id with words"), (5, "x y z"), (5, "x y z")]
    got = run(spark, rows)
    assert got == sorted(((d, n, c, d == c) for d, n, c, _ in brute(rows)), key=str)
    assert len({r[2] for r in got}) < len(rows) - 100


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (None, ""), (2, "a b")]) == [(1, 0, 1, True), (2, 1, 2, True), (None, 0, None, True)]


def test_frequent_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 8)
    rng = random.Random(5)
    base = made(rng, 100)
    rows = [(i, " ".join(changed(rng, base, rng.randint(0, 6)))) for i in range(120)] + [(200 + i, " ".join(base)) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_signatures_collide_as_sets_do():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85):
        hits = []
        for _ in range(60):
            both, n = rng.integers(0, 1 << 62, int(400 * share)), int(400 * (1 - share) / 2)
            a, b = (np.unique(np.r_[both, rng.integers(0, 1 << 62, n)]).astype(np.uint64) for _ in range(2))
            hits.append(len(np.intersect1d(M.signature(a), M.signature(b))))
        assert abs(np.mean(hits) / M.COORDINATES - share) < 0.03
    assert min(hits) >= M.MATCHES


@pytest.mark.parametrize("n,m,both,say", [(100, 100, 92, True), (100, 100, 91, False), (17, 20, 17, True), (16, 20, 16, False)])
def test_similarity_in_whole_numbers(n, m, both, say):
    a, b = np.arange(n, dtype=np.uint64), np.r_[np.arange(both), 1000 + np.arange(m - both)].astype(np.uint64)
    assert M.alike(a, b) is say


@pytest.mark.parametrize("sides", [1, 2])
def test_links_in_a_block(sides):
    rng = np.random.default_rng(sides)
    base = rng.integers(0, 1 << 62, 120)
    sets = []
    for i in range(90):
        keep = base[rng.random(120) > rng.choice([0.01, 0.05, 0.1])] if i < 80 else rng.integers(0, 1 << 62, 30)
        sets.append(np.unique(np.r_[keep, base[:3] + rng.integers(1, 5, 3)]).astype(np.uint64))
    label, side = rng.integers(0, 6, 90), rng.integers(0, sides, 90)
    a, b = M._links_in(sets, label, side, 85)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    want = {(x, y) for x in range(90) for y in range(x + 1, 90) if label[x] != label[y] and (sides == 1 or side[x] != side[y]) and M.alike(sets[x], sets[y])}
    assert got <= want and want
    merged = lambda pairs: _merged(pairs, label)
    assert merged(got) == merged(want)


def _merged(pairs, label):
    root = dict(zip(label.tolist(), label.tolist()))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        root[find(label[x])] = find(label[y])
    groups = {}
    for x in root:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_blocks_of_a_large_list(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 900)
    rng = random.Random(8)
    base = made(rng, 100)
    rows = [(i, " ".join(changed(rng, base, rng.randint(1, 7)))) for i in range(120)]
    assert run(spark, rows) == brute(rows)
