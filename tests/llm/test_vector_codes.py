import hashlib
import math

import numpy as np
import pytest

from ledgerstone.llm import vector_codes as V


@pytest.mark.parametrize("d,top", [(1, 3), (2, 5), (3, 40), (4, 120), (7, 120), (32, 120), (4, V.LARGEST)])
def test_nearest_is_exact(d, top):
    rng = np.random.default_rng(d)
    x, c = rng.integers(-top, top + 1, (500, d)), rng.integers(-top, top + 1, (64, d))
    c[40:] = c[:24]  # ties
    x[:64] = c
    index, distance = V.nearest(x, c)
    want = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (index == want.argmin(1)).all() and (distance == want.min(1)).all()


def test_bounds_leave_few():
    rng = np.random.default_rng(1)
    c = rng.normal(0, 1, (64, 32)).cumsum(1)
    x = c[rng.integers(0, 64, 1000)] + rng.normal(0, 0.3, (1000, 32))
    left: list = []
    V.nearest(np.floor(x * 256).astype(np.int64), np.floor(c * 256).astype(np.int64), left)
    assert left[0] < 0.3 * 64000 and left == sorted(left, reverse=True) and left[-1] < 0.05 * 64000


def brute(rows, parts=16, k=64, rounds=2):
    """As the contract says, with Python's own integers."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    first = sorted(kept)[:k]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    best = lambda v, p: min((dist(cut(v, p), c), j) for j, c in enumerate(books[p]))
    for _ in range(rounds):
        where = [[best(v, p)[1] for p in range(parts)] for _, _, v in kept]
        new = [list(b) for b in books]
        for p in range(parts):
            for j in range(len(first)):
                mine = [cut(v, p) for (_, _, v), w in zip(kept, where) if w[p] == j]
                if mine:
                    new[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
        books = new
    out, by = [], {}
    for i, label, v in kept:
        found = [best(v, p) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(e for e, _ in found), label))
        by[label] = by.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((i, c, e, by[label], digest) for i, c, e, label in out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 32)], int(i % 3) if i % 4 else None) for i in rng.permutation(150)]
    out += [(500, None, 1), (501, [float("nan")] * 32, 1), (502, [float("inf")] + [0.0] * 31, 1), (503, [None] + [0.0] * 31, 1)]
    return out + [(600 + i, out[0][1], 2) for i in range(40)]  # copies


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_query_equals_brute_force(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df.selectExpr("*", "'x' AS v", "1 AS codes", "2 AS error", "3 AS `of`", "4 AS n").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, V.op11_vector_codes(spark, str(tmp_path)).collect()))
    assert got == brute(rows)


def test_odd_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert V.op11_vector_codes(spark, f"{tmp_path}/none").collect() == []
    odd = [(None, [1.0] * 16, None), (3, [], 1), (3, [0.5] * 5, 1), (3, [0.5] * 5, 1), (1, [3e38] * 20, 2)]
    spark.createDataFrame(odd, SCHEMA).write.parquet(f"{tmp_path}/odd/embeddings.parquet")
    got = V.op11_vector_codes(spark, f"{tmp_path}/odd").collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 1), (False, 3), (False, 3), (False, 3), (True, 0)]
    assert all(len(r.code) == 32 and r.error == 0 for r in got)  # five vectors, five entries


def test_decoding_comes_close(spark, rows):
    df = V.usable(spark.createDataFrame(rows, SCHEMA), "embedding", "vec_id")
    books = V.train(df)
    coded = {r.vec_id: r for r in V.encode(df, books, "vec_id").collect()}
    i, v, _ = rows[0]
    back = V.decode(np.frombuffer(coded[i].codes, np.uint8)[None], books)[0]
    assert abs(((back - np.floor(np.array(v) * 256) / 256) ** 2).sum() * 65536 - coded[i].error) < 1e-6
