"""Operator 8: approximate nearest neighbours by NN-descent and greedy graph search.

Index. Equal vectors form one node, numbered by its smallest vec_id. Nearness between nodes is the inner product itself. First
lists come from TREES partitions by projections, compared within leaves of LEAF nodes; they are poor on purpose. NN-descent then
carries the graph: in each round every node gathers its list and the best BACK of the nodes that list it, all of these meet, and
pairs with a new edge that improve a list are sent to it. Rounds go on until less than SETTLED of all list entries change, at
every size of table. Vectors travel as 8-bit numbers of their own scale there, however large other vectors are.

Search. A query starts at its own node's list. Each hop opens its best unopened nodes (OPENED in the first, twice as many in each further one), fetches
their lists, scores what it hasn't seen, and keeps the best BEAM; it ends when all nodes in the beam are open. The best of the beam are scored in double
precision on the original vectors; rows that were not scored so never enter a result.

All joins are by node with small rows, so a task holds a batch or one node's meeting of at most DEGREE + BACK + 1 vectors. A
node that very many lists or queries name is dealt over several tasks (`join_dealt`).

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part. Ties go to the
smaller vec_id. Null ids take no part either. Copies of one vector are ranked by their ids; a result needs no more than the
first RANKS + 1 of them, so only those are kept. Repeated rows (same id and vector) count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT, Stage, join_dealt, table, trim

RANKS, DEGREE, BACK = 20, 48, 24
#: First lists: partitions, nodes that are dealt out together, nodes compared with each other.
TREES, DEALT, LEAF = 2, 1024, 256
#: Rounds end when fewer of the list entries change.
SETTLED = 0.005
#: Nodes that a query keeps, and those it opens in its first hop.
BEAM, OPENED = 64, 16
SEED = 20


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows (vec_id, v) whose vectors can take part."""
    v = F.col("v")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select("vec_id", F.col(vector).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(ok)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == F.lit(size["n"] if size else 0))


# -- arrays in record batches --------------------------------------------------------------------------------


def _matrix(column, dtype=np.uint8) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)


def _pack(v: np.ndarray, top: float) -> pa.Array:
    """8-bit numbers with their scale, relative to the largest component of all, in front."""
    most = np.abs(v).max(1)
    q = np.rint(v / most[:, None] * 127).astype(np.int8)
    scale = np.maximum(most / top / 127, 1e-30).astype("<f4")
    return pa.array([r.tobytes() for r in np.hstack([scale[:, None].view(np.uint8), q.view(np.uint8)])], pa.binary())


def _unpack(rows: np.ndarray) -> np.ndarray:
    return rows[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(rows[:, :4]).view("<f4")


class _Lists:
    """Neighbour lists as rows (id, nbrs, scores, fresh, n_fresh) in a record batch."""

    SCHEMA = "id long, nbrs binary, scores binary, fresh binary, n_fresh int"
    NAMES = ("id", "nbrs", "scores", "fresh", "n_fresh")

    @classmethod
    def batch(cls, ids, sizes, nbrs, scores, fresh) -> pa.RecordBatch:
        ends = np.cumsum(sizes)
        spans = list(zip((ends - sizes).tolist(), ends.tolist()))
        cut = lambda a: pa.array([a[s:e].tobytes() for s, e in spans], pa.binary())
        new = np.r_[0, np.cumsum(fresh)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), cut(nbrs.astype("<i8")), cut(scores.astype("<f4")), cut(fresh.astype(np.uint8)), pa.array(new[ends] - new[ends - sizes], pa.int32())], cls.NAMES)

    @staticmethod
    def flat(batch):
        """Flat (id, nbr, score, fresh)."""
        nb = batch.column(1).to_pylist()
        n = np.fromiter(map(len, nb), np.int64, len(nb)) // 8
        return np.repeat(batch.column(0).to_numpy(), n), np.frombuffer(b"".join(nb), "<i8"), np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f4"), np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8)


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    start = _starts(key).tolist()
    return list(zip(start, [*start[1:], len(key)]))


def _best(src, nbr, score, fresh, k: int):
    """The k best edges of each source; of equal edges the older one stays. Sorted by source, then best first."""
    order = np.lexsort((fresh, nbr, src))
    src, nbr, score, fresh = src[order], nbr[order], score[order], fresh[order]
    keep = np.r_[True, (src[1:] != src[:-1]) | (nbr[1:] != nbr[:-1])] if len(src) else np.zeros(0, bool)
    src, nbr, score, fresh = src[keep], nbr[keep], score[keep], fresh[keep]
    order = np.lexsort((nbr, -score, src))
    src, nbr, score, fresh = src[order], nbr[order], score[order], fresh[order]
    start = _starts(src)
    size = np.diff(np.r_[start, len(src)])
    top = np.arange(len(src)) - np.repeat(start, size) < k
    return src[start], np.minimum(size, k), nbr[top], score[top], fresh[top]


def _groups(batches: Iterator[pa.RecordBatch], column: int = 0, least: int = 0):
    """Record batches cut so that equal values of a sorted column stay together, and so that they have `least` rows where there are as many."""
    held: list[pa.RecordBatch] = []
    joined = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy()
        first = int(np.searchsorted(key, key[-1]))
        if first == 0 and held and held[-1].column(column)[-1].as_py() == key[-1] or first + sum(x.num_rows for x in held) < least:
            held.append(batch)
            continue
        if first:
            yield joined([*held, batch.slice(0, first)])
            held = []
        elif held:
            yield joined(held)
            held = []
        held.append(batch.slice(first))
    if held:
        yield joined(held)


def _merge_lists(rows: DataFrame, k: int) -> DataFrame:
    """Rows of lists merged into one list of the k best for each id."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches):
            yield _Lists.batch(*_best(*_Lists.flat(part), k))

    return rows.repartition("id").sortWithinPartitions("id").mapInArrow(merge, _Lists.SCHEMA)


# -- the graph -----------------------------------------------------------------------------------------------


def first_graph(nodes: DataFrame, n: int, stage: Stage, degree: int = DEGREE, trees: int = TREES) -> DataFrame:
    """Lists from partitions of nodes (id, code) by projections. Signs of projections deal the nodes out; what was dealt to one place
    is halved at medians of further projections until it has LEAF nodes. A crowded place is divided at random before that."""
    levels = max(int(np.ceil(np.log2(max(n, 1) / DEALT))), 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unpack(_matrix(batch.column(1)))
            v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-30
            if planes is None:
                planes = rng.standard_normal((trees, v.shape[1], max(levels, 1))).astype(np.float32)
            for t in range(trees):
                bits = (v @ planes[t] > 0)[:, :levels].astype(np.int64)
                place = t << 40 | (bits << np.arange(levels)).sum(1) if levels else np.full(len(v), t << 40)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), batch.column(0), batch.column(1)], ["place", "id", "code"])

    def halved(at: np.ndarray, v: np.ndarray, rng) -> Iterator[np.ndarray]:
        todo = [at]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                yield at
                continue
            side = np.argsort(v[at] @ rng.standard_normal(v.shape[1]).astype(np.float32), kind="stable")
            todo += [at[side[: len(at) // 2]], at[side[len(at) // 2 :]]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        for part in _groups(batches):
            ids, v = part.column(1).to_numpy(), _unpack(_matrix(part.column(2)))
            for a, b in _runs(part.column(0).to_numpy()):
                for leaf in halved(np.arange(a, b), v, rng):
                    k = min(degree, len(leaf) - 1)
                    if k < 1:
                        continue
                    s = v[leaf] @ v[leaf].T
                    np.fill_diagonal(s, -np.inf)
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    yield _Lists.batch(ids[leaf], np.full(len(leaf), k), ids[leaf][top].ravel(), np.take_along_axis(s, top, 1).ravel(), np.ones(top.size, np.uint8))

    placed = nodes.mapInArrow(deal, "place long, id long, code binary")
    hot = max(HOT, n * trees // 50_000)
    crowded = placed.groupBy("place").count().filter(F.col("count") > hot).select("place", F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(stage.write(crowded)), "place", "left")
    part = F.coalesce(F.pmod(F.xxhash64("id", "place"), F.col("parts")), F.lit(0))
    key = dealt.select(F.xxhash64("place", part).alias("key"), "id", "code")
    return _merge_lists(key.repartition("key").sortWithinPartitions("key").mapInArrow(compare, _Lists.SCHEMA), degree)


def _named(lists: DataFrame, hot: int) -> DataFrame:
    """How often lists name the nodes that they name most: (id, n), at least as large as the truth for all nodes named more than `hot` times.

    A task passes on only what it counts often enough: together the tasks keep back less than half of hot for any node, so twice
    what they pass on is enough."""
    least = max(hot // (2 * max(lists.rdd.getNumPartitions(), 1)), 1)

    def added(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, at = np.unique(ids, return_inverse=True)
        return one, np.bincount(at, n, len(one)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            held.append(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8"))
            size += len(held[-1])
            if size > 1 << 20:
                new = np.concatenate(held)
                (ids, n), held, size = added(np.r_[ids, new], np.r_[n, np.ones(len(new), np.int64)]), [], 0
        new = np.concatenate(held) if held else ids[:0]
        ids, n = added(np.r_[ids, new], np.r_[n, np.ones(len(new), np.int64)])
        often = n >= least
        yield pa.RecordBatch.from_arrays([pa.array(ids[often], pa.int64()), pa.array(n[often], pa.int64())], ["id", "n"])

    return lists.select("nbrs").mapInArrow(count, "id long, n long").groupBy("id").agg((F.sum("n") * 2).alias("n"))


def _listed_by(lists: DataFrame, k: int) -> DataFrame:
    """Who lists a node, the k best of each batch: (id, src, score, new), one row an edge. A list for each node that a batch names would
    be few rows only while the batches name the same nodes, and more and more a node in larger tables."""

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, nbr, score, fresh = _Lists.flat(batch)
            listed, size, src, score, new = _best(nbr, src, score, fresh, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(listed, size), pa.int64()), pa.array(src, pa.int64()), pa.array(score, pa.float32()), pa.array(new.astype(np.int8), pa.int8())], ["id", "src", "score", "new"])

    return lists.mapInArrow(turned, "id long, src long, score float, new byte")


def descend(graph: DataFrame, nodes: DataFrame, n: int, stage: Stage, degree: int = DEGREE) -> DataFrame:
    """One round of NN-descent: the neighbours of a node meet, in both directions, and better edges go to their lists."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Who meets at a node: itself, its list and the best of those that list it, if any edge among these is new. Rows: a node's list, then who lists it."""
        for part in _groups(batches, least=20_000):
            ids, listed = part.column(0).to_numpy(), part.column(1).is_valid().to_numpy(zero_copy_only=False)
            nbrs, fresh, src, score, new = (part.column(i).drop_null() for i in range(1, 6))
            nbrs = nbrs.to_pylist()
            lead, size, rev, _, new = _best(ids[~listed], src.to_numpy(), score.to_numpy(), new.to_numpy().astype(np.uint8), BACK)
            own = np.unique(ids)
            a = np.r_[np.repeat(ids[listed], np.fromiter(map(len, nbrs), np.int64, len(nbrs)) // 8), np.repeat(lead, size), own]
            m = np.r_[np.frombuffer(b"".join(nbrs), "<i8"), rev, own]
            f = np.r_[np.frombuffer(b"".join(fresh.to_pylist()), np.uint8), new, np.zeros(len(own), np.uint8)]
            order = np.lexsort((1 - f.astype(np.int8), m, a))
            a, m, f = a[order], m[order], f[order]
            once = np.r_[True, (a[1:] != a[:-1]) | (m[1:] != m[:-1])] if len(a) else np.zeros(0, bool)
            a, m, f = a[once], m[once], f[once]
            start = _starts(a)
            live = np.repeat(np.maximum.reduceat(f, start) > 0, np.diff(np.r_[start, len(a)])) if len(a) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(m[live], pa.int64()), pa.array(a[live], pa.int64()), pa.array(f[live].astype(np.int8), pa.int8())], ["id", "at", "fresh"])

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [np.frombuffer(x, "<f4")[-1] if len(x) // 4 >= degree else -np.inf for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.float32())], ["id", "low"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches):
            at, member, fresh, low = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            trim()
            fresh, v = fresh.astype(bool), _unpack(_matrix(part.column(3)))
            found = []
            for a, b in _runs(at):
                s, f = v[a:b] @ v[a:b].T, fresh[a:b]
                good = (s > low[a:b, None]) & (f[:, None] | f)
                np.fill_diagonal(good, False)
                i, j = np.nonzero(good)
                found.append((member[a + i], member[a + j], s[i, j]))
            if found:
                src, nbr, score = (np.concatenate(x) for x in zip(*found))
                yield _Lists.batch(*_best(src, nbr, score, np.ones(len(src), np.uint8), degree))

    def aged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = pa.array([bytes(len(x)) for x in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), old, pa.array(np.zeros(batch.num_rows), pa.int32())], _Lists.NAMES)

    both = graph.select("id", "nbrs", "fresh").unionByName(_listed_by(graph, BACK), allowMissingColumns=True)
    meetings = both.repartition("id").sortWithinPartitions("id").mapInArrow(members, "id long, at long, fresh byte")
    ready = nodes.join(graph.select("id", "scores").mapInArrow(limits, "id long, low float"), "id", "left").select("id", "code", F.coalesce("low", F.lit(float("-inf")).cast("float")).alias("low"))
    met = join_dealt(meetings, ready, "id", stage, _named(graph, max(HOT, n * (degree + BACK) // 50_000) - BACK - 1), n * (degree + BACK), n).select("at", "id", "fresh", "code", "low")
    better = met.repartition("at").sortWithinPartitions("at").mapInArrow(meet, _Lists.SCHEMA)
    return stage.write(_merge_lists(graph.mapInArrow(aged, _Lists.SCHEMA).union(better), degree))


class Index:
    """A neighbour graph over all usable vectors, ready to be searched. rounds bounds the descent (None: until it settles)."""

    def __init__(self, df: DataFrame, vector: str = "embedding", degree: int = DEGREE, rounds: int | None = None):
        self.stage = stage = Stage(df.sparkSession, "ann")
        self.degree = degree
        self.rows = stage.write(usable(df, vector).distinct())
        # the first copies of each vector: tasks drop the rest before the shuffle, so a frequent vector isn't one task's work
        nth = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
        first = stage.write(self.rows.withColumn("nth", nth).filter(F.col("nth") <= RANKS + 1).withColumn("id", F.min("vec_id").over(W.partitionBy("v"))))
        self.nodes, self.copies = first.filter("nth = 1").select("id", "v"), first.select("id", "vec_id")
        stats = self.nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
        self.n, top = stats["n"], stats["top"] or 1.0

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), _pack(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1), top)], ["id", "code"])

        self.codes = stage.write(self.nodes.mapInArrow(coded, "id long, code binary"))
        graph, self.rounds = stage.write(first_graph(self.codes, self.n, stage, degree)), 0
        while rounds is None or self.rounds < rounds:
            old, graph = graph, descend(graph, self.codes, self.n, stage, degree)
            stage.drop(old)
            self.rounds += 1
            if (graph.agg(F.sum("n_fresh")).first()[0] or 0) <= SETTLED * self.n * degree:
                break
        self.graph = graph

    def _by_node(self, asked: DataFrame, other: DataFrame, n_queries: int, each: int) -> DataFrame:
        """(query, id) with the columns of other by node."""
        return join_dealt(asked, other, "id", self.stage, asked.groupBy("id").agg(F.count(F.lit(1)).alias("n")), n_queries * each, n_queries)

    def search(self, queries: DataFrame, ranks: int = RANKS, beam: int = BEAM) -> DataFrame:
        """For nodes (id) as queries, the best other nodes found: (query, id, score)."""
        stage = self.stage
        schema = "query long, code binary, seen binary, ids binary, scores binary, opened binary, todo int"
        names = [x.split()[0] for x in schema.split(", ")]

        def state_batch(rows: list[tuple]) -> pa.RecordBatch:
            """Rows (query, code, seen, ids, scores, opened) of arrays, best first; todo counts the nodes that wait to be opened."""
            cols = list(zip(*rows)) if rows else [[]] * 6
            todo = [int((~o).sum()) for o in cols[5]]
            as_bytes = lambda c, t: pa.array([x.astype(t).tobytes() for x in c], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), as_bytes(cols[2], "<i8"), as_bytes(cols[3], "<i8"), as_bytes(cols[4], "<f4"), as_bytes(cols[5], np.uint8), pa.array(todo, pa.int32())], names)

        def state_rows(batch):
            for q, code, seen, ids, scores, opened in zip(*(batch.column(i).to_pylist() for i in range(6))):
                yield q, code, np.frombuffer(seen, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(scores, "<f4"), np.frombuffer(opened, np.uint8).astype(bool)

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for q, code, nbrs, scores in zip(*(c.to_pylist() for c in batch.columns)):
                    ids, s = np.frombuffer(nbrs or b"", "<i8"), np.frombuffer(scores or b"", "<f4")
                    out.append((q, code, np.sort(np.r_[ids, q]), ids, s, np.zeros(len(ids), bool)))
                yield state_batch(out)

        def to_open(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [(q, ids[~opened][:width]) for q, _, _, ids, _, opened in state_rows(batch)]
                sizes = [len(x) for _, x in got]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _ in got], sizes).astype(np.int64), pa.int64()), pa.array(np.concatenate([x for _, x in got]) if got else [], pa.int64())], ["query", "id"])

        def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Members of opened lists that a query hasn't seen. Rows: the query's seen nodes, then lists."""
            for part in _groups(batches):
                key, seen, nbrs = part.column(0).to_numpy(), part.column(1).to_pylist(), part.column(2).to_pylist()
                queries, want = [], []
                for a, b in _runs(key):
                    known = next(x for x in seen[a:b] if x is not None)
                    new = np.setdiff1d(np.frombuffer(b"".join(x for x in nbrs[a:b] if x is not None), "<i8"), np.frombuffer(known, "<i8"))
                    queries.append(np.full(len(new), key[a])), want.append(new)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(queries)), pa.array(np.concatenate(want).astype(np.int64))], ["query", "id"])

        def merge(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
            """Rows of a query: its state (its id in `id` is null), and candidates with their codes."""
            for part in _groups(batches):
                found, code = part.column(7).to_pylist(), part.column(1).to_pylist()
                out = []
                for a, b in _runs(part.column(0).to_numpy()):
                    base = next(i for i in range(a, b) if found[i] is None)
                    q, own, seen, ids, scores, opened = next(state_rows(part.slice(base, 1)))
                    opened = opened.copy()
                    opened[np.flatnonzero(~opened)[:width]] = True
                    rest = [i for i in range(a, b) if i != base]
                    if rest:
                        new = np.array([found[i] for i in rest], np.int64)
                        v = _unpack(np.frombuffer(b"".join([own, *(code[i] for i in rest)]), np.uint8).reshape(len(rest) + 1, -1))
                        ids, scores, opened, seen = np.r_[ids, new], np.r_[scores, v[1:] @ v[0]], np.r_[opened, np.zeros(len(new), bool)], np.union1d(seen, new)
                    order = np.lexsort((ids, -scores))[:beam]
                    out.append((q, own, seen, ids[order], scores[order], opened[order]))
                yield state_batch(out)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, ids = batch.column(0).to_numpy(), [np.frombuffer(x, "<i8") for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, [len(x) for x in ids]), pa.int64()), pa.array(np.concatenate(ids) if ids else [], pa.int64())], ["query", "id"])

        own = self.codes.join(queries.select("id"), "id").join(self.graph.select("id", "nbrs", "scores"), "id", "left")
        state = stage.write(own.select("id", "code", "nbrs", "scores").mapInArrow(start, schema))
        n_queries, finished, width = state.count(), [], OPENED
        held = stage.write if n_queries > HOT else lambda df: df  # stored only where its keys are counted before the join
        none = lambda t: F.lit(None).cast(t)
        while True:
            finished.append(state.filter("todo = 0"))
            active = state.filter("todo > 0")
            if active.isEmpty():
                break
            opening = held(active.mapInArrow(lambda it, w=width: to_open(it, w), "query long, id long"))
            lists = self._by_node(opening, self.graph.select("id", "nbrs"), n_queries, width)
            asked = active.select("query", "seen", none("binary").alias("nbrs")).union(lists.select("query", none("binary"), "nbrs"))
            wanted = held(asked.repartition("query").sortWithinPartitions("query").mapInArrow(unseen, "query long, id long"))
            coded = self._by_node(wanted, self.codes, n_queries, width * self.degree)
            rows = active.withColumn("id", none("long")).unionByName(coded.select("query", "code", "id"), allowMissingColumns=True)
            state = stage.write(rows.repartition("query").sortWithinPartitions("query").mapInArrow(lambda it, w=width: merge(it, w), schema))
            width = min(2 * width, beam)
        whole = finished[0]
        for part in finished[1:]:
            whole = whole.union(part)
        near = stage.write(whole.select("query", "ids").mapInArrow(best, "query long, id long"))

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _groups(batches):
                query, ids = part.column(0).to_numpy(), part.column(1).to_numpy()
                v = np.asarray(part.column(2).flatten()).reshape(part.num_rows, -1)
                out = []
                for a, b in _runs(query):
                    mine = a + int(np.flatnonzero(ids[a:b] == query[a])[0])
                    s = v[a:b] @ v[mine] + 0.0
                    order = np.lexsort((ids[a:b], -s))
                    order = order[a + order != mine][:ranks]
                    out.append((np.full(len(order), query[a]), ids[a:b][order], s[order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query", "id", "score"])

        with_own = near.union(queries.select(F.col("id").alias("query"), "id"))
        vectors = self._by_node(stage.write(with_own), self.nodes, n_queries, beam + 1)
        return vectors.select("query", "id", "v").repartition("query").sortWithinPartitions("query").mapInArrow(exact, "query long, id long, score double")


def nearest(df: DataFrame, every: int = 20, ranks: int = RANKS, vector: str = "embedding", rounds: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose vec_id is divisible by `every`, the nearest other rows found."""
    index = Index(df, vector, rounds=rounds)
    stage = index.stage
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    key = F.xxhash64("v").alias("key")
    wanted = stage.write(index.rows.filter(F.col("vec_id") % every == 0).select(key, "v", F.col("vec_id").alias("query_id")))
    nodes = index.nodes.select(key, F.col("v").alias("own"), "id", squared.alias("self"))
    n = wanted.count()
    counts = lambda rows, k: rows.groupBy(k).agg(F.count(F.lit(1)).alias("n"))
    queries = stage.write(join_dealt(wanted, nodes, "key", stage, counts(wanted, "key"), n, n).filter(F.col("v") == F.col("own")).select("query_id", F.col("id").alias("query"), "self"))
    points = stage.write(queries.groupBy("query").agg(F.first("self").alias("self")))
    found = stage.write(index.search(points.select(F.col("query").alias("id")), ranks).union(points.select("query", F.col("query").alias("id"), F.col("self").alias("score"))))
    copies = join_dealt(found, index.copies, "id", stage, counts(found, "id"), n * ranks, n).select("query", "vec_id", "score")
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), "vec_id"))), 1, ranks + 1)
    lists = stage.write(copies.groupBy("query").agg(top.alias("near")))
    rows = join_dealt(queries.select("query", "query_id"), lists, "query", stage, counts(queries, "query"), n, n)
    mine = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, ranks)
    every_one = rows.select("query_id", F.posexplode(mine).alias("at", "x"))
    return every_one.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (F.lit(0.0) - F.col("x.below")).alias("score"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
