"""Operator 13: near-duplicates by an inverted join on the coordinates of minhash signatures.

1. A task makes each text's set of distinct shingles (64-bit hashes) and COORDINATES minhashes of it. Equal sets become one node.
2. A node is posted under each pair of coordinate and value. Two sets collide in each coordinate with the probability of their
   Jaccard similarity; a pair is a candidate with MATCHES collisions or more (at 85 % and 20 of 40, one pair in 30 million is missed). Values
   that one node alone has are dropped, then nodes with fewer than MATCHES shared values, and both once more.
3. Prefix: a node's values are ordered from rare to frequent. Two nodes with MATCHES values in common share one of their
   first c - MATCHES + 1, c being how many a node has, so only these lists are merged. Skip: the long lists behind them are never
   walked; for a pair that met, their collisions are counted on the two signatures.
4. Candidates are confirmed on the full sets, 100 * intersection >= percent * union in integers. In a round all nodes of a list
   meet one leader (first the node that meets most others, as the middle of a large group does), and each tries the leader it
   collides with most. Lists whose nodes are in one component are done. Rounds go on while they settle a tenth of what is open.
5. Then the nodes of a list that are still in different components are compared in blocks of bounded size. A block writes each set as its
   difference from what most of its sets have; two sets differ where their differences do, so few postings are merged to get all
   intersections of a set at once, exactly. Links alone leave a block, no pairs. Nodes whose shingles are too often their own to have a partner are
   left out before, which is exact as well. Nothing is capped.
6. Components grow by smallest labels. Frequent keys (values, copies of a text, leaders) are dealt over several tasks.

A null text counts as empty. Rows without words have an empty set and are linked with nothing: each is a component of its own. Fewer
words than a shingle make one element, the whole sequence. Null or repeated ids keep their rows; component_id is the smallest
id that isn't null (null if there is none), and kept says that the id is that one (both null counts). Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, Stage, join_dealt, ragged_index, table, trim
from .simhash import components

WORDS, PERCENT, COORDINATES, MATCHES = 3, 85, 40, 20
#: Nodes whose ids may be sent to all tasks; more are found by a shuffled join.
FEW = 500_000
#: Shingles of the nodes on one side of a block.
BLOCK = 1 << 20
_RNG = np.random.default_rng(13)
_MULTIPLY = _RNG.integers(0, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, COORDINATES, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; words are compared with A-Z in lower case."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if len(parts) < words:
        return np.array([xxh64_intdigest(b" ".join(parts), len(parts))] if parts else [], np.uint64)
    known = {p: xxh64_intdigest(p, 13) for p in set(parts)}
    w = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    h = np.zeros(len(w) - words + 1, np.uint64)
    for k in range(words):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w[k : k + len(h)]
    return np.unique(_mix(h))


def signature(h: np.ndarray) -> np.ndarray:
    """One number for each coordinate: 56 bits of its smallest hash, and the coordinate in the low 8 bits."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 4096):
        low = np.minimum(low, (h[a : a + 4096, None] * _MULTIPLY + _ADD).min(0))
    return ((_mix(low) & ~np.uint64(255)) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def set_number(h: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(h.tobytes())).view(np.int64))


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, key, node, n, sig) of a table (doc_id, key, text). node is null for an empty set, sig for a set too small to be like another one."""
    least = percent / max(100 - percent, 1e-9)  # n / (n + 1) must reach the similarity

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trim()
            node, n, sig = [], [], []
            for t in batch.column(2):
                h = shingle_set(t.as_py() or "", words)
                node.append(set_number(h) if len(h) else None)
                n.append(len(h))
                sig.append(signature(h) if len(h) >= least else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "key", "node", "n", "sig"])

    return docs.select("doc_id", "key", "text").mapInArrow(work, "doc_id long, key long, node long, n long, sig array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, stage: Stage, words: int = WORDS) -> DataFrame:
    """(node, h) of the wanted nodes (key, node): their sets, made again from the row that key names."""
    few = wanted.count() <= FEW
    met = docs.select("key", "text").join(F.broadcast(wanted) if few else wanted, "key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trim()
            node, sets = [], []
            for t, want in zip(batch.column(0), batch.column(1).to_pylist()):
                h = shingle_set(t.as_py() or "", words)
                if len(h) and set_number(h) == want:  # a key may name several rows
                    node.append(want)
                    sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], ["node", "h"])

    return stage.write(met.select("text", "node").mapInArrow(work, "node long, h binary").dropDuplicates(["node"]))


def _attached(pairs: DataFrame, end: str, of: DataFrame, column: str, stage: Stage) -> DataFrame:
    """pairs with a column of the node at one end; an end that very many pairs have is dealt over tasks."""
    counts = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
    size = counts.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    return join_dealt(pairs, of.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}")), end, stage, counts, size["rows"] or 0, size["most"] or 0)


def colliding(pairs: DataFrame, nodes: DataFrame, stage: Stage, matches: int = MATCHES) -> DataFrame:
    """(a, b, hits) of the pairs (a, b) whose signatures agree in at least `matches` coordinates."""
    both = _attached(_attached(pairs, "b", nodes, "sig", stage), "a", nodes, "sig", stage)
    return both.select("a", "b", F.size(F.array_intersect("sig_a", "sig_b")).alias("hits")).filter(F.col("hits") >= matches)


def confirmed(pairs: DataFrame, sets: DataFrame, stage: Stage, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are alike, as links (fp, to)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trim()
            a, b = batch.column(2), batch.column(3)
            view = lambda column, i: np.frombuffer(column[i].as_buffer(), np.uint64)
            hit = pa.array([alike(view(a, i), view(b, i), percent) for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], ["fp", "to"])

    both = _attached(_attached(pairs.select("a", "b"), "b", sets, "h", stage), "a", sets, "h", stage)
    return both.select("a", "b", "h_a", "h_b").mapInArrow(check, "fp long, to long")


def shared_posts(posts: DataFrame, stage: Stage, matches: int = MATCHES) -> DataFrame:
    """(node, n, posts) of posts (node, n, key): each node's values that others have as well, from rare to frequent; nodes with fewer than `matches` are left out."""
    counts = stage.write(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    size = counts.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    met = join_dealt(posts, counts.select("key", F.col("n").alias("df")), "key", stage, counts, size["rows"] or 0, size["most"] or 0)
    return met.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("posts")).filter(F.size("posts") >= matches)


def _alone(open_: DataFrame, sets: DataFrame, stage: Stage, percent: int) -> DataFrame:
    """(node, lone) of open nodes that may have a partner: how many of a node's shingles no other such node has. Leaving a node out makes more shingles of others lone, so this is done twice."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trim()
            for node, h in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(h.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), node)), pa.array(values)], ["node", "h"])

    nodes = stage.write(open_.select("node", "n").distinct())
    held = stage.write(sets.join(nodes.select("node"), "node", "left_semi").mapInArrow(cut, "node long, h long"))
    for _ in range(2):
        alone = held.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("node")).filter("df = 1").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
        counted = nodes.select("node", "n").join(alone, "node", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
        nodes = stage.write(counted.filter(100 * (F.col("n") - F.col("lone")) >= percent * F.col("n")))
        held = held.join(nodes.select("node"), "node", "left_semi")
    return nodes.select("node", "lone")


def _links_in(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked sets of different labels and sides (a single side: any two), one for each set and label it links to."""
    g, n = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    token, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(g), n)
    common = count * 2 > g
    rank = np.cumsum(common) - 1  # of common tokens
    has = np.zeros((int(common.sum()), g), bool)  # at most twice as many as there are shingles
    inside = common[of]
    has[rank[of[inside]], member[inside]] = True
    lacks, lacking = np.nonzero(~has)
    extra = ~inside & (count[of] > 1)
    differs = np.bincount(member[~inside], minlength=g) + len(has) - has.sum(0)
    # postings of the differences: of each token the sets, and of each set the tokens
    t, m = np.r_[lacks, len(has) + of[extra]], np.r_[lacking, member[extra]]
    by_token, by_set = np.argsort(t, kind="stable"), np.argsort(m, kind="stable")
    sets_of, starts = m[by_token], np.searchsorted(t[by_token], np.arange(len(has) + len(token) + 1))
    tokens_of, begins = t[by_set], np.searchsorted(m[by_set], np.arange(g + 1))
    name, frequency = np.unique(label, return_counts=True)
    both = len(np.unique(side)) > 1
    found_a, found_b = [], []
    for x in np.flatnonzero(label != name[frequency.argmax()]).tolist():
        mine = tokens_of[begins[x] : begins[x + 1]]
        shared = np.bincount(sets_of[ragged_index(starts[mine], starts[mine + 1] - starts[mine])], minlength=g)
        delta, total = differs[x] + differs - 2 * shared, n[x] + n
        hit = np.flatnonzero(((100 + percent) * (total - delta) >= 2 * percent * total) & (label != label[x]) & ((side != side[x]) | (not both)))
        if len(hit):
            hit = hit[np.unique(label[hit], return_index=True)[1]]
            found_a.append(np.full(len(hit), x)), found_b.append(hit)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links_in_blocks(open_: DataFrame, sets: DataFrame, by_key, stage: Stage, percent: int = PERCENT) -> DataFrame:
    """Links (fp, to) between nodes of one list in open_ (key, node, n, label) with different labels: all that a component needs."""
    sizes = open_.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("sides"))
    put = by_key(open_.select("key", "node", "label"), sizes).withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"))
    blocks = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "label")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out():
            node, label, side = (np.array([h[k] for h in held], np.int64) for k in range(3))
            a, b = _links_in([np.frombuffer(h[3], np.uint64) for h in held], label, side, percent)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["fp", "to"])

        for batch in batches:
            trim()
            columns = [c.to_pylist() for c in batch.columns[:6]]
            for r, (key, i, j, side, node, label) in enumerate(zip(*columns)):
                if (key, i, j) != at:
                    if len(held) > 1:
                        yield out()
                    at, held = (key, i, j), []
                held.append((node, label, side, batch.column(6)[r].as_py()))
        if len(held) > 1:
            yield out()

    met = blocks.join(sets, "node").select("key", "i", "j", "side", "node", "label", "h")
    return stage.write(met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(solve, "fp long, to long"))


def shared_lists(lists: DataFrame, stage: Stage) -> DataFrame:
    """(key, node, n, size) of lists (key, node, n) with several nodes; size says how many."""
    counts = stage.write(lists.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    size = counts.agg(F.sum("size").alias("rows"), F.max("size").alias("most")).first()
    return stage.write(join_dealt(lists, counts, "key", stage, counts.select("key", F.col("size").alias("n")), size["rows"] or 0, size["most"] or 0))


def links_of(lists: DataFrame, nodes: DataFrame, sets: DataFrame, stage: Stage, percent: int = PERCENT, matches: int = MATCHES, links: DataFrame | None = None) -> DataFrame | None:
    """(fp, root) of all nodes with a link, from shared lists (key, node, n, size), their nodes (node, sig) and sets (node, h), and links
    (fp, to) known before; None without any list or link."""
    size = lists.agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("most")).first()
    counts = lists.filter(F.col("size") > HOT).select("key", F.col("size").alias("n")).distinct()
    by_key = lambda rows, other: join_dealt(rows, other, "key", stage, counts, size["rows"], size["most"] or 0)
    roots = components(links, stage) if links is not None else None
    if not size["rows"]:
        return roots
    weights = lists.groupBy("node").agg(F.sum("size").alias("weight"))
    # with nothing lone this is the bound by sizes
    fits = (100 + percent) * F.least(F.col("n") - F.col("lone"), F.col("m") - F.col("other_lone")) >= percent * (F.col("n") + F.col("m"))
    done = lonely = None
    turn, before = 0, 0
    while True:
        labelled = lists.withColumn("label", F.col("node")) if roots is None else lists.join(roots.withColumnRenamed("fp", "node"), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        split = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
        open_ = by_key(labelled, split)
        if turn == 0:
            open_ = open_.join(weights, "node").withColumn("lone", F.lit(0).cast("long"))
        else:
            open_ = stage.write(open_)
            lonely = lonely or _alone(open_, sets, stage, percent)
            open_ = open_.join(lonely, "node").withColumn("weight", F.xxhash64("node", F.lit(turn)))
        open_ = stage.write(open_)
        n_open = open_.count()
        if not n_open:
            return roots
        last = turn > 0 and n_open > 0.9 * before
        before = n_open
        if last:
            near = open_.select("key", "node", "n", "label")
            new = links_in_blocks(near, sets, by_key, stage, percent)
            return components(new if links is None else links.union(new), stage)
        first = open_.groupBy("key").agg(F.max(F.struct("weight", "node", "n", "label", "lone")).alias("f"))
        met = by_key(open_, first.select("key", F.col("f.node").alias("a"), F.col("f.n").alias("m"), F.col("f.label").alias("of"), F.col("f.lone").alias("other_lone")))
        pairs = met.filter((F.col("label") != F.col("of")) & fits).select("a", F.col("node").alias("b")).distinct()
        if done is not None:
            tried = done.union(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        found = colliding(stage.write(pairs), nodes, stage, matches)
        found = stage.write(found.groupBy("b").agg(F.max(F.struct("hits", "a")).alias("f")).select(F.col("f.a").alias("a"), "b"))
        done = found if done is None else done.union(found)
        new = stage.write(confirmed(found, sets, stage, percent))
        links = new if links is None else links.union(new)
        roots = components(links, stage)
        turn += 1


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of a table (doc_id, text)."""
    stage = Stage(docs.sparkSession, "minhash")
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1) - F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    docs = docs.select(F.col("doc_id").cast("long"), number.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stage.write(sketches(docs, words, percent))
    nodes = stage.write(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"), F.min("key").alias("key"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")))

    posts = nodes.filter("sig IS NOT NULL").select("node", "n", F.explode("sig").alias("key"))
    held = stage.write(shared_posts(posts, stage))
    held = stage.write(shared_posts(held.select("node", "n", F.explode("posts.key").alias("key")), stage))
    prefix = held.select("node", "n", F.transform(F.slice("posts", F.lit(1), F.size("posts") - (MATCHES - 1)), lambda p: p["key"]).alias("prefix"))
    lists = shared_lists(prefix.select("node", "n", F.explode("prefix").alias("key")), stage)
    wanted = stage.write(nodes.join(lists.select("node").distinct(), "node", "left_semi").select("node", "key", "sig"))
    sets = full_sets(docs, wanted.select("key", "node"), stage, words)
    roots = links_of(lists, wanted, sets, stage, percent)

    of = nodes.select("node", "low", "copies", F.col("node").alias("root"))
    if roots is not None:
        of = nodes.join(roots.withColumnRenamed("fp", "node"), "node", "left").select("node", "low", "copies", F.coalesce("root", "node").alias("root"))
    of = stage.write(of)
    several = of.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stage.write(of.join(several, "root").select("node", "component_id", F.col("copies").alias("n")))
    size = named.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    full = rows.filter("node IS NOT NULL").select("doc_id", "node", F.col("n").alias("n_shingles"))
    met = join_dealt(full, named.select("node", "component_id"), "node", stage, named, size["rows"] or 0, size["most"] or 0).select("doc_id", "n_shingles", "component_id")
    empty = rows.filter("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return met.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = {
    "op13_minhash_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
u AS MATERIALIZED (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s),
shared AS (SELECT g FROM u GROUP BY g HAVING count(*) > 1),
v AS MATERIALIZED (SELECT u.* FROM u JOIN shared USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS i FROM v a JOIN v b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * i >= 85 * (n + m - i)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON s.doc_id = r.a""",
}
