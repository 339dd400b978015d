"""Queries on merges, states, queues and graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import joins as J
from ..operators import merging as M
from ..operators.storage import kept
from .registry import query
from .tables import read


def _events(spark, d):
    return read(spark, d, "events")


@query("latest_state", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, d):
    return M.latest_state(_events(spark, d), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "value")


@query("change_only", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS was, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r = 1 OR event_type IS DISTINCT FROM was")
def _(spark, d):
    return M.change_only(_events(spark, d), "user_id", ["event_type"], F.asc("ts"), F.asc("event_id")).select("event_id", "user_id", "event_type")


@query("sticky_merge", """SELECT coalesce(c.k, i.k) AS field_id, CASE WHEN i.k IS NOT NULL AND c.state IS DISTINCT FROM 'user-modified' THEN CASE WHEN i.v > 0 THEN i.v END ELSE c.v END AS value, CASE WHEN i.k IS NOT NULL AND c.state IS DISTINCT FROM 'user-modified' THEN 'derived' ELSE c.state END AS state
  FROM (SELECT c_custkey AS k, c_acctbal AS v, CASE c_custkey % 3 WHEN 0 THEN 'user-modified' WHEN 1 THEN 'imported' ELSE 'default' END AS state FROM customer) c FULL JOIN (SELECT c_custkey * 2 AS k, c_acctbal - 500 AS v FROM customer) i ON c.k = i.k""")
def _(spark, d):
    c = read(spark, d, "customer")
    state = F.when(F.col("c_custkey") % 3 == 0, "user-modified").when(F.col("c_custkey") % 3 == 1, "imported").otherwise("default")
    now = c.select(F.col("c_custkey").alias("field_id"), F.col("c_acctbal").alias("value"), state.alias("state"))
    return M.sticky_merge(now, c.select((F.col("c_custkey") * 2).alias("field_id"), (F.col("c_acctbal") - 500).alias("value")), "field_id")


_STATES = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'accepted' WHEN 'purchase' THEN 'verified' ELSE 'none' END"


@query("state_machine", f"""SELECT user_id, arg_max(st, i) AS final_state FROM (SELECT user_id, st, i, max(CASE WHEN st IN ('accepted','verified') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS strong
  FROM (SELECT user_id, {_STATES} AS st, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)) WHERE NOT (st = 'pending' AND coalesce(strong, 0) = 1) GROUP BY 1""")
def _(spark, d):
    st = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "accepted").when(F.col("event_type") == "purchase", "verified").otherwise("none")
    rows = _events(spark, d).withColumn("st", st)
    return M.state_machine(rows, "user_id", {"none": 0, "pending": 1, "accepted": 2, "verified": 3}, "pending", "st", F.asc("ts"), F.asc("event_id"))


@query("debounce_sessions", "SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= 600000000")
def _(spark, d):
    return M.debounced(_events(spark, d), "user_id", "ts", 600.0, F.asc("event_id")).select("event_id", "user_id")


@query("queue_lifecycle", "SELECT user_id, CASE event_type WHEN 'purchase' THEN 'committed' WHEN 'click' THEN 'captured' ELSE 'pending' END AS queue_state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def _(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "click", "capture").when(F.col("event_type") == "error", "discard").otherwise("draft")
    return M.queue_lifecycle(_events(spark, d).withColumn("kind", kind), "user_id", "kind", F.desc("ts"), F.desc("event_id")).select("user_id", "queue_state")


@query("upsert_by_key", """SELECT k, v, seq FROM (SELECT c_custkey AS k, c_acctbal AS v, c_custkey AS seq FROM customer WHERE c_custkey % 5 <> 0 UNION ALL
  SELECT p.k, p.v, CASE WHEN b.k IS NOT NULL THEN b.seq ELSE (SELECT max(c_custkey) FROM customer) + p.seq + 1 END FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN c_custkey ELSE c_custkey + 1000000 END AS k, c_acctbal * 2 AS v, c_custkey AS seq FROM customer WHERE c_custkey % 5 = 0) p LEFT JOIN (SELECT c_custkey AS k, c_custkey AS seq FROM customer) b ON p.k = b.k
  UNION ALL SELECT c_custkey, c_acctbal, c_custkey FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 10 <> 0)""")
def _(spark, d):
    c = read(spark, d, "customer")
    base = c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("seq"))
    k = F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 1000000)
    return M.upsert_by_key(base, c.filter("c_custkey % 5 = 0").select(k.alias("k"), (F.col("c_acctbal") * 2).alias("v"), F.col("c_custkey").alias("seq")), "k")


@query("deep_merge", """SELECT coalesce(a.k, b.k) AS k, coalesce(b.name, a.name) AS name, coalesce(b.amount, a.amount) AS amount, array_to_string(coalesce(b.tags, a.tags), ',') AS tags FROM (SELECT c_custkey AS k, c_name AS name, c_acctbal AS amount, [c_mktsegment, 'x'] AS tags FROM customer) a
  FULL JOIN (SELECT c_custkey + 3 AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' END AS name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS amount, CASE WHEN c_custkey % 4 = 0 THEN ['y'] END AS tags FROM customer) b ON a.k = b.k""")
def _(spark, d):
    c = read(spark, d, "customer")
    a = c.select(F.col("c_custkey").alias("k"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount")).alias("r"), F.array("c_mktsegment", F.lit("x")).alias("tags"))
    k = F.col("c_custkey")
    b = c.select((k + 3).alias("k"), F.struct(F.when(k % 2 == 0, "new").alias("name"), F.when(k % 3 == 0, F.col("c_acctbal")).alias("amount")).alias("r"), F.when(k % 4 == 0, F.array(F.lit("y"))).alias("tags"))
    return M.deep_merge(a, b, "k").select("k", "r.name", "r.amount", F.array_join("tags", ",").alias("tags"))


@query("guarded_delete", "SELECT c_custkey FROM customer WHERE NOT (c_custkey % 4 = 0 AND c_mktsegment = 'BUILDING')")
def _(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return M.guarded_delete(c, c.filter("c_custkey % 4 = 0").select("c_custkey"), "c_custkey", F.col("c_mktsegment") == "BUILDING").select("c_custkey")


@query("prefix_clear", "SELECT p_partkey, p_name FROM part WHERE NOT starts_with(p_name, 'large') AND NOT starts_with(p_name, 'small')")
def _(spark, d):
    gone = reduce(lambda a, b: a | b, (F.col("p_name").startswith(x) for x in ("large", "small")))
    return read(spark, d, "part").filter(~gone).select("p_partkey", "p_name")


@query("prefix_bucket", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'large') THEN 'geometry' WHEN starts_with(p_name, 'small') THEN 'energy' WHEN starts_with(p_name, 'hot') THEN 'water' ELSE 'other' END AS field_group FROM part")
def _(spark, d):
    n = F.col("p_name")
    return read(spark, d, "part").select("p_partkey", F.when(n.startswith("large"), "geometry").when(n.startswith("small"), "energy").when(n.startswith("hot"), "water").otherwise("other").alias("field_group"))


_MATCH = """(SELECT s_suppkey AS {k}, lower(CASE WHEN s_suppkey % 6 = {h} THEN '' ELSE s_name END) AS maker, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'd' || CAST(s_suppkey % 50 AS VARCHAR) END AS declaration, 'n' || CAST(s_suppkey % 20 AS VARCHAR) AS name, CAST(s_nationkey AS VARCHAR) AS grp FROM supplier)"""


@query("two_tier_match", f"""SELECT r_id, k_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY r_id ORDER BY tier, k_id) AS n FROM (
  SELECT r.r_id, k.k_id, 1 AS tier FROM {_MATCH.format(k='r_id', h=9)} r JOIN {_MATCH.format(k='k_id', h=2)} k ON nullif(r.maker,'') = nullif(k.maker,'') AND nullif(r.declaration,'') = nullif(k.declaration,'') UNION ALL
  SELECT r.r_id, k.k_id, 2 FROM {_MATCH.format(k='r_id', h=9)} r JOIN {_MATCH.format(k='k_id', h=2)} k ON r.name = k.name AND r.grp = k.grp WHERE r.maker = '' OR k.maker = '' OR r.maker = k.maker)) WHERE n = 1""")
def _(spark, d):
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey")

    def side(name, hole):
        return s.select(k.alias(name), F.when(k % 6 == hole, "").otherwise(F.col("s_name")).alias("maker"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("d"), (k % 50).cast("string"))).alias("declaration"), F.concat(F.lit("n"), (k % 20).cast("string")).alias("name"), F.col("s_nationkey").cast("string").alias("grp"))

    return J.two_tier_match(side("r_id", 9), side("k_id", 2)).select("r_id", "k_id", "tier")


@query("six_key_match", """SELECT a.o_orderkey AS a_id, b.o_orderkey AS b_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AND a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority AND year(a.o_orderdate) = year(b.o_orderdate) AND a.o_orderkey < b.o_orderkey""")
def _(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"), F.array_sort(F.array("o_orderpriority", "o_orderstatus")).alias("tags"))
    a, b = o.alias("a"), o.alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("o_custkey", "o_orderstatus", "o_orderpriority", "y", "tags")))
    return a.join(b, same & (F.col("a.o_orderkey") < F.col("b.o_orderkey"))).select(F.col("a.o_orderkey").alias("a_id"), F.col("b.o_orderkey").alias("b_id"))


@query("drift_anti_both", "SELECT c_custkey AS k, 'stale' AS drift FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey + 3, 'miss' FROM orders WHERE o_custkey + 3 NOT IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = read(spark, d, "orders")
    stale = J.drift(c, o.select(F.col("o_custkey").alias("k")), "k").filter("drift = 'stale'")
    miss = J.drift(c, o.select((F.col("o_custkey") + 3).alias("k")), "k").filter("drift = 'miss'")
    return stale.union(miss)


@query("shape_diff", """SELECT coalesce(a.c, b.c) AS path, CASE WHEN b.c IS NULL THEN 'missing' WHEN a.c IS NULL THEN 'extra' ELSE 'type' END AS verdict FROM (VALUES ('key','bigint'),('name','string'),('acctbal','double'),('nationkey','int'),('mktsegment','string')) a(c, t)
  FULL JOIN (VALUES ('key','bigint'),('name','string'),('acctbal','double'),('nationkey','bigint'),('phone','string')) b(c, t) ON a.c = b.c WHERE a.c IS NULL OR b.c IS NULL OR a.t <> b.t""")
def _(spark, d):
    from ..sources.readers import schema_paths

    cut = lambda df, p: schema_paths(df.select(*(F.col(c).alias(c.removeprefix(p)) for c in df.columns)))
    want = cut(read(spark, d, "customer").withColumnRenamed("c_custkey", "c_key"), "c_")
    got = cut(read(spark, d, "supplier").withColumnRenamed("s_suppkey", "s_key").withColumn("s_nationkey", F.col("s_nationkey").cast("long")).withColumn("s_phone", F.lit("")), "s_")
    a, b = want.select("path", F.col("type").alias("t1")), got.select("path", F.col("type").alias("t2"))
    joined = a.join(b, "path", "full").filter("t1 IS NULL OR t2 IS NULL OR t1 <> t2")
    return joined.select("path", F.when(F.col("t2").isNull(), "missing").when(F.col("t1").isNull(), "extra").otherwise("type").alias("verdict"))


#: Suppliers depend on their nation, nations on their region and on the next nation but one of it; regions on the first nation.
_EDGES = """(SELECT 'nation_' || n_nationkey AS src, 'region_' || n_regionkey AS dst FROM nation UNION ALL SELECT 'nation_' || n_nationkey, 'nation_' || ((n_nationkey * 3 + 1) % 25) FROM nation UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey FROM supplier UNION ALL SELECT 'region_' || r_regionkey, 'nation_' || r_regionkey FROM region)"""


def _edges(spark, d):
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    n, s, r = (read(spark, d, t) for t in ("nation", "supplier", "region"))
    k = F.col("n_nationkey")
    parts = [
        n.select(name("nation_", k).alias("src"), name("region_", F.col("n_regionkey")).alias("dst")),
        n.select(name("nation_", k), name("nation_", (k * 3 + 1) % 25)),
        s.select(name("supplier_", F.col("s_suppkey")), name("nation_", F.col("s_nationkey"))),
        r.select(name("region_", F.col("r_regionkey")), name("nation_", F.col("r_regionkey"))),
    ]
    return reduce(lambda a, b: a.union(b), parts)


@query("dirty_closure", f"WITH RECURSIVE e AS {_EDGES}, c(node) AS (SELECT 'supplier_1' UNION SELECT e.dst FROM c JOIN e ON e.src = c.node) SELECT node FROM c")
def _(spark, d):
    seeds = spark.createDataFrame([("supplier_1",)], "node string")
    return G.reached(_edges(spark, d), seeds).select("node")


@query("dirty_increment", f"""WITH RECURSIVE e AS {_EDGES}, a(node) AS (SELECT 'nation_4' UNION SELECT e.dst FROM a JOIN e ON e.src = a.node), b(node) AS (SELECT 'supplier_' || CAST(s_suppkey AS VARCHAR) FROM supplier UNION SELECT e.dst FROM b JOIN e ON e.src = b.node)
  SELECT node FROM b WHERE node NOT IN (SELECT node FROM a)""")
def _(spark, d):
    edges = _edges(spark, d)
    dirty = kept(G.reached(edges, spark.createDataFrame([("nation_4",)], "node string")).select("node"))
    changed = read(spark, d, "supplier").select(F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("node"))
    return G.newly_reached(edges, changed, dirty)


@query("bounded_bfs", f"WITH RECURSIVE e AS {_EDGES}, c(node, depth) AS (SELECT 'nation_2', 0 UNION SELECT e.dst, c.depth + 1 FROM c JOIN e ON e.src = c.node WHERE c.depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY 1")
def _(spark, d):
    return G.reached(_edges(spark, d), spark.createDataFrame([("nation_2",)], "node string"), 3)


@query("graph_nodes_links", f"WITH e AS (SELECT DISTINCT * FROM {_EDGES}) SELECT node, split_part(node, '_', 1) AS node_group, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1, 2")
def _(spark, d):
    return G.nodes_and_links(_edges(spark, d))


@query("param_coalesce", "SELECT coalesce(a.k, b.k) AS k, coalesce(nullif(a.v, ''), nullif(b.v, '')) AS v FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS v FROM customer) a FULL JOIN (SELECT s_suppkey * 5 AS k, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name END AS v FROM supplier) b ON a.k = b.k")
def _(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("a"))
    b = read(spark, d, "supplier").select((F.col("s_suppkey") * 5).alias("k"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.col("s_name")).alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce(F.nullif("a", F.lit("")), F.nullif("b", F.lit(""))).alias("v"))
