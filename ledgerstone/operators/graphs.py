"""Dependency graphs: transitive closure, bounded breadth-first search, export of nodes and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import kept

#: Steps of a job, and tables that are put together.
STEPS, COMPACT = 4, 6


def reached(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes reachable from the seeds (node) over edges (src, dst), with the depth at which they are first met; cycles end by themselves.

    A job takes STEPS steps at once from the newest nodes; what it finds is kept as one table, and these tables are put together as
    soon as there are COMPACT of them, so that neither jobs nor files grow with each step."""
    edges = kept(edges.select("src", "dst").distinct())
    parts, depth = [kept(seeds.select("node").distinct().withColumn("depth", F.lit(0)))], 0
    front = parts[0]
    while max_depth is None or depth < max_depth:
        known = reduce(DataFrame.unionByName, parts)
        steps = STEPS if max_depth is None else min(STEPS, max_depth - depth)
        new, at = [], front.select("node")
        for k in range(steps):
            at = edges.join(at.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct().join(known.select("node"), "node", "left_anti")
            new.append(at.withColumn("depth", F.lit(depth + k + 1)))
        found = kept(reduce(DataFrame.unionByName, new).groupBy("node").agg(F.min("depth").alias("depth")))
        depth += steps
        front = found.filter(F.col("depth") == depth)
        parts.append(found)
        if front.isEmpty():
            break
        if len(parts) >= COMPACT:
            parts = [kept(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def newly_reached(edges: DataFrame, seeds: DataFrame, closed: DataFrame) -> DataFrame:
    """Nodes (node) that the seeds add to a closed set of nodes, one that holds whatever its nodes reach: new dirty nodes beside those that are dirty already.

    Only new nodes are followed, and each is followed once: the way ends where the set begins, so the work follows what is new, not the set or its edges."""
    edges = kept(edges.select("src", "dst").distinct())
    front = kept(seeds.select("node").distinct().join(closed.select("node"), "node", "left_anti"))
    parts = [front]
    while not front.isEmpty():
        known = reduce(DataFrame.unionByName, parts)
        step = edges.join(front.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = kept(step.join(closed.select("node"), "node", "left_anti").join(known, "node", "left_anti"))
        parts.append(front)
        if len(parts) >= COMPACT:
            parts = [kept(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def nodes_and_links(edges: DataFrame) -> DataFrame:
    """One row for each node with its group (the prefix before '_'), and how many links leave and enter it."""
    out = edges.distinct().groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.lit(0).cast("long").alias("n_in"))
    into = edges.distinct().groupBy(F.col("dst").alias("node")).agg(F.lit(0).cast("long").alias("n_out"), F.count(F.lit(1)).alias("n_in"))
    both = out.unionByName(into).groupBy("node").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
    return both.withColumn("node_group", F.substring_index("node", "_", 1))
