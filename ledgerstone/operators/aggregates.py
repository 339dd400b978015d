"""Aggregations: gated sums, imputation, order statistics, anchored clusters, roll-ups and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import anchored_starts, scanned
from .storage import numbered


def gated_sum(value: Column, gate: Column) -> Column:
    """The sum over rows that pass the gate; 0 where none does."""
    return F.coalesce(F.sum(F.when(gate, F.coalesce(value, F.lit(0.0)))), F.lit(0.0))


def exact_sum(value: Column) -> Column:
    """The sum of doubles that state decimals of up to six places, without the error that grows with their number and varies with their order.

    A group with a value that isn't finite, or has no such decimal, gets the plain sum."""
    stated = F.when(F.abs(value) < 1e20, value).try_cast("decimal(28,6)")
    whole = F.count(F.when(stated.cast("double") == value, 1)) == F.count(value)
    return F.when(whole, F.sum(stated).cast("double")).otherwise(F.sum(value))


def impute_peer_average(df: DataFrame, by: list[str], value: str, flag: str) -> DataFrame:
    """Flagged rows without a value get the mean of their group's finite values that aren't flagged, and the number of those peers.

    The means are aggregated first and joined back, so a large group isn't gathered in one task."""
    usable = ~F.col(flag) & F.col(value).isNotNull() & ~F.isnan(F.col(value)) & (F.abs(F.col(value)) < float("inf"))
    peers = df.groupBy(*by).agg(F.avg(F.when(usable, F.col(value))).alias("__mean"), F.count(F.when(usable, 1)).alias("n_peers"))
    hole = F.col(flag) & F.col(value).isNull()
    joined = df.join(peers, by, "left")
    return joined.withColumns({value: F.when(hole, F.col("__mean")).otherwise(F.col(value)), "n_peers": F.when(hole, F.col("n_peers")).otherwise(F.lit(0)).cast("long")}).drop("__mean")


def rows_at(df: DataFrame, by: list[str], places: dict[str, Column], *order: Column) -> DataFrame:
    """The rows at given places (from 0, in terms of the group's size __n) of each group's order, with the place's name as __place.

    Rows are numbered over the whole table, dealt by ranges; a group is a stretch of numbers, so none is gathered in one task."""
    rows = numbered(df, *(F.col(b).asc() for b in by), *order, name="__rn")
    groups = rows.groupBy(*by).agg(F.min("__rn").alias("__first"), F.count(F.lit(1)).alias("__n"))
    wanted = groups.select(F.explode(F.array(*(F.struct(F.lit(n).alias("__place"), (F.col("__first") + p).cast("long").alias("__rn")) for n, p in places.items()))).alias("w")).select("w.*")
    return rows.join(wanted.hint("merge"), "__rn").drop("__rn")


def trimmed_extent(df: DataFrame, by: list[str], value: str, share: float = 0.05) -> DataFrame:
    """Per group the sorted values at floor(share * n) and ceil((1 - share) * n) - 1; the extremes of groups below four."""
    n = F.col("__n")
    places = {"low": F.when(n < 4, 0).otherwise(F.floor(n * share)), "high": F.when(n < 4, n - 1).otherwise(F.ceil(n * (1 - share)) - 1)}
    r = rows_at(df.filter(F.col(value).isNotNull()).select(*by, value), by, places, F.asc(value))
    return r.groupBy(*by).agg(*(F.max(F.when(F.col("__place") == p, F.col(value))).alias(p) for p in places))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the sorted value at floor(n / 2)."""
    r = rows_at(df.filter(F.col(value).isNotNull()).select(*by, value), by, {"median": F.floor(F.col("__n") / 2)}, F.asc(value))
    return r.select(*by, F.col(value).alias("median"))


def lower_median_row(df: DataFrame, by: list[str], value: str, *tie: Column) -> DataFrame:
    """Per group the row at floor((n - 1) / 2) of the order by value (none or NaN as 0)."""
    clean = F.coalesce(F.nanvl(F.col(value), F.lit(0.0)), F.lit(0.0))
    return rows_at(df, by, {"row": F.floor((F.col("__n") - 1) / 2)}, clean.asc(), *tie).drop("__place")


def anchored_clusters(values: Column, gap: float) -> Column:
    """Clusters of an array of numbers: sorted, a new one begins when a value lies more than the gap above the first of the current one. Their means."""
    start = F.struct(F.array().cast("array<struct<first:double,total:double,n:long>>").alias("done"))
    one = lambda v: F.struct(v.alias("first"), v.alias("total"), F.lit(1).cast("long").alias("n"))

    def step(acc, v):
        done = acc["done"]
        last = F.element_at(done, -1)
        begins = (F.size(done) == 0) | (v - F.try_element_at(done, F.lit(-1))["first"] > gap)
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), (last["total"] + v).alias("total"), (last["n"] + 1).alias("n"))))
        return F.struct(F.when(begins, F.concat(done, F.array(one(v)))).otherwise(grown).alias("done"))

    ordered = F.array_sort(values)
    return F.transform(F.aggregate(ordered, start, step)["done"], lambda c: c["total"] / c["n"])


def cluster_means(rows: DataFrame, by: str, value: str, gap: float) -> DataFrame:
    """(by, anchor, mean, n): anchored clusters, a row for each, with the value that began it. Equal values count once while beginnings are sought, and no group is gathered."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("__n"))
    begun = anchored_starts(counted, [by], value, F.lit(float(gap)), [F.col(value)])
    own = scanned(begun, [by], [F.col(value)], {"anchor": ("last", F.when(F.col("begins"), F.col(value)))})
    return own.groupBy(by, "anchor").agg((F.sum(F.col(value) * F.col("__n")) / F.sum("__n")).alias("mean"), F.sum("__n").alias("n"))


def rolled_up(df: DataFrame, levels: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums for every level of a hierarchy and for the whole; levels rolled up are null."""
    return df.rollup(*levels).agg(*(c.alias(n) for n, c in sums.items()))


def populated(column: Column, kind: str) -> Column:
    """Whether a field holds anything: not null, and no empty array, map or string."""
    there = column.isNotNull()
    if kind in ("array", "map"):
        return there & (F.size(column) > 0)
    return there & (column != "") if kind == "string" else there


def coverage(df: DataFrame, by: list[str], fields: dict[str, Column]) -> DataFrame:
    """For each group its rows and, for each field, how many of them have it."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *(F.sum(c.cast("long")).alias(f"n_{n}") for n, c in fields.items()))


def pivoted(df: DataFrame, by: list[str], column: str, values: list[str], value: Column) -> DataFrame:
    """One column of sums for each of the given values."""
    return df.groupBy(*by).agg(*(F.sum(F.when(F.col(column) == v, value)).alias(v) for v in values))
