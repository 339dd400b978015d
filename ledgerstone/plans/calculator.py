"""Emission queries: units, factors, rows, roll-ups, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from .registry import query
from .tables import read

#: Line items as picker rows: quantity, share, factor, selection, units.
_ROWS = """(SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_type, l_quantity AS qty, 1 - l_discount AS pct, CASE WHEN p_size % 17 = 0 THEN NULL ELSE p_retailprice / 1000 END AS gwp, l_returnflag <> 'R' AS selected,
  CASE WHEN l_linenumber % 3 = 0 THEN 'm3' WHEN l_linenumber % 3 = 1 THEN 'm2' ELSE 'M2·RSI per unit' END AS unit_raw, CASE WHEN l_linenumber % 3 = 0 THEN 'THICKNESS' ELSE 'R-VALUE' END AS label, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS cfg,
  CASE WHEN p_size % 2 = 0 THEN 'in' ELSE 'ft' END AS cfg_unit FROM lineitem LEFT JOIN part ON l_partkey = p_partkey) r"""
_UNIT = "regexp_replace(translate(lower(trim(unit_raw)), '²³•·', '23**'), '\\s.*$', '')"
_METRES = "CASE WHEN cfg_unit = 'in' THEN cfg * 0.0254::DOUBLE WHEN cfg_unit = 'ft' THEN cfg * 0.3048::DOUBLE ELSE cfg END"
_NATIVE = f"""CASE WHEN qty IS NULL OR qty <= 0 THEN NULL WHEN {_UNIT} = 'm2' THEN qty WHEN {_UNIT} = 'm3' AND label = 'THICKNESS' AND cfg IS NOT NULL AND cfg <> 0 THEN qty * ({_METRES}) WHEN {_UNIT} = 'm2*rsi' AND label = 'R-VALUE' AND cfg IS NOT NULL AND cfg <> 0 THEN qty * cfg / 5.678::DOUBLE END"""
_NET = f"CASE WHEN selected AND coalesce(gwp, 0) <> 0 AND coalesce({_NATIVE}, 0) > 0 AND pct > 0 THEN ({_NATIVE}) * pct * gwp ELSE 0 END"


def picker_rows(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size", "p_retailprice")
    size, line = F.col("p_size"), F.col("l_linenumber")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_returnflag").join(p, "l_partkey", "left").select(
        "l_orderkey", "l_linenumber", "l_partkey", "p_brand", "p_type", F.col("l_quantity").alias("qty"), (1 - F.col("l_discount")).alias("pct"), F.when(size % 17 != 0, F.col("p_retailprice") / 1000).alias("gwp"), (F.col("l_returnflag") != "R").alias("selected"),
        F.when(line % 3 == 0, "m3").when(line % 3 == 1, "m2").otherwise("M2·RSI per unit").alias("unit_raw"), F.when(line % 3 == 0, "THICKNESS").otherwise("R-VALUE").alias("label"), F.when(size % 5 != 0, size.cast("double")).alias("cfg"), F.when(size % 2 == 0, "in").otherwise("ft").alias("cfg_unit"),
    )


def native_quantity() -> Column:
    return S.convert_quantity(F.col("qty"), F.lit("m2"), F.col("unit_raw"), F.col("label"), F.col("cfg"), F.col("cfg_unit"))


def net_emissions(quantity: Column, share: Column, factor: Column, selected: Column, storage: Column | None = None) -> Column:
    """Quantity x share x factor of selected rows; 0 without a factor or a positive quantity and share. Storage, where given, is taken off."""
    counts = selected & (F.coalesce(factor, F.lit(0.0)) != 0) & (F.coalesce(quantity, F.lit(0.0)) > 0) & (share > 0)
    gross = F.when(counts, quantity * share * factor).otherwise(F.lit(0.0))
    return gross if storage is None else gross - F.when(counts, F.coalesce(storage, F.lit(0.0))).otherwise(F.lit(0.0))


@query("unit_normalize", f"SELECT l_orderkey, l_linenumber, {_UNIT} AS unit FROM {_ROWS}")
def _(spark, d):
    return picker_rows(spark, d).select("l_orderkey", "l_linenumber", S.normalize_unit(F.col("unit_raw")).alias("unit"))


@query("unit_convert", f"SELECT l_orderkey, l_linenumber, round({_NATIVE}, 6) AS native, round(qty * 10.7639::DOUBLE, 4) AS qty_ft2, round(qty / 0.3048::DOUBLE, 4) AS qty_ft, round(qty * 0.06243::DOUBLE, 6) AS density_lb FROM {_ROWS}")
def _(spark, d):
    q = F.col("qty")
    return picker_rows(spark, d).select("l_orderkey", "l_linenumber", F.round(native_quantity(), 6).alias("native"), F.round(q * 10.7639, 4).alias("qty_ft2"), F.round(q / S.FOOT, 4).alias("qty_ft"), F.round(q * 0.06243, 6).alias("density_lb"))


@query("emissions_rows", f"SELECT l_orderkey, l_linenumber, round({_NET}, 6) AS net FROM {_ROWS}")
def _(spark, d):
    return picker_rows(spark, d).select("l_orderkey", "l_linenumber", F.round(net_emissions(native_quantity(), F.col("pct"), F.col("gwp"), F.col("selected")), 6).alias("net"))


@query("emissions_rollup", f"SELECT p_brand, p_type, round(sum({_NET}), 2) AS net, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(CAST(selected AS INT)) AS BIGINT) AS n_selected FROM {_ROWS} GROUP BY ROLLUP (p_brand, p_type)")
def _(spark, d):
    rows = picker_rows(spark, d).withColumn("net", net_emissions(native_quantity(), F.col("pct"), F.col("gwp"), F.col("selected")))
    return A.rolled_up(rows, ["p_brand", "p_type"], {"net": F.round(F.sum("net"), 2), "n_rows": F.count(F.lit(1)), "n_selected": F.sum(F.col("selected").cast("long"))})


@query("selected_review", f"SELECT l_orderkey, l_linenumber, p_brand, round(net, 6) AS net, round(net / qty, 6) AS per_unit FROM (SELECT *, {_NET} AS net FROM {_ROWS}) WHERE selected AND net > 500")
def _(spark, d):
    rows = picker_rows(spark, d).filter("selected").withColumn("net", net_emissions(native_quantity(), F.col("pct"), F.col("gwp"), F.col("selected")))
    return rows.filter("net > 500").select("l_orderkey", "l_linenumber", "p_brand", F.round("net", 6).alias("net"), F.round(F.try_divide("net", "qty"), 6).alias("per_unit"))


@query("top_emitters", f"SELECT l_orderkey, l_linenumber, round(net, 4) AS net FROM (SELECT *, {_NET} AS net FROM {_ROWS}) ORDER BY net DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10")
def _(spark, d):
    rows = picker_rows(spark, d).withColumn("net", net_emissions(native_quantity(), F.col("pct"), F.col("gwp"), F.col("selected")))
    return rows.orderBy(F.desc("net"), "l_orderkey", "l_linenumber", "l_partkey").limit(10).select("l_orderkey", "l_linenumber", F.round("net", 4).alias("net"))


@query("intensity_ratio", f"SELECT p_brand, round(sum({_NET}), 2) AS net, round(sum({_NET}) / sum(qty), 6) AS per_m2, round(sum({_NET}) * 2.2046226::DOUBLE / (sum(qty) * 10.7639::DOUBLE), 6) AS lb_per_ft2 FROM {_ROWS} GROUP BY 1")
def _(spark, d):
    rows = picker_rows(spark, d).withColumn("net", net_emissions(native_quantity(), F.col("pct"), F.col("gwp"), F.col("selected")))
    sums = rows.groupBy("p_brand").agg(F.sum("net").alias("s"), F.sum("qty").alias("a"))
    return sums.select("p_brand", F.round("s", 2).alias("net"), F.round(F.try_divide("s", "a"), 6).alias("per_m2"), F.round(F.try_divide(F.col("s") * 2.2046226, F.col("a") * 10.7639), 6).alias("lb_per_ft2"))


@query("report_with_subtotals", """SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'GROSS TOTAL' WHEN grouping(o_orderstatus) = 1 THEN o_orderpriority || ' TOTAL' ELSE o_orderpriority || '/' || o_orderstatus END AS label, printf('%.2f', sum(o_totalprice)) AS amount, CAST(grouping(o_orderpriority) * 2 + grouping(o_orderstatus) AS BIGINT) AS sort_key FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def _(spark, d):
    g = read(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(A.exact_sum(F.col("o_totalprice")).alias("s"), F.grouping("o_orderpriority").alias("g1"), F.grouping("o_orderstatus").alias("g2"))
    label = F.when(F.col("g1") == 1, "GROSS TOTAL").when(F.col("g2") == 1, F.concat("o_orderpriority", F.lit(" TOTAL"))).otherwise(F.concat("o_orderpriority", F.lit("/"), "o_orderstatus"))
    return g.select(label.alias("label"), F.format_string("%.2f", "s").alias("amount"), (F.col("g1") * 2 + F.col("g2")).cast("long").alias("sort_key"))


CARBON_TO_CO2 = 3.67


def biogenic_carbon(stated: Column, divisor: Column, density: Column, thickness: Column, bio_share: Column, carbon_share: Column, retention: Column) -> dict[str, Column]:
    """The carbon figures of a material: per common unit, the factor, stored and full carbon in CO2e, and carbon alone."""
    kg_c = density * thickness * bio_share * carbon_share
    full = kg_c * CARBON_TO_CO2
    return {"common": S.js_round(F.try_divide(stated, divisor), 2), "factor": S.js_round(F.try_divide(F.lit(1.0), divisor), 6), "full_carbon": S.js_round(full, 2), "stored": S.js_round(full * retention, 2), "kg_carbon": S.js_round(kg_c, 2)}


_JS = lambda x, n: f"(floor(({x}) * {10**n}::DOUBLE + 0.5::DOUBLE) / {10**n}::DOUBLE)"


@query("biogenic_carbon", f"""SELECT p_partkey, {_JS('p_retailprice / p_size', 2)} AS common, {_JS('1::DOUBLE / p_size', 6)} AS factor, {_JS('p_retailprice * 0.1::DOUBLE * 0.5::DOUBLE * 0.45::DOUBLE * 3.67::DOUBLE', 2)} AS full_carbon, {_JS('p_retailprice * 0.1::DOUBLE * 0.5::DOUBLE * 0.45::DOUBLE * 3.67::DOUBLE * 0.9::DOUBLE', 2)} AS stored, {_JS('p_retailprice * 0.1::DOUBLE * 0.5::DOUBLE * 0.45::DOUBLE', 2)} AS kg_carbon FROM part""")
def _(spark, d):
    c = biogenic_carbon(F.col("p_retailprice"), F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(0.1), F.lit(0.5), F.lit(0.45), F.lit(0.9))
    return read(spark, d, "part").select("p_partkey", *(v.alias(k) for k, v in c.items()))


@query("js_round", f"SELECT l_orderkey, l_linenumber, {_JS('l_extendedprice * (l_tax - 0.05::DOUBLE)', 2)} AS r2, {_JS('l_extendedprice / 7::DOUBLE', 0)} AS r0 FROM lineitem")
def _(spark, d):
    x = F.col("l_extendedprice")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.js_round(x * (F.col("l_tax") - 0.05), 2).alias("r2"), S.js_round(x / 7).alias("r0"))


@query("scale_math", "SELECT p_partkey, round(1::DOUBLE / ((25.4::DOUBLE / 72) * (p_size + 1) / 1000), 6) AS per_metre, CAST(p_size + 1 AS DOUBLE) AS ratio, round(1 - abs(p_size - (p_size + 1)) / CAST(p_size + 1 AS DOUBLE), 6) AS agreement FROM part")
def _(spark, d):
    ratio = (F.col("p_size") + 1).cast("double")
    per = S.units_per_metre(ratio)
    return read(spark, d, "part").select("p_partkey", F.round(per, 6).alias("per_metre"), S.scale_ratio(per).alias("ratio"), F.round(S.agreement(F.col("p_size").cast("double"), ratio), 6).alias("agreement"))


@query("pitch_factor", "SELECT p_partkey, CASE WHEN cos(radians(p_size * 2)) > 0.01 THEN round(1 / cos(radians(p_size * 2)), 6) END AS factor FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(S.pitch_factor((F.col("p_size") * 2).cast("double")), 6).alias("factor"))


@query("format_bands", "SELECT c_custkey, CASE WHEN x IS NULL THEN '—' WHEN abs(x) >= 1000 THEN printf('%.0f', x) WHEN abs(x) >= 10 THEN printf('%.1f', x) ELSE printf('%.3f', x) END AS shown FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal / (c_custkey % 7 + 1) + 0.0001 END AS x FROM customer)")
def _(spark, d):
    x = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") / (F.col("c_custkey") % 7 + 1) + 0.0001)
    return read(spark, d, "customer").select("c_custkey", S.format_band(x).alias("shown"))


@query("tolerance_match", "SELECT l_orderkey, l_linenumber, abs(l_extendedprice / l_quantity - 1500) <= 1e-12 OR abs(l_extendedprice / l_quantity - 1500) <= 0.2::DOUBLE * 1500 AS close FROM lineitem")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.tolerance_match(F.col("l_extendedprice") / F.col("l_quantity"), F.lit(1500.0), 0.2).alias("close"))


@query("trimmed_extent", """SELECT l_suppkey, max(CASE WHEN i = CASE WHEN n < 4 THEN 0 ELSE floor(n * 0.05::DOUBLE) END THEN v END) AS low, max(CASE WHEN i = CASE WHEN n < 4 THEN n - 1 ELSE ceil(n * 0.95::DOUBLE) - 1 END THEN v END) AS high FROM
  (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) GROUP BY 1""")
def _(spark, d):
    return A.trimmed_extent(read(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice")


@query("upper_median", "SELECT p_brand, max(CASE WHEN i = n // 2 THEN v END) AS median FROM (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_size > 10) GROUP BY 1")
def _(spark, d):
    return A.upper_median(read(spark, d, "part").filter("p_size > 10"), ["p_brand"], "p_retailprice")


@query("lower_median_row", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE i = (n - 1) // 2")
def _(spark, d):
    return A.lower_median_row(read(spark, d, "part"), ["p_brand"], "p_retailprice", F.asc("p_partkey")).select("p_brand", "p_partkey", "p_retailprice")


@query("anchored_clusters", """WITH RECURSIVE v AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS i FROM events WHERE event_type = 'purchase'),
  c AS (SELECT user_id, i, x, x AS anchor, CAST(1 AS BIGINT) AS k FROM v WHERE i = 1 UNION ALL SELECT v.user_id, v.i, v.x, CASE WHEN v.x - c.anchor > 5 THEN v.x ELSE c.anchor END, CASE WHEN v.x - c.anchor > 5 THEN c.k + 1 ELSE c.k END FROM c JOIN v ON v.user_id = c.user_id AND v.i = c.i + 1)
  SELECT user_id, string_agg(printf('%.6f', m), ',' ORDER BY k) AS means FROM (SELECT user_id, k, avg(x) AS m FROM c GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    rows = read(spark, d, "events").filter("event_type = 'purchase' AND value IS NOT NULL").select("user_id", F.col("value").alias("x"))
    means = A.cluster_means(rows, "user_id", "x", 5.0)
    own = F.array_sort(F.collect_list(F.struct("anchor", "mean")))  # a user's clusters make one string
    return means.groupBy("user_id").agg(F.array_join(F.transform(own, lambda c: F.format_string("%.6f", c["mean"])), ",").alias("means"))
