"""Catalogue queries: filter, search, sort, group, look up, classify, fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import extraction as E
from ..operators import joins as J
from ..operators.storage import numbered, stored_by
from .registry import query
from .tables import read

#: Part rows as catalogue entries.
_CATALOG = """(SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'part' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE 'EPD-' || CAST(p_partkey AS VARCHAR) END AS id,
  p_name, p_type AS category, CASE WHEN p_size = 13 THEN NULL ELSE p_brand END AS grp, CASE WHEN p_size % 10 = 7 THEN NULL ELSE p_retailprice END AS gwp, p_size FROM part) c"""


def catalog(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return read(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("part"), F.lpad(key, 6, "0"))).otherwise(F.concat(F.lit("EPD-"), key)).alias("id"),
        "p_name", F.col("p_type").alias("category"), F.when(F.col("p_size") != 13, F.col("p_brand")).alias("grp"), F.when(F.col("p_size") % 10 != 7, F.col("p_retailprice")).alias("gwp"), "p_size",
    )


def from_registry(id_: Column) -> Column:
    """Entries whose id isn't six or more small letters and digits; a null id counts."""
    return ~F.coalesce(id_, F.lit("")).rlike("^[a-z0-9]{6,}$")


def catalog_filter(df: DataFrame, groups: list[str], registry_only: bool, search: str) -> DataFrame:
    """Entries of the groups (none given: all), of the registry if asked, whose text contains the search."""
    keep = F.lit(True)
    if groups:
        keep = keep & F.col("grp").isin(groups)
    if registry_only:
        keep = keep & from_registry(F.col("id"))
    if search:
        keep = keep & S.search_text(F.col("p_name"), F.col("id"), F.col("category")).contains(search.lower())
    return df.filter(keep)


@query("catalog_filter", f"""SELECT p_partkey, id, grp FROM {_CATALOG} WHERE grp IN ('Brand#1','Brand#2','Brand#3') AND NOT regexp_matches(coalesce(id,''), '^[a-z0-9]{{6,}}$')
  AND contains(lower(concat_ws(' ', nullif(p_name,''), nullif(id,''), nullif(category,''))), 'ring')""")
def _(spark, d):
    return catalog_filter(catalog(spark, d), ["Brand#1", "Brand#2", "Brand#3"], True, "Ring").select("p_partkey", "id", "grp")


@query("catalog_search", f"SELECT p_partkey, id FROM {_CATALOG} WHERE contains(lower(concat_ws(' ', nullif(p_name,''), nullif(id,''), nullif(category,''))), 'large')")
def _(spark, d):
    return catalog_filter(catalog(spark, d), [], False, "large").select("p_partkey", "id")


@query("id_pattern_filter", f"SELECT p_partkey, id FROM {_CATALOG} WHERE NOT regexp_matches(coalesce(id,''), '^[a-z0-9]{{6,}}$')")
def _(spark, d):
    return catalog(spark, d).filter(from_registry(F.col("id"))).select("p_partkey", "id")


@query("glossary_search", f"""SELECT CAST(count(*) FILTER (contains(lower(concat_ws(' ', p_name, category)), 'bolt')) AS BIGINT) AS n_shown, CAST(count(*) AS BIGINT) AS n_all FROM {_CATALOG}""")
def _(spark, d):
    hit = S.search_text(F.col("p_name"), F.col("category")).contains("bolt")
    return catalog(spark, d).agg(F.count(F.when(hit, 1)).alias("n_shown"), F.count(F.lit(1)).alias("n_all"))


@query("index_projection", """SELECT p_partkey, lower('P' || CAST(p_partkey AS VARCHAR)) AS id, coalesce(nullif(trim(p_name), ''), p_brand, '—') AS display_name, p_brand AS grp,
  CASE WHEN p_size < 10 THEN 'm2' WHEN p_size < 20 THEN 'm3' ELSE 'kg' END AS unit FROM part""")
def _(spark, d):
    unit = F.coalesce(F.when(F.col("p_size") < 10, "m2"), F.when(F.col("p_size") < 20, "m3"), F.lit("kg"))
    return read(spark, d, "part").select("p_partkey", F.lower(F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).alias("id"), F.coalesce(F.nullif(F.trim("p_name"), F.lit("")), "p_brand", F.lit("—")).alias("display_name"), F.col("p_brand").alias("grp"), unit.alias("unit"))


@query("partition_point_lookup", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_orderkey BETWEEN 100 AND 400")
def _(spark, d):
    # the table is stored by group once; a lookup then reads the one group's files
    by_group = stored_by(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_returnflag"), "l_returnflag")
    return by_group.filter("l_returnflag = 'R' AND l_linestatus = 'F' AND l_orderkey BETWEEN 100 AND 400").select("l_orderkey", "l_linenumber", "l_partkey")


@query("sort_nulls_last", f"""SELECT p_partkey, gwp, CAST(row_number() OVER (ORDER BY gwp DESC NULLS LAST, p_partkey) AS BIGINT) AS rn_desc, CAST(row_number() OVER (ORDER BY gwp ASC NULLS LAST, p_partkey) AS BIGINT) AS rn_asc FROM {_CATALOG}""")
def _(spark, d):
    rows = catalog(spark, d).select("p_partkey", "gwp")
    down = numbered(rows, F.desc_nulls_last("gwp"), F.asc("p_partkey"), name="rn_desc")
    return numbered(down, F.asc_nulls_last("gwp"), F.asc("p_partkey"), name="rn_asc")


@query("natural_sort", """SELECT s_suppkey, code, CAST(row_number() OVER (ORDER BY z, n, s_suppkey) AS BIGINT) AS rn FROM
  (SELECT s_suppkey, 'Item ' || CAST(s_suppkey % 37 AS VARCHAR) || ' part' || CAST(s_suppkey AS VARCHAR) AS code, s_suppkey % 37 AS z, s_suppkey AS n FROM supplier)""")
def _(spark, d):
    k = F.col("s_suppkey")
    rows = read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Item "), (k % 37).cast("string"), F.lit(" part"), k.cast("string")).alias("code"))
    return numbered(rows.withColumn("key", S.natural_key(F.col("code"))), F.asc("key"), F.asc("s_suppkey")).drop("key")


@query("top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5)


@query("latest_first_list", """SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC NULLS LAST, event_id LIMIT 50""")
def _(spark, d):
    return read(spark, d, "events").filter("event_type = 'purchase'").orderBy(F.desc_nulls_last("ts"), "event_id").limit(50).select("event_id", "user_id")


@query("group_counts", f"SELECT coalesce(grp, '??') AS grp, CAST(count(*) AS BIGINT) AS n FROM {_CATALOG} GROUP BY 1")
def _(spark, d):
    return catalog(spark, d).groupBy(F.coalesce("grp", F.lit("??")).alias("grp")).agg(F.count(F.lit(1)).alias("n")).orderBy("grp")


@query("group_collect", f"""SELECT coalesce(grp, '??') AS grp, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY gwp DESC NULLS LAST, p_partkey) AS members FROM {_CATALOG} GROUP BY 1""")
def _(spark, d):
    place = F.struct((-F.coalesce("gwp", F.lit(-1e300))).alias("o"), F.col("p_partkey").alias("k"))
    return catalog(spark, d).groupBy(F.coalesce("grp", F.lit("??")).alias("grp")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["k"].cast("string")), ",").alias("members"))


@query("two_key_lookup", """SELECT o.o_orderkey, coalesce(CASE WHEN a.k IS NOT NULL THEN a.v END, b.v) AS v FROM orders o
  LEFT JOIN (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 4 = 0) a ON o.o_custkey = a.k
  LEFT JOIN (SELECT c_custkey * 2 AS k, c_name AS v FROM customer) b ON o.o_orderkey = b.k""")
def _(spark, d):
    c = read(spark, d, "customer")
    first = c.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("v"))
    second = c.select((F.col("c_custkey") * 2).alias("o_orderkey"), F.col("c_name").alias("v"))
    return J.two_key_lookup(read(spark, d, "orders").select("o_orderkey", "o_custkey"), first, second, "o_custkey", "o_orderkey", ["v"]).select("o_orderkey", "v")


@query("index_enrich_left", """SELECT o_orderkey, c_mktsegment, c_acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def _(spark, d):
    c = read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return read(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").select("o_orderkey", "c_mktsegment", "c_acctbal")


#: Which groups a project dimension feeds.
_FANOUT = [("AFRICA", "footings"), ("AFRICA", "slabs"), ("ASIA", "walls"), ("EUROPE", "roof"), ("EUROPE", "walls"), ("AMERICA", "windows")]


@query("dim_fanout_join", "SELECT n_nationkey, target FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES " + ",".join(f"('{a}','{b}')" for a, b in _FANOUT) + ") t(g, target) ON upper(trim(r_name)) = g")
def _(spark, d):
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.upper(F.trim("r_name")).alias("g"))
    return read(spark, d, "nation").join(r, "n_regionkey").join(F.broadcast(spark.createDataFrame(_FANOUT, "g string, target string")), "g").select("n_nationkey", "target")


_WORDS = [("ring", "fastener"), ("bolt", "fastener"), ("plate", "panel"), ("panel", "panel"), ("large", "bulk"), ("small", "loose")]
_WORDS_SQL = "CASE " + " ".join(f"WHEN contains(lower(p_name), '{w}') THEN '{c}'" for w, c in _WORDS) + " ELSE 'unresolved' END"


@query("keyword_classify", f"SELECT p_partkey, {_WORDS_SQL} AS cls FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", J.keyword_class(F.col("p_name"), _WORDS, "unresolved").alias("cls"))


_RULES = [("(?i)licensed under", "license"), ("[!]{2}", "shouting"), (r"^.{0,200}[#$%&*]{3}", "symbols"), (r"\|", "table")]
_RULES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for p, c in _RULES) + " ELSE 'other' END"


@query("priority_rules", f"SELECT doc_id, {_RULES_SQL} AS cls FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", J.pattern_class(F.col("text"), _RULES, "other").alias("cls"))


@query("first_set_wins", """SELECT doc_id, coalesce(nullif(regexp_extract(text, '([A-Za-z]+\\.[0-9]+)@', 1), ''), nullif(regexp_extract(text, '(\\+[0-9][0-9 ()-]+[0-9])', 1), ''), lang) AS contact,
  CASE WHEN nullif(regexp_extract(text, '([A-Za-z]+\\.[0-9]+)@', 1), '') IS NOT NULL THEN 'mail' WHEN nullif(regexp_extract(text, '(\\+[0-9][0-9 ()-]+[0-9])', 1), '') IS NOT NULL THEN 'phone' ELSE 'default' END AS source FROM documents""")
def _(spark, d):
    mail, phone = S.matched(F.col("text"), r"([A-Za-z]+\.[0-9]+)@"), S.matched(F.col("text"), r"(\+[0-9][0-9 ()-]+[0-9])")
    return read(spark, d, "documents").select("doc_id", F.coalesce(mail, phone, "lang").alias("contact"), F.when(mail.isNotNull(), "mail").when(phone.isNotNull(), "phone").otherwise("default").alias("source"))


_DEFAULTS = [("LARGE", 2400.0), ("SMALL", 500.0), ("ECONOMY", 1200.0)]
_ALIAS = [("STANDARD", "LARGE"), ("PROMO", "SMALL"), ("MEDIUM", "ECONOMY")]
_values = lambda rows: ",".join("(" + ",".join(repr(x) if isinstance(x, str) else f"CAST({x} AS DOUBLE)" for x in r) + ")" for r in rows)


@query("alias_default_fill", f"""SELECT p_partkey, coalesce(density, d1.v, d2.v) AS density, CASE WHEN density IS NOT NULL THEN 'declared' WHEN coalesce(d1.v, d2.v) IS NOT NULL THEN 'generic_default' END AS source
  FROM (SELECT p_partkey, p_type, CASE WHEN p_size % 3 = 0 THEN p_retailprice END AS density FROM part) p LEFT JOIN (VALUES {_values(_DEFAULTS)}) d1(t, v) ON p.p_type = d1.t
  LEFT JOIN (VALUES {_values(_ALIAS)}) a(t, u) ON p.p_type = a.t LEFT JOIN (VALUES {_values(_DEFAULTS)}) d2(t, v) ON a.u = d2.t""")
def _(spark, d):
    parts = read(spark, d, "part").select("p_partkey", "p_type", F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice")).alias("density"))
    filled = E.default_fill(parts, F.col("p_type"), "density", spark.createDataFrame(_DEFAULTS, "type string, default double"), spark.createDataFrame(_ALIAS, "type string, as_type string"))
    return filled.select("p_partkey", "density", "source")


_SUB = [("LARGE", 7, "wall,roof"), ("SMALL", 3, "floor")]
_TYPE = [("LARGE", "wall"), ("ECONOMY", "slab")]


@query("override_default", f"""SELECT p_partkey, coalesce(s.e, t.e, '') AS elements FROM part LEFT JOIN (VALUES {",".join(f"('{a}',{b},'{c}')" for a, b, c in _SUB)}) s(t, z, e) ON p_type = s.t AND p_size = s.z
  LEFT JOIN (VALUES {",".join(f"('{a}','{b}')" for a, b in _TYPE)}) t(t, e) ON p_type = t.t""")
def _(spark, d):
    sub = spark.createDataFrame(_SUB, "p_type string, p_size int, e1 string")
    kind = spark.createDataFrame(_TYPE, "p_type string, e2 string")
    return read(spark, d, "part").join(F.broadcast(sub), ["p_type", "p_size"], "left").join(F.broadcast(kind), "p_type", "left").select("p_partkey", F.coalesce("e1", "e2", F.lit("")).alias("elements"))


@query("lookup_or_warn", """SELECT n_nationkey, coalesce(m.codes, '') AS codes, CASE WHEN m.codes IS NULL THEN 'unmapped ' || n_name END AS warning FROM nation LEFT JOIN (VALUES ('NATION_1','CAN'),('NATION_2','CAN,USA'),('NATION_5','DEU')) m(n, codes) ON n_name = m.n""")
def _(spark, d):
    known = spark.createDataFrame([("NATION_1", "CAN"), ("NATION_2", "CAN,USA"), ("NATION_5", "DEU")], "n_name string, codes string")
    joined = read(spark, d, "nation").join(F.broadcast(known), "n_name", "left")
    return joined.select("n_nationkey", F.coalesce("codes", F.lit("")).alias("codes"), F.when(F.col("codes").isNull(), F.concat(F.lit("unmapped "), "n_name")).alias("warning"))


@query("peer_avg_impute", """SELECT p_partkey, round(CASE WHEN flag AND v IS NULL THEN avg(CASE WHEN NOT flag THEN v END) OVER (PARTITION BY p_brand) ELSE v END, 6) AS v,
  CAST(CASE WHEN flag AND v IS NULL THEN count(CASE WHEN NOT flag THEN v END) OVER (PARTITION BY p_brand) ELSE 0 END AS BIGINT) AS n_peers
  FROM (SELECT p_partkey, p_brand, p_size % 10 = 0 AS flag, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_retailprice END AS v FROM part)""")
def _(spark, d):
    rows = read(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") % 10 == 0).alias("flag"), F.when(F.col("p_size") % 10 != 0, F.col("p_retailprice")).alias("v"))
    return A.impute_peer_average(rows, ["p_brand"], "v", "flag").select("p_partkey", F.round("v", 6).alias("v"), "n_peers")


@query("array_preview", """SELECT p_brand, array_to_string(list_slice(l, 1, 3), ', ') || CASE WHEN len(l) > 3 THEN ' +' || CAST(len(l) - 3 AS VARCHAR) ELSE '' END AS preview FROM (SELECT p_brand, list(DISTINCT p_type ORDER BY p_type) AS l FROM part GROUP BY 1)""")
def _(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("l")).select("p_brand", S.array_preview(F.col("l")).alias("preview"))


@query("distinct_nonnull", """SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    first = read(spark, d, "events").filter("event_type IS NOT NULL").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query("stage_pivot", """SELECT l_returnflag, round(sum(CASE WHEN l_linenumber = 1 THEN l_quantity END), 4) AS A1, round(sum(CASE WHEN l_linenumber = 2 THEN l_quantity END), 4) AS A2, round(sum(CASE WHEN l_linenumber = 3 THEN l_quantity END), 4) AS A3 FROM lineitem GROUP BY 1""")
def _(spark, d):
    long = read(spark, d, "lineitem").withColumn("stage", F.concat(F.lit("A"), F.col("l_linenumber").cast("string")))
    wide = A.pivoted(long, ["l_returnflag"], "stage", ["A1", "A2", "A3"], F.col("l_quantity"))
    return wide.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("A1", "A2", "A3")))


@query("stage_scope_sum", """SELECT scope, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN (VALUES ('cradle_to_gate', 1), ('cradle_to_gate', 2), ('cradle_to_gate', 3), ('construction', 4), ('construction', 5), ('whole', 1), ('whole', 2), ('whole', 3), ('whole', 4), ('whole', 5), ('whole', 6), ('whole', 7)) s(scope, st) ON l_linenumber = st GROUP BY 1""")
def _(spark, d):
    scopes = [("cradle_to_gate", [1, 2, 3]), ("construction", [4, 5]), ("whole", [1, 2, 3, 4, 5, 6, 7])]
    by_stage = read(spark, d, "lineitem").groupBy("l_linenumber").agg(F.sum("l_extendedprice").alias("s"))
    lookup = spark.createDataFrame(scopes, "scope string, stages array<int>").select("scope", F.explode("stages").alias("l_linenumber"))
    return by_stage.join(F.broadcast(lookup), "l_linenumber").groupBy("scope").agg(F.round(F.sum("s"), 2).alias("total"))


@query("jurisdiction_filter", f"""SELECT s_suppkey, CASE WHEN country IS NULL THEN true WHEN country <> 'CAN' THEN false WHEN province IS NULL OR province = 'CA-wide' THEN true WHEN province IN ('BC','ON','QC') THEN province = 'BC' ELSE true END AS visible
  FROM (SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'CAN' ELSE 'USA' END AS country, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'BC' WHEN 2 THEN 'ON' WHEN 3 THEN 'CA-wide' ELSE 'ZZ' END AS province FROM supplier)""")
def _(spark, d):
    country = F.when(F.col("s_nationkey") % 3 == 1, "CAN").when(F.col("s_nationkey") % 3 == 2, "USA")
    province = F.when(F.col("s_suppkey") % 5 == 1, "BC").when(F.col("s_suppkey") % 5 == 2, "ON").when(F.col("s_suppkey") % 5 == 3, "CA-wide").when(F.col("s_suppkey") % 5 == 4, "ZZ")
    return read(spark, d, "supplier").select("s_suppkey", jurisdiction_match(country, province, "CAN", "BC", ["BC", "ON", "QC"]).alias("visible"))


def jurisdiction_match(country: Column, province: Column, want_country: str | None, want_province: str | None, known: list[str]) -> Column:
    """Whether a row counts for a place: untagged rows always, else the country must fit; provinces matter in Canada, where unknown and wide ones pass."""
    if not want_country:
        return F.lit(True)
    inside = F.lit(True) if want_country != "CAN" or not want_province else F.when(province.isNull() | (province == "CA-wide") | ~province.isin(known), True).otherwise(province == want_province)
    return F.when(country.isNull(), True).when(country != want_country, False).otherwise(inside)


_COUNTRIES = [("canada", "CAN"), ("united states", "USA"), ("germany", "DEU"), ("europe", "EUR")]


def infer_jurisdiction(name: Column) -> Column:
    """The country in brackets at a name's end, or after a dash; else of the first keyword."""
    tag = S.matched(name, r"[\[(]([A-Z]{2,3})[\])]\s*$")
    return F.coalesce(tag, J.keyword_class(name, _COUNTRIES))


@query("jurisdiction_infer", """SELECT s_suppkey, coalesce(nullif(regexp_extract(label, '[\\[(]([A-Z]{2,3})[\\])]\\s*$', 1), ''), CASE WHEN contains(lower(label), 'canada') THEN 'CAN' WHEN contains(lower(label), 'united states') THEN 'USA' WHEN contains(lower(label), 'germany') THEN 'DEU' WHEN contains(lower(label), 'europe') THEN 'EUR' END) AS country
  FROM (SELECT s_suppkey, s_name || CASE s_suppkey % 5 WHEN 0 THEN ' – CANADA' WHEN 1 THEN ' [US]' WHEN 2 THEN ' of Germany (DEU)' WHEN 3 THEN ' Europe' ELSE '' END AS label FROM supplier)""")
def _(spark, d):
    k = F.col("s_suppkey") % 5
    label = F.concat("s_name", F.when(k == 0, " – CANADA").when(k == 1, " [US]").when(k == 2, " of Germany (DEU)").when(k == 3, " Europe").otherwise(""))
    return read(spark, d, "supplier").select("s_suppkey", infer_jurisdiction(label).alias("country"))


@query("visibility_flags", """SELECT s_suppkey, visible, bool_or(visible) OVER (PARTITION BY s_nationkey) AS parent_visible, CAST(count(*) FILTER (NOT visible) OVER (PARTITION BY s_nationkey) AS BIGINT) AS n_hidden FROM (SELECT s_suppkey, s_nationkey, s_acctbal > 0 AND s_nationkey % 4 <> 0 AS visible FROM supplier)""")
def _(spark, d):
    rows = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", ((F.col("s_acctbal") > 0) & (F.col("s_nationkey") % 4 != 0)).alias("visible"))
    sums = rows.groupBy("s_nationkey").agg(F.bool_or("visible").alias("parent_visible"), F.count(F.when(~F.col("visible"), 1)).alias("n_hidden"))
    return rows.join(sums, "s_nationkey").select("s_suppkey", "visible", "parent_visible", "n_hidden")


@query("hierarchy_split", """SELECT s_suppkey, code, CAST(len(string_split(code, '|')) AS INTEGER) AS depth, string_split(code, '|')[-1] AS leaf, replace(code, '|', '_') AS dom_key FROM
  (SELECT s_suppkey, 'T' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || '|C' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE '|S' || CAST(s_suppkey AS VARCHAR) END AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def _(spark, d):
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    code = F.concat(F.lit("T"), two("n_regionkey"), F.lit("|C"), two("s_nationkey"), F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(F.concat(F.lit("|S"), F.col("s_suppkey").cast("string"))))
    rows = read(spark, d, "supplier").join(n, "s_nationkey").select("s_suppkey", code.alias("code"))
    parts = F.split("code", r"\|")
    return rows.select("s_suppkey", "code", F.size(parts).alias("depth"), F.element_at(parts, -1).alias("leaf"), F.replace("code", F.lit("|"), F.lit("_")).alias("dom_key"))


@query("hierarchy_banner_fill", """SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w AS banner, last_value(CASE WHEN event_type = 'login' THEN event_id END IGNORE NULLS) OVER w AS sub_banner FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return E.filled_down(read(spark, d, "events"), ["user_id"], {"banner": F.when(F.col("event_type") == "error", F.col("event_id")), "sub_banner": F.when(F.col("event_type") == "login", F.col("event_id"))}, F.asc("ts"), F.asc("event_id")).select("event_id", "banner", "sub_banner")


@query("coverage_matrix", """SELECT lang, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(CAST(contains(text, '@') AS INT)) AS BIGINT) AS n_mail, CAST(sum(CAST(regexp_matches(text, '[0-9]{3}') AS INT)) AS BIGINT) AS n_number, CAST(count(quality) AS BIGINT) AS n_label FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def _(spark, d):
    joined = read(spark, d, "documents").select("doc_id", "lang", F.col("text").contains("@").alias("m"), F.col("text").rlike("[0-9]{3}").alias("n")).join(read(spark, d, "labels"), "doc_id", "left")
    return A.coverage(joined, ["lang"], {"mail": F.col("m"), "number": F.col("n"), "label": F.col("quality").isNotNull()})


@query("validate_rules", """SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT (length(p_name) BETWEEN 3 AND 30) THEN 'name_length' END, CASE WHEN NOT regexp_matches(p_brand, '^Brand#[0-9]$') THEN 'brand_pattern' END, CASE WHEN NOT (p_size <= 45) THEN 'size_range' END, CASE WHEN NOT (p_type IN ('LARGE','SMALL','ECONOMY','STANDARD','MEDIUM')) THEN 'type_enum' END], lambda x: x IS NOT NULL), ',') AS errors FROM part""")
def _(spark, d):
    rules = {"name_length": F.char_length("p_name").between(3, 30), "brand_pattern": F.col("p_brand").rlike("^Brand#[0-9]$"), "size_range": F.col("p_size") <= 45, "type_enum": F.col("p_type").isin("LARGE", "SMALL", "ECONOMY", "STANDARD", "MEDIUM")}
    return read(spark, d, "part").select("p_partkey", F.array_join(E.violations(rules), ",").alias("errors"))


@query("preview_delta", """SELECT c_custkey, c_acctbal AS was, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal WHEN c_custkey % 3 = 1 THEN c_acctbal + 10 END AS now, c_custkey % 3 = 1 AS changed FROM customer""")
def _(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("was"))
    now = c.filter("c_custkey % 3 < 2").select("c_custkey", (F.col("was") + F.when(F.col("c_custkey") % 3 == 1, 10.0).otherwise(0.0)).alias("now"))
    return c.join(now, "c_custkey", "left").withColumn("changed", F.coalesce(F.col("now") != F.col("was"), F.lit(False))).orderBy(F.col("now").isNull(), "c_custkey")


