"""Sheet rows to nested material records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.readers import CATEGORIES
from .joins import keyword_class


def column_number(letters: str) -> int:
    """The number from 0 of a sheet's column letters."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def number(cell: Column) -> Column:
    """A number cell; blanks and text are null."""
    return F.regexp_replace(F.trim(cell), ",", "").try_cast("double")


def flag(cell: Column) -> Column:
    low = F.upper(F.trim(cell))
    return F.when(low == "TRUE", True).when(low == "FALSE", False)


def text(cell: Column) -> Column:
    return F.nullif(F.trim(cell), F.lit(""))


def fallback_of(formula: Column) -> Column:
    """The last quoted argument of a formula."""
    return S.matched(formula, r'"([^"]*)"[^"]*$')


def material_record(rows: DataFrame, at: dict[str, str], groups: list[tuple[str, str]], countries: DataFrame, source: str = "calculated") -> DataFrame:
    """Records from sheet cells c0, c1, ...; `at` names the column letters of what a record is made of.

    Names: id, name, category, manufacturer, country, stated, divisor, unit, density, thickness, bio, carbon, retention, expiry, standards, hidden.
    Rows with a blank id give none. The group is the first keyword's in name or category; countries map names to codes, unmapped ones give an empty array."""
    c = lambda name: F.col(f"c{column_number(at[name])}") if name in at else F.lit(None).cast("string")
    with_country = rows.withColumn("__country", F.lower(F.trim(c("country"))))
    joined = with_country.join(F.broadcast(countries.select(F.col("country").alias("__country"), "codes")), "__country", "left")
    density, thickness, bio, share, keep = (number(c(x)) for x in ("density", "thickness", "bio", "carbon", "retention"))
    kg_c = density * thickness * bio * share
    full = kg_c * 3.67
    stated, divisor = number(c("stated")), number(c("divisor"))
    block = lambda name, value: F.struct(F.struct(value.alias("value"), F.when(value.isNotNull(), source).alias("source")).alias("total"), F.create_map().cast("map<string,struct<value:double,source:string>>").alias("by_stage")).alias(name)
    common = S.js_round(F.try_divide(stated, divisor), 2)
    impacts = F.struct(*(block(k, common if k == CATEGORIES[0] else F.lit(None).cast("double")) for k in CATEGORIES))
    return joined.filter(text(c("id")).isNotNull()).select(
        F.lower(F.trim(c("id"))).alias("id"),
        F.struct(F.trim(c("id")).alias("source_id")).alias("external_refs"),
        F.struct(F.coalesce(text(c("name")), F.lit("—")).alias("display_name")).alias("naming"),
        F.struct(text(c("manufacturer")).alias("name"), F.coalesce("codes", F.array().cast("array<string>")).alias("countries")).alias("manufacturer"),
        F.struct(text(c("category")).alias("category"), keyword_class(S.search_text(c("name"), c("category")), groups).alias("group_prefix")).alias("classification"),
        F.struct(stated.alias("stated"), common.alias("common_value"), S.js_round(F.try_divide(F.lit(1.0), divisor), 6).alias("conversion_factor"), S.normalize_unit(c("unit")).alias("functional_unit"),
                 F.struct(S.js_round(full, 2).alias("full_carbon"), S.js_round(full * keep, 2).alias("stored"), S.js_round(kg_c, 2).alias("kg_carbon"), keep.alias("retention")).alias("biogenic")).alias("carbon"),
        F.struct(density.alias("density"), (density * 0.06243).alias("density_lb_ft3"), thickness.alias("thickness")).alias("physical"),
        impacts.alias("impacts"),
        F.struct(S.expiry_to_iso(number(c("expiry")).cast("int")).alias("expiry_date"), S.split_clean(F.coalesce(c("standards"), F.lit(""))).alias("standards")).alias("epd"),
        F.struct(F.when(flag(c("hidden")), "hidden").otherwise("listed").alias("visibility")).alias("status"),
    )


def index_entries(records: DataFrame, listed_only: bool = False) -> DataFrame:
    """The flat index of records; hidden ones only if they are wanted."""
    rows = records.filter("status.visibility <> 'hidden'") if listed_only else records
    return rows.select("id", F.coalesce("naming.display_name", "manufacturer.name", F.lit("—")).alias("display_name"), F.col("classification.category").alias("category"), F.col("classification.group_prefix").alias("group_prefix"), F.col("manufacturer.name").alias("manufacturer"), F.col("manufacturer.countries").alias("countries"), F.col(f"impacts.{CATEGORIES[0]}.total.value").alias("gwp"), F.col("carbon.functional_unit").alias("functional_unit"))


def fallback_catalogue(rows: DataFrame, rules: list[tuple[str, str]], override: DataFrame) -> DataFrame:
    """For each class of rows (name, density) the named default, or the row of the lower median density, with all variants. override: (cls, name)."""
    from .aggregates import lower_median_row
    from .joins import pattern_class

    known = rows.withColumn("cls", pattern_class(F.col("name"), rules, "skip")).filter("cls <> 'skip'")
    middle = lower_median_row(known, ["cls"], "density", F.asc("name")).select("cls", F.col("name").alias("__name"), F.col("density").alias("__density"))
    named = known.join(override, ["cls", "name"]).select("cls", F.col("name").alias("__own"), F.col("density").alias("__own_density"))
    variants = known.groupBy("cls").agg(F.array_sort(F.collect_set("name")).alias("variants"))
    return middle.join(named, "cls", "left").join(variants, "cls").select("cls", F.coalesce("__own", "__name").alias("name"), F.when(F.col("__own").isNotNull(), F.col("__own_density")).otherwise(F.col("__density")).alias("density"), "variants")
