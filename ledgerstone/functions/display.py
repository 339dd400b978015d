"""Numbers as text for reports. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import js_round, parse_numeric

DASH = "—"

#: The blocks of a record's detail view, with the label and the place of each line.
DETAIL_BLOCKS = {
    "identity": [
        ("id", "id"), ("display_name", "naming.display_name"), ("material_name", "naming.material_name"), ("product_brand_name", "naming.product_brand_name"),
        ("group", "classification.group_prefix"), ("material_type", "classification.material_type"), ("product_type", "classification.product_type"),
        ("product_subtype", "classification.product_subtype"), ("typical_elements", "classification.typical_elements"), ("rendering.grain", "rendering.has_grain"),
    ],
    "provenance": [
        ("manufacturer", "manufacturer.name"), ("country_code", "manufacturer.country_code"), ("website", "manufacturer.website"),
        ("countries_of_manufacture", "provenance.countries_of_manufacture"), ("markets_of_applicability", "provenance.markets_of_applicability"),
        ("visibility", "status.visibility"), ("source_notes", "source_notes"), ("notes", "notes"),
    ],
    "physical": [
        ("density", "physical.density.value_kg_m3"), ("thermal.conductivity (W/mK)", "physical.thermal.conductivity_w_mk"), ("moisture_content_pct", "physical.moisture_content_pct"),
        ("mass_per_unit_kg", "physical.mass_per_unit_kg"), ("dimensions.length_m", "physical.dimensions.length_m"), ("dimensions.width_m", "physical.dimensions.width_m"),
        ("dimensions.depth_m", "physical.dimensions.depth_m"), ("dimensions.units_per_m2", "physical.dimensions.units_per_m2"),
    ],
}


def detail_lines(df: DataFrame, key: str = "id", blocks: dict | None = None) -> DataFrame:
    """(key, block, line_no, label, shown): what a record's detail view says, one row for each line. Lists are joined by commas, flags are yes or no,
    numbers are shown by their size; nulls, empty lists and places that the records don't have are a dash."""
    from pyspark.sql import types as T

    def kind_of(place: str):
        kind = df.schema
        for part in place.split("."):
            kind = next((f.dataType for f in kind.fields if f.name == part), None) if isinstance(kind, T.StructType) else None
        return kind

    def text(place: str) -> Column:
        kind, c = kind_of(place), F.col(place)
        if kind is None:
            return F.lit(DASH)
        if isinstance(kind, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ", ")
        elif isinstance(kind, T.BooleanType):
            c = F.when(c, "yes").when(~c, "no")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = measure(c)
        return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(DASH))

    lines = [F.struct(F.lit(b).alias("block"), F.lit(i).alias("line_no"), F.lit(label).alias("label"), text(place).alias("shown")) for b, rows in (blocks or DETAIL_BLOCKS).items() for i, (label, place) in enumerate(rows)]
    return df.select(F.col(key), F.explode(F.array(*lines)).alias("x")).select(key, "x.*")


def _usable(x: Column) -> Column:
    """Neither null, zero nor without bound."""
    return F.coalesce((x != 0) & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def _small(x: Column) -> Column:
    """Two decimals and an exponent without leading zeros."""
    return F.regexp_replace(F.format_string("%.2e", x), r"e([+-])0+(?=\d)", "e$1")


def whole_kg(x: Column) -> Column:
    """Whole kilograms with thousands commas; 0 for nothing."""
    return F.when(_usable(x), F.format_number(js_round(x), 0)).otherwise(F.lit("0"))


def quantity(x: Column) -> Column:
    """Two decimals; blank for nothing."""
    return F.when(_usable(x), F.format_string("%.2f", x)).otherwise(F.lit(""))


def potential(x: Column) -> Column:
    """A warming potential: fewer decimals from 10 and from 100 on, whatever the sign of small ones."""
    return F.when(x.isNull(), F.lit(DASH)).when(x >= 100, F.format_string("%.0f", x)).when(x >= 10, F.format_string("%.1f", x)).otherwise(F.format_string("%.2f", x))


def measure(x: Column) -> Column:
    """A measure by its size: none, two or three decimals, or an exponent below 0.01."""
    size = F.abs(x)
    return F.when(x == 0, F.lit("0")).when(size >= 1000, F.format_string("%.0f", x)).when(size >= 10, F.format_string("%.2f", x)).when(size >= 0.01, F.format_string("%.3f", x)).otherwise(_small(x))


def factor(x: Column) -> Column:
    """A factor with up to six decimals, or an exponent below 0.0001."""
    fixed = F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    return F.when(x.isNull(), F.lit(DASH)).when(x == 0, F.lit("0")).when(F.abs(x) < 0.0001, _small(x)).otherwise(fixed)


def shown(text: Column, style: str = "number-2dp") -> Column:
    """A cell's text in a style: raw, integer, number or percent, the last two with decimals ("-2dp") and number with commas ("-comma").

    Null and N/A give N/A; text without a number stays, and a blank is 0.00."""
    kind, _, rest = style.partition("-")
    digits = next((int(p[:-2]) for p in rest.split("-") if p.endswith("dp") and p[:-2].isdigit()), 0 if kind == "percent" else 2)
    x = parse_numeric(text, None)
    if kind == "raw":
        out = text
    elif kind == "integer":
        out = F.format_number(F.round(x, 0), 0)
    elif kind == "percent":
        out = F.concat(F.format_number(F.round(x * 100, digits), digits), F.lit("%"))
    elif "comma" in rest:
        out = F.format_number(F.round(x, digits), digits)
    else:
        out = F.format_string(f"%.{digits}f", x)
    if kind != "raw":
        out = F.when(x.isNotNull(), out).when(F.trim(text) != "", text).otherwise(F.lit("0.00"))
    return F.when(text.isNull() | (F.upper(F.trim(text)) == "N/A"), F.lit("N/A")).otherwise(out)
