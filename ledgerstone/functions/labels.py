"""Names, codes and labels: identifiers, provinces and countries, group defaults, provenance envelopes, volumes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import js_round

# -- fixed values ----------------------------------------------------------------------------------------------

PROVINCES = {
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador", "NS": "Nova Scotia",
    "NT": "Northwest Territories", "NU": "Nunavut", "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon",
}
STATES = [
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii", "Idaho",
    "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi",
    "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio",
    "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia",
    "Washington", "West Virginia", "Wisconsin", "Wyoming",
]
GROUPS = {"03": "Concrete", "04": "Masonry", "05": "Metals", "06": "Wood", "07": "Thermal", "08": "Openings", "09": "Finishes", "31": "Earthwork"}
#: Group: base colour, metallic, roughness, grain.
RENDERING = {
    "03": ((0.72, 0.71, 0.69, 1.0), 0.0, 0.85, False),
    "04": ((0.70, 0.45, 0.35, 1.0), 0.0, 0.80, False),
    "05": ((0.75, 0.77, 0.80, 1.0), 0.85, 0.35, False),
    "06": ((0.82, 0.68, 0.44, 1.0), 0.0, 0.78, True),
    "07": ((0.88, 0.85, 0.80, 1.0), 0.0, 0.90, False),
    "08": ((0.60, 0.75, 0.85, 0.6), 0.0, 0.10, False),
    "09": ((0.90, 0.88, 0.84, 1.0), 0.0, 0.70, False),
    "31": ((0.55, 0.50, 0.45, 1.0), 0.0, 0.95, False),
    "32": ((0.55, 0.55, 0.55, 1.0), 0.0, 0.90, False),
}
METALS = ("Steel", "Aluminum", "Metal", "Ground screw")
MINERAL_GROUPS, WOOD_GROUPS = ("03", "04", "31", "32"), ("06",)

# -- identifiers -----------------------------------------------------------------------------------------------


def record_id(source_id: Column) -> Column:
    return F.lower(source_id)


def dom_key(code: Column) -> Column:
    """A code whose bars are underscores."""
    return F.translate(code, "|", "_")


def group_file(prefix: Column) -> Column:
    """The file of a group's records, 03-concrete.json; null for unknown groups."""
    names = F.create_map(*(F.lit(x) for p, label in GROUPS.items() for x in (p, f"{p}-{label.lower()}.json")))
    return F.element_at(names, prefix)


def pretty_category(category: Column) -> Column:
    """A category without its number and underscores; a dash for none."""
    plain = F.regexp_replace(F.regexp_replace(category, r"^\d\d_", ""), "_", " ")
    return F.when(F.coalesce(category, F.lit("")) == "", "—").otherwise(plain)


def sibling_source(path: Column) -> Column:
    """The path of a value's source: its last part is `source`; null for paths of one part."""
    parts = F.split(path, r"\.")
    return F.when(F.size(parts) > 1, F.concat_ws(".", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit("source")))


def contains_text(text: Column, part: Column) -> Column:
    """Whether a text holds another, whatever their case."""
    return F.contains(F.lower(text), F.lower(part))


def minted_id(key: Column, attempt: int = 0) -> Column:
    """Six hexadecimal digits that depend on the key alone; another attempt gives others."""
    return F.substring(F.sha2(F.concat_ws(":", key.cast("string"), F.lit(attempt).cast("string")), 256), 1, 6)


# -- places ----------------------------------------------------------------------------------------------------


def province(text: Column) -> Column:
    """A province by its name or two letters, null for others."""
    names = F.create_map(*(F.lit(x) for code, name in PROVINCES.items() for k in (code.lower(), name.lower()) for x in (k, name)))
    return F.element_at(names, F.lower(F.trim(text)))


def country_code(text: Column) -> Column:
    """CA or US, null for others."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("ca", "canada"), "CA").when(low.isin("us", "usa", "united states"), "US")


def province_options(country: Column) -> Column:
    """What may be chosen below a country; nothing below others."""
    listed = lambda names: F.array(*map(F.lit, names))
    return F.when(country == "Canada", listed(PROVINCES.values())).when(country == "United States", listed(STATES)).otherwise(F.array().cast("array<string>"))


# -- defaults --------------------------------------------------------------------------------------------------


def rendering(prefix: Column) -> Column:
    """{base_color, metallic, roughness, has_grain} of a group; finishes stand in for unknown ones."""

    def look(p: str) -> Column:
        colour, metallic, roughness, grain = RENDERING[p]
        return F.struct(F.array(*map(F.lit, colour)).alias("base_color"), F.lit(metallic).alias("metallic"), F.lit(roughness).alias("roughness"), F.lit(grain).alias("has_grain"))

    known = F.create_map(*(x for p in RENDERING for x in (F.lit(p), look(p))))
    return F.coalesce(F.element_at(known, prefix), look("09"))


def combustibility(prefix: Column, material_type: Column) -> Column:
    return F.when(material_type.isin(*METALS) | prefix.isin(*MINERAL_GROUPS), "non_combustible").when(prefix.isin(*WOOD_GROUPS), "combustible")


# -- provenance ------------------------------------------------------------------------------------------------


def provenance(project: Column, polygons: Column, summary: Column, sheets: Column) -> Column:
    """The envelope that says which outlines a value comes from, as JSON."""
    none = F.array().cast("array<string>")
    return F.to_json(F.struct(F.lit("pdf-parser").alias("type"), project.alias("projectUuid"), F.coalesce(polygons, none).alias("polyIds"), F.coalesce(summary, F.lit("")).alias("summary"), F.coalesce(sheets, none).alias("sheets")))


def read_provenance(source: Column) -> Column:
    """{type, summary, sheets} of an envelope; a plain string is an older writer's and has a summary only for parameters."""
    e = F.from_json(source, "type string, summary string, sheets array<string>")
    plain = F.struct(F.lit(None).cast("string").alias("type"), F.when(source == "pdf:param", "project-level parameter").alias("summary"), F.array().cast("array<string>").alias("sheets"))
    return F.when(source.isNotNull(), F.when(e["type"].isNotNull(), e).otherwise(plain))


# -- volumes ---------------------------------------------------------------------------------------------------


def volume(length: Column, height: Column, width: Column) -> Column:
    return length * height * width


def length_of_volume(total: Column, height: Column, width: Column) -> Column:
    """The length that a volume comes to, with four decimals; null where height or width are none or zero."""
    return js_round(F.try_divide(total, height * width), 4)


def display_value(field: Column, value: Column) -> Column:
    """Three decimals for volumes, continuous footings and column piers, else two."""
    return F.when(field.rlike("volume|continuous_footings|columns_piers"), js_round(value, 3)).otherwise(js_round(value, 2))
