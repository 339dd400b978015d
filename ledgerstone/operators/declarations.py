"""Declaration texts to records: family, title, type, fields by family, indicator totals and values by life-cycle stage.

A declaration is read by a small grammar over plain tables. A label is a phrase; white space may stand between any of its letters, as it
does where a page was set letter by letter. A field is a label and the value behind it, by one of a few rules. A table row is a
label, a unit and numbers, taken apart line by line. Tables say which labels, units and rules belong together; no pattern is written by hand
for a single field, and no value has a length of its own: it ends with its line or at the next known label. Everything is a column over the text, so a corpus is one scan; only values by stage are rows of their own."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_line, date_after, euro_number, loose_date_after, matched, parse_date
from .extraction import declared_quantity, lines_of, stage_codes
from .joins import asof_header, pattern_class

# -- fixed values ----------------------------------------------------------------------------------------------

#: Families in order of priority by their signs; the first also needs a registry number.
FAMILIES = [
    ("epd_intl", ["programme operator"]),
    ("nsf", ["NSF International"]),
    ("eu_ibu", ["programme holder", "owner of the declaration"]),
    ("na", ["program operator"]),
]
REGISTRY_ID = r"S\s*-\s*P\s*-\s*(\d{5,6})"

#: How lines that aren't titles begin, and standards whose citation makes a line none.
NO_TITLE = [
    "type iii", "environmental product declaration", "in accordance", "as per", "according to", "programme", "program", "publisher", "owner of",
    "declaration number", "issue date", "valid to", "valid until", "publication date", "EPD", "environmental",
]
NO_TITLE_ALONE = ["product", "declaration"]
TITLE_STANDARDS = ["ISO 14025", "ISO 13025", "EN 15804", "ISO 21930", "ISO 14040"]

#: Material types by the first phrase that a text has; a blank may be a hyphen or nothing.
MATERIAL_TYPES = [
    ("Engineered wood", ["cross laminated timber", "CLT"]),
    ("Glulam", ["glulam", "glue laminated"]),
    ("LVL", ["laminated veneer lumber", "LVL"]),
    ("Wood I-joist", ["wood i joist"]),
    ("Plywood", ["plywood"]),
    ("Framing", ["soft wood lumber", "dimension lumber", "framing lumber"]),
    ("Hardwood", ["hardwood"]),
    ("Portland Cement", ["portland cement", "portland limestone cement", "GUL"]),
    ("Concrete", ["ready mix concrete", "ready mixed concrete", "concrete mix", "concrete mixes"]),
    ("Concrete", ["concrete block", "CMU"]),
    ("Clay Brick", ["clay brick"]),
    ("Brick", ["brick"]),
    ("Steel", ["hot rolled steel", "structural steel", "steel bar", "steel coil", "steel sheet", "steel plate", "steel section", "steel sections", "rebar"]),
    ("Aluminum", ["aluminum", "aluminium"]),
    ("Spray polyurethane foam", ["spray polyurethane foam", "SPF"]),
    ("Polyisocyanurate", ["polyisocyanurate", "polyiso"]),
    ("XPS Foam", ["extruded polystyrene", "XPS"]),
    ("EPS Foam", ["expanded polystyrene", "EPS"]),
    ("Mineral wool", ["mineral wool", "mineral fibre", "mineral fiber", "stone wool", "glass wool", "rockwool"]),
    ("Cellulose", ["cellulose"]),
    ("Fiberglass", ["fiberglass", "fibreglass"]),
    ("Gypsum", ["gypsum", "drywall"]),
    ("Luxury vinyl tile", ["vinyl floor", "vinyl tile", "vinyl sheet", "LVT"]),
]

#: Programme operators by the first name that a text has; names in capitals alone must be written so.
OPERATORS = [
    ("EPD International AB", ["EPD International AB"]),
    ("IBU", ["Institut Bauen und Umwelt", "IBU"]),
    ("NSF International", ["NSF International"]),
    ("CSA Group", ["CSA Group"]),
    ("ASTM International", ["ASTM International"]),
    ("UL Environment", ["UL Environment"]),
    ("AWC & CWC", ["American Wood Council", "AWC & CWC", "AWC CWC", "Canadian Wood Council"]),
]
FIXED_OPERATOR = {"eu_ibu": "IBU", "epd_intl": "EPD International AB", "nsf": "NSF International"}

#: Standards in the order of a record's list: what they are called, and what may follow the number.
STANDARDS = [
    (["ISO 14025", "ISO 13025"], r":20\d\d"),
    (["ISO 21930"], r":20\d\d"),
    (["EN 15804"], r"\+A[12](?::20\d\d|/AC[:0-9-]*)?|:20\d\d|/AC[:0-9-]*"),
    (["ISO 14040"], r"/44?"),
    (["CAN/CSA-ISO 14025", "CAN/CSA ISO 14025", "CAN/CSA-ISO 13025"], ""),
]

#: Fields of each family: labels in order of priority, with the rule of the value behind them (see after_label).
FIELDS: dict[str, dict[str, list[tuple[str, str]]]] = {
    "na": {
        "manufacturer": [("declaration holder", "name"), ("manufacturer name and address", "name"), ("manufacturer name", "name"), ("EPD commissioner and owner", "name"), ("EPD commissioner owner", "name"), ("produced by", "capitals"), ("produced at", "capitals")],
        "epd_id": [("declaration number", "line"), ("EPD registration number", "line"), ("EPD number", "line")],
        "unit_line": [("declared product & unit", "line"), ("functional product & unit", "line"), ("declared unit", "line"), ("functional unit", "line")],
        "pcr": [(x, "line") for x in ("part B", "reference PCR and version number", "reference PCR", "product category rules (PCR)", "product category rules PCR", "product category rules", "product category rule")],
        "markets": [("markets of applicability", "line"), ("region covered", "line")],
        "kind": [("EPD type", "line")],
    },
    "eu_ibu": {
        "manufacturer": [("owner of the declaration", "name")],
        "epd_id": [("declaration number", "line")],
        "unit_line": [("this declaration refers to", "line")],
        "pcr": [("category rules", "line")],
        "published": [("issue date", "line")],
        "expires": [("valid to", "line")],
    },
    "epd_intl": {
        "manufacturer": [("from", "name"), ("owner of the declaration", "name")],
        "unit_line": [("functional unit / declared unit", "line")],
        "pcr": [("product category rules (PCR)", "cited"), ("product category rule (PCR)", "cited"), ("PCR", "code")],
    },
    "nsf": {
        "manufacturer": [("EPD commissioner and owner", "name"), ("EPD commissioner owner", "name")],
        "unit_line": [("declared unit", "line")],
        "pcr": [(x, "line") for x in ("product category rules (PCR)", "product category rules", "product category rule")],
        "published": [("date of issue & validity period", "line"), ("date of issue", "line")],
    },
}
DENSITY = {"na": ["density of", "density"], "eu_ibu": ["density of"]}
ISSUED = ["date of issue & validity period", "date of issue", "publication date", "issue date"]
EXPIRES = ["period of validity", "valid until", "valid to", "expiry date"]

#: Units of indicators; a digit may be missing.
_CO2, _CFC, _SO2, _N, _O3 = "kg CO2 e", "kg CFC11 e", "kg SO2 e", "kg N e", "kg O3 e"
#: Indicators: (kind of row, labels, units). Codes stand for themselves and may have letters behind them; names are phrases; a
#: wrapped row has its unit or its value on a later line. The first row that gives a value counts, in this order of kinds.
INDICATORS: dict[str, list[tuple[str, list[str], list[str]]]] = {
    "gwp_kgco2e": [
        ("code", ["GWP", "GWPfossil", "GWP fossil", "GWP total", "GWP-fossil", "GWP-total"], [_CO2]),
        ("name", ["global warming potential", "global warming potential - total", "global warming potential – total", "global warming potential — total"], [_CO2]),
    ],
    "gwp_bio_kgco2e": [
        ("code", ["GWPBIO", "GWP bio", "GWP-bio", "GWP biogenic", "GWP-biogenic"], [_CO2]),
        ("name", [f"global warming potential {d} {b}" for d in "–—-" for b in ("biogenic", "bio")], [_CO2]),
    ],
    "ozone_depletion_kgcfc11eq": [
        ("code", ["ODP"], [_CFC]),
        ("name", ["ozone depletion potential"], [_CFC]),
        ("wrapped", ["depletion potential of the stratospheric ozone layer"], []),
        ("name", ["depletion potential of the stratospheric ozone layer"], [_CFC]),
    ],
    "acidification_kgso2eq": [("code", ["AP"], [_SO2]), ("name", ["acidification potential of soil and water sources", "acidification potential"], [_SO2])],
    "eutrophication_kgneq": [("code", ["EP"], [_N]), ("name", ["eutrophication potential"], [_N])],
    "smog_kgo3eq": [("code", ["SFP", "POCP"], [_O3]), ("name", ["smog potential"], [_O3]), ("name", ["formation potential of tropospheric ozone"], [_O3])],
    "abiotic_depletion_fossil_mj": [
        ("code", ["ADPf", "ADPfossil", "ADP fossil", "ADP-fossil", "ADP NRf", "FFD"], ["MJ"]),
        ("name", ["abiotic depletion potential (ADPfossil)", "abiotic depletion potential (ADP_fossil)", "abiotic depletion potential for fossil resources"], ["MJ"]),
    ],
    "water_consumption_m3": [
        ("code", ["WDP", "Water DP", "Water-DP"], ["m3", "m³", "kg"]),
        ("name", ["consumption of freshwater resources", "consumption of fresh water resources"], ["m3", "m³"]),
        ("name", ["use of net fresh water"], ["m3", "m³"]),
        ("wrapped", ["FW"], ["m3", "m³"]),
    ],
    "primary_energy_nonrenewable_mj": [
        ("code", ["PENR", "NRPE", "PE NR", "PE-NR", "nonrenewable primary energy", "non renewable primary energy", "non-renewable primary energy"], ["MJ"]),
        ("name", ["nonrenewable fossil", "non renewable fossil", "non-renewable fossil", "nonrenewable, fossil", "non-renewable, fossil"], ["MJ"]),
        ("name", ["NRPRE"], ["MJ"]),
    ],
    "primary_energy_renewable_mj": [
        ("code", ["PER", "RPE", "PE R", "PE-R", "renewable primary energy"], ["MJ"]),
        ("name", ["renewable biomass", "renewable, biomass"], ["MJ"]),
        ("name", ["RPRE"], ["MJ"]),
    ],
}
#: Words behind a label that make it another one's.
NOT_BEHIND = {"gwp_kgco2e": ["bio", "biogenic", "fossil"]}
#: Labels of rows with values by stage, beside the names above.
STAGE_LABELS = {
    "smog_kgo3eq": ["photochemical ozone formation"],
    "primary_energy_nonrenewable_mj": ["nonrenewable primary energy used as energy", "non renewable primary energy used as energy", "non-renewable primary energy used as energy"],
    "primary_energy_renewable_mj": ["renewable primary energy used as energy"],
}

# -- the grammar -----------------------------------------------------------------------------------------------


def phrase(words: str, between: str = r"\s++") -> str:
    """A pattern for a phrase whose letters may stand apart, and whose words do, or have `between` among them."""
    return between.join(r"\s*+".join(map(re.escape, w)) for w in words.split())


def any_of(phrases: list[str], between: str = r"\s++") -> str:
    """One pattern for several phrases, the longest first."""
    return "(?:" + "|".join(phrase(p, between) for p in sorted(phrases, key=len, reverse=True)) + ")"


def _word(phrases: list[str], between: str = r"\s++", any_case: bool = True) -> str:
    return rf"{'(?i)' if any_case else ''}(?<![A-Za-z0-9]){any_of(phrases, between)}(?![A-Za-z0-9])"


def unit_pattern(unit: str) -> str:
    """A pattern for a unit: blanks, hyphens and brackets may stand in it, digits may be missing, and 'e' may go on to 'eq.'."""
    letters = (re.escape(c) + ("?" if c.isdigit() and unit.startswith("kg") else "") for c in unit.replace(" ", ""))
    return r"[\s-]*".join(letters) + (r"(?:qv?)?\.?" if unit.endswith(" e") else r"\b")


NUMBER = r"-?\s*\d[\d,]*(?:\.\d+)?(?:\s*E\s*[-+]?\s*\d+)?"
#: A number of plain text: digits with points and commas among them, ending in a digit.
PLAIN_NUMBER = r"\d(?:[\d.,]*\d)?"
#: Labels of several words, at which a value ends that stands before one on a line.
_ENDS = sorted({label for by in FIELDS.values() for specs in by.values() for label, _ in specs if " " in label} | {x for x in ISSUED + EXPIRES})


def to_next_label(value: Column) -> Column:
    """A line's text up to the next known label on it."""
    return F.get(F.split(value, rf"(?i)\s+(?={any_of(_ENDS)}(?![A-Za-z]))", 2), F.lit(0))


def while_words(line: Column, keep) -> Column:
    """The words of a line up to the first that doesn't keep."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    stop = F.get(F.filter(F.transform(words, lambda w, i: F.when(~keep(w), i)), lambda i: i.isNotNull()), F.lit(0))
    return F.nullif(F.array_join(F.slice(words, 1, F.coalesce(stop, F.size(words))), " "), F.lit(""))


def after_label(text: Column, label: str, rule: str) -> Column:
    """The value behind a label: the rest of its line, or of the next line that has any, up to the next known label.

    Rules: line takes it as it is; name wants one that begins with a capital letter or a digit, and ends it at a bracket; capitals takes its words that
    begin so; cited takes the label, too; code takes the label and the words behind it that have digits."""
    lead = rf"(?<![A-Za-z])(?i:{phrase(label)})"
    begins = r"(?=[\p{Lu}\d])" if rule in ("name", "capitals") else r"(?=\S*\d)" if rule == "code" else ""
    gap = r"\s+" if rule == "code" else r"[\s:#]+"
    value = to_next_label(matched(text, rf"{lead}{gap}({begins}[^\r\n]+)"))
    if rule == "name":
        return F.get(F.split(value, r"[(\[;]", 2), F.lit(0))
    if rule == "capitals":
        return while_words(value, lambda w: w.rlike(r"^\p{Lu}"))
    if rule == "code":
        return F.concat(F.lit(label + " "), while_words(value, lambda w: w.rlike(r"\d")))
    if rule == "cited":
        return F.concat(matched(text, rf"({lead}[\s:#]+){begins}[^\r\n]"), value)
    return value


def row_value(line: Column, labels: list[str], units: list[str], kind: str, unlike: list[str]) -> Column:
    """The first number of a table row behind one of the labels and a unit; null where the line is no such row.

    Behind a code the number must be followed by another, by a bracket or by the line's end: others are versions of methods. A wrapped row
    without a unit counts only numbers with an exponent."""
    code = "[A-Z0-9]{0,8}" if kind == "code" else ""
    other = rf"(?!\s*[–—-]?\s*(?:{'|'.join(unlike)}))" if unlike else ""
    lead = rf"(?i)(?<![A-Za-z0-9]){any_of(labels)}{other}{code}(?![A-Za-z0-9])"
    behind = matched(line, rf"{lead}(.*)$")
    if units:
        behind = matched(behind, rf"(?i)^.{{0,40}}?(?:{'|'.join(map(unit_pattern, units))})(.*)$")
    ends = r"(?=\s+-?\s*\d|\s*[\])]|\s*$)" if kind == "code" else r"(?![\w.])"
    number = NUMBER if units else r"\d+(?:\.\d+)?E[-+]?\d+"
    return euro_number(F.regexp_replace(matched(behind, rf"(?i)(?<![\w.,-])({number}){ends}"), r"\s+", ""))


def total(lines: Column, indicator: str) -> Column:
    """The total of an indicator: of the first kind of row that gives one, in the first such line."""
    joined = F.transform(lines, lambda x, i: F.concat_ws(" ", x, F.get(lines, i + 1), F.get(lines, i + 2)))
    unlike = NOT_BEHIND.get(indicator, [])

    def of(kind: str, labels: list[str], units: list[str]) -> Column:
        values = F.transform(joined if kind == "wrapped" else lines, lambda x: row_value(x, labels, units, kind, unlike))
        return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))

    return F.coalesce(*(of(*row) for row in INDICATORS[indicator]))


def totals(text: Column) -> list[Column]:
    """One number for each indicator; spaces inside a number go, a single comma is a decimal sign."""
    lines = F.split(text, "\r?\n")
    return [total(lines, x).alias(x) for x in INDICATORS]


# -- columns ---------------------------------------------------------------------------------------------------


def family(text: Column) -> Column:
    """The family of a declaration by its first sign: epd_intl, nsf, eu_ibu, na or unknown."""
    (first, signs), *rest = FAMILIES
    return F.when(text.rlike(REGISTRY_ID) & text.rlike(_word(signs)), first).otherwise(pattern_class(text, [(_word(s), f) for f, s in rest], "unknown"))


def title(text: Column, within: int = 1500) -> Column:
    """The first line of the head that is 4 to 160 long, has two words and is neither a registry heading nor a citation."""
    lines = F.transform(F.split(F.substring(text, 1, within), "\n"), clean_line)
    starts = rf"(?i)^(?:{any_of(NO_TITLE)}\b|{any_of(NO_TITLE_ALONE)}$|page\s+\d|\d+\s*/\s*\d|[–—]|--)"
    fits = lambda s: F.char_length(s).between(4, 160) & ~s.rlike(starts) & ~s.rlike(_word(TITLE_STANDARDS)) & s.contains(" ")
    return F.get(F.filter(lines, fits), F.lit(0))


def material_type(name: Column, text: Column) -> Column:
    """The type that the title names, else the first that the text names."""
    of = lambda c: F.nullif(pattern_class(c, [(_word(ps, r"[\s-]*"), t) for t, ps in MATERIAL_TYPES], ""), F.lit(""))
    return F.coalesce(of(name), of(text))


def program_operator(text: Column) -> Column:
    return F.nullif(pattern_class(text, [(_word([n], any_case=not n.isupper()), o) for o, names in OPERATORS for n in names], ""), F.lit(""))


def tidy_operator(name: Column) -> Column:
    """An operator's name without what follows it: addresses and links."""
    words = F.split(clean_line(name), " ")
    stop = lambda w: w.rlike(r"^(?:https?://|\d{2})")
    first = F.get(F.filter(F.transform(words, lambda w, i: F.when(stop(w) & (i > 0), i)), lambda i: i.isNotNull()), F.lit(0))
    return F.array_join(F.slice(words, 1, F.coalesce(first, F.size(words))), " ")


def standards(text: Column) -> Column:
    """The standards that a text cites, one spelling each, in the list's order."""
    cited = lambda names, more: clean_line(matched(text, rf"(?i)((?:{'|'.join(phrase(n, chr(92) + 's*') for n in names)})(?:{more})?)"))
    return F.array_distinct(F.filter(F.array(*(cited(*s) for s in STANDARDS)), lambda x: x.isNotNull()))


def verification(text: Column) -> Column:
    """external or internal, by ticked boxes and phrases; external where both boxes stand around the tick."""
    ticked = lambda word: text.rlike(rf"(?i)[x✓]\s*{word}|{word[:-2] if word.endswith('ly') else word}\s+verification")
    outside = ticked("external") | ticked("externally")
    return F.when(outside, "external").when(ticked("internal") | ticked("internally"), "internal")


def market_codes(text: Column) -> Column:
    """Country codes of a list of markets: a continent's, else all codes, else those of known names."""
    line = clean_line(text)
    parts = F.filter(F.transform(F.split(line, "[,;]+"), lambda x: F.trim(x)), lambda x: x != "")
    codes = F.filter(parts, lambda x: x.rlike("^[A-Z]{3}$"))
    names = F.create_map(*(F.lit(x) for x in ("canada", "CAN", "united states", "USA", "us", "USA", "usa", "USA")))
    named = F.filter(F.transform(parts, lambda x: F.element_at(names, F.lower(x))), lambda x: x.isNotNull())
    europe = line.rlike("(?i)europe") & ~line.rlike("(?i)eastern|western")
    return F.when(line.rlike(r"(?i)north\s+america"), F.array(F.lit("CAN"), F.lit("USA"))).when(europe, F.array(F.lit("EUR"))).when(F.size(codes) > 0, codes).otherwise(named)


def identifier(line: Column) -> Column:
    """The identifier that a line begins with: its words up to the first without a digit that has small letters; null without a digit."""
    words = F.split(clean_line(F.regexp_replace(line, r"^[\s#:]+", "")), " ")
    stops = F.transform(words, lambda w, i: F.when(w.rlike(r"[a-z]") & ~w.rlike(r"\d"), i))
    first = F.get(F.filter(stops, lambda i: i.isNotNull()), F.lit(0))
    own = F.array_join(F.slice(words, 1, F.coalesce(first, F.size(words))), " ")
    return F.when(own.rlike(r"\d"), own)


def records(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: list[tuple[str, str]] | None = None) -> DataFrame:
    """A record for each declaration: (key, family, title, material_type, group_prefix, display_name, fields, totals, n_anchors).

    `groups` are (material type, group prefix, label); a record with both a group and a type is named 'label | type'. Null texts
    give records without values. n_anchors counts which of nine leading fields have one."""
    t = F.coalesce(F.col(text), F.lit(""))
    fam = F.col("family")

    def field(name: str) -> Column:
        of = lambda specs: F.coalesce(*(after_label(t, *s) for s in specs))
        return clean_line(F.coalesce(*(F.when(fam == f, of(by[name])) for f, by in FIELDS.items() if name in by)))

    unit_line = field("unit_line")
    registry = F.concat(F.lit("S-P-"), matched(t, REGISTRY_ID))
    own_id = identifier(field("epd_id"))
    kind = F.lower(field("kind"))
    first_date = lambda labels: F.coalesce(*(date_after(t, f"(?i){phrase(x)}") for x in labels))
    loose = lambda label: loose_date_after(t, f"(?i){phrase(label)}\\s*:?")
    issued = F.when(fam == "na", first_date(ISSUED)).when(fam == "epd_intl", loose("publication date")).otherwise(parse_date(field("published")))
    expires = F.when(fam == "na", first_date(EXPIRES)).when(fam == "epd_intl", loose("valid until")).otherwise(parse_date(field("expires")))
    own_operator = F.coalesce(*(F.when(fam == f, F.lit(o)) for f, o in FIXED_OPERATOR.items()), F.lit(None).cast("string"))
    by_volume = rf"({PLAIN_NUMBER})\s*kg\s*/\s*m"
    dense = lambda label: matched(t, rf"(?i){phrase(label)}\s*{by_volume}")
    moist = matched(t, rf"(?i){phrase('mass (including moisture) kg')}\s+({PLAIN_NUMBER})")
    said = F.coalesce(*(F.when(fam == f, F.coalesce(*map(dense, labels))) for f, labels in DENSITY.items()), F.when(fam == "na", moist))
    density = euro_number(F.coalesce(F.when(fam == "na", matched(unit_line, rf"(?i){by_volume}")), said))
    pcr = F.when(fam == "eu_ibu", F.regexp_replace(field("pcr"), r"\s*\(.*$", "")).otherwise(field("pcr"))

    named = docs.select(key, F.col(text), family(t).alias("family"), title(t).alias("title"))
    typed = named.withColumn("material_type", material_type(F.col("title"), t))
    of_type = lambda place: reduce(lambda c, g: c.when(F.col("material_type") == g[0], F.lit(g[place])), groups, F.when(F.lit(False), F.lit(""))) if groups else F.lit(None).cast("string")
    prefix, label = of_type(1), of_type(2)
    rows = typed.select(
        key, "family", "title", "material_type", prefix.alias("group_prefix"),
        F.coalesce(F.concat(label, F.lit(" | "), F.col("material_type")), "title").alias("display_name"),
        field("manufacturer").alias("manufacturer"),
        F.when(fam == "epd_intl", registry).otherwise(F.coalesce(own_id, registry)).alias("epd_id"),
        F.coalesce(own_operator, program_operator(t)).alias("program_operator"),
        F.coalesce(F.when(fam == "na", declared_quantity(unit_line, t)), unit_line).alias("per_unit"),
        density.alias("density_kg_m3"), pcr.alias("pcr"), issued.alias("published"), expires.alias("expires"),
        F.when(kind.rlike(r"product[-\s]*specific"), "product_specific").when(kind.rlike(r"industry[-\s]*average"), "industry_average").when(kind.contains("generic"), "generic").alias("epd_type"),
        market_codes(field("markets")).alias("markets"), standards(t).alias("standards"), verification(t).alias("verification"), *totals(t),
    )
    anchors = ("display_name", "manufacturer", "epd_id", "program_operator", "per_unit", "density_kg_m3", "pcr", "published", "expires")
    return rows.withColumn("n_anchors", sum((F.col(a).isNotNull().cast("int") for a in anchors), F.lit(0)))


# -- values by stage -------------------------------------------------------------------------------------------


def row_numbers(line: Column) -> Column:
    """The numbers of a table row: decimals, three digits or more, exponents; not digits inside words, such as CO2."""
    found = F.regexp_extract_all(line, F.lit(r"(?<![A-Za-z\d.,])(-?\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?)"), F.lit(1))
    plain = F.transform(found, lambda x: F.regexp_replace(x, ",", ""))
    return F.transform(F.filter(plain, lambda x: x.rlike(r"[.eE]|\d{3}")), lambda x: x.cast("double"))


def stage_indicator(line: Column) -> Column:
    """The indicator that a row with values by stage is labelled with; null for other lines."""
    rules = []
    for indicator in INDICATORS:
        names = [p for kind, labels, _ in INDICATORS[indicator] for p in labels if kind != "code" and not p.isupper() and "primary_energy" not in indicator]
        unlike = NOT_BEHIND.get(indicator)
        other = rf"(?!\s*[–—-]\s*(?:{'|'.join(unlike)}))" if unlike else ""
        rules.append((rf"(?i)(?<![A-Za-z0-9-]){any_of(names + STAGE_LABELS.get(indicator, []))}{other}(?![A-Za-z0-9])", indicator))
    return F.nullif(pattern_class(line, rules, ""), F.lit(""))


def by_stage(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, indicator, stage, value): numbers of labelled rows, placed under the nearest header at or above with as many stages, else the nearest at all.

    Sums over A1-A3 take a place but aren't returned. The first value of an indicator and stage stays."""
    lines = lines_of(docs, key, text).withColumn("stages", stage_codes(F.col("line_text")))
    numbered = lines.withColumn("h_id", F.col("line").cast("long"))
    headers = numbered.filter(F.size("stages") >= 3)
    rows = (
        numbered.filter(F.size("stages") < 3)
        .select(key, "line", F.col("h_id").alias("row_id"), stage_indicator(F.col("line_text")).alias("indicator"), row_numbers(F.col("line_text")).alias("numbers"))
        .filter(F.col("indicator").isNotNull() & (F.size("numbers") > 0))
        .withColumn("n_values", F.size("numbers"))
    )
    placed = asof_header(rows, headers.select(key, "line", "h_id", F.size("stages").alias("n_cols")), key)
    joined = rows.join(placed, [key, "row_id"]).join(headers.select(key, "h_id", "stages"), [key, "h_id"])
    pairs = joined.select(key, "indicator", "line", F.posexplode(F.arrays_zip("stages", "numbers")).alias("place", "z"))
    values = pairs.select(key, "indicator", "line", "place", F.col("z.stages").alias("stage"), F.col("z.numbers").alias("value")).filter("stage IS NOT NULL AND value IS NOT NULL AND stage <> 'A1-A3'")
    return values.groupBy(key, "indicator", "stage").agg(F.min_by("value", F.struct("line", "place")).alias("value"))
