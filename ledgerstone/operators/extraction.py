"""Fields out of declaration texts, and rules that rows are held against."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clean_line, matched
from .scans import scanned

STAGE = r"(?<![A-Za-z0-9])(A1\s*[–—-]?\s*A3|A[1-5]|B[1-7]|C[1-4]|D)(?![A-Za-z0-9])"


def label_value(text: Column, label: str) -> Column:
    """The rest of the line after a label and a colon, with single blanks."""
    return F.nullif(clean_line(F.regexp_extract(text, rf"(?im)^\s*{label}\s*:\s*([^\n]+)", 1)), F.lit(""))


def first_line(text: Column, within: int = 1500, least: int = 4, most: int = 160) -> Column:
    """The first line of the text's head that has a fitting length and at least two words."""
    lines = F.transform(F.split(F.substring(text, 1, within), "\n"), clean_line)
    return F.get(F.filter(lines, lambda s: F.char_length(s).between(least, most) & s.contains(" ")), F.lit(0))


def declared_unit(text: Column) -> Column:
    """{amount, unit} of a declared unit such as '1 m²'; folded names, one piece without a number."""
    p = r"^\s*(\d+(?:\.\d+)?)?\s*([A-Za-z²³]+)"
    unit = F.lower(F.translate(F.regexp_extract(text, p, 2), "²³", "23"))
    folded = F.when(unit.isin("sqm", "m2"), "m2").when(unit.isin("cbm", "m3"), "m3").when(unit.isin("kilogram", "kilograms", "kg"), "kg").when(unit.isin("tonne", "tonnes", "t"), "t").otherwise(F.nullif(unit, F.lit("")))
    return F.struct(F.coalesce(matched(text, p).try_cast("double"), F.lit(1.0)).alias("amount"), folded.alias("unit"))


def declared_quantity(line: Column, text: Column) -> Column:
    """'number unit' that a unit line begins with; a bare m is taken for m³ or m² where the text names one. Null where the line names no known unit."""
    p = r"(?i)^(\d+(?:[.,]\d+)?)\s*(m³|m²|m\^?3|m\^?2|m|metric\s+tons?|tonnes?|kgs?|kilograms?|liters?|litres?)(?![A-Za-z0-9_])"
    unit = F.regexp_replace(F.lower(F.regexp_extract(line, p, 2)), r"\^", "")
    cubic = text.rlike(r"(?i)\bm³|\bm\s*\^?\s*3\b|cubic\s+m(?:eter|etre)")
    square = text.rlike(r"(?i)\bm²|\bm\s*\^?\s*2\b|square\s+m(?:eter|etre)")
    folded = (
        F.when(unit == "m", F.when(cubic, "m³").when(square, "m²").otherwise("m"))
        .when(unit.isin("m3", "m³"), "m³")
        .when(unit.isin("m2", "m²"), "m²")
        .when(unit.rlike(r"^metric\s+tons?$|^tonnes?$"), "metric ton")
        .when(unit.rlike("^kgs?$|^kilograms?$"), "kg")
        .otherwise("L")
    )
    return F.when(line.rlike(p), F.concat(F.regexp_replace(F.regexp_extract(line, p, 1), ",", "."), F.lit(" "), folded))


def indicator_totals(text: Column, slots: dict[str, Sequence[str]]) -> list[Column]:
    """One number for each slot, from the first of its patterns that matches."""
    number = r"[^\n0-9-]*(-?\d[\d,]*(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    return [F.coalesce(*(F.regexp_replace(matched(text, rf"(?i){p}{number}"), ",", "").try_cast("double") for p in ps)).alias(slot) for slot, ps in slots.items()]


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, line_text) of all lines."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "line_text"))


def stage_codes(line: Column) -> Column:
    """The life-cycle stages of a line; the sum of the first three is A1-A3 however it is written."""
    codes = F.regexp_extract_all(line, F.lit(STAGE), F.lit(1))
    return F.transform(codes, lambda x: F.when(F.char_length(x) > 2, "A1-A3").otherwise(x))


def stage_headers(lines: DataFrame, least: int = 3) -> DataFrame:
    """Lines that name at least three life-cycle stages, with the stages."""
    return lines.withColumn("stages", stage_codes(F.col("line_text"))).filter(F.size("stages") >= least)


def zip_stages(lines: DataFrame, key: str, values: Column) -> DataFrame:
    """Values by stage: each line of values takes the nearest header above it in its document; the first value of a stage stays, and sums over A1-A3 only take their place.

    lines have (key, line, stages) where headers have stages; values is an array of numbers, null on headers."""
    w = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    header = F.last(F.when(F.size("stages") >= 3, F.col("stages")), True).over(w)
    rows = lines.withColumn("header", header).withColumn("numbers", values).filter(F.col("numbers").isNotNull() & F.col("header").isNotNull())
    pairs = rows.select(key, "line", F.posexplode(F.arrays_zip("header", "numbers")).alias("place", "z")).select(key, "line", "place", F.col("z.header").alias("stage"), F.col("z.numbers").alias("value"))
    return pairs.filter("stage IS NOT NULL AND value IS NOT NULL AND stage <> 'A1-A3'").groupBy(key, "stage").agg(F.min_by("value", F.struct("line", "place")).alias("value"))


def default_fill(df: DataFrame, key: Column, value: str, defaults: DataFrame, alias: DataFrame) -> DataFrame:
    """Null values take the default of their type, or of the type their alias names; the source says so. defaults (type, default), alias (type, as_type)."""
    d2 = defaults.select(F.col("type").alias("as_type"), F.col("default").alias("__d2"))
    rows = df.withColumn("type", key)
    joined = rows.join(defaults.withColumnRenamed("default", "__d1"), "type", "left").join(alias, "type", "left").join(d2, "as_type", "left")
    found = F.coalesce("__d1", "__d2")
    source = F.when(F.col(value).isNotNull(), "declared").when(found.isNotNull(), "generic_default")
    return joined.withColumn("source", source).withColumn(value, F.coalesce(F.col(value), found)).drop("__d1", "__d2", "as_type")


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules a row breaks, in the rules' order; a rule that gives null holds."""
    return F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())


def against_truth(truth: DataFrame, found: DataFrame, keys: list[str], relative: float = 0.01) -> DataFrame:
    """Expected values (keys, want) with what was found (keys, got): match, wrong or missing."""
    joined = truth.join(found, keys, "left")
    close = F.abs(F.col("got") - F.col("want")) <= F.greatest(F.lit(1e-12), relative * F.abs(F.col("want")))
    return joined.withColumn("verdict", F.when(F.col("got").isNull(), "missing").when(close, "match").otherwise("wrong"))


def until_sentinel(df: DataFrame, by: list[str], flag: Column, *order: Column) -> DataFrame:
    """Rows before the first flagged one of their group."""
    return scanned(df, by, list(order), {"__seen": ("max", F.coalesce(flag, F.lit(False)).cast("int"))}).filter("__seen = 0").drop("__seen")


def joined_words(df: DataFrame, by: list[str], gap: Column, threshold: float, word: str, *order: Column) -> DataFrame:
    """Words of a row joined in order, with a blank where the gap to the word before exceeds the threshold or is below -2."""
    first = F.row_number().over(W.partitionBy(*by).orderBy(*order)) == 1
    blank = F.when(first, "").when((gap > threshold) | (gap < -2), " ").otherwise("")
    rows = df.withColumn("__piece", F.concat(blank, F.col(word))).withColumn("__at", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__piece"))), lambda x: x["__piece"]), "").alias("line_text"))


def filled_down(df: DataFrame, by: list[str], values: dict[str, Column], *order: Column) -> DataFrame:
    """Each value carried on from the last row that has it."""
    return scanned(df, by, list(order), {name: ("last", value) for name, value in values.items()})
