"""Scalar functions on columns: numbers, units, text, dates. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- numbers -------------------------------------------------------------------------------------------------


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """A column that names a value as often as it likes, with the value worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_numeric(text: Column, default: float | None = 0.0) -> Column:
    """The number a text begins with, after currency signs and thousands commas are taken off; blank and N/A give the default."""
    bare = F.trim(F.regexp_replace(text, "[$£€¥,]", ""))
    number = matched(bare, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)").try_cast("double")
    return F.when(F.upper(bare).isin("", "N/A"), F.lit(default)).otherwise(F.coalesce(number, F.lit(default)))


def euro_number(text: Column) -> Column:
    """A number whose comma is a thousands sign if there is a point too, else the decimal sign."""
    plain = F.when(text.contains(".") & text.contains(","), F.regexp_replace(text, ",", "")).otherwise(F.regexp_replace(text, ",", "."))
    return plain.try_cast("double")


#: Decimals, grouped thousands, whole numbers of three digits or more, scientific notation.
NUMBER_TOKEN = r"(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\d{3,})(?:[eE][+-]?\d+)?"


def number_tokens(text: Column) -> Column:
    """The numbers in a text; whole numbers of one or two digits don't count."""
    return F.regexp_extract_all(text, F.lit(rf"(?<![\d.,])({NUMBER_TOKEN})(?![\d])"), F.lit(1))


def js_round(x: Column, digits: int = 0) -> Column:
    """Half away upwards on the scaled double: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def tolerance_match(a: Column, b: Column, relative: float = 0.01, absolute: float = 1e-12) -> Column:
    gap = F.abs(a - b)
    return (gap <= absolute) | (gap <= relative * F.abs(b))


def agreement(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(F.abs(a - b), b)


def percent_share(x: Column) -> Column:
    """A percentage kept within 0 and 100, as a share; no number means all of it."""
    return F.when(x.isNull() | F.isnan(x), 1.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0)) / 100)


# -- units ---------------------------------------------------------------------------------------------------


def normalize_unit(unit: Column) -> Column:
    """Lower case, superscripts as digits, bullets as *, cut at the first blank."""
    flat = F.translate(F.lower(F.trim(unit)), "²³•·", "23**")
    return F.regexp_replace(flat, r"\s.*$", "")


FOOT, INCH, R_PER_RSI = 0.3048, 0.0254, 5.678


def convert_quantity(qty: Column, from_unit: Column, to_unit: Column, config_label: Column, config_value: Column, config_unit: Column) -> Column:
    """A quantity in the material's unit; null where there is no way, or no positive quantity."""
    a, b = normalize_unit(from_unit), normalize_unit(to_unit)
    label = F.upper(config_label)
    metres = F.when(F.lower(config_unit) == "in", config_value * INCH).when(F.lower(config_unit) == "ft", config_value * FOOT).otherwise(config_value)
    usable = config_value.isNotNull() & (config_value != 0)
    return (
        F.when(qty.isNull() | (qty <= 0), F.lit(None).cast("double"))
        .when(a == b, qty)
        .when((a == "m2") & (b == "m3") & (label == "THICKNESS") & usable, qty * metres)
        .when((a == "m2") & (b == "m2*rsi") & (label == "R-VALUE") & usable, qty * config_value / R_PER_RSI)
    )


POINTS_PER_MM = 72 / 25.4


def units_per_metre(ratio: Column) -> Column:
    """Page units for a metre at a drawing scale of 1 : ratio."""
    return 1 / ((25.4 / 72) * ratio / 1000)


def scale_ratio(per_metre: Column) -> Column:
    """The drawing scale that units_per_metre undoes, rounded."""
    return js_round(1000 / ((25.4 / 72) * per_metre))


def pitch_factor(degrees: Column) -> Column:
    """Sloped area over plan area; null for slopes that are nearly upright."""
    c = F.cos(F.radians(degrees))
    return F.when(c > 0.01, 1 / c)


# -- text ----------------------------------------------------------------------------------------------------


def clean_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def csv_escape(text: Column) -> Column:
    """Thousands commas leave cells that look like numbers; cells with commas, quotes or line ends are quoted."""
    plain = F.when(text.rlike(r"^-?[\d,]+(\.\d+)?$"), F.regexp_replace(text, ",", "")).otherwise(text)
    return F.when(plain.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(plain)


def split_clean(text: Column) -> Column:
    """Items between commas or semicolons, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, r"[,;]\s*"), lambda x: F.trim(x)), lambda x: x != "")


def search_text(*parts: Column) -> Column:
    """What a search looks at: non-empty parts in lower case, joined by blanks."""
    return F.lower(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))


def natural_key(text: Column, width: int = 12) -> Column:
    """A key that sorts digits by value: runs of digits are padded to a fixed width."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, width, "0")).otherwise(x)), "")


def array_preview(items: Column, shown: int = 3) -> Column:
    """The first items joined, and how many more there are."""
    rest = F.size(items) - shown
    return F.concat(F.array_join(F.slice(items, 1, shown), ", "), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"))).otherwise(F.lit("")))


def format_band(x: Column) -> Column:
    """Fewer decimals for larger numbers; a dash for none."""
    return F.when(x.isNull(), F.lit("—")).when(F.abs(x) >= 1000, F.format_string("%.0f", x)).when(F.abs(x) >= 10, F.format_string("%.1f", x)).otherwise(F.format_string("%.3f", x))


# -- dates ---------------------------------------------------------------------------------------------------


def excel_serial_to_iso(serial: Column) -> Column:
    """An ISO date from a day count since 1899-12-30; counts below 30000 are none."""
    return F.when(serial >= 30000, F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int")), "yyyy-MM-dd"))


def expiry_to_iso(value: Column) -> Column:
    """A year means its last day; otherwise as excel_serial_to_iso."""
    return F.when(value < 3000, F.concat(F.lpad(value.cast("int").cast("string"), 4, "0"), F.lit("-12-31"))).otherwise(excel_serial_to_iso(value))


MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def parse_date(text: Column) -> Column:
    """ISO, day/month/year, '5 May 2020', 'Feb 5 , 2020' or a leading 'May 2020', in this order, as an ISO string; the calendar isn't checked.

    A month is known by its first three letters."""
    two = lambda d: F.lpad(d, 2, "0")

    def month(name: Column) -> Column:
        place = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3)))
        return F.when(place > 0, two(place.cast("string")))

    def ymd(pattern: str, year: int, month_at: int, day: int | None, named: bool = True) -> Column:
        g = lambda k: F.regexp_extract(text, pattern, k)
        m = month(g(month_at)) if named else two(g(month_at))
        whole = F.concat(g(year), F.lit("-"), m, F.lit("-"), F.lit("01") if day is None else two(g(day)))
        return F.when(text.rlike(pattern), whole)

    return F.coalesce(
        matched(text, r"(\d{4}-\d{2}-\d{2})"),
        ymd(r"(\d{1,2})/(\d{1,2})/(\d{4})", 3, 2, 1, named=False),
        ymd(r"(\d{1,2})\s+([A-Za-z]+)\s*,?\s*(\d{4})", 3, 2, 1),
        ymd(r"([A-Za-z]+)\s+(\d{1,2})\s*,?\s*(\d{4})", 3, 1, 2),
        ymd(r"^\s*([A-Za-z]+)\s+(\d{4})", 2, 1, None),
    )


def date_after(text: Column, label: str, within: int = 200) -> Column:
    """The date in the characters behind a label (a pattern without groups)."""
    return parse_date(matched(text, rf"{label}([\s\S]{{1,{within}}})"))


def loose_date_after(text: Column, label: str, within: int = 60) -> Column:
    """An ISO date behind a label whose digits and dashes may stand apart, as in '202 5 - 10 - 2 0'."""
    window = matched(text, rf"{label}([\s\S]{{1,{within}}})")
    joined = F.regexp_replace(F.regexp_replace(window, r"(?<=\d)\s+(?=\d)", ""), r"(?<=\d)\s*-\s*(?=\d)", "-")
    p = r"(\d{4})-(\d{1,2})-(\d{1,2})"
    two = lambda k: F.lpad(F.regexp_extract(joined, p, k), 2, "0")
    return F.when(joined.rlike(p), F.concat_ws("-", F.regexp_extract(joined, p, 1), two(2), two(3)))


def relative_time(at: Column, now: Column) -> Column:
    """How long ago: minutes, hours within a day, then the date and time; none means now."""
    minutes = js_round((now.cast("timestamp").cast("double") - at.cast("timestamp").cast("double")) / 60).cast("long")
    return (
        F.when(at.isNull() | (minutes < 1), "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60 + 0.5).cast("string"), F.lit("h ago")))
        .otherwise(F.date_format(at, "yyyy-MM-dd HH:mm"))
    )


# -- dimensions ----------------------------------------------------------------------------------------------


def parse_imperial(text: Column) -> Column:
    """Metres of feet-inch callouts such as 12'-6 1/2"; null outside 0.05 to 100 m."""
    p = r"^\s*(\d+)'\s*-?\s*(?:(\d+)(?:\s+(\d+)/(\d+))?\")?\s*$"
    g = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, p, k), F.lit("")).try_cast("double"), F.lit(0.0))
    metres = g(1) * FOOT + (g(2) + F.coalesce(F.try_divide(g(3), g(4)), F.lit(0.0))) * INCH
    return F.when(text.rlike(p) & metres.between(0.05, 100), metres)


def parse_metric(text: Column) -> Column:
    """Metres of callouts in mm or m; bare numbers below 30 with a decimal point are metres, else millimetres."""
    p = r"^\s*(\d+(?:\.\d+)?)\s*(mm|m)?\s*$"
    n = matched(text, p).try_cast("double")
    unit = F.regexp_extract(text, p, 2)
    metres = F.when((unit == "m") | ((unit == "") & (n < 30) & text.contains(".")), n).otherwise(n / 1000)
    return F.when(metres.between(0.05, 100), metres)


def parse_distance(text: Column) -> Column:
    """{value, unit} of a typed distance, by the first pattern that fits; a bare number has no unit."""
    t = F.lower(F.trim(text))
    feet = r"^(\d+(?:\.\d+)?)\s*(?:'|ft|feet)\s*(\d+(?:\.\d+)?)\s*(?:\"|in|inches)$"
    num = lambda p, k=1: matched(t, p, k).try_cast("double")
    out = F.when(t.rlike(feet), F.struct((num(feet) + num(feet, 2) / 12).alias("value"), F.lit("ft").alias("unit")))
    for unit, names in (("mm", "mm"), ("cm", "cm"), ("m", "m|metres|meters"), ("ft", "'|ft|feet"), ("in", '"|in|inches')):
        p = rf"^(\d+(?:\.\d+)?)\s*(?:{names})$"
        out = out.when(t.rlike(p), F.struct(num(p).alias("value"), F.lit(unit).alias("unit")))
    bare = r"^(\d+(?:\.\d+)?)$"
    return out.when(t.rlike(bare), F.struct(num(bare).alias("value"), F.lit(None).cast("string").alias("unit")))
