"""Drawing sheets: title block, scale, class and tags of pages; dimensions of callouts; room schedules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import agreement, bound, matched, parse_imperial, parse_metric, units_per_metre
from .aggregates import upper_median
from .joins import best_score_match, first_of, spread
from .layout import glyph_runs, paired_fractions, table_cells, tolerant_pick

# -- fixed values ----------------------------------------------------------------------------------------------

METRIC_RATIOS = (1, 2, 5, 10, 20, 25, 48, 50, 75, 100, 125, 150, 200, 250, 300, 400, 500, 600, 750, 1000, 1250, 1500, 2000, 2500, 5000)
IMPERIAL_RATIOS = (12, 16, 24, 32, 48, 64, 96, 128, 192)

#: What a drawing shows, and words of place and level that may stand before it.
DRAWN = ("plan", "elevation", "section", "site", "key-plan")
PLACES = (
    "north", "south", "east", "west", "nw", "ne", "sw", "se", "front", "rear", "left", "right", "first", "second", "third", "1st", "2nd", "3rd",
    "ground", "main", "upper", "lower", "basement", "roof", "foundation", "floor", "storey", "story", "level", "key", "site",
)

#: Classes by the words of a title, in order: a title must have a word of each group; a star stands for any ending
#: of the word. Then classes by the sheet number's first two signs, then its first.
TITLE_CLASSES = [
    ("plan", [["plan"], ["foundation", "main", "upper", "floor", "level", "ground", "basement"]]),
    ("plan", [["roof plan"]]),
    ("site", [["site plan"]]),
    ("section", [["section*"]]),
    ("elevation", [["elevation*"]]),
    ("schedule", [["schedule*"]]),
    ("detail", [["detail*"]]),
    ("general", [["note", "notes"]]),
    ("structural", [["framing"]]),
    ("general", [["assembl*"]]),
    ("other", [["3d", "view*"]]),
]
NUMBER_CLASSES = {
    "A0": "general", "A1": "site", "A2": "plan", "A3": "plan", "A4": "elevation", "A5": "section", "A6": "detail", "A7": "interior", "A8": "schedule", "A9": "3d",
    "S": "structural", "M": "mechanical", "E": "electrical", "P": "plumbing",
}
TRACED = ("plan", "elevation")

# -- columns ---------------------------------------------------------------------------------------------------


def title_phrase(line: Column) -> Column:
    """The drawing title inside a line of text: what is drawn, with up to three words of place before it and a mark such as A-A behind; lines of digits have none."""

    def phrase(words: Column, low: Column, first: Column) -> Column:
        drawn = lambda i: F.coalesce(F.get(low, i).isin(*DRAWN), F.lit(False))
        place = lambda i: F.coalesce((i >= 0) & F.get(low, i).isin(*PLACES), F.lit(False))

        def around(at: Column) -> Column:
            places = F.when(~place(at - 1), 0).when(~place(at - 2), 1).when(~place(at - 3), 2).otherwise(3)
            mark = F.coalesce(F.get(words, at + 1).rlike(r"(?i)^(?:[A-Z]-[A-Z]|[A-Z]{2}|\d-\d|[A-Z]\d|\d[A-Z])$"), F.lit(False)).cast("int")
            return bound(places, lambda before: F.array_join(F.slice(words, at - before + 1, before + 1 + mark), " "))

        return bound(F.when(drawn(first + 1) & place(first), first + 1).otherwise(first), around)  # a site plan is a plan

    def title(words: Column, low: Column) -> Column:
        hits = F.filter(F.transform(low, lambda w, i: F.when(w.isin(*DRAWN), i)), lambda i: i.isNotNull())
        found = bound(F.get(hits, F.lit(0)), lambda first: F.when(first.isNotNull(), phrase(words, low, first)))
        return bound(found, lambda p: F.when(F.char_length(p) >= 4, p))

    words = F.regexp_extract_all(line, F.lit(r"([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)"), F.lit(1))
    return bound(words, lambda w: bound(F.transform(w, F.lower), lambda low: title(w, low)))


def _has(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the words or phrases; a star stands for any ending."""
    one = lambda w: r"\b" + r"\s+".join(w.rstrip("*").split()) + ("" if w.endswith("*") else r"\b")
    return text.rlike(f"(?i)(?:{'|'.join(map(one, words))})")


def sheet_class(number: Column, title: Column) -> Column:
    text = F.coalesce(title, F.lit(""))
    by_title = F.coalesce(*(F.when(reduce(lambda a, b: a & b, (_has(text, g) for g in groups)), cls) for cls, groups in TITLE_CLASSES))
    known = F.create_map(*(F.lit(x) for kv in NUMBER_CLASSES.items() for x in kv))
    letter = F.substring(matched(number, "^([A-Z]+)"), 1, 1)
    digit = F.regexp_extract(number, r"^[A-Z]+(\d)", 1)
    return F.coalesce(by_title, F.when(digit != "", F.element_at(known, F.concat(letter, digit))), F.element_at(known, letter), F.lit("other"))


def detected_scale(text: Column) -> Column:
    """{ratio, kind} of the scale that a text names.

    The kinds are looked for in turn: after 'scale', bare 1:n, inches to a foot, not to scale. The first usual ratio wins, and a
    'not to scale' before any; else the first ratio, given one more digit if that makes it a usual one."""
    ratios = F.array(*map(F.lit, sorted({*METRIC_RATIOS, *IMPERIAL_RATIOS})))
    found = lambda p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: x.try_cast("double"))
    inches = r"(\d+)/(\d+)\"\s*=\s*1'-0\""
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(inches), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(inches), F.lit(2)).alias("b"))
    to_foot = F.transform(parts, lambda z: F.try_divide(12 * z["b"].try_cast("double"), z["a"].try_cast("double")))
    kinds = [("metric", found(r"[Ss]cale[\s:]*1\s*:\s*(\d+)")), ("metric", found(r"\b1\s*:\s*(\d+)\b")), ("imperial", to_foot)]
    of_kind = lambda kind: lambda x: F.struct(x.alias("ratio"), F.lit(kind).alias("kind"))
    all_ = F.concat(*(F.transform(values, of_kind(k)) for k, values in kinds))
    usual = F.get(F.filter(all_, lambda z: F.array_contains(ratios, z["ratio"].cast("int")) & (z["ratio"] == z["ratio"].cast("int"))), F.lit(0))
    first = F.get(all_, F.lit(0))
    longer = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (first["ratio"] * 10 + i).cast("int")), lambda x: F.array_contains(ratios, x)), F.lit(0))
    grown = F.struct(F.coalesce(longer.cast("double"), first["ratio"]).alias("ratio"), first["kind"].alias("kind"))
    unscaled = F.struct(F.lit(None).cast("double").alias("ratio"), F.lit("nts").alias("kind"))
    return F.when(usual.isNotNull(), usual).when(text.rlike(r"(?i)\bN\.?T\.?S\.?\b|NOT\s+TO\s+SCALE"), unscaled).when(first.isNotNull(), grown)


def auto_tag(cls: Column, title: Column, page_text: Column) -> Column:
    """{component, scope, preset} of what a page's outline stands for; any mention of a garage sets the scope."""
    low = F.lower(F.coalesce(title, F.lit("")))
    garage = low.rlike(r"\bgarage\b") | F.coalesce(page_text, F.lit("")).rlike(r"(?i)\bgarage\b")
    floor = low.rlike(r"\b(main|upper|lower|basement|ground|floor)\b") | garage
    plan = F.when(low.rlike(r"\bfoundation\b"), "slab_foundation").when(low.rlike(r"\broof\b"), "roof_plan").when(floor, "slab_above_grade")
    component = F.when(cls == "plan", plan).when(cls == "elevation", "wall_exterior")
    return F.struct(component.alias("component"), F.when(garage, "garage").otherwise("building").alias("scope"), F.when(cls == "elevation", "wood_2x6").alias("preset"))


def traceable(cls: Column) -> Column:
    """Whether outlines may be found on a page of this class."""
    return F.coalesce(cls.isin(*TRACED), F.lit(False))


# -- pages -----------------------------------------------------------------------------------------------------


def classified_pages(items: DataFrame, lines: DataFrame, page: str = "page") -> DataFrame:
    """(page, sheet_id, title, scale, cls, tag) of pages.

    items are (page, item_id, str); lines are rows of joined items (page, line_no, line_text, font, y, x_max). The number is the
    first item that is one, else the one in the largest line (lower on the page if fonts are within half a point). The title is
    the phrase in the largest line; within half a point the lower one, within five points of height the one further right."""
    own = first_of(items.filter(F.trim("str").rlike(r"^[A-Z]\d+\.\d+$")), [page], F.asc("item_id")).select(page, F.trim("str").alias("own_id"))
    numbers = lines.withColumn("number", matched(F.col("line_text"), r"\b([A-Z]\d+\.\d+)\b")).filter("number IS NOT NULL")
    in_line = tolerant_pick(numbers.select(page, "line_no", "font", "y"), page, [("font", True, 0.5), ("y", True, 0.0)], "line_no").join(numbers.select(page, "line_no", "number"), [page, "line_no"]).select(page, "number")
    titled = lines.withColumn("title", title_phrase(F.col("line_text"))).filter("title IS NOT NULL")
    best = tolerant_pick(titled.select(page, "line_no", "font", "y", "x_max"), page, [("font", True, 0.5), ("y", True, 5.0), ("x_max", True, 0.0)], "line_no")
    title = best.join(titled.select(page, "line_no", "title"), [page, "line_no"]).select(page, "title")
    text = lines.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_text"))), lambda z: z["line_text"]), " ").alias("page_text"))
    joined = text.join(own, page, "left").join(in_line, page, "left").join(title, page, "left").withColumn("sheet_id", F.coalesce("own_id", "number"))
    rows = joined.withColumn("scale", detected_scale(F.col("page_text"))).withColumn("cls", sheet_class(F.col("sheet_id"), F.col("title")))
    return rows.select(page, "sheet_id", "title", "scale", "cls", auto_tag(F.col("cls"), F.col("title"), F.col("page_text")).alias("tag"))


def callouts(items: DataFrame, page: str = "page") -> DataFrame:
    """(page, c_id, text, metres, format, cx, cy): words made of glyphs (str, x, y, width, height) that are lengths, feet and inches before metric.

    A stacked fraction goes to the nearest word that ends up to 8 before it (and overlaps it by 2 at most) on the same row."""
    words = glyph_runs(items, page)
    halves = paired_fractions(items, page).withColumn("w", F.concat(F.lit(" "), "num", F.lit("/"), "den"))
    near = words.select(page, "text", F.col("x").alias("wx"), F.col("y").alias("wy"), "width").join(halves.select(page, "w", F.col("x").alias("fx"), F.col("y").alias("fy")), page)
    gap = F.col("fx") - F.col("wx") - F.col("width")
    host = first_of(near.filter(gap.between(-2, 8) & (F.abs(F.col("fy") - F.col("wy")) <= 8) & ~F.col("text").rlike(r"^\d+$")), [page, "fx", "fy"], F.asc(F.abs(gap)), F.asc("wx"))
    whole = words.join(host.select(page, F.col("wx").alias("x"), F.col("wy").alias("y"), "w"), [page, "x", "y"], "left")
    text = F.when(F.col("w").isNotNull(), F.regexp_replace(F.concat(F.regexp_replace("text", '"$', ""), "w", F.lit('"')), r"\s+", " ")).otherwise(F.col("text"))
    read = whole.select(page, text.alias("text"), "x", "y", "width").withColumn("imperial", parse_imperial(F.col("text"))).withColumn("metric", parse_metric(F.col("text")))
    rows = read.withColumn("metres", F.coalesce("imperial", "metric")).filter("metres IS NOT NULL")
    place = F.row_number().over(W.partitionBy(page).orderBy("y", "x"))
    return rows.select(page, place.cast("long").alias("c_id"), "text", "metres", F.when(F.col("imperial").isNotNull(), "imperial").otherwise("metric").alias("format"), F.col("x").alias("cx"), F.col("y").alias("cy"))


def dimensions(found: DataFrame, segments: DataFrame, scales: DataFrame, page: str = "page") -> DataFrame:
    """Callouts paired with segments (page, s_id, x1, y1, x2, y2, length) under each page's declared ratio (page, ratio), with the scale they imply.

    Returns (page, c_id, text, metres, s_id, score, implied, declared, implied_median, agreement); the median is over scores above a
    half, the upper one of an even count. Callouts without a partner keep nulls; pages without a declared scale pair none."""
    declared = scales.filter("ratio IS NOT NULL").select(page, units_per_metre(F.col("ratio")).alias("declared"))
    wanted = found.join(spread(declared), page, "left")
    key = F.concat_ws("/", page, F.col("c_id").cast("string"))
    c = wanted.filter("declared IS NOT NULL").select(page, key.alias("c_id"), "cx", "cy", (F.col("metres") * F.col("declared")).alias("want"))
    pairs = best_score_match(c, segments, scope=[page]).select(F.col("c_id").alias("__key"), "s_id", "score")
    joined = wanted.withColumn("__key", key).join(spread(pairs), "__key", "left").join(spread(segments.select(page, "s_id", "length")), [page, "s_id"], "left")
    rows = joined.withColumn("implied", F.col("length") / F.col("metres"))
    sure = rows.filter("score > 0.5 AND implied IS NOT NULL")
    middle = upper_median(sure, [page], "implied").select(page, F.col("median").alias("implied_median"))
    return rows.join(spread(middle), page, "left").select(page, "c_id", "text", "metres", "s_id", "score", "implied", "declared", "implied_median", agreement(F.col("implied_median"), F.col("declared")).alias("agreement"))


def room_schedule(items: DataFrame, page: str = "page") -> DataFrame:
    """(page, num, name, area) of the first page with a room table: rows below the header up to a total; blank names are left out."""
    cells = table_cells(items, page)
    low = F.lower("text")
    role = F.when(low.isin("room", "room name"), "name").when((low == "area") | low.rlike(r"area\s*\(m"), "area").when(low.isin("#", "no.", "num"), "num")
    heads = cells.withColumn("role", role).filter("role IS NOT NULL")
    header = heads.filter("role = 'name'").groupBy(page).agg(F.min("row_no").alias("head"))
    columns = heads.join(spread(header), page).filter("row_no <= head").groupBy(page, "head", "role").agg(F.max_by("cell_no", F.struct("row_no", "cell_no")).alias("cell_no"))
    values = cells.join(spread(columns), [page, "cell_no"]).filter("row_no > head").groupBy(page, "row_no").pivot("role", ["num", "name", "area"]).agg(F.first("text"))
    ends = F.max(F.col("name").rlike("(?i)total|gross|net").cast("int")).over(W.partitionBy(page).orderBy("row_no").rowsBetween(W.unboundedPreceding, 0))
    named = values.filter("trim(name) <> ''").withColumn("over", ends).filter("over = 0")
    rows = named.select(page, "row_no", matched(F.col("num"), r"^\s*(\d+)").try_cast("int").alias("num"), F.trim("name").alias("name"), matched(F.col("area"), r"^\s*(\d+(?:\.\d+)?)").try_cast("double").alias("area"))
    first = rows.agg(F.min(page).alias(page))
    return rows.join(F.broadcast(first), page).select(page, "row_no", "num", "name", "area")


def scale_system(ratio: Column, label: Column) -> Column:
    """imperial where the label has foot or inch marks, or the ratio is of imperial scales alone; else metric."""
    marked = F.coalesce(label, F.lit("")).rlike("[\"']")
    alone = ratio.isin(sorted({*IMPERIAL_RATIOS} - {*METRIC_RATIOS, 24}))
    return F.when(marked | F.coalesce(alone, F.lit(False)), "imperial").otherwise("metric")
