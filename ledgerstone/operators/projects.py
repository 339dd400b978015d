"""Drawing projects and their fields: flat polygons, life cycle, ids, imports of a whole project, dependent options, quiet batches, validation of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import minted_id
from .joins import first_of
from .merging import STATES
from .storage import kept

#: What a polygon is if nothing says so.
POLYGON_DEFAULTS = {"kind": "area", "mode": "net", "scope": "building"}


def flat_polygons(polygons: DataFrame, pages: DataFrame, page: list[str]) -> DataFrame:
    """Polygons with their page's sheet number, class and title where they have none of their own, and the usual kind, mode and scope.

    polygons (page, poly_id, kind, mode, scope, sheet_id, sheet_class), pages (page, sheet_id, classification, title). A scope other
    than garage is building."""
    of_page = pages.select(*page, F.col("sheet_id").alias("__sheet"), F.col("classification").alias("__class"), F.col("title").alias("sheet_title"))
    joined = polygons.join(of_page, page, "left")
    filled = joined.withColumn("sheet_id", F.coalesce("sheet_id", "__sheet")).withColumn("sheet_class", F.coalesce("sheet_class", "__class"))
    filled = filled.withColumn("scope", F.when(F.col("scope") == "garage", "garage").otherwise(POLYGON_DEFAULTS["scope"]))
    return filled.withColumn("kind", F.coalesce("kind", F.lit(POLYGON_DEFAULTS["kind"]))).withColumn("mode", F.coalesce("mode", F.lit(POLYGON_DEFAULTS["mode"]))).drop("__sheet", "__class")


def closable(kind: Column, vertices: Column) -> Column:
    """Whether a polygon may be finished: lines need two points, others three."""
    return F.coalesce(F.size(vertices), F.lit(0)) >= F.when(kind == "polyline", 2).otherwise(3)


def components_of(targets: DataFrame, dims: DataFrame) -> DataFrame:
    """(dim, components): which components feed each dimension. targets (component, dims array), dims (dim)."""
    pairs = targets.select("component", F.explode("dims").alias("dim")).distinct()
    fed = pairs.groupBy("dim").agg(F.array_sort(F.collect_set("component")).alias("components"))
    return dims.join(fed, "dim", "left").withColumn("components", F.coalesce("components", F.array().cast("array<string>")))


def orthogonal(segments: DataFrame, least: float = 50.0, slack: float = 0.5) -> DataFrame:
    """Segments along an axis and long enough, with their axis and place on the other one."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    axis = F.when((dy < slack) & (dx >= least), "h").when((dx < slack) & (dy >= least), "v")
    return segments.withColumn("axis", axis).filter("axis IS NOT NULL").withColumn("at", F.when(F.col("axis") == "h", F.col("y1")).otherwise(F.col("x1")))


def trusted_import(previews: DataFrame, projects: DataFrame, current: DataFrame) -> DataFrame:
    """Fields after the newest project's computable dimensions are taken over at once.

    previews (project, dim, value), projects (project, updated), current (field_id, value, state); the newest project has the
    greatest time, the greater name on ties. Values taken become imported; fields without a preview stay."""
    newest = projects.agg(F.max(F.struct("updated", "project"))["project"].alias("project"))
    found = previews.join(F.broadcast(newest), "project").filter("value IS NOT NULL").select(F.col("dim").alias("field_id"), F.col("value").alias("__new"))
    joined = current.join(found, "field_id", "full")
    taken = F.col("__new").isNotNull()
    return joined.select("field_id", F.coalesce("__new", "value").alias("value"), F.when(taken, "imported").otherwise(F.col("state")).alias("state"))


def invalid_choices(children: DataFrame, options: DataFrame) -> DataFrame:
    """Child fields (field_id, parent_value, value) with values that their parent doesn't offer (parent_value, option): blank and calculated; others as they are."""
    offered = options.select("parent_value", F.col("option").alias("value")).distinct().withColumn("__ok", F.lit(True))
    joined = children.join(offered, ["parent_value", "value"], "left")
    reset = (F.coalesce(F.col("value"), F.lit("")) != "") & F.col("__ok").isNull()
    return joined.select("field_id", "parent_value", F.when(reset, "").otherwise(F.col("value")).alias("value"), F.when(reset, "calculated").alias("new_state"))


def with_ids(rows: DataFrame, key: str, taken: DataFrame, attempts: int = 4) -> DataFrame:
    """Rows with an id of six digits each, as their key gives it: the first of the attempts that nothing has yet, the smaller key first.

    Rows that lose every attempt take a longer id, so none is without. taken has the ids in use."""
    left, parts = rows.select(key), []
    used = taken.select(F.col("id").alias("rid"))
    for n in range(attempts):
        tried = left.withColumn("rid", minted_id(F.col(key), n)).join(used, "rid", "left_anti")
        won = kept(first_of(tried, ["rid"], F.asc(key)).select(key, "rid"))
        parts.append(won)
        used = used.unionByName(won.select("rid"))
        left = kept(left.join(won.select(key), key, "left_anti"))
    parts.append(left.withColumn("rid", F.sha2(F.col(key).cast("string"), 256)))
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.unionByName(p)
    return rows.join(ids.withColumnRenamed("rid", "id"), key)


def quiet_batches(events: DataFrame, batch: str, key: str, *order: Column) -> DataFrame:
    """What listeners hear of batches that are applied while they are muted: for each batch and field one notice with the last value, and how many events it stands for."""
    last = first_of(events, [batch, key], *order)
    counts = events.groupBy(batch, key).agg(F.count(F.lit(1)).alias("n_events"))
    return last.join(counts, [batch, key])


def file_errors(files: DataFrame, rules: dict[str, Column], most: int = 10) -> DataFrame:
    """Broken rules of files (path, id, records): each record of a file that has some, else the file's own row; the first few of each.

    rules are over the fields of `r`, the record. Returns (path, place, record_id, errors) where something is broken; place is null for
    a file without records."""
    from .extraction import violations

    rows = files.select("path", F.posexplode_outer("records").alias("place", "r"))
    broken = rows.withColumn("errors", F.slice(violations(rules), 1, most)).filter("size(errors) > 0")
    return broken.select("path", "place", F.col("r.id").alias("record_id"), "errors")


def class_counts(rows: DataFrame, by: list[str], factor: str) -> DataFrame:
    """Rows by class, and those among them with a factor other than zero."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.coalesce(F.col(factor), F.lit(0.0)) != 0, 1)).alias("n_nonzero"))


def applicable(requirements: DataFrame, chosen: dict[str, str | None]) -> DataFrame:
    """Rows of a requirement matrix that hold for what is chosen; a row's null or empty list, and an open choice, hold for all."""
    for column, value in chosen.items():
        if value is not None:
            requirements = requirements.filter(F.col(column).isNull() | (F.size(column) == 0) | F.array_contains(column, value))
    return requirements


def strongest(states: Column) -> Column:
    """The strongest claim in an array of states."""
    order = F.array(*map(F.lit, STATES))
    best = F.array_max(F.transform(states, lambda s: F.array_position(order, s)))
    return F.when(best > 0, F.get(order, (best - 1).cast("int")))


def sources_left(sources: DataFrame, edits: DataFrame, parents: DataFrame) -> DataFrame:
    """Recorded sources (field, ...) that user edits (field) leave standing: an edit ends the field's own, and that of the volume it is part of.

    parents (field, parent) names the volumes."""
    edited = edits.select("field")
    ended = edited.unionByName(parents.join(edited, "field", "left_semi").select(F.col("parent").alias("field")))
    return sources.join(ended, "field", "left_anti")


def calibrated(pages: DataFrame, readings: DataFrame) -> DataFrame:
    """Page calibrations (page, units_per_metre, ratio, label, state) after dimensions were read from pages; the reading with the largest seq counts.

    A reading (page, units_per_metre, ratio, label, seq) that isn't a positive finite number says nothing. Where one has no ratio or label,
    that of the reading before it holds, else the page's."""
    unit = F.col("units_per_metre")
    ratio, label = F.nullif("ratio", F.lit(0.0)), F.nullif("label", F.lit(""))
    usable = readings.filter((unit > 0) & ~F.isnan(unit) & (unit != float("inf")))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    new = usable.groupBy("page").agg(last(unit).alias("__unit"), last(ratio).alias("__ratio"), last(label).alias("__label"))
    read = F.col("__unit").isNotNull()
    named = F.when(read, F.coalesce("__label", label, F.lit("auto-calibrated"))).otherwise(F.col("label"))
    joined = pages.join(new, "page", "full")
    return joined.select("page", F.coalesce("__unit", "units_per_metre").alias("units_per_metre"), F.coalesce("__ratio", "ratio").alias("ratio"), named.alias("label"), F.when(read, "verified").otherwise(F.col("state")).alias("state"))
