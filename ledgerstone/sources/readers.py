"""Readers: cells of CSV sheets, picker tabs, catalogue files, drawing projects, field states, flat XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import first_of

POINT = "struct<x:double,y:double>"
IMPACT = "struct<total:struct<value:double,source:string>,by_stage:map<string,struct<value:double,source:string>>>"
#: Impact categories and life-cycle stages of a material record.
CATEGORIES = ("gwp_kgco2e", "gwp_bio_kgco2e", "ozone_depletion_kgcfc11eq", "acidification_kgso2eq", "eutrophication_kgneq", "smog_kgo3eq", "abiotic_depletion_fossil_mj", "water_consumption_m3", "primary_energy_nonrenewable_mj", "primary_energy_renewable_mj")
STAGES = ("A1", "A2", "A3", "A4", "A5", "B1", "B2", "B3", "B4", "B5", "B6", "B7", "C1", "C2", "C3", "C4", "D")

PROJECT = f"""uuid string, version string, fileName string, createdAt string, updatedAt string, pageCount int, params map<string,string>,
  scheduleData struct<rooms:array<struct<num:int,name:string,area:double>>>, pages array<struct<pageNum:int, sheetId:string, sheetTitle:string, classification:string,
  scale:struct<ratio:double,type:string,source:string,raw:string>, calibration:struct<pdfUnitsPerMetre:double,source:string,ratio:double,confirmed:boolean>,
  polygons:array<struct<id:string,label:string,vertices:array<{POINT}>,closed:boolean,type:string,mode:string,component:string,scope:string,depth_m:double,parentId:string,sheetId:string>>>>"""


def csv_cells(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Rows of one sheet as strings c0, c1, ... in their order (row_index): quotes, doubled quotes and line ends inside quotes are read; blanks are ''."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(columns)])
    raw = spark.read.csv(path, schema=schema, header=False, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    # a multi-line file is read by one task, so these ids follow its order
    return raw.select(F.monotonically_increasing_id().alias("row_index"), *(F.coalesce(c, F.lit("")).alias(c) for c in raw.columns))


def csv_line(line: Column, columns: int) -> Column:
    """The trimmed cells of a single line."""
    ddl = ", ".join(f"c{i} string" for i in range(columns))
    cells = F.from_csv(line, ddl, {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return F.array(*(F.coalesce(cells[f"c{i}"], F.lit("")) for i in range(columns)))


CODE = r"^T\d+(\|[^|]+)*$"


def picker_rows(cells: DataFrame, tab: str = "tab") -> DataFrame:
    """Material rows of a picker tab (c0 = name ... c13 = code), each with the last group and subgroup banner before it and the group's inline setting.

    cells need row_index; several tabs at once are told apart by the column `tab`, if there is one."""
    by = [tab] if tab in cells.columns else []
    rows = cells.filter(F.trim("c13").rlike(CODE)).withColumn("code", F.trim("c13"))
    depth = F.size(F.split("code", r"\|"))
    w = W.partitionBy(*by).orderBy("row_index").rowsBetween(W.unboundedPreceding, 0)
    setting = F.when(F.trim("c2") != "", F.struct(F.trim("c2").alias("label"), F.regexp_replace("c3", ",", "").try_cast("double").alias("value"), F.nullif(F.trim("c4"), F.lit("")).alias("unit")))
    filled = rows.select("*", F.last(F.when(depth == 2, F.struct(F.col("code").alias("code"), F.trim("c0").alias("name"), setting.alias("setting"))), True).over(w).alias("grp"), F.last(F.when(depth == 3, F.struct(F.col("code").alias("code"), F.trim("c0").alias("name"))), True).over(w).alias("sub"))
    parts = F.split("code", r"\|")
    return filled.filter((depth == 4) & (F.trim("c0") == "")).select(*by, "row_index", "code", F.element_at(parts, -1).alias("hash"), F.col("grp.name").alias("group_name"), F.col("sub.name").alias("sub_name"), F.col("grp.setting").alias("setting"), *(f"c{i}" for i in range(1, 13)))


def catalogue_files(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Records of group files, one row each; files that can't be parsed give none (unreadable_files names them). group_prefix comes along for pruning."""
    return _group_files(spark, paths, schema).filter("_bad IS NULL").select("group_prefix", F.explode("records").alias("r")).select("group_prefix", "r.*")


def unreadable_files(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """(path) of the group files that can't be parsed."""
    # the reader wants one more column than that of bad files
    return _group_files(spark, paths, schema).filter("_bad IS NOT NULL AND (records IS NULL OR size(records) >= 0)").select(F.col("_metadata.file_path").alias("path"))


def _group_files(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(f"group_prefix string, records array<struct<{schema}>>, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(paths)


def dictionary(spark: SparkSession, path: str, under: str | None = None, value: str = "string") -> DataFrame:
    """(key, value) of a JSON dictionary file; `under` names the field that holds the dictionary, where it isn't the file itself."""
    whole = spark.read.text(path, wholetext=True)
    kind = f"map<string,{value}>"
    held = F.from_json("value", f"{under} {kind}")[under] if under else F.from_json("value", kind)
    return whole.select(F.explode(held).alias("key", "value"))


def lookups(spark: SparkSession, files: dict[str, tuple[str, str | None]]) -> dict[str, DataFrame]:
    """The lookup tables of an importer by name: files are (path, field) of JSON dictionaries; joins broadcast them by their size."""
    return {name: dictionary(spark, path, under) for name, (path, under) in files.items()}


def projects(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of drawing projects with their page's calibration and the defaults of older writers."""
    raw = spark.read.schema(PROJECT).option("multiLine", True).json(path)
    pages = raw.select("fileName", "params", F.explode_outer("pages").alias("p"))
    polygons = pages.select("fileName", "params", F.col("p.pageNum").alias("page"), F.col("p.classification").alias("classification"), F.col("p.calibration.pdfUnitsPerMetre").alias("units_per_metre"), F.explode_outer("p.polygons").alias("g"))
    return polygons.select("fileName", "params", "page", "classification", "units_per_metre", F.col("g.id").alias("poly_id"), F.col("g.label").alias("label"), F.col("g.vertices").alias("vertices"), F.coalesce("g.closed", F.lit(True)).alias("closed"), F.coalesce("g.type", F.lit("area")).alias("kind"), F.coalesce("g.mode", F.lit("net")).alias("mode"), F.col("g.component").alias("component"), F.coalesce("g.scope", F.lit("building")).alias("scope"), F.col("g.depth_m").alias("depth"), F.col("g.parentId").alias("parent"))


def state_json(text: Column) -> Column:
    """Fields of a state dump, {"fields": {...}} or a bare dictionary, as an array of (field_id, value)."""
    wrapped = F.from_json(text, "fields map<string,string>")["fields"]
    return F.map_entries(F.coalesce(wrapped, F.from_json(text, "map<string,string>")))


def state_csv(headers: Column, values: Column) -> Column:
    """Pairs of a header row and one row of values; header text after a colon is dropped, unequal counts are an error."""
    names = F.transform(headers, lambda h: F.trim(F.substring_index(h, ":", 1)))
    pairs = F.arrays_zip(names.alias("field_id"), values.alias("value"))
    return F.when(F.assert_true(F.size(headers) == F.size(values), F.lit("as many values as headers are needed")).isNull(), pairs)


def flat_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def by_suffix(spark: SparkSession, path: str) -> DataFrame:
    """A file read by its suffix: json or csv; anything else is an error."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "json":
        return spark.read.text(path, wholetext=True).select(F.explode(state_json(F.col("value"))).alias("e")).select(F.col("e.key").alias("field_id"), F.col("e.value").alias("value"))
    if suffix == "csv":
        return spark.read.csv(path, header=True)
    raise ValueError(f"unsupported file: {path}")


def listed(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """All files below a folder, with size and time."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "length", "modificationTime")


def schema_paths(df: DataFrame) -> DataFrame:
    """(path, type) of all fields; structs are descended, arrays aren't."""

    def walk(prefix: str, kind: T.DataType):
        for f in kind.fields:
            yield prefix + f.name, f.dataType.simpleString().split("<")[0]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f"{prefix}{f.name}.", f.dataType)

    return df.sparkSession.createDataFrame(list(walk("", df.schema)), "path string, type string")


def workbook_fields(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Fields (field, number, text) of workbook cells (tab, cell, number, text, format), by a mapping (tab, cell, field, seq).

    Percentages count in hundredths there and in percent here. Blank cells and the #NAME? of broken references give no field; of several
    cells for one field the last in the mapping counts."""
    number = F.when(F.coalesce("format", F.lit("")).contains("%"), F.col("number") * 100).otherwise(F.col("number"))
    text = F.when(F.col("number").isNull(), F.nullif("text", F.lit("#NAME?")))
    found = cells.join(mapping, ["tab", "cell"]).select("field", "seq", number.alias("number"), text.alias("text"))
    return first_of(found.filter("number IS NOT NULL OR text IS NOT NULL"), ["field"], F.desc("seq")).select("field", "number", "text")
