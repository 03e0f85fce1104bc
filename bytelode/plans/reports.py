"""Reports of an analysis: one row each, of a type that names its fields; JSON out and in; summaries."""

from __future__ import annotations

import shutil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelode.formats import FORMATS
from bytelode.functions.binary import human_size

#: Types of reports, with the fields that each has beside its type; errors have a severity.
TYPES: dict[str, tuple[str, ...]] = {
    "ErrorReport": ("severity",), "UnknownError": ("severity", "exception"), "CalculateChunkExceptionReport": ("severity", "exception", "start_offset", "handler"),
    "CalculateMultiFileExceptionReport": ("severity", "exception", "path", "handler"), "ExtractCommandFailedReport": ("severity", "command", "stdout", "stderr", "exit_code"),
    "OutputDirectoryExistsReport": ("severity", "path"), "ExtractorDependencyNotFoundReport": ("severity", "dependencies"), "ExtractorTimedOut": ("severity", "cmd", "timeout"),
    "MaliciousSymlinkRemoved": ("severity", "link", "target"), "MultiFileCollisionReport": ("severity", "paths", "handler"),
    "StatReport": ("path", "size", "is_dir", "is_file", "is_link", "link_target"), "HashReport": ("md5", "sha1", "sha256"), "FileMagicReport": ("magic", "mime_type"), "RandomnessReport": ("shannon", "chi_square"),
    "ChunkReport": ("id", "handler_name", "start_offset", "end_offset", "size", "is_encrypted", "extraction_reports"), "UnknownChunkReport": ("id", "start_offset", "end_offset", "size", "randomness"),
    "CarveDirectoryReport": ("carve_dir",), "MultiFileReport": ("id", "handler_name", "name", "paths", "extraction_reports"), "ExtractedFileDeletedReport": ("path", "handler_name"),
    "ExtractionProblem": ("problem", "resolution", "path"), "PathTraversalProblem": ("problem", "resolution", "path", "extraction_path"), "LinkExtractionProblem": ("problem", "resolution", "path", "link_path"),
    "SpecialFileExtractionProblem": ("problem", "resolution", "path", "mode", "device"),
}
NESTED = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
_MEASURE = T.StructType([T.StructField("percentages", T.ArrayType(T.DoubleType())), T.StructField("block_size", T.LongType()), T.StructField("mean", T.DoubleType())])
_RANDOM = T.StructType([T.StructField("shannon", _MEASURE), T.StructField("chi_square", _MEASURE)])
KINDS: dict[str, T.DataType] = {
    **dict.fromkeys(("start_offset", "end_offset", "size", "exit_code", "mode", "device"), T.LongType()), **dict.fromkeys(("is_dir", "is_file", "is_link", "is_encrypted"), T.BooleanType()),
    **dict.fromkeys(("dependencies", "paths"), T.ArrayType(T.StringType())), "extraction_reports": NESTED, "shannon": _MEASURE, "chi_square": _MEASURE, "randomness": _RANDOM, "timeout": T.DoubleType(),
}
FIELDS = list(dict.fromkeys(f for fields in TYPES.values() for f in fields))
#: All reports in one wide table: nulls where a type lacks a field; ``extra`` holds what registered types add.
SCHEMA = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("typename", T.StringType()), *(T.StructField(f, KINDS.get(f, T.StringType())) for f in FIELDS), T.StructField("extra", T.StringType())])


class UnknownType(ValueError):
    """No such type of report, or no type is named."""


def register(name: str, fields: tuple[str, ...]) -> None:
    """A type of report of one's own; its fields that no built-in type has go to ``extra``."""
    if name in TYPES:
        raise ValueError(f"there is a type {name} already")
    TYPES[name] = fields


def reports(rows: DataFrame, typename: str, **fields: Column) -> DataFrame:
    """Reports of one type, with ``rows``'s file_id."""
    if typename not in TYPES:
        raise UnknownType(typename)
    own = {**fields}
    return rows.select("file_id", F.lit(typename).alias("typename"), *(own[f].cast(KINDS.get(f, T.StringType())).alias(f) if f in own else F.lit(None).cast(KINDS.get(f, T.StringType())).alias(f) for f in FIELDS), F.lit(None).cast("string").alias("extra"))


def of_analysis(made) -> DataFrame:
    """Reports of all files of an analysis, of every type that it can give.

    What went wrong as a chunk was unpacked is nested in the chunk's report.
    """
    wrong = made.entries.filter(F.col("problem").isNotNull())
    needed = F.regexp_extract("problem", r"^(\S+) is needed$", 1)
    kind = (
        F.when(needed != "", "ExtractorDependencyNotFoundReport").when(F.col("problem").rlike(r"^\S+ ended with "), "ExtractCommandFailedReport").when(F.col("problem").rlike(r"^\S+ took over "), "ExtractorTimedOut")
        .when(F.col("problem").rlike("path leaves the root|path is absolute"), "PathTraversalProblem").when(F.col("problem").startswith("the link to "), "LinkExtractionProblem").when(F.col("problem") == "a special file", "SpecialFileExtractionProblem")
        .when(F.col("problem").rlike(r"^\w+(Error|Invalid|Large): "), "UnknownError").otherwise("ExtractionProblem")
    )
    one = F.create_map(*[x for name, c in (("__typename__", kind), ("severity", F.col("severity")), ("problem", F.col("problem")), ("resolution", F.col("resolution")), ("path", F.col("path"))) for x in (F.lit(name), c)])
    problems = wrong.groupBy("parent_id").agg(F.sort_array(F.collect_list(F.to_json(one))).alias("_problems")).select(F.col("parent_id").alias("_parent"), F.transform("_problems", lambda x: F.from_json(x, "map<string,string>")).alias("_problems"))
    chunks = reports(made.chunks.join(problems, F.col("chunk_id") == F.col("_parent"), "left"), "ChunkReport", extraction_reports=F.col("_problems"), id=F.col("chunk_id"), handler_name=F.col("handler"), start_offset=F.col("start"), end_offset=F.col("end"), size=F.col("end") - F.col("start"), is_encrypted=F.col("is_encrypted"))
    padding = reports(made.gaps.filter("kind = 'padding'"), "ChunkReport", id=F.col("chunk_id"), handler_name=F.lit("padding"), start_offset=F.col("start"), end_offset=F.col("end"), size=F.col("end") - F.col("start"), is_encrypted=F.lit(False))
    measured = made.randomness.select(F.col("chunk_id").alias("_measured"), F.struct("shannon", "chi_square").alias("_random")).filter("_measured IS NOT NULL")
    gaps = made.gaps.filter("kind = 'unknown'").join(measured, F.col("chunk_id") == F.col("_measured"), "left")
    unknown = reports(gaps, "UnknownChunkReport", randomness=F.col("_random"), id=F.col("chunk_id"), start_offset=F.col("start"), end_offset=F.col("end"), size=F.col("end") - F.col("start"))
    stat = reports(made.tasks, "StatReport", path=F.col("path"), size=F.col("length"), is_file=F.lit(True), is_dir=F.lit(False), is_link=F.lit(False))
    every = [
        stat, chunks, padding, unknown,
        reports(made.tasks, "HashReport", md5=F.col("md5"), sha1=F.col("sha1"), sha256=F.col("sha256")), reports(made.tasks, "FileMagicReport", magic=F.col("magic"), mime_type=F.col("mime_type")),
        reports(made.randomness.filter("chunk_id IS NULL"), "RandomnessReport", shannon=F.col("shannon"), chi_square=F.col("chi_square")),
        reports(made.errors, "CalculateChunkExceptionReport", severity=F.col("severity"), exception=F.col("error"), start_offset=F.col("start"), handler=F.col("handler")),
        reports(made.sets.join(problems, F.col("set_id") == F.col("_parent"), "left"), "MultiFileReport", id=F.col("set_id"), handler_name=F.col("handler"), name=F.col("name"), paths=F.col("paths"), extraction_reports=F.col("_problems")),
        reports(made.collisions, "MultiFileCollisionReport", severity=F.lit("ERROR"), paths=F.array("path")), reports(made.deleted, "ExtractedFileDeletedReport", path=F.col("path"), handler_name=F.col("handler")),
        # What is carved out of a file that is no container as a whole.
        reports(made.chunks.join(made.tasks.select("file_id", "length"), "file_id").filter("start > 0 OR end < length").select("file_id").distinct(), "CarveDirectoryReport", carve_dir=F.concat("file_id", F.lit("_extract"))),
    ]
    out = every[0]
    for rows in every[1:]:
        out = out.unionByName(rows)
    return out


def to_json(rows: DataFrame) -> DataFrame:
    """(file_id, json): fields that are null are left out; the type is ``__typename__``."""
    body = F.struct(F.col("typename").alias("__typename__"), *FIELDS)
    return rows.select("file_id", F.to_json(body).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """The wide table again; a row without a known type raises."""
    inner = T.StructType([T.StructField("__typename__", T.StringType()), *(T.StructField(f, KINDS.get(f, T.StringType())) for f in FIELDS)])
    parsed = rows.select("file_id", F.from_json("json", inner).alias("r"))
    name = F.col("r.__typename__")
    known = F.when(name.isin(*TYPES), name).otherwise(F.raise_error(F.concat(F.lit("unknown type of report: "), F.coalesce(name, F.lit("none is named")))))
    return parsed.select("file_id", known.alias("typename"), *(F.col(f"r.{f}").alias(f) for f in FIELDS), F.lit(None).cast("string").alias("extra"))


def errors(rows: DataFrame) -> DataFrame:
    """(file_id, typename, severity): reports that are errors, and those nested in chunks."""
    top = rows.filter(F.col("severity").isNotNull()).select("file_id", "typename", "severity")
    nested = rows.filter("typename IN ('ChunkReport', 'MultiFileReport')").select("file_id", F.explode("extraction_reports").alias("r")).select("file_id", F.col("r")["__typename__"].alias("typename"), F.col("r")["severity"].alias("severity"))
    return top.unionByName(nested.filter(F.col("severity").isNotNull()))


def exit_code(errors: DataFrame) -> DataFrame:
    """One row: 1 if any error is more than a warning, else 0."""
    return errors.agg(F.coalesce(F.max((F.col("severity") == "ERROR").cast("int")), F.lit(0)).alias("exit_code"))


def size_summary(stat: DataFrame) -> DataFrame:
    """One row: counts of files, directories and links, and the bytes of files."""
    return stat.agg(F.count_if("is_file").alias("files"), F.count_if("is_dir").alias("dirs"), F.count_if("is_link").alias("links"), F.coalesce(F.sum(F.when(F.col("is_file"), F.col("size"))), F.lit(0)).alias("size"))


def distribution(chunks: DataFrame) -> DataFrame:
    """(handler, size): bytes by handler; ``unknown`` is always there."""
    own = chunks.select("handler", F.col("size").cast("long").alias("size")).unionByName(chunks.sparkSession.sql("SELECT 'unknown' AS handler, 0L AS size"))
    return own.groupBy("handler").agg(F.sum("size").alias("size"))


def ranked(distribution: DataFrame) -> DataFrame:
    """(handler, size, shown, percent) in order of size, the largest first."""
    # A row for each format: a window over them is small.
    return distribution.withColumn("total", F.sum("size").over(Window.partitionBy(F.lit(0)))).select("handler", "size", human_size(F.col("size")).alias("shown"), F.when(F.col("total") > 0, F.col("size") * 100 / F.col("total")).otherwise(0.0).alias("percent")).orderBy(F.col("size").desc(), "handler")


def output_dir(tasks: DataFrame) -> DataFrame:
    """(root, path): what an analysis of a root gave: its carve directory if it has one, else its first subtask's path."""
    pick = F.coalesce(F.min("carve_dir"), F.min(F.when(F.col("depth") > 0, F.col("path"))))
    return tasks.groupBy("root").agg(pick.alias("path"))


def formats_table(spark: SparkSession) -> DataFrame:
    """(name, type, patterns, offset, tool, note, fully_supported) of all formats, in order of name."""
    rows = [(f.name, f.kind, list(f.patterns), f.offset, f.tool, f.note, not f.note) for f in FORMATS]
    return spark.createDataFrame(rows, "name string, type string, patterns array<string>, offset int, tool string, note string, fully_supported boolean").orderBy(F.upper("name"))


def tools(spark: SparkSession) -> DataFrame:
    """(tool, formats, installed): commands that unpack what the library doesn't, and whether the driver has them."""
    here = [f.tool for f in FORMATS if f.tool and shutil.which(f.tool)]
    found = formats_table(spark).filter(F.col("tool").isNotNull()).groupBy("tool").agg(F.sort_array(F.collect_set("name")).alias("formats"))
    return found.withColumn("installed", F.col("tool").isin(*here) if here else F.lit(False)).orderBy("tool")


def plot(percentages: list[float], width: int = 80, height: int = 10) -> str:
    """An ASCII picture of a blocked measure."""
    if not percentages:
        raise TypeError("there is nothing to plot")
    step = max(1, -(-len(percentages) // width))
    bars = [max(percentages[i : i + step]) for i in range(0, len(percentages), step)]
    rows = []
    for level in range(height, 0, -1):
        rows.append(f"{level * 100 // height:>4} |" + "".join("#" if b >= (level - 0.5) * 100 / height else " " for b in bars))
    return "\n".join([*rows, "     +" + "-" * len(bars)])
