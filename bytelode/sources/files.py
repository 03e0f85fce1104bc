"""Files as tables: content, metadata, hashes, kinds, and which of them to analyse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelode.functions.binary import blob, signature

#: Hex prefixes and names of kinds that need no search.  A part of what a full detector knows.
SIGNATURES = {
    "89504e470d0a1a0a": "PNG image", "ffd8ff": "JPEG image", "474946383761": "GIF image", "474946383961": "GIF image", "255044462d": "PDF document", "52494646": "RIFF data",
    "4f676753": "Ogg data", "664c6143": "FLAC audio", "494433": "Audio file", "7f454c46": "ELF", "504b0304": "Zip archive", "1f8b08": "gzip compressed data", "425a68": "bzip2 compressed data",
    "fd377a585a00": "XZ compressed data", "377abcaf271c": "7-zip archive", "28b52ffd": "Zstandard compressed data", "cafebabe": "compiled Java class data", "53514c69746520666f726d6174203300": "SQLite 3.x database",
    "3c21444f43545950": "HTML document", "3c21646f63747970": "HTML document", "3c68746d6c": "HTML document", "3c3f786d6c": "XML document",
    "62464c54": "BFLT executable", "464f5231": "Erlang BEAM file", "de120495": "GNU message catalog", "950412de": "GNU message catalog", "1b252d3132333435": "HP Printer Job Language data", "cafedada": "Java module image", "000001ba": "MPEG sequence", "000001b3": "MPEG sequence",
    "00000100": "MS Windows icon resource", "465753": "Macromedia Flash data", "435753": "Macromedia Flash data", "0001000000": "TrueType Font data", "774f4646": "Web Open Font Format", "774f4632": "Web Open Font Format", "42303030": "Windows Embedded CE binary image", "00090ff00ff0": "Xilinx BIT data",
}
#: Starts of names of kinds that are not searched, and ends of paths that are not.
SKIPPED_KINDS = ("PNG image", "JPEG image", "GIF image", "PDF document", "Audio file", "Ogg data", "FLAC audio", "RIFF data", "SQLite 3.x", "compiled Java class", "BFLT", "Erlang BEAM file", "GNU message catalog", "HP Printer Job Language",
                 "Java module image", "MPEG", "MS Windows icon resource", "Macromedia Flash data", "TrueType Font data", "Web Open Font Format", "Windows Embedded CE binary image", "Xilinx BIT data")
SKIPPED_SUFFIXES = (".rlib",)
#: Media types of kinds.
MIME = {
    "PNG image": "image/png", "JPEG image": "image/jpeg", "GIF image": "image/gif", "PDF document": "application/pdf", "ELF": "application/x-executable", "Zip archive": "application/zip", "gzip compressed data": "application/gzip", "bzip2 compressed data": "application/x-bzip2",
    "XZ compressed data": "application/x-xz", "7-zip archive": "application/x-7z-compressed", "Zstandard compressed data": "application/zstd", "compiled Java class data": "application/x-java-applet", "SQLite 3.x database": "application/vnd.sqlite3", "HTML document": "text/html", "XML document": "text/xml",
    "Ogg data": "application/ogg", "FLAC audio": "audio/flac", "Audio file": "audio/mpeg", "MPEG sequence": "video/mpeg", "MS Windows icon resource": "image/vnd.microsoft.icon", "Macromedia Flash data": "application/x-shockwave-flash", "TrueType Font data": "font/sfnt", "Web Open Font Format": "font/woff",
}


def mime_type(magic: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(table[magic], F.lit("application/octet-stream"))



def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(file_id, path, length, content) of files below ``path``; columns that aren't used aren't read.

    Spark's reader gives no row for an empty file.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.sha2(F.col("path"), 256).alias("file_id"), "path", "length", "content")


def text_files(rows: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """The same columns of a table's texts."""
    content = F.coalesce(blob(F.col(text)), F.lit(b""))
    return rows.select(F.col(key).cast("string").alias("file_id"), (F.col(path) if path else F.col(key).cast("string")).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


def stat(files: DataFrame) -> DataFrame:
    return files.select("file_id", "path", F.col("length").alias("size"), F.lit(False).alias("is_dir"), F.lit(True).alias("is_file"), F.lit(False).alias("is_link"), F.lit(None).cast("string").alias("link_target"))


def hashes(files: DataFrame) -> DataFrame:
    return files.select("file_id", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))


def with_kind(files: DataFrame) -> DataFrame:
    return files.withColumn("magic", signature(F.col("content"), SIGNATURES))


def skipped(magic: Column, path: Column, kinds: tuple[str, ...] = SKIPPED_KINDS, suffixes: tuple[str, ...] = SKIPPED_SUFFIXES) -> Column:
    test = F.lit(False)
    for kind in kinds:
        test = test | magic.startswith(kind)
    for suffix in suffixes:
        test = test | path.endswith(suffix)
    return test


def to_search(files: DataFrame, depth: Column | int = 0, max_depth: int = 10) -> DataFrame:
    """Files that the search goes through: within the depth, with content, of no skipped kind.  Cheap tests come first."""
    at = F.lit(depth) if isinstance(depth, int) else depth
    return with_kind(files.filter((at < max_depth) & (F.col("length") > 0))).filter(~skipped(F.col("magic"), F.col("path")))


def children(listing: DataFrame, done: DataFrame, made: DataFrame) -> DataFrame:
    """Paths of a listing that are neither processed yet nor made by unpacking."""
    return listing.join(done.select("path"), "path", "left_anti").join(made.select("path"), "path", "left_anti")


def groups(files: DataFrame, pattern: str) -> DataFrame:
    """Sets of files that are parts of one: (folder, stem, paths in order, length); ``pattern`` has groups for stem and part.

    Members are gathered as paths and lengths, not content.
    """
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", "[^/]*$", "")
    own = files.select("path", "length", folder.alias("folder"), F.regexp_extract(name, pattern, 1).alias("stem"), F.regexp_extract(name, pattern, 2).alias("part")).filter("stem <> ''")
    return own.groupBy("folder", "stem").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.sum("length").alias("length"), F.count("*").alias("parts"), F.min("path").alias("first"))


def collisions(sets: DataFrame) -> DataFrame:
    """(path, sets): paths that more than one set claims."""
    return sets.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count("*").alias("sets")).filter("sets > 1")


def first_of(files: DataFrame, by: str, order: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    return files.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
