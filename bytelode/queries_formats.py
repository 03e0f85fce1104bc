"""Queries that run the search, the formats' rules, the unpackers, the analysis and sets of files, with SQL that states what they must give.

Samples of all formats are looked for in files made of them; containers are also made around each text of whole tables, where the SQL
gets the ranges by arithmetic from the texts' lengths, and what comes out by the texts' hashes.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import lzma
import tempfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode import samples
from bytelode.formats import FORMATS, Format, Span
from bytelode.functions.batches import map_batches
from bytelode.operators import extract, intervals, measures, multifile, scan
from bytelode.plans import recursion, reports
from bytelode.queries import pages, query, read
from bytelode.sources import files as source

FILES = "file_id string, path string, length long, content binary"


def values(rows: list[tuple], names: str) -> str:
    """SQL of a table of values."""
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
    kinds = [next((type(r[i]) for r in rows if r[i] is not None), str) for i in range(len(rows[0]))]
    casts = ", ".join(f"{n}::{'VARCHAR' if k is str else 'BOOLEAN' if k is bool else 'BIGINT'} AS {n}" for n, k in zip(names.split(", "), kinds))
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names})"


def frame(spark: SparkSession, files: dict[str, bytes]) -> DataFrame:
    return spark.createDataFrame([(n, f"/samples/{n}", len(d), bytearray(d)) for n, d in files.items()], FILES)


# Every format's range ----------------------------------------------------------------------------


@lru_cache(maxsize=1)
def families() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for f in FORMATS:
        if f.name not in out.setdefault(f.kind.replace(" ", "_"), []):
            out[f.kind.replace(" ", "_")].append(f.name)
    return out


def _ranges(names: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All formats' patterns over a file for each sample; the outer chunks of the sample's own format."""
        files = {n: (a := samples.around(n))[0] + samples.made()[n] + a[1] for n in names}
        found = scan.search_chunks(frame(spark, files)).filter(F.col("error").isNull())
        return intervals.outer(found).filter(F.col("handler") == F.col("file_id")).select("handler", "start", F.col("end").alias("stop"))

    return run


for _kind, _names in families().items():
    _run = _ranges(_names)
    _run.__name__ = f"formats_{_kind}"
    query(values([(n, len(samples.around(n)[0]), len(samples.around(n)[0]) + len(samples.made()[n])) for n in _names], "handler, start, stop"))(_run)


def _damaged() -> dict[str, bytes]:
    """Samples with a checksum, of which one byte is another: none is found."""
    out = {}
    for name, at in (("sevenzip", 12), ("trx_v1", 50), ("hdr1", 100), ("cramfs", 200), ("shrs", 1800), ("romfs", 100), ("lzo", 20), ("partclone", 60), ("jffs2_new", 9), ("arj", 8)):
        data = bytearray(samples.made()[name])
        data[at] ^= 0x55
        out[name] = samples.HEAD + bytes(data)
    return out


@query(values([(n, 0) for n in _damaged()], "handler, found"))
def formats_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = frame(spark, _damaged())
    hits = scan.search_chunks(files).filter(F.col("error").isNull()).filter("handler = file_id AND start = 24").groupBy("file_id").agg(F.count("*").alias("n"))
    return files.join(hits, "file_id", "left").select(F.col("file_id").alias("handler"), F.coalesce("n", F.lit(0)).cast("long").alias("found"))


#: Containers whose size is arithmetic, around a body.
STORED = {"tar": samples.tarred, "zip": samples.zipped, "ar": samples.ar, "cpio_portable_ascii": lambda body: samples.cpio(body=body), "cpio_binary": samples.cpio_binary, "cpio_portable_old_ascii": samples.cpio_old}
UP = lambda x, n: f"(({x}) + {n - 1}) // {n} * {n}"
SIZES = {
    "tar": UP("512 + " + UP("n", 512) + " + 1024 + 1024", 10240), "zip": "30 + 5 + n + 30 + 9 + 6 + 46 + 5 + 46 + 9 + 22 + 9", "ar": "8 + 60 + n + n % 2", "cpio_portable_ascii": UP("116 + " + UP("n", 4) + " + 116 + 124", 512),
    "cpio_binary": UP("26 + 6 + n + n % 2 + 26 + 11 + 1", 512), "cpio_portable_old_ascii": UP("76 + 6 + n + 76 + 11", 512),
}


def made_around(texts: DataFrame, makers: dict[str, Callable[[bytes], bytes]], head: bytes = b"", tail: bytes = b"") -> DataFrame:
    """(id, text) to files, one for each maker: file_id is the id and the maker's name."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                out = [(f"{i}:{name}", head + make((text or "").encode()) + tail) for name, make in makers.items()]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out]), pa.array([f"/made/{n}" for n, _ in out]), pa.array([len(d) for _, d in out], pa.int64()), pa.array([d for _, d in out], pa.binary())], names=["file_id", "path", "length", "content"])

    return map_batches(texts, rows, FILES)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query("WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS handler, 24::BIGINT AS start, (24 + {size})::BIGINT AS stop FROM d" for name, size in SIZES.items()))
def formats_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container of each kind around every text, between other bytes; all patterns are searched."""
    # Dealt out first, as a table in one row group is read by one task, and the search takes far longer than the shuffle.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    found = scan.search_chunks(made_around(texts(spark, sf_dir).repartition(parts), STORED, samples.HEAD, samples.TAIL)).filter(F.col("error").isNull())
    return intervals.outer(found).select(F.split("file_id", ":")[0].cast("long").alias("doc_id"), "handler", "start", F.col("end").alias("stop"))


# The sweep ---------------------------------------------------------------------------------------


def _size(n: int):
    return lambda r: n


def _fails(r):
    raise ValueError("a defect")


TOYS = (
    Format("toy_a", "toy", ("41",), 0, _size(5), None, ""), Format("toy_b", "toy", ("42 ( 42 | 43 )",), -1, _size(10), None, ""), Format("toy_none", "toy", ("44",), 0, lambda r: Span(r.base, r.base), None, ""), Format("toy_fails", "toy", ("45 58 43",), 0, _fails, None, ""),
)
#: content, the ranges that the sweep finds, and the places at which a format fails.
SWEEPS: list[tuple[bytes, list[tuple[str, int, int | None]]]] = [
    (b"00A23450", [("toy_a", 2, 7)]), (b"0BB34A678900", [("toy_b", 0, 10)]), (b"A23450BB3456789", [("toy_a", 0, 5), ("toy_b", 5, 15)]), (b"0BC34A67890A2345", [("toy_b", 0, 10), ("toy_a", 11, 16)]), (b"A23450BB34", [("toy_a", 0, 5)]),
    (b"0BBA2345", [("toy_a", 3, 8)]), (b"BB34A678900", [("toy_a", 4, 9)]), (b"EXCA2345", [("toy_a", 3, 8), ("toy_fails", 0, None)]), (b"00D00", []), (b"", []),
]


@query(values([(f"{i}", *r) for i, (_, found) in enumerate(SWEEPS) for r in found], "file_id, handler, start, stop"))
def search_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which hits count: what lies in an accepted chunk, goes beyond the file or starts before it does not; a format that fails hides no other."""
    files = frame(spark, {f"{i}": content for i, (content, _) in enumerate(SWEEPS)})
    return scan.search_chunks(files, (), TOYS).select("file_id", "handler", "start", F.col("end").alias("stop"))


# Unpacking ---------------------------------------------------------------------------------------

_BODY, _SECOND = samples.BODY, b"second"
#: What comes out of samples: (path, type, content).
HELD: dict[str, list[tuple[str, str, bytes | None]]] = {
    **{n: [("a.txt", "file", _BODY), ("dir/b.txt", "file", _SECOND)] for n in ("tar", "zip")}, **{n: [("a.txt", "file", _BODY), ("dir", "dir", None)] for n in ("cpio_portable_ascii", "cpio_portable_ascii_crc", "rpm")},
    **{n: [("a.txt", "file", _BODY)] for n in ("cpio_portable_old_ascii", "cpio_binary", "ar", "romfs")}, **{n: [(f"{n}.uncompressed", "file", samples.RAW)] for n in ("bzip2", "xz", "lzma", "zstd", "zlib", "qca_lzma", "lzip")},
    "gzip": [("gzip.uncompressed", "file", samples.RAW + b"more")], "lzo": [("lzo.uncompressed", "file", b"abcd")], "lz4_default": [("lz4.uncompressed", "file", b"abcd")], "lz4_legacy": [("lz4.uncompressed", "file", b"x" * 20)], "lz4_skippable": [("lz4.uncompressed", "file", b"")],
    "qnx_deflate": [("qnx_deflate.uncompressed", "file", b"literal text")], "xalz": [("xalz.uncompressed", "file", b"abcabcabcabcdefgh")], "uzip": [("uzip.uncompressed", "file", _BODY.ljust(512, b"\0") + _SECOND.ljust(512, b"\0"))], "sparse": [("sparse.raw", "file", b"s" * 4096)],
    "minifs": [("dir/a", "file", b"first file"), ("dir/b", "file", _SECOND)], "minix_fs_v1": [("file", "file", b"x" * 1500), ("link", "link", None)], "lvm2": [("root.img", "file", b"B" * 1024 + b"A" * 1024)], "deafbead": [("ab", "dir", None), ("c", "file", b"xyz")],
    "bneg": [("part1", "file", b"A" * 30), ("part2", "file", b"B" * 40)], "chk": [("kernel", "file", b"K" * 30), ("rootfs", "file", b"R" * 12)], "bdl": [("entry-0", "file", b"E" * 20)], "ipkg": [("entry-0", "file", b"E" * 20)], "fpkg": [("name", "file", b"F" * 10)],
    "airoha": [("firmware.encrypted", "file", (b"locked" * 3).ljust(20, b"\0"))], "instar_hd": [("instar_hd.deobfuscated", "file", samples.zipped())], "compress": [("compress.uncompressed", "file", samples.LETTERS)],
}


def _md5(content: bytes | None) -> str | None:
    return None if content is None else hashlib.md5(content).hexdigest()


@query(values([(n, p, t, len(c or b""), _md5(c)) for n, found in HELD.items() for p, t, c in found] + [("elf64", "initramfs", "file", len(samples.cpio()), _md5(samples.cpio()))], "handler, path, type, size, md5"))
def extract_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = [(n, n, bytearray(samples.made()[n]), False) for n in HELD] + [("elf64", "elf64", bytearray(samples.kernel()), False)]
    found = extract.entries(spark.createDataFrame(chunks, "chunk_id string, handler string, content binary, is_encrypted boolean"))
    return found.select("handler", "path", "type", "size", F.md5("content").alias("md5"))


PACKED: dict[str, Callable[[bytes], bytes]] = {
    **STORED, "gzip": lambda b: gzip.compress(b, 1, mtime=0), "bzip2": lambda b: bz2.compress(b, 1), "xz": lambda b: lzma.compress(b, preset=0), "lzma": lambda b: lzma.compress(b, format=lzma.FORMAT_ALONE, preset=0), "zlib": lambda b: zlib.compress(b, 1), "zstd": lambda b: zstandard.compress(b, 1), "romfs": samples.romfs,
}


@query("SELECT doc_id, u.handler, md5(coalesce(text, '')) AS md5, strlen(coalesce(text, ''))::BIGINT AS size FROM documents, (VALUES " + ", ".join(f"('{n}')" for n in PACKED) + ") u(handler)")
def extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, packed in each way and unpacked again."""
    files = made_around(texts(spark, sf_dir), PACKED)
    chunks = files.select(F.col("file_id").alias("chunk_id"), F.split("file_id", ":")[1].alias("handler"), "content", F.lit(False).alias("is_encrypted"))
    found = extract.entries(chunks).filter("path = 'a.txt' OR path = concat(handler, '.uncompressed')")
    return found.select(F.split("parent_id", ":")[0].cast("long").alias("doc_id"), "handler", F.md5("content").alias("md5"), "size")


#: Names of members of an archive, links' targets, and what is done about them: paths that leave the root, are absolute or come twice.
HOSTILE = [("../up", None, "Moved to lost and found."), ("/abs", None, "Made relative."), ("a", None, None), ("a", None, "Replaced it."), ("esc", "../../etc", "Removed."), ("ok", "a", None), ("self", "self", "Removed."), ("sub/../b", None, None), ("x" * 300, None, "Skipped.")]


def _hostile() -> bytes:
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as f:
        for name, link, _ in HOSTILE:
            i = tarfile.TarInfo(name)
            if link:
                i.type, i.linkname = tarfile.SYMTYPE, link
            else:
                i.size = 1
            f.addfile(i, io.BytesIO(b"x"))
    return out.getvalue()


@query(values([(r[2] or "-", n) for r in HOSTILE for n in [sum(x[2] == r[2] for x in HOSTILE)]], "resolution, n").replace("SELECT ", "SELECT DISTINCT ", 1))
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = spark.createDataFrame([("c", "tar", bytearray(_hostile()), False)], "chunk_id string, handler string, content binary, is_encrypted boolean")
    return extract.entries(chunks).groupBy(F.coalesce("resolution", F.lit("-")).alias("resolution")).agg(F.count("*").alias("n"))


# The whole analysis ------------------------------------------------------------------------------


def _nested(body: bytes) -> bytes:
    return samples.tarred(samples.zipped(body))


def _work(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or f"file://{tempfile.mkdtemp(prefix='bytelode-analysis-')}"


def _analysed(spark: SparkSession, sf_dir: str, **options) -> recursion.Analysis:
    """A page in a zip in a tar, with bytes before and after it, for each page."""
    own = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    return recursion.analyse(made_around(own, {"tar": _nested}, b"junk", b"\xff" * 3), _work(spark), recursion.Config(**options))


_ZIP = SIZES["zip"]
_TAR = SIZES["tar"].replace("n", f"({_ZIP})")


@query(f"""WITH p AS (SELECT strlen(coalesce(html, '')) AS n FROM pages), s AS (SELECT n, ({_ZIP})::BIGINT AS z, ({_TAR})::BIGINT AS t FROM p)
  SELECT 0 AS depth, 'tar' AS handler, 4::BIGINT AS start, 4 + t AS stop FROM s UNION ALL SELECT 1, 'zip', 0, z FROM s""")
def analysis_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).chunks.select("depth", "handler", "start", F.col("end").alias("stop"))


@query(f"""WITH s AS (SELECT ({_TAR})::BIGINT AS t FROM (SELECT strlen(coalesce(html, '')) AS n FROM pages))
  SELECT 'unknown' AS kind, 0::BIGINT AS start, 4::BIGINT AS stop FROM s UNION ALL SELECT 'padding', 4 + t, 7 + t FROM s""")
def analysis_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).gaps.select("kind", "start", F.col("end").alias("stop"))


@query(f"""WITH p AS (SELECT html, strlen(coalesce(html, '')) AS n FROM pages), s AS (SELECT *, ({_ZIP})::BIGINT AS z, ({_TAR})::BIGINT AS t FROM p)
  SELECT 0 AS depth, 7 + t AS length, NULL::VARCHAR AS md5 FROM s UNION ALL SELECT 1, z, NULL FROM s UNION ALL SELECT 1, 6, '{hashlib.md5(b"second").hexdigest()}' FROM s
  UNION ALL SELECT 2, n, md5(html) FROM s WHERE n > 0 UNION ALL SELECT 2, 6, '{hashlib.md5(b"second").hexdigest()}' FROM s""")
def analysis_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all levels, with the hashes of those that are no containers."""
    made = _analysed(spark, sf_dir)
    containers = made.chunks.select("file_id").distinct().withColumn("held", F.lit(True))
    return made.tasks.join(containers, "file_id", "left").select("depth", "length", F.when(F.col("held").isNull(), F.col("md5")).alias("md5"))


@query("""WITH p AS (SELECT strlen(coalesce(html, '')) > 0 AS filled FROM pages), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE filled) AS f FROM p)
  SELECT unnest(['StatReport', 'HashReport', 'FileMagicReport', 'ChunkReport', 'UnknownChunkReport', 'CarveDirectoryReport', 'RandomnessReport', 'ExtractedFileDeletedReport']) AS typename,
    unnest([4 * n + f, 4 * n + f, 4 * n + f, 3 * n, n, n, n, n])::BIGINT AS n FROM n""")
def analysis_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of every type that this analysis gives, to JSON and back: chunks and padding, gaps, files, and the deletion of unpacked zips."""
    made = _analysed(spark, sf_dir, delete=("zip",), randomness_depth=2)
    return reports.from_json(reports.to_json(reports.of_analysis(made))).groupBy("typename").agg(F.count("*").alias("n"))


@query("SELECT depth, count(*) AS measured FROM (SELECT 0 AS depth FROM pages) GROUP BY depth")
def randomness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only levels above the given depth are measured, and padding is not."""
    return _analysed(spark, sf_dir).randomness.groupBy("depth").agg(F.count("*").alias("measured"))


@query("SELECT 0 AS depth, count(*) AS files FROM pages UNION ALL SELECT 1, 2 * count(*) FROM pages")
def depth_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir, max_depth=1).tasks.groupBy("depth").agg(F.count("*").alias("files"))


@query("SELECT 0 AS depth, count(*) AS chunks, 0::BIGINT AS entries FROM pages")
def extraction_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _analysed(spark, sf_dir, skip_extraction=True)
    return made.chunks.groupBy("depth").agg(F.count("*").alias("chunks")).withColumn("entries", F.lit(made.entries.count()).cast("long"))


# Sets of files -----------------------------------------------------------------------------------


def _parts(texts: DataFrame) -> DataFrame:
    """For each document a set in two parts by its id: 7z parts, gzip parts or a PAR2 set; in every third the content is not what it says."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                body, good = (text or "").encode() + b"." * 8, i % 3 != 0
                if i % 4 == 0:
                    data = samples.pad({0: b"7z\xbc\xaf\x27\x1c", 12: samples.le(len(body) - 4, 8), 20: samples.le(4, 8)}, 32) + body
                    data = samples.crc_at(data, 8, 12, 32, False)
                    data = data if good else data + b"more"
                    out = [(f"{i}.7z.001", data[:36]), (f"{i}.7z.002", data[36:])]
                elif i % 4 == 1:
                    data = gzip.compress(body, 1, mtime=0) if good else b"no" + body
                    out = [(f"{i}.gz.aa", data[:10]), (f"{i}.gz.ab", data[10:])]
                else:
                    packet = b"PAR2\0PKT" + samples.le(32 + 32 + len(body), 8) + hashlib.md5(bytes(32) + body).digest() + bytes(32) + body
                    out = [(f"{i}.par2", packet), (f"{i}.vol0+1.par2", packet if good else packet[:-1] + b"!")]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out]), pa.array([f"/sets/{n}" for n, _ in out]), pa.array([len(d) for _, d in out], pa.int64()), pa.array([d for _, d in out], pa.binary())], names=["file_id", "path", "length", "content"])

    return map_batches(texts, rows, FILES)


@query("""SELECT CASE WHEN doc_id % 4 = 0 THEN 'multi-sevenzip' WHEN doc_id % 4 = 1 THEN 'multi-gzip' ELSE 'multi-par2' END AS handler, doc_id::VARCHAR || CASE WHEN doc_id % 4 = 0 THEN '.7z' WHEN doc_id % 4 = 1 THEN '.gz' ELSE '' END AS name, 2::BIGINT AS parts
  FROM documents WHERE doc_id % 3 <> 0""")
def multi_file_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multifile.multi_files(_parts(texts(spark, sf_dir))).select("handler", "name", F.size("paths").cast("long").alias("parts"))


@query("SELECT doc_id::VARCHAR || '.gz' AS name, md5(coalesce(text, '') || '........') AS md5 FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 = 1")
def multi_file_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets found as the analysis begins; parts put together and unpacked."""
    made = recursion.analyse(_parts(texts(spark, sf_dir).filter("id % 4 = 1")), _work(spark), recursion.Config(max_depth=1))
    return made.entries.join(made.sets.select(F.col("set_id").alias("parent_id"), "name"), "parent_id").select("name", F.md5("content").alias("md5"))


@query("SELECT page_id::VARCHAR AS file_id, url AS path, 'text/html' AS mime_type FROM pages WHERE html LIKE '<!DOCTYPE%' OR html LIKE '<!doctype%' OR html LIKE '<html%'")
def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = source.with_kind(pages(spark, sf_dir)).withColumn("mime_type", source.mime_type(F.col("magic")))
    return found.filter("mime_type = 'text/html'").select("file_id", "path", "mime_type")


#: Contents, and the chance that uniformly random bytes differ from uniform as much, to six decimals, from tables of the distribution.
CHANCES = [(b"", 0.0), (bytes(range(256)), 1.0), (bytes(256), 0.0), (bytes(range(256)) * 4, 1.0), (bytes(1024), 0.0)]


@query(values([(i, p == 1.0) for i, (_, p) in enumerate(CHANCES)], "id, uniform"))
def chi_square_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(CHANCES)], "id long, content binary")
    return measures.byte_measures(files).select("id", (F.round("p_value", 6) == 1.0).alias("uniform"))
