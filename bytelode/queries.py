"""The library's own queries, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelode.functions import binary as b
from bytelode.functions.patterns import java_regex
from bytelode.operators import intervals, markup, measures, scan
from bytelode.plans import recursion, reports
from bytelode.sources import files as source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.text_files(read(spark, sf_dir, "pages"), "page_id", "html", "url")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.text_files(read(spark, sf_dir, "documents"), "doc_id", "text")


MARKUP = markup.sql()
OUTER = """outer_ranges AS (SELECT DISTINCT file_id, start, "end" FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunks d WHERE d.file_id = c.file_id AND d.start <= c.start AND d."end" >= c."end" AND (d.start < c.start OR d."end" > c."end"))),
outer_chunks AS (SELECT c.* FROM chunks c JOIN outer_ranges r ON r.file_id = c.file_id AND r.start = c.start AND r."end" = c."end")"""
GAPS = """gap AS (SELECT * FROM (
  SELECT file_id, least(a, z) AS start, greatest(a, z) AS "end", a > z AS overlap FROM (
    SELECT file_id, coalesce(lag("end") OVER (PARTITION BY file_id ORDER BY start, "end"), 0) AS a, start AS z FROM outer_chunks
    UNION ALL SELECT file_id, max("end"), any_value(length) FROM outer_chunks JOIN files USING (file_id) GROUP BY file_id) WHERE a <> z))"""


# Search and range algebra -------------------------------------------------------------------------


@query("""SELECT page_id AS file_id, marker, place::BIGINT AS at FROM (
  SELECT page_id, marker, pos, sum(strlen(part) + strlen(lit)) OVER (PARTITION BY page_id, marker ORDER BY pos) - strlen(lit) AS place, n FROM (
    SELECT page_id, marker, lit, unnest(string_split(html, lit)) AS part, generate_subscripts(string_split(html, lit), 1) AS pos, len(string_split(html, lit)) AS n
    FROM pages, (VALUES ('script', '<script'), ('paragraph', '<p>'), ('comment', '<!--')) m(marker, lit))) WHERE pos < n""")
def magic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.literal_hits(pages(spark, sf_dir), {"script": b"<script", "paragraph": b"<p>", "comment": b"<!--"})


@query(f"WITH {MARKUP} SELECT * FROM chunks")
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.elements(pages(spark, sf_dir))


@query(f"WITH {MARKUP}, {OUTER} SELECT * FROM outer_chunks")
def outer_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.outer(markup.elements(pages(spark, sf_dir))).select("file_id", "handler", "start", "end")


@query(f"WITH {MARKUP}, {OUTER}, {GAPS} SELECT * FROM gap")
def gap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pages(spark, sf_dir)
    return intervals.gaps(intervals.outer(markup.elements(files)), files)


PIECE = "substr(hex(encode(content)), 2 * g.start::BIGINT + 1, 2 * (g.\"end\" - g.start)::BIGINT)"


@query(f"""WITH {MARKUP}, {OUTER}, {GAPS} SELECT g.file_id, g.start, g."end", g.overlap,
  CASE WHEN len(list_distinct(regexp_extract_all({PIECE}, '..'))) = 1 THEN 'padding' ELSE 'unknown' END AS kind FROM gap g JOIN files USING (file_id)""")
def padding_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pages(spark, sf_dir)
    return intervals.padded(intervals.gaps(intervals.outer(markup.elements(files)), files), files)


@query(f"""WITH {MARKUP}, {OUTER} SELECT f.file_id, f.length, coalesce(c.covered, 0)::BIGINT AS covered, round(coalesce(c.covered, 0) / f.length, 6) AS ratio
  FROM files f LEFT JOIN (SELECT file_id, sum("end" - start) AS covered FROM outer_ranges GROUP BY file_id) c USING (file_id)""")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pages(spark, sf_dir)
    return intervals.coverage(intervals.outer(markup.elements(files)), files).withColumn("ratio", F.round(F.col("covered") / F.col("length"), 6))


DISTRIBUTION = f"""WITH {MARKUP}, {OUTER}, {GAPS}, sizes AS (
  SELECT handler, "end" - start AS size FROM outer_chunks UNION ALL SELECT 'unknown', "end" - start FROM gap WHERE NOT overlap UNION ALL SELECT 'unknown', 0)"""


def _distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pages(spark, sf_dir)
    outer = intervals.outer(markup.elements(files))
    rest = intervals.gaps(outer, files).filter(~F.col("overlap"))
    size = (F.col("end") - F.col("start")).alias("size")
    return reports.distribution(outer.select("handler", size).unionByName(rest.select(F.lit("unknown").alias("handler"), size)))


@query(f"{DISTRIBUTION} SELECT handler, sum(size)::BIGINT AS size FROM sizes GROUP BY handler")
def chunk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distribution(spark, sf_dir)


HUMAN = """(CASE WHEN {x} >= 1099511627776 THEN printf('%.2f TB', {x} / 1099511627776) WHEN {x} >= 1073741824 THEN printf('%.2f GB', {x} / 1073741824) WHEN {x} >= 1048576 THEN printf('%.2f MB', {x} / 1048576)
  WHEN {x} >= 1024 THEN printf('%.2f KB', {x} / 1024) ELSE printf('%.2f B', {x}::DOUBLE) END)"""


@query(f"""{DISTRIBUTION}, d AS (SELECT handler, sum(size)::BIGINT AS size FROM sizes GROUP BY handler)
  SELECT handler, size, {HUMAN.format(x='size')} AS shown, round(size * 100 / sum(size) OVER (), 6) AS percent FROM d""")
def ranked_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ranked(_distribution(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query(f"""WITH {MARKUP} SELECT url AS path, handler, start, "end", '0x' || lower(to_hex(start)) || '-0x' || lower(to_hex("end")) AS range
  FROM chunks JOIN pages ON page_id::VARCHAR = file_id ORDER BY path, start, handler""")
def scan_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pages(spark, sf_dir)
    return markup.elements(files).join(files.select("file_id", "path"), "file_id").select("path", "handler", "start", "end", b.range_hex(F.col("start"), F.col("end")).alias("range")).orderBy("path", "start", "handler")


@query(f"""WITH {MARKUP}, {OUTER} SELECT c.file_id, c.handler, c.start, c."end", (c.start || '-' || c."end" || '.' || c.handler) AS name, md5(unhex(substr(hex(encode(content)), 2 * c.start + 1, 2 * (c."end" - c.start)))) AS md5
  FROM outer_chunks c JOIN files USING (file_id)""")
def carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pages(spark, sf_dir)
    name = F.concat_ws("", "start", F.lit("-"), "end", F.lit("."), "handler")
    content = b.slice_bytes(F.col("content"), F.col("start"), F.col("end"))
    return intervals.outer(markup.elements(files)).join(files.select("file_id", "content"), "file_id").select("file_id", "handler", "start", "end", name.alias("name"), F.md5(content).alias("md5"))


@query(f"WITH {MARKUP} SELECT file_id, count(*) = 1 AS whole_file_rule, count(*) AS chunks FROM chunks GROUP BY file_id")
def whole_file_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.elements(pages(spark, sf_dir)).groupBy("file_id").agg((F.count("*") == 1).alias("whole_file_rule"), F.count("*").alias("chunks"))


# Measures ----------------------------------------------------------------------------------------

BYTES = "SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents"


@query(f"""WITH n AS (SELECT doc_id, count(*) AS c FROM ({BYTES}) GROUP BY doc_id, byte), t AS (SELECT doc_id, sum(c) AS t FROM n GROUP BY doc_id)
  SELECT n.doc_id, round(-sum(c / t * log2(c / t)), 6) AS entropy FROM n JOIN t ON t.doc_id = n.doc_id GROUP BY n.doc_id""")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.byte_measures(documents(spark, sf_dir).select("file_id", "content")).select(F.col("file_id").cast("long").alias("doc_id"), F.round("entropy", 6).alias("entropy"))


@query(f"""WITH n AS (SELECT doc_id, count(*) AS c FROM ({BYTES}) GROUP BY doc_id, byte)
  SELECT doc_id, round(sum(c * c) * 256 / sum(c) - sum(c), 6) AS chi_square FROM n GROUP BY doc_id""")
def chi_square_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.byte_measures(documents(spark, sf_dir).select("file_id", "content")).select(F.col("file_id").cast("long").alias("doc_id"), F.round("chi_square", 6).alias("chi_square"))


@query(f"SELECT doc_id, byte, count(*) AS n FROM ({BYTES}) GROUP BY doc_id, byte")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = measures.byte_counts(documents(spark, sf_dir), ["file_id"])
    return counts.select(F.col("file_id").cast("long").alias("doc_id"), F.hex(F.encode("byte", "ISO-8859-1")).alias("byte"), "n")


BLOCKED = """WITH b AS (SELECT doc_id, hex(encode(text)) AS h, least(greatest(strlen(text) // 80, 1024), 1048576) AS size FROM documents WHERE strlen(text) > 0),
k AS (SELECT doc_id, size, unnest(range(0, (length(h) // 2 - 1) // size + 1)) AS block_no, h FROM b),
p AS (SELECT doc_id, size, block_no, substr(h, (2 * block_no * size + 1)::BIGINT, (2 * size)::BIGINT) AS piece FROM k),
n AS (SELECT doc_id, block_no, byte, count(*) AS c FROM (SELECT doc_id, block_no, unnest(regexp_extract_all(piece, '..')) AS byte FROM p) GROUP BY ALL),
e AS (SELECT doc_id, block_no, sum(c)::BIGINT AS length, greatest(0.0, log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS entropy FROM n GROUP BY doc_id, block_no)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir).withColumn("size", b.block_size(F.col("length")))
    pieces = measures.blocks(files.select("file_id", "size", "content"), F.col("size"))
    return measures.byte_measures(pieces.select("file_id", "block_no", F.octet_length("content").cast("long").alias("length"), "content"))


@query(f"{BLOCKED} SELECT doc_id, block_no::INTEGER AS block_no, length, round(entropy, 6) AS entropy FROM e")
def block_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select(F.col("file_id").cast("long").alias("doc_id"), "block_no", "length", F.round("entropy", 6).alias("entropy"))


@query(f"{BLOCKED} SELECT doc_id, round(sum(entropy * length) / sum(length), 6) AS mean, round(max(entropy), 6) AS highest, round(min(entropy), 6) AS lowest FROM e GROUP BY doc_id")
def randomness_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).groupBy("file_id").agg((F.sum(F.col("entropy") * F.col("length")) / F.sum("length")).alias("mean"), F.max("entropy").alias("highest"), F.min("entropy").alias("lowest"))
    return rows.select(F.col("file_id").cast("long").alias("doc_id"), *(F.round(c, 6).alias(c) for c in ("mean", "highest", "lowest")))


@query("SELECT doc_id, least(greatest(strlen(text) // 80, 1024), 1048576)::BIGINT AS block_size FROM documents")
def block_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("file_id").cast("long").alias("doc_id"), b.block_size(F.col("length")).alias("block_size"))


@query()
def randomness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked percentages as the report has them: rounded in Python's way, so without SQL."""
    return measures.with_randomness(documents(spark, sf_dir).select("file_id", "content"))


# Files and reports -------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def hash_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.hashes(documents(spark, sf_dir)).withColumn("doc_id", F.col("file_id").cast("long")).drop("file_id")


@query("SELECT page_id::VARCHAR AS file_id, url AS path, strlen(html)::BIGINT AS size, false AS is_dir, true AS is_file, false AS is_link, NULL::VARCHAR AS link_target FROM pages")
def stat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.stat(pages(spark, sf_dir))


@query("""SELECT page_id::VARCHAR AS file_id, CASE WHEN html LIKE '<!DOCTYPE%' OR html LIKE '<!doctype%' OR html LIKE '<html%' THEN 'HTML document' WHEN html LIKE '<?xml%' THEN 'XML document' ELSE 'data' END AS magic FROM pages""")
def file_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.with_kind(pages(spark, sf_dir)).select("file_id", "magic")


@query("""SELECT page_id::VARCHAR AS file_id, html LIKE '<!DOCTYPE html><html lang="e%' OR url LIKE '%feed' AS skipped FROM pages""")
def skip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pages(spark, sf_dir).withColumn("magic", b.latin1(F.substring("content", 1, 40)))
    return files.select("file_id", source.skipped(F.col("magic"), F.col("path"), ('<!DOCTYPE html><html lang="e',), ("feed",)).alias("skipped"))


@query("SELECT doc_id FROM documents WHERE strlen(text) > 0 AND source <> 'src3'")
def to_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source.text_files(read(spark, sf_dir, "documents"), "doc_id", "text", "source")
    kept = files.filter((F.col("length") > 0) & ~source.skipped(F.lit("data"), F.col("path"), (), ("src3",)))
    return kept.select(F.col("file_id").cast("long").alias("doc_id"))


@query("SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS size, count(*) FILTER (WHERE n_chars > 5000) AS large FROM documents GROUP BY source")
def size_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("size"), F.count_if(F.col("n_chars") > 5000).alias("large"))


@query("SELECT count(*) AS files, 0::BIGINT AS dirs, 0::BIGINT AS links, sum(strlen(html))::BIGINT AS size FROM pages")
def size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.size_summary(source.stat(pages(spark, sf_dir)))


@query(f"SELECT o_orderkey, {HUMAN.format(x='v')} AS shown FROM (SELECT o_orderkey, (o_totalprice * o_orderkey)::BIGINT AS v FROM orders)")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", b.human_size(F.rint(F.col("o_totalprice") * F.col("o_orderkey")).cast("long")).alias("shown"))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").withColumn("file_id", F.col("doc_id").cast("string"))
    nested = F.when(F.col("toxic") == 1, F.array(F.create_map(F.lit("__typename__"), F.lit("ExtractCommandFailedReport"), F.lit("severity"), F.lit("WARNING"))))
    top = reports.reports(labels.filter("quality = 0"), "UnknownError", severity=F.lit("ERROR"), exception=F.lit("none"))
    return reports.errors(top.unionByName(reports.reports(labels, "ChunkReport", extraction_reports=nested)))


ERRORS = "errors AS (SELECT doc_id::VARCHAR AS file_id, 'UnknownError' AS typename, 'ERROR' AS severity FROM labels WHERE quality = 0 UNION ALL SELECT doc_id::VARCHAR, 'ExtractCommandFailedReport', 'WARNING' FROM labels WHERE toxic = 1)"


@query(f"WITH {ERRORS} SELECT * FROM errors")
def error_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir)


@query(f"WITH {ERRORS} SELECT coalesce(max((severity = 'ERROR')::INTEGER), 0)::INTEGER AS exit_code FROM errors")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.exit_code(_errors(spark, sf_dir))


@query("SELECT typename, count(*) AS n FROM (SELECT 'UnknownError' AS typename FROM labels WHERE quality = 0 UNION ALL SELECT 'ChunkReport' FROM labels) GROUP BY typename")
def filter_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").withColumn("file_id", F.col("doc_id").cast("string"))
    every = reports.reports(labels.filter("quality = 0"), "UnknownError", severity=F.lit("ERROR")).unionByName(reports.reports(labels, "ChunkReport")).unionByName(reports.reports(labels, "StatReport"))
    return every.filter(F.col("typename").isin("UnknownError", "ChunkReport")).groupBy("typename").agg(F.count("*").alias("n"))


@query(f"""WITH {MARKUP} SELECT file_id, 'ChunkReport' AS typename, handler AS handler_name, start AS start_offset, "end" AS end_offset, "end" - start AS size FROM chunks""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports to JSON and back."""
    rows = reports.reports(markup.elements(pages(spark, sf_dir)), "ChunkReport", handler_name=F.col("handler"), start_offset=F.col("start"), end_offset=F.col("end"), size=F.col("end") - F.col("start"))
    return reports.from_json(reports.to_json(rows)).select("file_id", "typename", "handler_name", "start_offset", "end_offset", "size")


@query("SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = read(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("p"))
    return parsed.select("event_id", "event_type", F.from_json(F.to_json("p"), "k long")["k"].alias("k"))


# Tasks, sets and lineage -------------------------------------------------------------------------


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, 0 AS depth FROM conversations WHERE turn = 0
  UNION ALL SELECT c.conv_id, c.turn, r.depth + 1 FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1 WHERE r.depth < 10) SELECT conv_id, turn, depth FROM r""")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    node = lambda turn: F.struct("conv_id", turn.alias("turn"))
    edges = rows.select(node(F.col("turn") - 1).alias("parent"), node(F.col("turn")).alias("child"))
    made = recursion.lineage(edges, rows.filter("turn = 0").select(node(F.col("turn")).alias("node")))
    return made.select("node.conv_id", "node.turn", "depth")


@query("""SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def parent_child_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, parts = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return orders.join(parts, orders["o_orderkey"] == parts["l_orderkey"]).select("o_orderkey", "o_orderstatus", "l_linenumber", "l_quantity")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unprocessed_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def handler_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("""SELECT l_orderkey AS stem, string_agg(printf('%03d', l_linenumber), ',' ORDER BY l_linenumber) AS parts, count(*) AS n, sum(l_quantity)::BIGINT AS length FROM lineitem GROUP BY l_orderkey""")
def multi_file_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.format_string("%03d", "l_linenumber")
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("stem")).agg(F.array_join(F.sort_array(F.collect_list(part)), ",").alias("parts"), F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("length"))


@query("SELECT md5(text) AS path, count(*) AS sets FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.collisions(documents(spark, sf_dir).select(F.array(F.md5("content")).alias("paths")))


@query("""SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS difference FROM events QUALIFY difference IS NOT NULL""")
def interval_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.differences(read(spark, sf_dir, "events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")))


@query("""WITH d AS (SELECT user_id, epoch_us(ts) // 3600000000 - lag(epoch_us(ts) // 3600000000) OVER (PARTITION BY user_id ORDER BY ts) AS difference FROM events QUALIFY difference IS NOT NULL),
  c AS (SELECT user_id, difference, count(*) AS n FROM d GROUP BY ALL) SELECT user_id, difference, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, difference) = 1""")
def interval_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return intervals.mode(intervals.differences(read(spark, sf_dir, "events"), "user_id", hours), "user_id", "difference")


@query("""SELECT lang AS value, 'union' AS kind FROM (SELECT lang FROM documents UNION SELECT source FROM documents)
  UNION ALL SELECT source, 'intersect' FROM (SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'es')
  UNION ALL SELECT source, 'except' FROM (SELECT source FROM documents EXCEPT SELECT source FROM documents WHERE lang = 'es' AND n_chars > 3000)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sources = docs.select(F.col("source").alias("value"))
    of = lambda test: docs.filter(test).select(F.col("source").alias("value"))
    both = docs.select(F.col("lang").alias("value")).union(sources).distinct()
    return (
        both.withColumn("kind", F.lit("union"))
        .unionByName(of("lang = 'en'").intersect(of("lang = 'es'")).withColumn("kind", F.lit("intersect")))
        .unionByName(sources.subtract(of("lang = 'es' AND n_chars > 3000")).withColumn("kind", F.lit("except")))
    )


@query("SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang")
def first_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.first_of(read(spark, sf_dir, "documents"), "lang", "doc_id").select("lang", "doc_id")


@query("""SELECT conv_id AS root, coalesce(min(CASE WHEN turn = 1 AND role = 'user' THEN text END), min(CASE WHEN turn > 0 THEN md5(text) END)) AS path FROM conversations GROUP BY conv_id""")
def output_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    own = F.when((F.col("turn") == 1) & (F.col("role") == "user"), F.col("text"))
    return reports.output_dir(rows.select(F.col("conv_id").alias("root"), own.alias("carve_dir"), F.col("turn").alias("depth"), F.md5("text").alias("path")))


# Bytes -------------------------------------------------------------------------------------------


@query("""SELECT doc_id, ('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT AS u32_le, ('0x' || h[1:8])::BIGINT AS u32_be, ('0x' || h[11:12] || h[9:10])::BIGINT AS u16_le,
  ('0x' || h[1:14])::BIGINT AS u56_be FROM (SELECT doc_id, md5(text) AS h FROM documents)""")
def endian_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.unhex(F.md5("text"))
    return read(spark, sf_dir, "documents").select("doc_id", b.integer(raw, 0, 4).alias("u32_le"), b.integer(raw, 0, 4, True).alias("u32_be"), b.integer(raw, 4, 2).alias("u16_le"), b.integer(raw, 0, 7, True).alias("u56_be"))


@query("SELECT p_partkey, ((p_size + 7) // 8 * 8)::BIGINT AS up, (p_size - p_size % 8)::BIGINT AS down, ((p_size + 9) // 10 * 10)::BIGINT AS up10 FROM part")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("long")
    return read(spark, sf_dir, "part").select("p_partkey", b.round_up(size, 8).alias("up"), b.round_down(size, 8).alias("down"), b.round_up(size, 10).alias("up10"))


PATTERN = "74 68 ( 65 | 61 74 ) 20 [1-3] 6? 6e"


@query("SELECT doc_id, regexp_matches(lower(hex(encode(text))), '^(..)*7468(65|6174)20(..){1,3}6.6e') AS found FROM documents")
def hexstring_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", b.latin1(b.blob(F.col("text"))).rlike(java_regex(PATTERN)).alias("found"))


@query("SELECT c_custkey, c_name AS text FROM customer")
def strip_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.col("c_name"), F.lit("\0\0\0"))
    return read(spark, sf_dir, "customer").select("c_custkey", b.without_nulls(padded).alias("text"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(hex(encode(text)), '..'))) = 1 AS padding FROM documents")
def single_byte_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", b.single_byte(b.blob(F.col("text"))).alias("padding"))


@query("""SELECT p_partkey, ('0x' || substr(md5(p_name), 1, 6))::BIGINT AS number, CASE WHEN p_name ~ '^[0-7]+$' THEN 1 END AS octal, p_size & 1 AS b0, (p_size >> 3) & 1 AS b3 FROM part""")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = b.bits(F.col("p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", b.decode_int(F.concat(F.substring(F.md5("p_name"), 1, 6), F.lit("\0 ")), 16).alias("number"), F.when(b.decode_int(F.col("p_name"), 8).isNotNull(), 1).alias("octal"), bits[0].alias("b0"), bits[3].alias("b3"))


@query("SELECT o_orderkey, o_orderkey AS value, CASE WHEN o_orderkey % 2 = 0 THEN 'big' ELSE 'little' END AS endian, (o_orderkey % 4 + 2)::INTEGER AS run FROM orders")
def varint_and_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written in groups of 7 bits and read back; byte orders by a mark; runs of padding."""
    key = F.col("o_orderkey")
    group = lambda i: F.lpad(F.hex(F.call_function("shiftright", key, F.lit(7 * i)).bitwiseAND(F.lit(127)) + F.when(F.call_function("shiftright", key, F.lit(7 * i + 7)) > 0, 128).otherwise(0)), 2, "0")
    packed = F.unhex(F.concat(*[group(i) for i in range(5)]))
    mark = F.unhex(F.when(key % 2 == 0, "CAFEBABE").otherwise("BEBAFECA"))
    padding = F.unhex(F.concat(F.lit("AA00"), F.repeat(F.lit("FF"), (key % 4 + 1).cast("int")), F.lit("AA")))
    return read(spark, sf_dir, "orders").select("o_orderkey", b.leb128(packed).alias("value"), b.endian(mark, b"\xca\xfe\xba\xbe", b"\xbe\xba\xfe\xca").alias("endian"), b.run_length(padding, 1).alias("run"))


@query("""WITH p AS (SELECT c_custkey, c_name, unnest(range(1, strlen(c_name) + 1)) AS i FROM customer)
  SELECT c_custkey, ((sum((strlen(c_name) - i + 1) * ascii(substr(c_name, i, 1))) + any_value(strlen(c_name))) % 65521 * 65536 + (1 + sum(ascii(substr(c_name, i, 1)))) % 65521)::BIGINT AS adler32 FROM p GROUP BY c_custkey""")
def adler32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", b.adler32(b.blob(F.col("c_name"))).alias("adler32"))


# What is there -----------------------------------------------------------------------------------


@query()
def doc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.formats_table(spark)


@query()
def tool_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tools(spark)


@query()
def format_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All formats' patterns over whole texts."""
    return scan.search_chunks(documents(spark, sf_dir))


@query("""SELECT c_mktsegment, c_custkey, c_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank FROM customer) WHERE rank <= 3""")
def largest_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return read(spark, sf_dir, "customer").withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("c_mktsegment", "c_custkey", "c_acctbal", "rank")
