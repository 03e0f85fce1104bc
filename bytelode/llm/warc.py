"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

The writer gives each page a record in a gzip member of its own, many to an archive; archives are rows
(archive, content), which Spark commits as a table, so that a lost executor leaves no half-written file behind.
Of records with equal payloads the one with the largest page_id is the response; the others are revisits that refer
to it and carry no payload.

The reader takes archives from such a table or from files (``binaryFile``), compressed by member, as one stream, or plain.  A
record counts only if its version line, header, length, SHA-1 digests if it has any and, for compressed ones, the member's
checksum hold.  A block that is not HTTP is its payload as a whole.  Records of one member all have the member's place.
After a failed check it searches for the next place at which a valid member or version line starts, goes on from
there, and logs the bytes between as a quarantined gap.

Defined cases: a null html is an empty payload; empty payloads count as equal payloads where ``least`` is 0; a null
page_id comes before all others and is never referred to unless all copies' ids are null; repeated rows of the
largest page_id are all responses; an empty table gives an empty archive table; a null url is an empty one; a line
break in a url is percent-encoded; payloads of any length are written whole; columns besides ``page_id``, ``url`` and ``html`` are not read,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.llm.common import map_arrow, materialize

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "archive string, start long, stop long, kind string, reason string, record_type string, page_id long, uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"
NAMES = [x.split()[0] for x in RECORDS.split(", ")]
TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
SCHEMA = pa.schema([(x.split()[0], TYPES[x.split()[1]]) for x in RECORDS.split(", ")])


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def differs(said: str, data: bytes) -> bool:
    """Whether a digest is a SHA-1, in base 32 or hexadecimal digits, of something else; others are not compared."""
    kind, _, value = said.partition(":")
    if kind.strip().lower() != "sha1":
        return False
    value = value.strip()
    return value.lower() != hashlib.sha1(data).hexdigest() if len(value) == 40 else value.upper() != sha1(data)


def payload_of(fields: dict) -> tuple[bytes, bytes]:
    """(HTTP header, payload) of a record's block; a block of anything but HTTP is its payload."""
    block, kind = fields["block"], fields.get("content-type", "").lower()
    if not (kind.startswith("application/http") or not kind and block.startswith(b"HTTP/")):
        return b"", block
    http, _, payload = block.partition(b"\r\n\r\n")
    return http, payload


def record_id(page: int | None) -> str:
    return f"<urn:bytelode:page:{'' if page is None else page}>"


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:bytelode:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(page: int | None, url: str | None, html: str | None, refers: int | None, revisit: bool) -> bytes:
    """One uncompressed record; of a revisit, the block is the HTTP header alone."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers)}"] if revisit else []),
        f"WARC-Payload-Digest: sha1:{sha1(payload)}", f"WARC-Block-Digest: sha1:{sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    body = b"software: bytelode\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:bytelode:archive:{name}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(data) + packed.flush()


def archives(limit: int, compress: bool):
    wrap = member if compress else bytes

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit"))):
                if not parts:
                    name = f"part-{part:06d}-{count:06d}.warc{'.gz' if compress else ''}"
                    parts, count = [wrap(info(name))], count + 1
                    size = len(parts[0])
                parts.append(wrap(record(*row)))
                size += len(parts[-1])
                if size >= limit:
                    yield close()
                    parts = []
        if parts:
            yield close()

    return write


def resolved(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, refers_to, revisit.  Only ids and digests are grouped; groups of one are not joined at all."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    hashed = pages.select("page_id", "url", "html", F.sha1(payload).alias("hex"), F.octet_length(payload).alias("bytes"))
    groups = hashed.filter(F.col("bytes") >= least).groupBy("hex").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    shared = materialize(groups.filter("n > 1").select("hex", "top"), "warc-shared")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    # Written above, so that both sides of this join come from an exchange of their own and a hot payload's part can be split.
    return hashed.join(shared, "hex", "left").select("page_id", "url", "html", refers.alias("refers_to"), refers.isNotNull().alias("revisit"))


def write_archives(pages: DataFrame, least: int = 0, limit: int = 4 << 20, compress: bool = True) -> DataFrame:
    """archive, content: a row for each archive of about ``limit`` bytes."""
    return map_arrow(resolved(pages, least), archives(limit, compress), "archive string, content binary")


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int] | str:
    """(fields, end) of the record that starts at ``at``, or what is wrong with it.  Read line by line up to the first that is
    no header line, so that many marks without a header's end are not each searched to the end."""
    if not re.match(rb"WARC/\d+\.\d+\r?\n", data[at : at + 16]):
        return "version line"
    fields: dict[str, str] = {}
    head = data.index(b"\n", at) - 1
    while data[head : head + 4] != b"\r\n\r\n":
        stop = data.find(b"\r\n", head + 2)
        if stop < 0:
            return "header not closed"
        name, colon, value = data[head + 2 : stop].partition(b":")
        head = stop
        if not colon:
            return "header line"
        try:
            fields[name.decode("utf-8").strip().lower()] = value.decode("utf-8").strip()
        except UnicodeDecodeError:
            return "header not UTF-8"
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return "content length"
    start, end = head + 4, head + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "record end"
    block = data[start:end]
    if differs(fields.get("warc-block-digest", ""), block):
        return "block digest"
    return fields | {"block": block}, end + 4


def as_row(archive: str, start: int, stop: int, fields: dict) -> tuple | str:
    kind = fields.get("warc-type")
    row = {"archive": archive, "start": start, "stop": stop, "kind": "record", "record_type": kind, "page_id": page_of(fields.get("warc-record-id")), "uri": fields.get("warc-target-uri"), "refers_to": page_of(fields.get("warc-refers-to"))}
    if kind in ("response", "revisit"):
        http, payload = payload_of(fields)
        said = fields.get("warc-payload-digest", "")
        if kind == "response":
            if differs(said, payload):
                return "payload digest"
            row |= {"payload": payload, "payload_bytes": len(payload)}
        elif size := re.search(rb"\r\nContent-Length: (\d+)", http):
            row["payload_bytes"] = int(size[1])
        row["payload_digest"] = said.removeprefix("sha1:") or None
    return tuple(row.get(n) for n in NAMES)


def unpacked(content: bytes, at: int) -> tuple[bytes, int] | str:
    """(data, end) of the gzip member that starts at ``at``, checked."""
    inflate = zlib.decompressobj(31)
    pieces = []
    try:
        pos = at
        while not inflate.eof and pos < len(content):
            pieces.append(inflate.decompress(content[pos : pos + 65536]))
            pos += 65536
    except zlib.error as e:
        return f"member: {e}"
    if not inflate.eof:
        return "member cut off"
    return b"".join(pieces), min(pos, len(content)) - len(inflate.unused_data)


STARTS = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r?\n")
VERSIONS = re.compile(rb"WARC/\d+\.\d+\r?\n")


def gap(archive: str, start: int, stop: int, reason: str) -> tuple:
    return tuple({"archive": archive, "start": start, "stop": stop, "kind": "gap", "reason": reason}.get(n) for n in NAMES)


def member_rows(archive: str, content: bytes, at: int) -> tuple[list[tuple], int] | str:
    """(rows, end) of the member that starts at ``at``: all its valid records, and its gaps, each with the member's place;
    or what is wrong, if it has no valid record."""
    found = unpacked(content, at)
    if isinstance(found, str):
        return found
    data, end = found
    rows = [(archive, at, end, *row[3:]) for row in walked(archive, data, VERSIONS)]
    if any(row[3] == "record" for row in rows):
        return rows, end
    return rows[0][4] if rows else "empty member"


def walked(archive: str, content: bytes, starts: re.Pattern) -> Iterator[tuple]:
    at, bad, reason = 0, None, ""
    while at < len(content):
        if found := starts.match(content, at):
            if found[0][:1] == b"\x1f":
                got = member_rows(archive, content, at)
            elif not isinstance(got := parse_record(content, at), str):
                row = as_row(archive, at, got[1], got[0])
                got = row if isinstance(row, str) else ([row], got[1])
            if not isinstance(got, str):
                if bad is not None:
                    yield gap(archive, bad, at, reason)
                    bad = None
                yield from got[0]
                at = got[1]
                continue
            why = got
        else:
            why = "no record starts here"
        if bad is None:
            bad, reason = at, why
        after = starts.search(content, at + 1)
        at = after.start() if after else len(content)
    if bad is not None:
        yield gap(archive, bad, len(content), reason)


def salvage(archive: str, content: bytes) -> Iterator[tuple]:
    """Rows of RECORDS: kind record, and kind gap for bytes that no valid record covers."""
    return walked(archive, content, STARTS)


def read_archives(archives: DataFrame) -> DataFrame:
    """All records and gaps of a table (archive, content); see RECORDS."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)

        for batch in batches:
            for archive, content in zip(batch["archive"].to_pylist(), batch["content"]):
                out: list[tuple] = []
                for row in salvage(archive, content.as_py() or b""):
                    out.append(row)
                    if len(out) >= 256:
                        yield batch_of(out)
                        out = []
                yield batch_of(out)

    return map_arrow(archives.select("archive", "content"), rows, RECORDS)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of the files below ``path``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from written archives."""
    written = materialize(write_archives(pages, least), "warc-archives")
    got = read_archives(written).filter(F.col("kind") == "record").filter(F.col("record_type").isin("response", "revisit"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_FIVE = "('0x' || substr(h, 5 * {i} + 1, 5))::BIGINT"
_QUAD = "".join(f" || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({_FIVE.format(i=i)}) >> {s}) & 31)::BIGINT + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, ''{_QUAD} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""
