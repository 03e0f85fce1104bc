"""Unpacking as rows: what a container holds becomes entries; unsafe members become problems; nothing is written to disk."""

from __future__ import annotations

import bz2
import io
import lzma
import os
import posixpath
import stat
import struct
import subprocess
import tarfile
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from bytelode.formats import FORMATS, alpha
from bytelode.functions import codecs, paths
from bytelode.functions.batches import map_batches
from bytelode.operators import lvm, streams, ufs, yaffs  # noqa: F401  (they register extractors)
from bytelode.operators.entry import EXTRACTORS, Entry, Extractor, extractor

ENTRIES = "parent_id string, handler string, path string, type string, mode int, size long, link_target string, content binary, problem string, resolution string, severity string"
NAMES = [x.split()[0] for x in ENTRIES.split(", ")]
KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
SCHEMA = pa.schema([(x.split()[0], KINDS[x.split()[1]]) for x in ENTRIES.split(", ")])
MOST = 1 << 30


class TooLarge(ValueError):
    """More comes out than a row may hold."""


def inflated(decoder, data: bytes) -> bytes:
    """All of a stream, in steps, so that a bomb is noticed before it is whole."""
    out, size = [], 0
    for at in range(0, len(data), 65536):
        piece = decoder.decompress(data[at : at + 65536])
        size += len(piece)
        if size > MOST:
            raise TooLarge("the content is larger than a row may hold")
        out.append(piece)
        if decoder.eof:
            break
    return b"".join(out)


def members(make: Callable[[], object], data: bytes, start: bytes) -> bytes:
    """Streams one after the other, as long as the next one starts with its mark."""
    out = []
    while data.startswith(start):
        decoder = make()
        out.append(inflated(decoder, data))
        data = decoder.unused_data.lstrip(b"\0") if start == b"\xfd7zXZ" else decoder.unused_data
    return b"".join(out)


@extractor("gzip")
def gzip(data: bytes) -> Iterator[Entry]:
    name = "gzip.uncompressed"
    flags, at = data[3], 10
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    if flags & 8:
        said = data[at : data.index(b"\0", at)].decode("latin-1")
        name = posixpath.basename(said) or name
    yield Entry(name, content=members(lambda: zlib.decompressobj(31), data, b"\x1f\x8b\x08"))


@extractor("zlib")
def zlib_(data: bytes) -> Iterator[Entry]:
    yield Entry("zlib.uncompressed", content=inflated(zlib.decompressobj(), data))


@extractor("bzip2")
def bzip2(data: bytes) -> Iterator[Entry]:
    yield Entry("bzip2.uncompressed", content=members(bz2.BZ2Decompressor, data, b"BZh"))


@extractor("xz")
def xz(data: bytes) -> Iterator[Entry]:
    yield Entry("xz.uncompressed", content=members(lzma.LZMADecompressor, data, b"\xfd7zXZ"))


@extractor("lzma")
def lzma_(data: bytes) -> Iterator[Entry]:
    yield Entry("lzma.uncompressed", content=inflated(lzma.LZMADecompressor(lzma.FORMAT_ALONE), data))


def unzstd(data: bytes) -> bytes:
    """All frames; read in steps, so that a bomb is noticed."""
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as f:
        return bounded(b"", f.read(MOST + 1))


@extractor("zstd")
def zstd(data: bytes) -> Iterator[Entry]:
    yield Entry("zstd.uncompressed", content=unzstd(data))


@extractor("lz4_default", "lz4_skippable", "lz4_legacy")
def lz4(data: bytes) -> Iterator[Entry]:
    """Frames one after the other, those to be skipped among them; the legacy kind has blocks of 8 MiB without an end."""
    out, at = bytearray(), 0
    while at + 4 <= len(data):
        mark, at = struct.unpack_from("<I", data, at)[0], at + 4
        if mark & 0xFFFFFFF0 == 0x184D2A50:
            at += 4 + struct.unpack_from("<I", data, at)[0]
        elif mark == 0x184C2102:
            while at + 4 <= len(data) and (size := struct.unpack_from("<I", data, at)[0]) not in (0x184C2102, 0x184D2204) and at + 4 + size <= len(data):
                out += bounded(out, codecs.lz4_block(data[at + 4 : at + 4 + size], 8 << 20))
                at += 4 + size
        elif mark == 0x184D2204:
            flags, sizes = data[at], data[at + 1]
            most, linked, start = 1 << 8 + 2 * (sizes >> 4 & 7), not flags & 0x20, len(out)
            at += 3 + 8 * bool(flags & 8) + 4 * (flags & 1)
            while size := struct.unpack_from("<I", data, at)[0]:
                body = data[at + 4 : at + 4 + (size & 0x7FFFFFFF)]
                out += bounded(out, body if size >> 31 else codecs.lz4_block(body, most, bytes(out[max(start, len(out) - 65536) :]) if linked else b""))
                at += 4 + len(body) + 4 * bool(flags & 0x10)
            at += 4 + 4 * bool(flags & 4)
        else:
            break
    yield Entry("lz4.uncompressed", content=bytes(out))


def bounded(before: bytes | bytearray, piece: bytes) -> bytes:
    if len(before) + len(piece) > MOST:
        raise TooLarge("the content is larger than a row may hold")
    return piece


@extractor("lzip")
def lzip(data: bytes) -> Iterator[Entry]:
    """The stream is as in the older kind of file, whose header is made from the dictionary's size: a power of two, less sixteenths of it."""
    size = 1 << (data[5] & 31)
    size -= size // 16 * (data[5] >> 5)
    head = b"\x5d" + size.to_bytes(4, "little") + b"\xff" * 8
    yield Entry("lzip.uncompressed", content=inflated(lzma.LZMADecompressor(lzma.FORMAT_ALONE), head + data[6:-20]))


@extractor("compress")
def compress(data: bytes) -> Iterator[Entry]:
    yield Entry("compress.uncompressed", content=bounded(b"", codecs.lzw(data[3:], data[2] & 31, bool(data[2] & 0x80))))


@extractor("lzo")
def lzo(data: bytes) -> Iterator[Entry]:
    """Blocks of (size, packed size, checksums, bytes); which checksums there are is in the flags."""
    version = struct.unpack_from(">H", data, 9)[0]
    at = 9 + 6 + 1 + (version >= 0x940)
    flags = struct.unpack_from(">I", data, at)[0]
    at += 4 + 4 * bool(flags & 0x800) + 4 + 4 + 4 * (version >= 0x940)
    name = data[at + 1 : at + 1 + data[at]].decode("utf-8", "replace")
    at += 1 + data[at] + 4
    if flags & 0x40:
        at += 4 + struct.unpack_from(">I", data, at)[0] + 4
    out = bytearray()
    while size := struct.unpack_from(">I", data, at)[0]:
        packed = struct.unpack_from(">I", data, at + 4)[0]
        at += 8 + 4 * bool(flags & 1) + 4 * bool(flags & 0x100)
        if packed < size:
            at += 4 * bool(flags & 2) + 4 * bool(flags & 0x200)
        body = data[at : at + packed]
        out += bounded(out, codecs.lzo1x(body, size) if packed < size else body)
        at += packed
    yield Entry(posixpath.basename(name) or "lzo.uncompressed", content=bytes(out))


@extractor("qnx_deflate")
def qnx(data: bytes) -> Iterator[Entry]:
    """Blocks with a header of four 16-bit numbers, the second its length, the last the size of what comes out."""
    if data[14]:
        yield Entry("", problem="blocks are packed by UCL", resolution="Not unpacked.", severity="ERROR")
        return
    out, at = bytearray(), 16
    while step := struct.unpack_from("<H", data, at + 2)[0]:
        out += bounded(out, codecs.lzo1x(data[at + 8 : at + step], 1 << 16))
        at += step
    yield Entry("qnx_deflate.uncompressed", content=bytes(out))


@extractor("sparse")
def sparse(data: bytes) -> Iterator[Entry]:
    """Chunks of raw blocks, of a word to repeat, or of nothing."""
    head, width, block = *struct.unpack_from("<HH", data, 8), struct.unpack_from("<I", data, 12)[0]
    out, at = bytearray(), head
    for _ in range(struct.unpack_from("<I", data, 20)[0]):
        kind, _, blocks, size = struct.unpack_from("<HHII", data, at)
        body = data[at + width : at + size]
        if len(out) + blocks * block > MOST:
            raise TooLarge("the content is larger than a row may hold")
        out += body if kind == 0xCAC1 else body[:4] * (blocks * block // 4) if kind == 0xCAC2 else bytes(blocks * block) if kind == 0xCAC3 else b""
        at += size
    yield Entry("sparse.raw", content=bytes(out))


@extractor("elf32", "elf64")
def elf(data: bytes) -> Iterator[Entry]:
    """The archive of a kernel's first files, which ends before its size at the end of the section of data for the start."""
    order, wide = "<" if data[5] == 1 else ">", data[4] == 2
    word, number = (8, "Q") if wide else (4, "I")
    sections = struct.unpack_from(order + number, data, 40 if wide else 32)[0]
    width, count, strings = struct.unpack_from(order + "HHH", data, 58 if wide else 46)

    def place(i: int) -> tuple[int, int, int]:
        at = sections + width * i
        return struct.unpack_from(order + "I", data, at)[0], *struct.unpack_from(order + number * 2, data, at + (24 if wide else 16))

    if not sections or sections + width * count > len(data) or strings >= count:
        return
    _, names, _ = place(strings)
    for i in range(count):
        name, start, size = place(i)
        if data[names + name :].startswith(b".init.data\0") and word < size and start + size <= len(data):
            length = struct.unpack_from(order + number, data, start + size - word)[0]
            # The size stands at a multiple of 8, the archive before it.
            if 0 < length <= size - word:
                yield Entry("initramfs", content=data[start + size - word - -(-length // 8) * 8 : start + size - word])


@extractor("qca_lzma")
def qca_lzma(data: bytes) -> Iterator[Entry]:
    packed, size = struct.unpack_from("<II", data, 8)
    decoder = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 20}])
    yield Entry("qca_lzma.uncompressed", content=decoder.decompress(data[16 : 16 + packed], min(size, MOST)))


@extractor("uzip")
def uzip(data: bytes) -> Iterator[Entry]:
    block, count = struct.unpack_from(">II", data, 128)
    places = struct.unpack_from(f">{count + 1}Q", data, 136)
    unpack = {b"#!": lambda x: inflated(zlib.decompressobj(), x), b"#L": lambda x: inflated(lzma.LZMADecompressor(), x), b"#Z": unzstd}[data[:2]]
    yield Entry("uzip.uncompressed", content=b"".join(unpack(data[a:b]) if b > a else b"\0" * block for a, b in zip(places, places[1:])))


@extractor("zip")
def zip_(data: bytes) -> Iterator[Entry]:
    with zipfile.ZipFile(io.BytesIO(data)) as f:
        for i in f.infolist():
            mode = i.external_attr >> 16
            if i.is_dir():
                yield Entry(i.filename.rstrip("/"), "dir", mode=mode & 0o7777 or 0o775)
            elif i.flag_bits & 1:
                yield Entry(i.filename, problem="the member is encrypted", resolution="Skipped.", severity="ERROR")
            elif mode & 0o170000 == 0o120000:
                yield Entry(i.filename, "link", link_target=f.read(i).decode("utf-8", "replace"))
            elif i.file_size > MOST:
                raise TooLarge(i.filename)
            else:
                yield Entry(i.filename, content=f.read(i), mode=mode & 0o7777 or 0o644)


@extractor("tar")
def tar(data: bytes) -> Iterator[Entry]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as f:
        for i in f:
            if i.isdir():
                yield Entry(i.name, "dir", mode=i.mode)
            elif i.issym():
                yield Entry(i.name, "link", link_target=i.linkname)
            elif i.islnk():
                yield Entry(i.name, "hardlink", link_target=i.linkname)
            elif i.isfile():
                yield Entry(i.name, content=f.extractfile(i).read(), mode=i.mode)
            else:
                yield Entry(i.name, "special", problem="a special file", resolution="Skipped.", severity="WARNING")


@extractor("cpio_portable_ascii", "cpio_portable_ascii_crc", "cpio_portable_old_ascii", "cpio_binary")
def cpio(data: bytes) -> Iterator[Entry]:
    at = 0
    while True:
        mark, check = data[at : at + 6], None
        if mark in (b"070701", b"070702"):
            field = lambda i: int(data[at + 6 + 8 * i : at + 14 + 8 * i], 16)  # noqa: B023, E731
            mode, size, name, head, align = field(1), field(6), field(11), 110, 4
            check = field(12) if mark == b"070702" else None
        elif mark == b"070707":
            mode, name, size, head, align = int(data[at + 18 : at + 24], 8), int(data[at + 59 : at + 65], 8), int(data[at + 65 : at + 76], 8), 76, 1
        elif data[at : at + 2] == b"\xc7\x71":
            mode, name = struct.unpack_from("<H", data, at + 6)[0], struct.unpack_from("<H", data, at + 20)[0]
            high, low = struct.unpack_from("<HH", data, at + 22)
            size, head, align = high << 16 | low, 26, 2
        else:
            return
        path = data[at + head : at + head + name - 1].decode("utf-8", "surrogateescape")
        if path == "TRAILER!!!":
            return
        start = -(-(at + head + name) // align) * align
        content = data[start : start + size]
        at = -(-(start + size) // align) * align
        kind = mode >> 12
        if kind == 4:
            yield Entry(path, "dir", mode=mode & 0o7777)
        elif kind == 10:
            yield Entry(path, "link", link_target=content.decode("utf-8", "surrogateescape"))
        elif kind in (8, 0):
            wrong = check is not None and sum(content) & 0xFFFFFFFF != check
            yield Entry(path, content=content, mode=mode & 0o7777, problem="the checksum differs" if wrong else None, resolution="Extracted anyway." if wrong else None, severity="WARNING" if wrong else None)
        else:
            yield Entry(path, "special", problem="a special file", resolution="Skipped.", severity="WARNING")


@extractor("ar")
def ar(data: bytes) -> Iterator[Entry]:
    at, long_names, found = 8, b"", []
    while data[at + 58 : at + 60] == b"`\n":
        name, size = data[at : at + 16].rstrip(b" "), int(data[at + 48 : at + 58])
        content = data[at + 60 : at + 60 + size]
        at += 60 + size + (size & 1)
        if name == b"//":
            long_names = content
        elif name.startswith(b"#1/"):
            n = int(name[3:])
            found.append((content[:n].rstrip(b"\0"), content[n:]))
        elif name not in (b"/", b"/SYM64/"):
            if name[:1] == b"/" and name[1:].isdigit():
                name = long_names[int(name[1:]) :].split(b"\n")[0]
            found.append((name.rstrip(b"/"), content))
    for name, content in sorted(found):
        try:
            yield Entry(name.decode("utf-8"), content=content)
        except UnicodeDecodeError:
            yield Entry(name.decode("utf-8", "backslashreplace"), content=content, problem="the name is not UTF-8", resolution="Renamed.", severity="WARNING")


@extractor("rpm")
def rpm(data: bytes) -> Iterator[Entry]:
    def end(at: int) -> int:
        count, size = struct.unpack_from(">II", data, at + 8)
        return at + 16 + 16 * count + size

    payload = data[end(-(-end(96) // 8) * 8) :]
    for mark, name in ((b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ", "xz"), (b"]\0\0", "lzma"), (b"\x28\xb5\x2f\xfd", "zstd")):
        if payload.startswith(mark):
            payload = next(EXTRACTORS[name](payload)).content
            break
    yield from cpio(payload)


@extractor("romfs")
def romfs(data: bytes) -> Iterator[Entry]:
    def name_at(at: int) -> tuple[str, int]:
        stop = data.index(b"\0", at)
        return data[at:stop].decode("utf-8", "surrogateescape"), at + (stop - at) // 16 * 16 + 16

    def walk(at: int, folder: str, seen: set[int]) -> Iterator[Entry]:
        while at and at not in seen:
            seen.add(at)
            following, info, size = struct.unpack_from(">III", data, at)
            name, body = name_at(at + 16)
            path, kind, mode = f"{folder}{name}", following & 7, 0o755 if following & 8 else 0o644
            if name not in (".", ".."):
                if kind == 1:
                    yield Entry(path, "dir", mode=0o755)
                    yield from walk(info & ~15, path + "/", seen)
                elif kind == 2:
                    yield Entry(path, content=data[body : body + size], mode=mode)
                elif kind == 3:
                    yield Entry(path, "link", link_target=data[body : body + size].decode("utf-8", "surrogateescape"))
                elif kind == 0:
                    yield Entry(path, "hardlink", link_target=str(info))
                else:
                    yield Entry(path, "special", problem="a special file", resolution="Skipped.", severity="WARNING")
            at = following & ~15

    _, first = name_at(16)
    yield from walk(first, "", set())


def carved(*parts: tuple[str, int, int]):
    """Entries of fixed ranges that hold something."""
    return [(n, a, b) for n, a, b in parts if b > a]


TABLES: dict[str, Callable[[bytes], list[tuple[str, int, int]]]] = {
    "bneg": lambda d: carved(("part1", 20, 20 + (n := struct.unpack_from("<I", d, 12)[0])), ("part2", 20 + n, 20 + n + struct.unpack_from("<I", d, 16)[0])),
    "chk": lambda d: carved(("kernel", h := struct.unpack_from(">I", d, 4)[0], h + (k := struct.unpack_from(">I", d, 24)[0])), ("rootfs", h + k, h + k + struct.unpack_from(">I", d, 28)[0])),
    "trx_v1": lambda d: offsets(d, struct.unpack_from("<3I", d, 16)),
    "trx_v2": lambda d: offsets(d, struct.unpack_from("<4I", d, 16)),
    "bdl": lambda d: table_of_contents(d),
    "ipkg": lambda d: table_of_contents(d),
    "sbfh": lambda d: carved(("firmware", struct.unpack_from("<I", d, 4)[0], len(d))),
    "macho": lambda d: [(f"slice-{i}", *(lambda o, s: (o, o + s))(*struct.unpack_from(">II", d, 16 + 20 * i))) for i in range(struct.unpack_from(">I", d, 4)[0])] if d[:4] == b"\xca\xfe\xba\xbe" else [],
    "fpkg": lambda d: walked(d),
    "hdr1": lambda d: blobs(d, 16),
    "hdr2": lambda d: blobs(d, 48),
}


def offsets(data: bytes, starts: tuple[int, ...]) -> list[tuple[str, int, int]]:
    places = sorted(x for x in starts if x)
    return [(f"part{i}", a, b) for i, (a, b) in enumerate(zip(places, [*places[1:], len(data)]))]


def table_of_contents(data: bytes) -> list[tuple[str, int, int]]:
    at, count = struct.unpack_from("<I", data, 8)[0], struct.unpack_from("<I", data, 16)[0]
    rows = [struct.unpack_from("<QQ", data, at + 16 * i) for i in range(count)]
    return [(f"entry-{i}", a, a + n) for i, (a, n) in enumerate(rows)]


def walked(data: bytes) -> list[tuple[str, int, int]]:
    at, out = struct.unpack_from(">I", data, 8)[0], []
    while at + 28 <= len(data):
        head, size = struct.unpack_from(">I", data, at)[0], struct.unpack_from(">I", data, at + 8)[0]
        out.append((data[at + 12 : at + 28].split(b"\0")[0].decode("utf-8", "replace") or f"entry-{len(out)}", at + head, at + head + size))
        at += head + size
    return out


def blobs(data: bytes, at: int) -> list[tuple[str, int, int]]:
    """Blobs by up to eight offsets: each has a header of 48 bytes with its size and name."""
    out = []
    for start in struct.unpack_from("<8I", data, at):
        if not start:
            break
        mark, _, size = struct.unpack_from("<III", data, start)
        if mark != 0xBABE or not size:
            break
        name = data[start + 16 : start + 48].split(b"\0", 1)[0].decode("utf-8")
        out.append((name or f"blob-{len(out)}", start + 48, start + 48 + size))
    return out


def by_table(name: str) -> Extractor:
    def entries(data: bytes) -> Iterator[Entry]:
        for path, start, end in TABLES[name](data):
            yield Entry(path, content=data[start:end])

    return entries


EXTRACTORS.update({name: by_table(name) for name in TABLES})


@extractor("deafbead")
def deafbead(data: bytes) -> Iterator[Entry]:
    at = 4
    while data[at : at + 1] in (b"\x86", b"\x87"):
        kind, n = data[at], int.from_bytes(data[at + 1 : at + 3], "little")
        name = data[at + 3 : at + 3 + n].decode("utf-8", "replace")
        at += 3 + n
        if kind == 0x86:
            yield Entry(name, "dir", mode=0o755)
        else:
            size = int.from_bytes(data[at : at + 4], "little")
            yield Entry(name, content=data[at + 4 : at + 4 + size])
            at += 4 + size


#: Keys of vendors' ciphers, as published for these devices.
ENCRPTED_KEY, ENCRPTED_IV = b"he9-4+M!)d6=m~we1,q2a3d1n&2*Z^%8", b"J%1iQl8$=lm-;8AE"
SHRS_KEY = bytes.fromhex("c05fbf1936c99429ce2a0781f08d6ad8")
ENGENIUS_KEY = b"\xac\x78\x3c\x9e\xcf\x67\xb3\x59"


@extractor("encrpted_img")
def encrpted_img(data: bytes) -> Iterator[Entry]:
    yield Entry("encrpted_img.decrypted", content=codecs.aes_cbc_decrypt(data[16 : 16 + (len(data) - 16) // 16 * 16], ENCRPTED_KEY, ENCRPTED_IV))


@extractor("alpha_encimg_v1", "alpha_encimg_v2")
def alpha_encimg(data: bytes) -> Iterator[Entry]:
    yield Entry("alpha_encimg.decrypted", content=alpha.decrypted(data))


@extractor("shrs")
def shrs(data: bytes) -> Iterator[Entry]:
    whole = struct.unpack_from(">I", data, 8)[0]
    yield Entry("shrs.decrypted", content=codecs.aes_cbc_decrypt(data[1756 : 1756 + (len(data) - 1756) // 16 * 16], SHRS_KEY, data[12:28])[: whole or None])


@extractor("engenius")
def engenius(data: bytes) -> Iterator[Entry]:
    start = 136 + struct.unpack_from(">I", data, 132)[0]
    phase = start - max(data.find(ENGENIUS_KEY), 0)
    key = (ENGENIUS_KEY * ((len(data) - start) // 8 + 2))[phase % 8 :][: len(data) - start]
    yield Entry("engenius.decrypted", content=bytes(a ^ b for a, b in zip(data[start:], key)))


@extractor("instar_hd")
def instar_hd(data: bytes) -> Iterator[Entry]:
    for theirs, usual in ((b"PK\x03\x07", b"PK\x03\x04"), (b"PK\x05\x09", b"PK\x05\x06"), (b"PK\x01\x08", b"PK\x01\x02")):
        data = data.replace(theirs, usual)
    yield Entry("instar_hd.deobfuscated", content=data)


@extractor("xalz")
def xalz(data: bytes) -> Iterator[Entry]:
    size = struct.unpack_from("<I", data, 8)[0]
    yield Entry("xalz.uncompressed", content=codecs.lz4_block(data[12:], size))


@extractor("airoha")
def airoha(data: bytes) -> Iterator[Entry]:
    at, size = struct.unpack_from("<II", data, 262)
    firmware = data[at : at + size]
    if firmware[:3] == b"]\0\0":
        yield Entry("firmware.bin", content=inflated(lzma.LZMADecompressor(lzma.FORMAT_ALONE), firmware))
    else:
        yield Entry("firmware.encrypted", content=firmware)


@extractor("moxa_frm")
def moxa_frm(data: bytes) -> Iterator[Entry]:
    """Sections of 16 bytes (type, offset, size) after the header: 1 is the firmware, 2 a table of files within the section."""
    for i in range(struct.unpack_from("<H", data, 14)[0]):
        kind, at, size = struct.unpack_from("<III", data, 64 + 16 * i)
        section = data[at : at + size]
        if kind == 1:
            yield Entry("firmware.bin", content=section)
        elif kind == 2:
            table, width, count = struct.unpack_from("<I", section, 48)[0], *struct.unpack_from("<HH", section, 56)
            for n in range(count or struct.unpack_from("<H", section, 66)[0]):
                row = section[table + n * width : table + n * width + 64]
                length, place = struct.unpack_from("<II", row, 56)
                name, content = row[:48].rstrip(b"\0"), section[place : place + length]
                if name and place < size:
                    yield Entry(name.decode("ascii", "replace"), content=members(lambda: zlib.decompressobj(31), content, b"\x1f\x8b") if content[:2] == b"\x1f\x8b" else content)
        else:
            yield Entry("", problem=f"a section of type {kind}", resolution="Stopped here.", severity="ERROR")
            return


@extractor("minifs")
def minifs(data: bytes) -> Iterator[Entry]:
    files, _, names = struct.unpack_from(">III", data, 20)
    table = 32 + names
    rows = [struct.unpack_from(">5I", data, table + 20 * i) for i in range(files)]
    entries = table + 20 * files
    chunks = max(r[2] for r in rows) + 1
    start = entries + 12 * chunks
    text = lambda at: data[32 + at :].split(b"\0", 1)[0].decode("utf-8", "replace")
    now, opened = -1, b""
    # Files of one chunk together, so that each is opened once.
    for path, name, chunk, offset, size in sorted(rows, key=lambda r: (r[2], r[3])):
        if chunk != now:
            at, packed, whole = struct.unpack_from(">3I", data, entries + 12 * chunk)
            opened, now = lzma.LZMADecompressor(lzma.FORMAT_ALONE).decompress(data[start + at : start + at + packed], whole), chunk
        yield Entry(posixpath.join(text(path), text(name)), content=opened[offset : offset + size])


@extractor("minix_fs_v1", "minix_fs_v2", "minix_fs_v3")
def minix(data: bytes) -> Iterator[Entry]:
    third = data[0x418:0x41A] in (b"\x5a\x4d", b"\x4d\x5a")
    mark = data[0x418:0x41A] if third else data[0x410:0x412]
    order = ">" if mark in (b"\x4d\x5a", b"\x13\x7f", b"\x13\x8f", b"\x24\x68", b"\x24\x78") else "<"
    number = lambda kind, at: struct.unpack_from(order + kind, data, at)[0]
    old = not third and mark in (b"\x7f\x13", b"\x8f\x13", b"\x13\x7f", b"\x13\x8f")
    block = number("H", 0x400 + 28) if third else 1024
    imap, zmap = (number("H", 0x406), number("H", 0x408)) if third else (number("H", 0x404), number("H", 0x406))
    log = number("H", 0x40C) if third else number("H", 0x40A)
    inodes, width = (2 + imap + zmap) * block, 32 if old else 64
    name_size, zone_kind, zone_width = (60, "I", 4) if third else (30 if mark in (b"\x8f\x13", b"\x13\x8f", b"\x78\x24", b"\x24\x78") else 14, "H" if old else "I", 2 if old else 4)

    def zones(at: int, levels: int, left: int) -> Iterator[bytes]:
        piece = data[at * block << log : (at * block << log) + (block << log)]
        if not levels:
            yield piece
            return
        for i in range(min(left, (block << log) // zone_width)):
            inner = struct.unpack_from(order + zone_kind, piece, zone_width * i)[0]
            if not inner:
                return
            yield from zones(inner, levels - 1, left)

    def content(inode: int) -> tuple[int, bytes]:
        at = inodes + (inode - 1) * width
        mode, size = number("H", at), number("I", at + (4 if old else 8))
        first = at + (14 if old else 24)
        out = b""
        for i in range(9 if old else 10):
            zone = number(zone_kind, first + zone_width * i)
            if not zone or len(out) >= size:
                break
            for piece in zones(zone, max(0, i - 6), size // block + 1):
                out += piece
                if len(out) >= size:
                    break
        return mode, out[:size]

    def walk(inode: int, folder: str, seen: frozenset[int]) -> Iterator[Entry]:
        _, listing = content(inode)
        step = name_size + (4 if third else 2)
        for i in range(0, len(listing) - step + 1, step):
            child = struct.unpack_from(order + ("I" if third else "H"), listing, i)[0]
            name = listing[i + step - name_size : i + step].split(b"\0", 1)[0].decode("utf-8", "replace")
            if not child or name in (".", ".."):
                continue
            mode, body = content(child)
            kind, path = mode >> 12, folder + name
            if kind == 4:
                yield Entry(path, "dir", mode=mode & 0o7777)
                if child not in seen:
                    yield from walk(child, path + "/", seen | {child})
            elif kind == 8:
                yield Entry(path, content=body, mode=mode & 0o7777)
            elif kind == 10:
                yield Entry(path, "link", link_target=body.decode("utf-8", "replace"))
            else:
                yield Entry(path, "special", problem="a special file", resolution="Skipped.", severity="WARNING")

    yield from walk(1, "", frozenset({1}))


#: Programs that unpack a file into a folder; {file}, {folder}.  What one writes to its output alone is a file's name after ">".
COMMANDS: dict[str, tuple[str, ...]] = {
    "7z": ("7z", "x", "-p", "-y", "{file}", "-o{folder}"), "unar": ("unar", "-no-directory", "-p", "", "{file}", "-o", "{folder}"), "debugfs": ("debugfs", "-R", "rdump / {folder}", "{file}"), "jefferson": ("jefferson", "-v", "-f", "-d", "{folder}", "{file}"),
    "sasquatch": ("sasquatch", "-no-exit-code", "-f", "-d", "{folder}", "{file}"), "ubireader_extract_images": ("ubireader_extract_images", "{file}", "-o", "{folder}"), "ubireader_extract_files": ("ubireader_extract_files", "{file}", "-w", "-o", "{folder}"),
    "fsck.erofs": ("fsck.erofs", "--no-preserve", "--extract={folder}", "{file}"), "partclone.restore": ("partclone.restore", "-W", "-s", "{file}", "-o", "{folder}/partclone.image", "-L", "/dev/stdout"),
}
TIMEOUT = 12 * 3600.0


def command(data: bytes, tool: str, timeout: float = TIMEOUT) -> Iterator[Entry]:
    """What a program unpacks, in a folder of the task's own that goes with it.  A program that is missing, fails or takes too long is an
    entry with an error, after what it had unpacked by then."""
    with tempfile.TemporaryDirectory(prefix="bytelode-") as top:
        file, folder = os.path.join(top, "in"), os.path.join(top, "out")
        os.mkdir(folder)
        with open(file, "wb") as f:
            f.write(data)
        wrong = None
        try:
            run = subprocess.run([a.format(file=file, folder=folder) for a in COMMANDS[tool]], stdin=subprocess.DEVNULL, capture_output=True, timeout=timeout, check=False)
            if run.returncode:
                wrong = f"{tool} ended with {run.returncode}: {run.stderr.decode('utf-8', 'replace')[-500:]}", "Extraction may be incomplete."
        except FileNotFoundError:
            wrong = f"{tool} is needed", "Not unpacked."
        except subprocess.TimeoutExpired:
            wrong = f"{tool} took over {timeout:g} seconds", "Stopped it."
        for where, folders, files in os.walk(folder):
            for name in sorted(folders + files):
                path = os.path.join(where, name)
                inside, mode = os.path.relpath(path, folder), os.lstat(path).st_mode
                if stat.S_ISLNK(mode):
                    yield Entry(inside, "link", link_target=os.readlink(path))
                elif stat.S_ISDIR(mode):
                    yield Entry(inside, "dir", mode=mode & 0o7777)
                elif stat.S_ISREG(mode):
                    size = os.path.getsize(path)
                    if size > MOST:
                        yield Entry(inside, problem="the content is larger than a row may hold", resolution="Skipped.", severity="ERROR")
                        continue
                    with open(path, "rb") as f:
                        yield Entry(inside, content=f.read(), mode=mode & 0o7777)
                else:
                    yield Entry(inside, "special", problem="a special file", resolution="Skipped.", severity="WARNING")
        if wrong:
            yield Entry("", problem=wrong[0], resolution=wrong[1], severity="ERROR")


def checked(entry: Entry, seen: set[str]) -> Entry:
    """The entry with a safe path and link target, or its problem and what was done about it."""
    if not entry.path:
        return entry if entry.problem else replace(entry, content=None, problem="the name is empty", resolution="Skipped.", severity="WARNING")
    if len(entry.path.encode("utf-8", "surrogatepass").split(b"/")[-1]) > 255:
        return replace(entry, content=None, problem="the name is too long", resolution="Skipped.", severity="WARNING")
    path = paths.normal(paths.without_root(entry.path))
    if entry.path.startswith("/") and path is not None:
        entry = replace(entry, problem="the path is absolute", resolution="Made relative.", severity="WARNING")
    if path is None:
        return replace(entry, path=paths.lost_and_found(entry.path), problem="the path leaves the root", resolution="Moved to lost and found.", severity="WARNING")
    entry = replace(entry, path=path)
    if entry.type == "link":
        target = paths.link_target(path, entry.link_target or "")
        if target is None:
            return replace(entry, link_target=None, problem=f"the link to {entry.link_target!r} escapes or loops", resolution="Removed.", severity="WARNING")
        entry = replace(entry, link_target=target)
    if path in seen and entry.type != "dir":
        entry = replace(entry, problem="a member of that name came before", resolution="Replaced it.", severity="WARNING")
    seen.add(path)
    mode = entry.mode | (0o775 if entry.type == "dir" else 0o644)
    return replace(entry, mode=mode)


def unpack(data: bytes, handler: str, encrypted: bool = False, commands: bool = False) -> Iterator[Entry]:
    """Checked entries; what goes wrong is an entry with an error.  With ``commands`` other programs unpack what isn't unpacked here."""
    if encrypted:
        yield Entry("", problem="the container is encrypted", resolution="Not unpacked.", severity="ERROR")
        return
    known = EXTRACTORS.get(handler)
    if known is None:
        tool = next((f.tool for f in FORMATS if f.name == handler), None)
        if not tool:
            yield Entry("", problem="this format is found, but not unpacked", resolution="Not unpacked.", severity="WARNING")
            return
        if not commands or tool not in COMMANDS:
            yield Entry("", problem=f"{tool} is needed", resolution="Not unpacked.", severity="ERROR")
            return
        known = lambda content: command(content, tool)
    seen: set[str] = set()
    try:
        for entry in known(data):
            yield checked(entry, seen)
    except Exception as e:  # a damaged container: what came before stays, the rest is reported
        yield Entry("", problem=f"{type(e).__name__}: {e}", resolution="Stopped here.", severity="ERROR")


def entries(chunks: DataFrame, commands: bool = False) -> DataFrame:
    """(chunk_id, handler, content, is_encrypted) to ENTRIES."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, handler, content, encrypted in zip(*(batch[c].to_pylist() for c in ("chunk_id", "handler", "content", "is_encrypted"))):
                out = [(chunk, handler, e.path, e.type, e.mode, len(e.content or b""), e.link_target, e.content, e.problem, e.resolution, e.severity) for e in unpack(content or b"", handler, bool(encrypted), commands)]
                # A batch for each container: what one holds may be large.
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(SCHEMA)], schema=SCHEMA)

    return map_batches(chunks.select("chunk_id", "handler", "content", "is_encrypted"), rows, ENTRIES)
