"""Compressed streams."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

from bytelode.formats.base import Invalid, Reader, fmt, need

COMPRESSED = "compression"


def drained(decoder, r: Reader, at: int = 0) -> tuple[int, int]:
    """(bytes read, bytes given) of a decoder up to the end of its stream."""
    read, out, pos = 0, 0, r.base + at
    while not decoder.eof and pos < len(r.data):
        block = bytes(r.data[pos : pos + 65536])
        try:
            out += len(decoder.decompress(block))
        except (zlib.error, OSError, lzma.LZMAError) as e:
            raise Invalid from e
        pos += len(block)
    if not decoder.eof:
        raise EOFError
    return pos - len(decoder.unused_data) - r.base, out


BZIP = b"\x31\x41\x59\x26\x53\x59"


@fmt("bzip2", COMPRESSED, r"re:\x42\x5a\x68[\x31-\x39]\x31\x41\x59\x26\x53\x59")
def bzip2(r: Reader) -> int:
    end = 0
    while r.upto(end, 3) == b"BZh" and r.upto(end + 4, 6) == BZIP:
        end = drained(bz2.BZ2Decompressor(), r, end)[0]
    return end


@fmt("compress", COMPRESSED, "1f 9d")
def compress(r: Reader) -> int:
    flags = r.u8(2)
    most, block_mode = flags & 0x1F, bool(flags & 0x80)
    need(9 <= most <= 16 and not flags & 0x60)
    bits, free, at, group = 9, 257 if block_mode else 256, 24, 0
    total = r.left * 8
    start, old = at, -1
    while at + bits <= total:
        low = at >> 3
        code = (int.from_bytes(r.upto(low, 4), "little") >> (at & 7)) & ((1 << bits) - 1)
        at, group = at + bits, group + 1
        if code == 256 and block_mode and old >= 0:
            # Codes come in groups of eight of a width; the rest of a group is left out.
            at = start + -(-(at - start) // (bits * 8)) * bits * 8
            bits, free, start, old = 9, 257, at, -1
            continue
        need(code < 256 if old < 0 else code <= free)
        if old >= 0 and free < 1 << most:
            free += 1
            if free > (1 << bits) - 1 and bits < most:
                at = start + -(-(at - start) // (bits * 8)) * bits * 8
                bits, start = bits + 1, at
        old = code
    size = r.left
    need(size > 5)
    return size


GZIP = "1F 8B 08 ( " + " | ".join(f"{i:02X}" for i in range(0x1F)) + " ) [5] ( " + " | ".join([*(f"{i:02X}" for i in range(0x0E)), "FF"]) + " )"


@fmt("gzip", COMPRESSED, GZIP)
def gzip(r: Reader) -> int:
    end = 0
    while r.upto(end, 3) == b"\x1f\x8b\x08":
        try:
            end = drained(zlib.decompressobj(31), r, end)[0]
        except (Invalid, EOFError):
            if not end:
                raise
            break
    return end


@fmt("lzh", COMPRESSED, *[f"re:-{m}-" for m in ("lh0", "lzs", "lz4", "lh1", "lh2", "lh3", "lh4", "lh5", "lh6", "lh7", "lh8", "lhd")], offset=-2, tool="7z")
def lzh(r: Reader) -> int:
    level = r.u8(20)
    need(level <= 2)
    header = r.u16(0) if level == 2 else r.u8(0) + 2
    need(header >= 21)
    end = header + r.u32(7)
    return end + 1 if end + 1 == r.left else end


@fmt("lzip", COMPRESSED, "4C 5A 49 50 01")
def lzip(r: Reader) -> int:
    for at in range(6 + 20, r.left - 7):
        if r.upto(at, 2) == (at + 8).to_bytes(8, "little")[:2] and r.u64(at) == at + 8:
            return at + 8
    raise Invalid


@fmt("lzo", COMPRESSED, "89 4C 5A 4F 00 0D 0A 1A 0A")
def lzo(r: Reader) -> int:
    r = r.be()
    flags, shift = r.u32(17), 0
    need(r.u8(16) <= 9)
    if flags & 0x800:
        shift = 4
    end = 34 + shift + r.u8(33 + shift)
    check = zlib.crc32 if flags & 0x1000 else zlib.adler32
    need(check(r.raw(9, end - 9)) == r.u32(end))
    at = end + 4
    while size := r.u32(at):
        packed = r.u32(at + 4)
        need(packed <= size)
        sums = bool(flags & 1) + bool(flags & 0x100)
        if packed < size:
            sums += bool(flags & 2) + bool(flags & 0x200)
        at += 8 + 4 * sums + packed
    return at + 4


LZMA = (
    "( 51 | 5A | 5B | 5C | 5D | 5E | 63 | 64 | 65 | 66 | 6C | 6D | 6E | 75 | 76 | 7E | 87 | 88 | 89 | 8A | 8B | 90 | 91 | 92 | 93 | 99 | 9A | 9B | A2 | A3 | AB"
    " | B4 | B5 | B6 | B7 | B8 | BD | BE | BF | C0 | C6 | C7 | C8 | CF | D0 | D8 ) 00 00 ( 00 | 01 | 04 | 08 | 10 | 20 | 40 | 80) ( 00 | 01 | 02 | 04 | 08 )"
)


@fmt("lzma", COMPRESSED, LZMA)
def lzma_(r: Reader) -> int:
    dictionary, size = r.u32(1), r.u64(5)
    need(dictionary and not dictionary & (dictionary - 1))
    need(size == (1 << 64) - 1 or 256 <= size < 1 << 40)
    decoder = lzma.LZMADecompressor(lzma.FORMAT_ALONE)
    try:
        read, out = drained(decoder, r)
    except EOFError as e:
        raise Invalid from e
    need(read >= 256 and read <= out)
    return read


@fmt("lz4_legacy", COMPRESSED, "02 21 4C 18")
def lz4_legacy(r: Reader) -> int:
    def decoded(at: int, size: int) -> int:
        """The length that a block of raw LZ4 has when it is decoded."""
        end, out = at + size, 0

        def more(at: int) -> tuple[int, int]:
            total = 0
            while True:
                byte = r.u8(at)
                total, at = total + byte, at + 1
                if byte != 255:
                    return total, at

        while at < end:
            token = r.u8(at)
            at += 1
            literals = token >> 4
            if literals == 15:
                extra, at = more(at)
                literals += extra
            at, out = at + literals, out + literals
            if at >= end:
                break
            need(0 < r.u16(at) <= out)
            at += 2
            match = token & 15
            if match == 15:
                extra, at = more(at)
                match += extra
            out += match + 4
        need(at == end)
        return out

    at = 4
    while at + 4 <= r.left:
        size = r.u32(at)
        if size in (0x184C2102, 0x184D2204) or 0x184D2A50 <= size <= 0x184D2A5F or size > 0x808000 or not size or at + 4 + size > r.left:
            break
        try:
            length = decoded(at + 4, size)
        except Invalid:
            break
        at += 4 + size
        if length < 8 << 20:
            break
    need(at > 4)
    return at


@fmt("lz4_skippable", COMPRESSED, "5? 2A 4D 18")
def lz4_skippable(r: Reader) -> int:
    return 8 + r.u32(4)


@fmt("lz4_default", COMPRESSED, "04 22 4D 18")
def lz4(r: Reader) -> int:
    flags = r.u8(4)
    need(flags >> 6 == 1)
    at = 7 + 8 * bool(flags & 8) + 4 * bool(flags & 1)
    while size := r.u32(at):
        at += 4 + (size & 0x7FFFFFFF) + 4 * bool(flags & 16)
        need(r.base + at <= len(r.data))
    return at + 4 + 4 * bool(flags & 4)


@fmt("xz", COMPRESSED, "FD 37 7A 58 5A 00")
def xz(r: Reader) -> int:
    end = 0
    while r.upto(end, 6) == b"\xfd7zXZ\0":
        try:
            end = drained(lzma.LZMADecompressor(lzma.FORMAT_XZ), r, end)[0]
        except (Invalid, EOFError):
            if not end:
                raise
            break
        after = r.skip(end, b"\0")
        end += (after - end) // 4 * 4
    return end


@fmt("zstd", COMPRESSED, "28 B5 2F FD")
def zstd(r: Reader) -> int:
    flags = r.u8(4)
    single, size = bool(flags & 0x20), flags >> 6
    need(not flags & 8)
    at = 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[size]
    while True:
        block = r.int(at, 3)
        kind, length = block >> 1 & 3, block >> 3
        need(kind != 3)
        at += 3 + (1 if kind == 1 else length)
        need(r.base + at <= len(r.data))
        if block & 1:
            return at + 4 * bool(flags & 4)


@fmt("zlib", COMPRESSED, r"re:\A\x78[\x01\x9c\xda\x5e]")
def zlib_(r: Reader) -> int:
    # The trailer of a disk image: its pieces are streams of this kind.
    need(b"koly" not in bytes(r.data[-512:]))
    return drained(zlib.decompressobj(), r)[0]


UZIP = (b"#!/bin/sh\n#V2.0 Format\n(kldstat -qm g_uzip||kldload geom_uzip)>&-&&mount_cd9660 /dev/`mdconfig -af $0`.uzip $1\nexit $?\n", b"#L3.0\n", b"#Z4.0\n")


@fmt("uzip", COMPRESSED, *["re:" + "".join(f"\\x{c:02x}" for c in m) for m in UZIP])
def uzip(r: Reader) -> int:
    r = r.be()
    block, count = r.u32(128), r.u32(132)
    need(block and block % 512 == 0 and 0 < count < 1 << 28)
    places = struct.unpack(f">{count + 1}Q", r.raw(136, 8 * (count + 1)))
    need(all(a <= b for a, b in zip(places, places[1:])))
    return places[-1]


@fmt("qca_lzma", COMPRESSED, "00 00 00 00 ?? ?? ?? ?? 03 00 02 00 00 10 00 00", offset=8)
def qca_lzma(r: Reader) -> int:
    packed, size = r.u32(8), r.u32(12)
    body = r.raw(16, packed)
    try:
        out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 20}]).decompress(body, size)
    except lzma.LZMAError as e:
        raise Invalid from e
    need(len(out) == size)
    return 16 + packed


@fmt("qnx_deflate", COMPRESSED, "69 77 6c 79 66 6d 62 70 [6] (00|01)")
def qnx_deflate(r: Reader) -> int:
    need(r.u32(8) and r.u16(12) in (4096, 8192, 16384, 32768))
    at = 16
    while step := r.u16(at + 2):
        need(step >= 8)
        at += step
    return at + 8
