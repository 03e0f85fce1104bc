"""Samples: small files of every format, made here from the formats' descriptions, with what they hold.

They carry the queries of ``bytelode.queries_formats``, whose SQL states as values what must be found, and the tests.  Sizes of what
is compressed follow from the compressors that are installed; all else is arithmetic.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import random
import struct
import tarfile
import zipfile
import zlib
from functools import lru_cache

import zstandard

RAW = random.Random(5).randbytes(3000) + b"abc" * 2000
LETTERS = bytes(random.Random(1).choices(range(97, 101), k=400))
#: What files in sample archives hold.
BODY = b"the content of a file in a container, of 57 bytes in all."


def pad(fields: dict[int, bytes], size: int) -> bytes:
    out = bytearray(size)
    for at, value in fields.items():
        out[at : at + len(value)] = value
    return bytes(out)


def le(x: int, n: int = 4) -> bytes:
    return x.to_bytes(n, "little")


def be(x: int, n: int = 4) -> bytes:
    return x.to_bytes(n, "big")


def crc_at(body: bytes, at: int, start: int, end: int, invert: bool) -> bytes:
    crc = zlib.crc32(body[start:end]) ^ (0xFFFFFFFF if invert else 0)
    return body[:at] + le(crc) + body[at + 4 :]


# Archives ----------------------------------------------------------------------------------------


def zipped(body: bytes = BODY) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as f:
        f.writestr(zipfile.ZipInfo("a.txt", (2024, 1, 1, 0, 0, 0)), body)
        f.writestr(zipfile.ZipInfo("dir/b.txt", (2024, 1, 1, 0, 0, 0)), b"second")
        f.comment = b"a comment"
    return out.getvalue()


def tarred(body: bytes = BODY) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as f:
        for name, content in (("a.txt", body), ("dir/b.txt", b"second")):
            i = tarfile.TarInfo(name)
            i.size = len(content)
            f.addfile(i, io.BytesIO(content))
    return out.getvalue()


def cpio(mark: bytes = b"070701", body: bytes = BODY) -> bytes:
    def entry(name: bytes, data: bytes, mode: int) -> bytes:
        head = mark + b"".join(b"%08X" % x for x in (1, mode, 0, 0, 1, 0, len(data), 0, 0, 0, 0, len(name) + 1, sum(data) if mark == b"070702" else 0))
        out = head + name + b"\0"
        out += b"\0" * (-len(out) % 4) + data
        return out + b"\0" * (-len(out) % 4)

    out = entry(b"a.txt", body, 0o100644) + entry(b"dir", b"", 0o40755) + entry(b"TRAILER!!!", b"", 0)
    return out + bytes(-len(out) % 512)


def cpio_old(body: bytes = BODY) -> bytes:
    entry = lambda name, data, mode: b"070707" + b"000001" * 2 + b"%06o" % mode + b"000000" * 4 + b"%011o" % 0 + b"%06o" % (len(name) + 1) + b"%011o" % len(data) + name + b"\0" + data
    out = entry(b"a.txt", body, 0o100644) + entry(b"TRAILER!!!", b"", 0)
    return out + bytes(-len(out) % 512)


def cpio_binary(body: bytes = BODY) -> bytes:
    def entry(name: bytes, data: bytes, mode: int) -> bytes:
        head = b"\xc7\x71" + le(1, 2) * 2 + le(mode, 2) + le(0, 2) * 6 + le(len(name) + 1, 2) + le(len(data) >> 16, 2) + le(len(data) & 0xFFFF, 2)
        out = head + name + b"\0"
        out += bytes(len(out) % 2) + data
        return out + bytes(len(out) % 2)

    out = entry(b"a.txt", body, 0o100644) + entry(b"TRAILER!!!", b"", 0)
    return out + bytes(-len(out) % 512)


def ar(body: bytes = BODY) -> bytes:
    return b"!<arch>\n" + b"a.txt/".ljust(16) + b"0".ljust(12) + b"0".ljust(6) * 2 + b"644".ljust(8) + str(len(body)).encode().ljust(10) + b"`\n" + body + b"\n" * (len(body) % 2)


def arj() -> bytes:
    def block(body: bytes) -> bytes:
        return b"\x60\xea" + le(len(body), 2) + body + le(zlib.crc32(body)) + le(0, 2)

    main = block(pad({0: bytes([30]), 1: b"\x0b\x01\x02\x10"}, 34))
    return main + block(pad({0: bytes([30]), 12: le(10)}, 40)) + b"d" * 10 + b"\x60\xea\0\0"


def arc() -> bytes:
    return b"\x1a\x02" + b"file.txt".ljust(13, b"\0") + le(20) + le(0) + le(0, 2) + le(20) + b"z" * 20 + b"\x1a\0"


def rar(fifth: bool) -> bytes:
    """Headers of the fourth edition: checksum, type, flags, size; of the fifth: checksum, size and fields in groups of 7 bits."""
    if not fifth:
        def block(kind: int, flags: int, rest: bytes = b"") -> bytes:
            body = bytes([kind]) + le(flags, 2) + le(7 + len(rest), 2) + rest
            return le(zlib.crc32(body) & 0xFFFF, 2) + body

        head = le(20) + le(20) + b"\2" + le(0) * 2 + b"\x14\x30" + le(1, 2) + le(0) + b"f"
        return b"Rar!\x1a\x07\x00" + block(0x73, 0, bytes(6)) + block(0x74, 0x8000, head) + b"r" * 20 + block(0x7B, 0x4000)

    def block5(*fields: int, data: bytes = b"") -> bytes:
        body = bytes(fields)
        return le(zlib.crc32(bytes([len(body)]) + body)) + bytes([len(body)]) + body + data

    return b"Rar!\x1a\x07\x01\x00" + block5(1, 0, 0) + block5(2, 2, 20, 0, 20, 0, 0, 0, 1, ord("f"), data=b"r" * 20) + block5(5, 0, 0)


def rpm(payload: bytes | None = None) -> bytes:
    def header(tags: list[tuple[int, int]]) -> bytes:
        return b"\x8e\xad\xe8\1" + bytes(4) + be(len(tags)) + be(4 * len(tags)) + b"".join(be(t) + be(4) + be(4 * i) + be(1) for i, (t, _) in enumerate(tags)) + b"".join(be(v) for _, v in tags)

    lead = pad({0: b"\xed\xab\xee\xdb\3\0\0\0\0\1", 76: b"\0\1\0\5"}, 96)
    body = header([(1004, 5)]) + (gzip.compress(cpio(), mtime=0) if payload is None else payload)
    signature = header([(1000, len(body))])
    return lead + signature + bytes(-(96 + len(signature)) % 8) + body


def msi() -> bytes:
    free, mark = 0xFFFFFFFF, 0xFFFFFFFD
    table = [mark, 0xFFFFFFFE, 3, 0xFFFFFFFE] + [free] * 124
    head = pad({0: b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 30: le(9, 2), 44: le(1), 68: le(0xFFFFFFFE), 72: le(0), 76: le(0) + le(free) * 108}, 512)
    return head + struct.pack("<128I", *table) + b"s" * 3 * 512


def sevenzip() -> bytes:
    return crc_at(pad({0: b"7z\xbc\xaf\x27\x1c", 12: le(100, 8), 20: le(20, 8)}, 152), 8, 12, 32, False)


def partclone() -> bytes:
    head = pad({0: b"partclone-image\0", 16: b"0.3.13", 30: b"0002", 34: b"\xde\xc0", 60: le(16, 8), 76: le(3, 8), 84: le(512), 96: le(1, 2), 98: le(4, 2), 100: le(2)}, 106)
    head += le(zlib.crc32(head) ^ 0xFFFFFFFF)
    return head + b"\xff\xff" + bytes(4) + bytes(2 * 4) + b"b" * 3 * 512  # bitmap, its checksum, the blocks' checksums, blocks


# Compressed streams ------------------------------------------------------------------------------


def lzo() -> bytes:
    head = b"\x89LZO\0\r\n\x1a\n" + be(0x1030, 2) + be(0x2080, 2) + be(0x0940, 2) + b"\1" + b"\5" + be(1) + be(0o100644) + be(0) + be(0) + b"\0"
    return head + be(zlib.adler32(head[9:])) + be(4) + be(4) + be(zlib.adler32(b"abcd")) + b"abcd" + be(0)


def lzw(data: bytes) -> bytes:
    """As the usual program writes it: codes of 9 bits, never cleared; for data of so few phrases that the width never changes."""
    table, free, codes, w = {bytes([i]): i for i in range(256)}, 257, [], b""
    for c in data:
        if w + bytes([c]) in table:
            w += bytes([c])
            continue
        codes.append(table[w])
        table[w + bytes([c])] = free
        free, w = free + 1, bytes([c])
    codes.append(table[w])
    acc = sum(code << 9 * i for i, code in enumerate(codes))
    return b"\x1f\x9d\x8c" + acc.to_bytes(-(-9 * len(codes) // 8), "little")


def lzip() -> bytes:
    packed = lzma.compress(RAW, format=lzma.FORMAT_ALONE, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 16}])[13:]
    return b"LZIP\1\x10" + packed + le(zlib.crc32(RAW)) + le(len(RAW), 8) + le(6 + len(packed) + 20, 8)


def lzh() -> bytes:
    return pad({0: bytes([25]), 2: b"-lh0-", 7: le(40), 11: le(40), 20: b"\1"}, 27) + b"q" * 40


def lz4_legacy() -> bytes:
    block = bytes([0xF0, 5]) + b"x" * 20
    return b"\x02\x21\x4c\x18" + le(len(block)) + block


def qca_lzma() -> bytes:
    packed = lzma.compress(RAW, format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 20}])
    return b"\3\0\2\0\0\x10\0\0" + le(len(packed)) + le(len(RAW)) + packed


def qnx() -> bytes:
    block = lambda step, size: le(0, 2) + le(step, 2) + le(0, 2) + le(size, 2)
    return b"iwlyfmbp" + le(40) + le(4096, 2) + b"\0" + b"\0" + block(24, 12) + lzo1x(b"literal text") + block(0, 0)


def lzo1x(literals: bytes) -> bytes:
    """Literals alone, and the end mark: 4 to 238 of them."""
    return bytes([17 + len(literals)]) + literals + b"\x11\0\0"


def uzip() -> bytes:
    blocks = [lzma.compress(BODY.ljust(512, b"\0")), lzma.compress(b"second".ljust(512, b"\0"))]
    start = 136 + 8 * 3
    ends = [start, start + len(blocks[0]), start + len(blocks[0]) + len(blocks[1])]
    return pad({0: b"#L3.0\n", 128: be(512) + be(2), 136: b"".join(be(e, 8) for e in ends)}, start) + b"".join(blocks)


# File systems ------------------------------------------------------------------------------------


def romfs(body: bytes = BODY) -> bytes:
    up = lambda x: -(-x // 16) * 16
    file = struct.pack(">III", 2, 0, len(body)) + be(0) + b"a.txt".ljust(16, b"\0") + body
    data = bytearray(pad({0: b"-rom1fs-", 16: b"vol", 32: file}, up(32 + len(file))))
    data[8:12] = be(len(data))
    head = bytes(data[:512])
    data[12:16] = be(-sum(struct.unpack(f">{len(head) // 4}I", head)) & 0xFFFFFFFF)
    return bytes(data) + bytes(-len(data) % 1024)


def cramfs() -> bytes:
    body = pad({0: le(0x28CD3D45), 4: le(4096), 8: le(1), 16: b"Compressed ROMFS", 100: b"data"}, 4096)
    return body[:32] + le(zlib.crc32(body)) + body[36:]


def btrfs() -> bytes:
    return b"btrfs-stream\0\1\0\0\0" + le(4) + le(1, 2) + le(0) + b"abcd" + le(0) + le(21, 2) + le(0)


def ubi(blocks: int = 4, size: int = 4096) -> bytes:
    return b"".join(pad({0: b"UBI#\x01", 100: bytes([i])}, size) for i in range(blocks))


def jffs2(mark: int) -> bytes:
    def node(kind: int, body: bytes) -> bytes:
        head = le(mark, 2) + le(kind, 2) + le(12 + len(body))
        return head + le((zlib.crc32(head, 0xFFFFFFFF) ^ 0xFFFFFFFF) & 0xFFFFFFFF) + body

    return node(0xE001, b"x" * 28) + node(0xE002, b"y" * 56) + node(0x2003, b"")


def ufs(second: bool, solaris: bool = False) -> bytes:
    sb = 0x10000 if second else 0x2000
    fields = {sb + 44: le(4), sb + 48: le(8192), sb + 52: le(1024), sb + 56: le(8)}
    if second:
        return pad({**fields, sb + 1080: le(90, 8), sb + 0x55C: b"\x19\x01\x54\x19", sb + 0x560: b"\0"}, 90 * 1024)
    return pad({**fields, sb + 36: le(40), sb + 0x550: b"\x08\0\0\0" if solaris else b"\1\0\0\0", sb + 0x55C: b"\x54\x19\1\0"}, 40 * 1024)


def fat() -> bytes:
    return pad({0: b"\xeb\x3c\x90", 11: le(512, 2), 13: b"\1", 14: le(1, 2), 16: b"\2", 17: le(16, 2), 19: le(100, 2), 21: b"\xf8", 22: le(1, 2), 510: b"\x55\xaa"}, 51200)


def minix(version: int) -> bytes:
    """Version 1 has a folder with a file of 1500 bytes and a link; the others are empty."""
    if version == 1:
        inode = lambda mode, size, zones: struct.pack("<HHIIBB9H", mode, 0, size, 0, 0, 1, *(zones + [0] * (9 - len(zones))))
        entry = lambda n, name: struct.pack("<H14s", n, name)
        sb = struct.pack("<HHHHHHIHH", 32, 12, 1, 1, 5, 0, 268966912, 0x137F, 1)
        inodes = inode(0o40755, 64, [5]) + inode(0o100644, 1500, [6, 7]) + inode(0o120777, 4, [8])
        root = entry(1, b".") + entry(1, b"..") + entry(2, b"file") + entry(3, b"link")
        return pad({0x400: sb, 4 * 1024: inodes, 5 * 1024: root, 6 * 1024: b"x" * 1500, 8 * 1024: b"file"}, 12 * 1024)
    if version == 2:
        sb = le(32, 2) + le(0, 2) + le(1, 2) + le(1, 2) + le(5, 2) + le(0, 2) + le(1 << 20) + le(0x2468, 2) + le(1, 2) + le(10)
    else:
        sb = le(32) + le(0, 2) + le(1, 2) + le(1, 2) + le(5, 2) + le(0, 2) + le(0, 2) + le(1 << 20) + le(10) + le(0x4D5A, 2) + le(0, 2) + le(1024, 2) + b"\0"
    return pad({0x400: sb}, 10240)


def yaffs() -> bytes:
    header = lambda kind, parent, size: pad({0: le(kind) + le(parent) + b"\xff\xff" + b"name", 292: le(size)}, 2048) + b"\xff" * 64
    return header(3, 1, 0xFFFFFFFF) + header(1, 1, 3000) + (b"d" * 2048 + b"\xff" * 64) * 2 + header(3, 1, 0xFFFFFFFF)


def minifs() -> bytes:
    body = b"first file" + b"second"
    packed = lzma.compress(body, format=lzma.FORMAT_ALONE)
    names = b"dir\0a\0b\0"
    data = pad({0: b"MINIFS", 16: b"\0\0\0\3", 20: struct.pack(">III", 2, 0, len(names))}, 32) + names
    return data + struct.pack(">5I", 0, 6, 0, 10, 6) + struct.pack(">5I", 0, 4, 0, 0, 10) + struct.pack(">3I", 0, len(packed), len(body)) + packed


def iso9660() -> bytes:
    volume = pad({0: b"\1CD001", 80: le(20) + be(20), 128: le(2048, 2) + be(2048, 2)}, 2048)
    return b"\0" * 0x8000 + volume + b"\0" * (20 * 2048 - 0x8800)


def lvm2() -> bytes:
    text = b'vg {\nid = "x"\nextent_size = 2\nphysical_volumes { pv0 { id = "ABCDEF-0123-4567-89AB-CDEF-0123-456789" pe_start = 16 } }\nlogical_volumes {\nroot { segment1 { start_extent = 0 extent_count = 1 type = "striped" stripe_count = 1 stripes = ["pv0", 1] } segment2 { start_extent = 1 extent_count = 1 type = "striped" stripe_count = 1 stripes = ["pv0", 0] } }\n}\n}\n'
    pv = b"ABCDEF0123456789ABCDEF0123456789" + struct.pack("<Q", 10240) + struct.pack("<4Q", 8192, 0, 0, 0) + struct.pack("<4Q", 4096, 2048, 0, 0)
    sector = pad({0: b"LABELONE", 8: struct.pack("<Q", 1), 20: struct.pack("<I", 32), 24: b"LVM2 001", 32: pv}, 512)
    crc = zlib.crc32(sector[20:], 0xF597A6CF ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    sector = sector[:16] + struct.pack("<I", crc) + sector[20:]
    area = pad({4: b" LVM2 x[5A%r0N*>", 32: struct.pack("<Q", 2048), 40: struct.pack("<QQ", 512, len(text)), 512: text}, 2048)
    return pad({512: sector, 4096: area, 8192: b"A" * 1024 + b"B" * 1024}, 10240)


# Executables and firmware ------------------------------------------------------------------------


def elf(wide: bool) -> bytes:
    if wide:
        return pad({0: b"\x7fELF\2\1\1", 16: le(2, 2), 18: le(62, 2), 20: le(1), 32: le(64, 8), 40: le(0, 8), 54: le(56, 2), 56: le(1, 2), 64: le(1), 72: le(0, 8), 96: le(400, 8)}, 400)
    return pad({0: b"\x7fELF\1\2\1", 16: be(2, 2), 18: be(8, 2), 20: be(1), 28: be(52), 32: be(0), 42: be(32, 2), 44: be(1, 2), 52: be(1), 56: be(0), 68: be(300)}, 300)


def kernel(initramfs: bytes | None = None) -> bytes:
    """An executable with a section of data for the start, at whose end are an archive and its size, as 64-bit little-endian files have."""
    archive = cpio() if initramfs is None else initramfs
    names = b"\0.init.data\0.shstrtab\0"
    data = b"i" * 32 + archive + bytes(-len(archive) % 8) + le(len(archive), 8)
    at = 64
    strings = at + len(data)
    table = strings + len(names) + -(strings + len(names)) % 8
    section = lambda name, kind, where, size: le(name) + le(kind) + le(0, 8) * 2 + le(where, 8) + le(size, 8) + bytes(24)
    head = pad({0: b"\x7fELF\2\1\1", 16: le(2, 2), 18: le(62, 2), 20: le(1), 40: le(table, 8), 52: le(64, 2), 54: le(56, 2), 58: le(64, 2), 60: le(3, 2), 62: le(2, 2)}, 64)
    return pad({0: head + data + names, table: section(0, 0, 0, 0) + section(1, 1, at, len(data)) + section(12, 3, strings, len(names))}, table + 3 * 64)


def engenius() -> bytes:
    return pad({32: be(180), 92: b"\x12\x34\x56xall"}, 180)


def alpha_v1() -> bytes:
    """For a device whose header opens with its own key: made by the cipher's inverse, which only the sample needs."""
    from bytelode.formats import alpha
    from bytelode.functions.codecs import aes_cbc_decrypt, aes_cbc_encrypt

    head, device, key, start = alpha.DEVICES[0]
    keys = alpha.masked(device, key), alpha.masked(device, start)
    first = aes_cbc_decrypt(bytes.fromhex(head), *keys)
    name = (b"signature=" + device).ljust(int.from_bytes(first[4:8], "big"), b"\0")
    plain = first[:12] + name + be(alpha.MAGIC) + bytes(4) + be(64)
    return aes_cbc_encrypt(plain.ljust(128, b"\0"), *keys) + bytes(range(64))


def squashfs(mark: bytes, version: int, big: bool, size: int = 2048) -> bytes:
    number = be if big else le
    where = {1: {8: number(size)}, 2: {8: number(size)}, 3: {63: number(size, 8)}, 4: {40: number(size, 8)}}[version]
    return pad({0: mark, 28: number(version, 2), **where}, size)


@lru_cache(maxsize=1)
def made() -> dict[str, bytes]:
    """name: a sample of the format, from its first byte to its last."""
    out = {
        "zip": zipped(), "tar": tarred(), "cpio_portable_ascii": cpio(), "cpio_portable_ascii_crc": cpio(b"070702"), "cpio_portable_old_ascii": cpio_old(), "cpio_binary": cpio_binary(), "ar": ar(), "arj": arj(), "arc": arc(), "rar": rar(False),
        "rpm": rpm(), "msi": msi(), "sevenzip": sevenzip(), "partclone": partclone(), "cab": pad({0: b"MSCF\0\0\0\0", 8: le(200)}, 200), "stuffit": pad({0: b"SIT!", 6: be(120), 10: b"rLau"}, 120), "stuffit5": pad({0: b"StuffIt (c)1997-", 84: be(130)}, 130),
        "dmg": b"d" * 700 + pad({0: b"koly\0\0\0\4\0\0\2\0", 32: be(700, 8)}, 512), "instar_hd": zipped().replace(b"PK\x03\x04", b"PK\x03\x07").replace(b"PK\x05\x06", b"PK\x05\x09").replace(b"PK\x01\x02", b"PK\x01\x08"),
        "gzip": gzip.compress(RAW, mtime=0) + gzip.compress(b"more", mtime=0), "bzip2": bz2.compress(RAW), "xz": lzma.compress(RAW) + b"\0" * 8, "lzma": lzma.compress(RAW, format=lzma.FORMAT_ALONE), "zstd": zstandard.compress(RAW), "zlib": zlib.compress(RAW),
        "lzo": lzo(), "lzip": lzip(), "lzh": lzh(), "lz4_legacy": lz4_legacy(), "lz4_skippable": b"\x50\x2a\x4d\x18" + le(9) + b"x" * 9, "lz4_default": b"\x04\x22\x4d\x18\x60\x40\x82" + le(4 | 1 << 31) + b"abcd" + le(0),
        "compress": lzw(LETTERS), "uzip": uzip(), "qca_lzma": qca_lzma(), "qnx_deflate": qnx(), "xalz": b"XALZ" + le(0) + le(17) + b"\x35abc\x03\x00\x50defgh",
        "romfs": romfs(), "cramfs": cramfs(), "btrfs_stream": btrfs(), "ubi": ubi(), "jffs2_new": jffs2(0x1985), "jffs2_old": jffs2(0x1984), "ufs1": ufs(False), "ufs2": ufs(True), "solaris_ufs1": ufs(False, True), "fat": fat(),
        "minix_fs_v1": minix(1), "minix_fs_v2": minix(2), "minix_fs_v3": minix(3), "yaffs": yaffs(), "minifs": minifs(), "iso9660": iso9660(), "lvm2": lvm2(), "ubifs": pad({0: b"\x31\x18\x10\x06", 20: b"\6\0\0\0", 36: le(100), 40: le(3)}, 300),
        "extfs": pad({0x404: le(8), 0x418: le(0), 0x438: b"\x53\xef\1\0\1\0"}, 8192), "erofs": pad({0x400: b"\xe2\xe1\xf5\xe0", 0x40C: b"\x0c", 0x418: le(9, 8), 0x424: le(2)}, 8192), "ntfs": pad({0: b"\xeb\x52\x90NTFS    ", 11: le(512, 2), 40: le(7, 8), 510: b"\x55\xaa"}, 4096),
        "squashfs_v1": squashfs(b"sqsh", 1, True), "squashfs_v2": squashfs(b"hsqs", 2, False), "squashfs_v2_nonstandard": squashfs(b"sqlz", 2, True), "squashfs_v3": squashfs(b"sqsh", 3, True), "squashfs_v3_ddwrt": squashfs(b"hsqt", 3, False),
        "squashfs_v3_broadcom": squashfs(b"shsq", 3, False), "squashfs_v3_nonstandard": squashfs(b"zlqs", 3, False), "squashfs_v4_le": squashfs(b"hsqs", 4, False), "squashfs_v4_be": squashfs(b"sqsh", 4, True), "squashfs_v4_broadcom": squashfs(b"shsq", 4, False),
        "elf32": elf(False), "elf64": elf(True), "macho": pad({0: b"\xca\xfe\xba\xbe", 4: be(1), 16: be(100), 20: be(60)}, 160), "moxa_frm": pad({0: b"*FRM\0\0\0\1", 8: le(150), 12: b"\x60\0\2\0"}, 150), "encrpted_img": b"encrpted_img" + be(64) + b"x" * 64,
        "bneg": pad({0: b"BNEG", 4: le(1), 8: le(1), 12: le(30), 16: le(40), 20: b"A" * 30 + b"B" * 40}, 90), "chk": pad({0: b"*#$^", 4: be(58), 24: be(30), 28: be(12), 40: b"U12H0000", 58: b"K" * 30 + b"R" * 12}, 100),
        "trx_v1": crc_at(pad({0: b"HDR0", 4: le(100), 14: le(1, 2), 16: le(28), 40: b"abc"}, 100), 8, 12, 100, True), "trx_v2": crc_at(pad({0: b"HDR0", 4: le(100), 14: le(2, 2), 16: le(32), 40: b"abc"}, 100), 8, 12, 100, True),
        "hdr1": crc_at(pad({0: b"HDR1", 4: le(48)}, 320), 8, 12, 320, True), "hdr2": crc_at(pad({0: b"HDR2", 4: le(80)}, 352), 8, 12, 352, True), "ecc": pad({0: b"ECC0101\0", 8: le(50), 12: le(32)}, 82),
        "sparse": le(0xED26FF3A) + pad({0: le(1, 2), 4: le(28, 2), 6: le(12, 2), 8: le(4096), 12: le(1), 16: le(1)}, 24) + le(0xCAC1, 2) + le(0, 2) + le(1) + le(4108) + b"s" * 4096,
        "deafbead": b"\xde\xaf\xbe\xad\x86\2\0ab\x87\1\0c" + le(3) + b"xyz", "shrs": pad({0: b"SHRS", 4: be(64), 156: hashlib.sha512(b"p" * 64).digest(), 1756: b"p" * 64}, 1820), "bdl": pad({0: b"ibdl\1\0\1\0", 8: le(1321), 16: le(1), 1321: le(1337, 8) + le(20, 8), 1337: b"E" * 20}, 1357),
        "ipkg": pad({0: b"ipkg\1\0\3\0", 8: le(1056), 16: le(1), 1056: le(1072, 8) + le(20, 8), 1072: b"E" * 20}, 1092), "airoha": pad({240: b"\xff" * 16 + b"\x11\0\x0a\0\0\0", 262: le(300) + le(20), 300: b"locked" * 3}, 320),
        "qnap_nas": b"\xf5\x7b\x47\x03" + b"e" * 60 + pad({0: b"icpnas", 6: le(60), 10: b"TS-1", 26: b"4.0"}, 74), "qnap_networking": b"e" * 80 + pad({0: b"icpnas", 6: le(60), 10: b"QSW-1"}, 74), "engenius": engenius(),
        "alpha_encimg_v1": alpha_v1(), "alpha_encimg_v2": pad({0: b"wapnd", 32: b"\x21\x03\x08\x20\x21\x03\x08\x20", 104: le(32)}, 160) + bytes(range(32, 64)),
        "fpkg": pad({0: b"CPKG\1\0\0\0", 8: be(12), 12: be(28), 20: be(10), 24: b"name", 40: b"F" * 10}, 50),
    }
    out["sbfh"] = b"SBFH\x1c\1\0\0" + bytes(7) + le(60) + bytes(265) + b"MRVL\x7b\xf1\x9c\x2e" + bytes(4) + b"\1\0\0\0" + bytes(2) + b"\0\x1f" + bytes(40)
    return out


#: Found only at the start of a file, only at its end, or only as the whole of one.
AT_START = frozenset({"zlib", "xalz", "dmg", "iso9660", "yaffs", "qnap_networking", "compress"})
AT_END = frozenset({"xalz", "qnap_networking", "compress"})
HEAD, TAIL = b"\x11" * 24, b"\x11trailing bytes of something else"
#: What stands before a sample, where its pattern begins there.
BEFORE = {"qca_lzma": HEAD + le(0) + le(7)}


def around(name: str) -> tuple[bytes, bytes]:
    """What may stand before and after a sample in a file."""
    return b"" if name in AT_START else BEFORE.get(name, HEAD), b"" if name in AT_END else TAIL
