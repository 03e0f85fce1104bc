"""The rest of the formats, on what is made here."""

import lzma
import random
import struct
import zlib

import pytest

from bytelode.operators.scan import scanner
from test_formats import RAW, be, crc_at, le, pad, zipped


def ubi(blocks=4, size=4096):
    return b"".join(pad({0: b"UBI#\x01", 100: bytes([i])}, size) for i in range(blocks))


def jffs2(mark):
    def node(kind, body):
        head = le(mark, 2) + le(kind, 2) + le(12 + len(body))
        return head + le((zlib.crc32(head, 0xFFFFFFFF) ^ 0xFFFFFFFF) & 0xFFFFFFFF) + body

    return node(0xE001, b"x" * 28) + node(0xE002, b"y" * 56) + node(0x2003, b"")


def ufs(second):
    sb = 0x10000 if second else 0x2000
    out = {sb + 44: le(4), sb + 48: le(8192), sb + 52: le(1024), sb + 56: le(8), sb + 0x55C: le(0x19540119 if second else 0x00011954)}
    out |= {sb + 1080: le(90, 8)} if second else {sb + 36: le(40)}
    if second:
        return pad(out | {sb + 0x55C: b"\x19\x01\x54\x19", sb + 0x560: b"\0"}, 90 * 1024)
    return pad(out | {sb + 0x550: b"\1\0\0\0"}, 40 * 1024)


def arj():
    def block(body):
        return b"\x60\xea" + le(len(body), 2) + body + le(zlib.crc32(body)) + le(0, 2)

    main = block(pad({0: bytes([30]), 1: b"\x0b\x01\x02\x10"}, 34))
    entry = block(pad({0: bytes([30]), 12: le(10)}, 40)) + b"d" * 10
    return main + entry + b"\x60\xea\0\0"


def arc():
    entry = b"\x1a\x02" + b"file.txt".ljust(13, b"\0") + le(20) + le(0) + le(0, 2) + le(20)
    return entry + b"z" * 20 + b"\x1a\0"


def lzh():
    return pad({0: bytes([25]), 2: b"-lh5-", 7: le(40), 20: b"\1"}, 27) + b"q" * 40


def rpm():
    def header(tags):
        return b"\x8e\xad\xe8\1" + bytes(4) + be(len(tags)) + be(4 * len(tags)) + b"".join(be(t) + be(4) + be(4 * i) + be(1) for i, (t, _) in enumerate(tags)) + b"".join(be(v) for _, v in tags)

    lead = pad({0: b"\xed\xab\xee\xdb\3\0\0\0\0\1", 76: b"\0\1\0\5"}, 96)
    main = header([(1004, 5)])
    body = main + b"payload" * 9
    signature = header([(1000, len(body))])
    return lead + signature + bytes(-(96 + len(signature)) % 8) + body


def fat():
    return pad({0: b"\xeb\x3c\x90", 11: le(512, 2), 13: b"\1", 14: le(1, 2), 16: b"\2", 17: le(16, 2), 19: le(100, 2), 21: b"\xf8", 22: le(1, 2), 510: b"\x55\xaa"}, 51200)


def qnx():
    block = lambda step: le(0, 2) + le(step, 2) + le(10, 2) + le(20, 2)
    return b"iwlyfmbp" + le(40) + le(4096, 2) + b"\0" + b"\0" + block(24) + b"c" * 16 + block(0)


def partclone():
    head = pad({0: b"partclone-image\0", 16: b"0.3.13", 30: b"0002", 34: b"\xde\xc0", 60: le(16, 8), 76: le(3, 8), 84: le(512), 96: le(1, 2), 98: le(4, 2), 100: le(2)}, 106)
    head += le(zlib.crc32(head) ^ 0xFFFFFFFF)
    return head + b"\xff\xff" + bytes(4) + bytes(2 * 4) + b"b" * 3 * 512  # bitmap, its checksum, the blocks' checksums, blocks


def msi():
    free, mark = 0xFFFFFFFF, 0xFFFFFFFD
    table = [mark, 0xFFFFFFFE, 3, 0xFFFFFFFE] + [free] * 124
    head = pad({0: b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 30: le(9, 2), 44: le(1), 68: le(0xFFFFFFFE), 72: le(0), 76: le(0) + le(free) * 108}, 512)
    return head + struct.pack("<128I", *table) + b"s" * 3 * 512


def lzw(data):
    """As the usual program writes it: codes of 9 bits on, cleared never."""
    table, bits, free, codes = {bytes([i]): i for i in range(256)}, 9, 257, []
    w = b""
    for c in data:
        if w + bytes([c]) in table:
            w += bytes([c])
            continue
        codes.append((table[w], bits))
        if free < 1 << 12:
            table[w + bytes([c])] = free
            free += 1
        w = bytes([c])
    codes.append((table[w], bits))
    assert free <= 512  # the width never changes in what is made here
    acc = 0
    for i, (code, n) in enumerate(codes):
        acc |= code << 9 * i
    return b"\x1f\x9d\x8c" + acc.to_bytes(-(-9 * len(codes) // 8), "little")


def lz4_legacy():
    block = bytes([0xF0, 5]) + b"x" * 20
    return b"\x02\x21\x4c\x18" + le(len(block)) + block


def qca():
    raw = lzma.compress(RAW, format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 20}])
    return raw


def elf32():
    return pad({0: b"\x7fELF\1\2\1", 16: be(2, 2), 18: be(8, 2), 20: be(1), 28: be(52), 32: be(0), 42: be(32, 2), 44: be(1, 2), 52: be(1), 56: be(0), 68: be(300)}, 300)


def macho():
    return pad({0: b"\xcf\xfa\xed\xfe", 16: le(1), 20: le(72), 32: le(0x19) + le(72), 72: le(100, 8) + le(200, 8)}, 300)


def cpio_old():
    entry = lambda name, data, mode: b"070707" + b"000001" * 2 + b"%06o" % mode + b"000000" * 4 + b"%011o" % 0 + b"%06o" % (len(name) + 1) + b"%011o" % len(data) + name + b"\0" + data
    out = entry(b"a.txt", b"12345", 0o100644) + entry(b"TRAILER!!!", b"", 0)
    return out + bytes(-len(out) % 512)


def cpio_binary():
    def entry(name, data, mode):
        head = b"\xc7\x71" + le(1, 2) * 2 + le(mode, 2) + le(0, 2) * 6 + le(len(name) + 1, 2) + le(len(data) >> 16, 2) + le(len(data) & 0xFFFF, 2)
        out = head + name + b"\0"
        out += bytes(len(out) % 2) + data
        return out + bytes(len(out) % 2)

    out = entry(b"a.txt", b"12345", 0o100644) + entry(b"TRAILER!!!", b"", 0)
    return out + bytes(-len(out) % 512)


def minix(version):
    if version == 2:
        sb = le(32, 2) + le(0, 2) + le(1, 2) + le(1, 2) + le(5, 2) + le(0, 2) + le(1 << 20) + le(0x2468, 2) + le(1, 2) + le(10)
    else:
        sb = le(32) + le(0, 2) + le(1, 2) + le(1, 2) + le(5, 2) + le(0, 2) + le(0, 2) + le(1 << 20) + le(10) + le(0x4D5A, 2) + le(0, 2) + le(1024, 2) + b"\0"
    return pad({0x400: sb}, 10240)


def yaffs():
    header = lambda kind, parent, size: pad({0: le(kind) + le(parent) + b"\xff\xff" + b"name", 292: le(size)}, 2048) + b"\xff" * 64
    return header(3, 1, 0xFFFFFFFF) + header(1, 1, 3000) + (b"d" * 2048 + b"\xff" * 64) * 2 + header(3, 1, 0xFFFFFFFF)


MADE = {
    "ubi": ubi(), "jffs2_new": jffs2(0x1985), "jffs2_old": jffs2(0x1984), "ufs1": ufs(False), "ufs2": ufs(True), "arj": arj(), "arc": arc(), "lzh": lzh(), "rpm": rpm(), "fat": fat(), "qnx_deflate": qnx(), "partclone": partclone(),
    "msi": msi(), "compress": lzw(random.Random(1).choices(range(97, 101), k=400)), "lz4_legacy": lz4_legacy(), "elf32": elf32(), "macho": macho(), "cpio_portable_old_ascii": cpio_old(), "cpio_binary": cpio_binary(),
    "minix_fs_v2": minix(2), "minix_fs_v3": minix(3), "yaffs": yaffs(), "trx_v2": crc_at(pad({0: b"HDR0", 4: le(100), 14: le(2, 2), 40: b"abc"}, 100), 8, 12, 100, True),
    "hdr2": crc_at(pad({0: b"HDR2", 4: le(80)}, 352), 8, 12, 352, True), "ipkg": pad({0: b"ipkg\1\0\3\0", 8: le(1056), 16: le(1), 1056: le(1072, 8) + le(20, 8)}, 1092),
    "minifs": b"MINIFS" + bytes(13) + b"\3" + struct.pack(">III", 1, 0, 4) + b"d\0f\0" + struct.pack(">5I", 0, 2, 0, 0, 9) + struct.pack(">3I", 0, 9, 9) + b"c" * 9,
    "instar_hd": zipped().replace(b"PK\x03\x04", b"PK\x03\x07").replace(b"PK\x05\x06", b"PK\x05\x09").replace(b"PK\x01\x02", b"PK\x01\x08"),
    "squashfs_v1": pad({0: b"sqsh", 28: be(1, 2), 8: be(3000)}, 3000) + bytes(72 + 1024), "squashfs_v2": pad({0: b"hsqs", 28: le(2, 2), 8: le(1024)}, 1024),
    "squashfs_v2_nonstandard": pad({0: b"sqlz", 28: be(2, 2), 8: be(1024)}, 1024), "squashfs_v3_ddwrt": pad({0: b"hsqt", 28: le(3, 2), 63: le(1024, 8)}, 1024), "squashfs_v3_broadcom": pad({0: b"shsq", 28: le(3, 2), 63: le(1024, 8)}, 1024),
    "squashfs_v3_nonstandard": pad({0: b"zlqs", 28: le(3, 2), 63: le(1024, 8)}, 1024), "squashfs_v4_be": pad({0: b"sqsh", 28: be(4, 2), 40: be(1024, 8)}, 1024), "squashfs_v4_broadcom": pad({0: b"shsq", 28: le(4, 2), 40: le(1024, 8)}, 1024),
}
MADE["sbfh"] = b"SBFH\x1c\1\0\0" + bytes(7) + le(60) + bytes(265) + b"MRVL\x7b\xf1\x9c\x2e" + bytes(4) + b"\1\0\0\0" + bytes(2) + b"\0\x1f" + bytes(40)
WHOLE_ONLY = {"compress"}


@pytest.mark.parametrize("name", sorted(MADE))
def test_found(name):
    head = b"" if name == "yaffs" else b"\x11" * 24
    tail = b"" if name in WHOLE_ONLY else b"\x11trailing bytes of something else"
    found = [r for r in scanner((name,)).search(head + MADE[name] + tail)]
    assert found and found[0][:3] == (name, len(head), len(head) + len(MADE[name])), (found, len(MADE[name]))


def test_raw_lzma_behind_its_header():
    packed = qca()
    data = b"....." + le(0) + le(7) + b"\3\0\2\0\0\x10\0\0" + le(len(packed)) + le(len(RAW)) + packed
    found = scanner(("qca_lzma",)).search(data)
    assert all(r[4] != "ERROR" for r in found)


def test_footer_at_the_end():
    data = b"e" * 80 + pad({0: b"icpnas", 6: le(60), 10: b"QSW-1"}, 74)
    assert [r[:3] for r in scanner(("qnap_networking",)).search(data)] == [("qnap_networking", 0, len(data))]


def test_solaris():
    sb = 0x2000
    data = pad({sb + 36: le(40), sb + 44: le(4), sb + 48: le(8192), sb + 52: le(1024), sb + 56: le(8), sb + 0x550: b"\x08\0\0\0", sb + 0x55C: b"\x54\x19\1\0"}, 40960)
    assert [r[:3] for r in scanner(("solaris_ufs1",)).search(data)] == [("solaris_ufs1", 0, 40960)]
