"""Codecs, unpackers that are made of them, sinks, and the command line."""

import json
import lzma
import struct

import pytest

from bytelode.__main__ import main
from bytelode.functions import codecs
from bytelode.operators import extract
from bytelode.sources import sinks
from test_formats import pad, zipped


def test_aes():
    """The published example of CBC mode with a key of 128 bits, and of 256."""
    iv, plain = bytes(range(16)), bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    for key, cipher in (
        ("2b7e151628aed2a6abf7158809cf4f3c", "7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2"),
        ("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4", "f58c4c04d6e5f1ba779eabfb5f7bfbd69cfc4e967edb808d679f777bc6702c7d"),
    ):
        assert codecs.aes_cbc_decrypt(bytes.fromhex(cipher), bytes.fromhex(key), iv) == plain
    with pytest.raises(ValueError):
        codecs.aes_cbc_decrypt(b"123", b"k" * 16, iv)


def test_lz4():
    assert codecs.lz4_block(b"\x35abc\x03\x00\x50defgh", 100) == b"abcabcabcabc" + b"defgh"
    assert codecs.lz4_block(b"\xf0\x03" + b"x" * 18, 100) == b"x" * 18
    with pytest.raises(ValueError):
        codecs.lz4_block(b"\x10a\x05\x00\x00", 100)
    data = b"XALZ" + bytes(4) + struct.pack("<I", 17) + b"\x35abc\x03\x00\x50defgh"
    assert [e.content for e in extract.unpack(data, "xalz")] == [b"abcabcabcabcdefgh"]


def test_minifs():
    body = b"first file" + b"second"
    packed = lzma.compress(body, format=lzma.FORMAT_ALONE)
    names = b"dir\0a\0b\0"
    data = pad({0: b"MINIFS", 16: b"\0\0\0\3", 20: struct.pack(">III", 2, 0, len(names))}, 32) + names
    data += struct.pack(">5I", 0, 6, 0, 10, 6) + struct.pack(">5I", 0, 4, 0, 0, 10) + struct.pack(">3I", 0, len(packed), len(body)) + packed
    assert [(e.path, e.content) for e in extract.unpack(data, "minifs")] == [("dir/a", b"first file"), ("dir/b", b"second")]


def test_minix():
    def inode(mode, size, zones):
        return struct.pack("<HHIIBB9H", mode, 0, size, 0, 0, 1, *(zones + [0] * (9 - len(zones))))

    entry = lambda n, name: struct.pack("<H14s", n, name)
    sb = struct.pack("<HHHHHHIHH", 32, 12, 1, 1, 5, 0, 268966912, 0x137F, 1)
    inodes = inode(0o40755, 64, [5]) + inode(0o100644, 1500, [6, 7]) + inode(0o120777, 4, [8])
    root = entry(1, b".") + entry(1, b"..") + entry(2, b"file") + entry(3, b"link")
    data = pad({0x400: sb, 4 * 1024: inodes, 5 * 1024: root, 6 * 1024: b"x" * 1500, 8 * 1024: b"file"}, 12 * 1024)
    assert [(e.path, e.type, e.content, e.link_target) for e in extract.unpack(data, "minix_fs_v1")] == [("file", "file", b"x" * 1500, None), ("link", "link", None, "file")]


def test_ciphers():
    assert [len(e.content) for e in extract.unpack(b"encrpted_img" + bytes(4) + b"c" * 64, "encrpted_img")] == [64]
    key = extract.ENGENIUS_KEY
    head = pad({132: struct.pack(">I", 4), 136: b"mode"}, 140)
    plain = bytes(range(50)) + bytes(16)
    out = next(extract.unpack(head + bytes(a ^ b for a, b in zip(plain, key * 10)), "engenius")).content
    assert out == plain
    theirs = zipped().replace(b"PK\x03\x04", b"PK\x03\x07").replace(b"PK\x05\x06", b"PK\x05\x09").replace(b"PK\x01\x02", b"PK\x01\x08")
    assert next(extract.unpack(theirs, "instar_hd")).content == zipped()


def test_sinks(spark, tmp_path):
    files = spark.createDataFrame([("f", 10, bytearray(b"0123456789")), ("w", 3, bytearray(b"abc"))], "file_id string, length long, content binary")
    chunks = spark.createDataFrame([("f", "zip", 2, 5), ("w", "zip", 0, 3)], "file_id string, handler string, start long, end long")
    sinks.write_files(sinks.carved(chunks, files), str(tmp_path))
    assert [p.name for p in tmp_path.rglob("*.zip")] == ["2-5.zip"] and (tmp_path / "f_extract" / "2-5.zip").read_bytes() == b"234"
    sinks.write_files(sinks.carved(chunks, files), str(tmp_path))
    with pytest.raises(Exception, match="FileExistsError"):
        sinks.write_files(spark.createDataFrame([("f_extract/2-5.zip", bytearray(b"other"))], "path string, content binary"), str(tmp_path))
    with pytest.raises(Exception, match="leaves the folder"):
        sinks.write_files(spark.createDataFrame([("../x", bytearray(b"x"))], "path string, content binary"), str(tmp_path))
    rows = spark.createDataFrame([("zip", 0, 5, 5, 1), ("zip", 0, 5, 5, 0), ("tar", 0, 5, 5, 1), ("zip", 1, 5, 5, 1)], "handler string, start long, end long, length long, depth int")
    assert [r[0] for r in rows.select(sinks.deleted(rows, ("zip",))).collect()] == [True, False, False, False]
    assert [r[0] for r in rows.select(sinks.deleted(rows, "all")).collect()] == [True, False, True, False]
    assert not any(r[0] for r in rows.select(sinks.deleted(rows)).collect())


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.bin").write_bytes(b"junk" + zipped() + b"tail")
    code = main([str(tmp_path / "in"), "--work", str(tmp_path / "work"), "--report", str(tmp_path / "report"), "--extract-dir", str(tmp_path / "out")], spark)
    assert code == 0 and "zip" in capsys.readouterr().out
    kinds = {json.loads(line)["__typename__"] for p in (tmp_path / "report").glob("*.txt") for line in p.read_text().splitlines()}
    assert kinds == {"StatReport", "HashReport", "FileMagicReport", "ChunkReport", "UnknownChunkReport", "CarveDirectoryReport"}
    assert [p.read_bytes() for p in (tmp_path / "out").rglob("a.txt")] == [b"hello " * 50]
    assert main(["--show-external-dependencies"], spark) == 0 and "7z" in capsys.readouterr().out


def test_blobs():
    blob = struct.pack("<III", 0xBABE, 0, 5) + bytes(4) + b"name.bin".ljust(32, b"\0") + b"12345"
    data = pad({0: b"HDR1", 16: struct.pack("<8I", 64, 200, *[0] * 6), 64: blob, 200: blob.replace(b"name", b"more")}, 300)
    assert [(e.path, e.content) for e in extract.unpack(data, "hdr1")] == [("name.bin", b"12345"), ("more.bin", b"12345")]


def test_send_stream():
    from bytelode.operators import streams

    def command(kind, *attributes, bad=False):
        body = b"".join(struct.pack("<HH", k, len(v)) + v for k, v in attributes)
        crc = streams.crc32c(struct.pack("<IHI", len(body), kind, 0) + body)
        return struct.pack("<IHI", len(body), kind, crc ^ bad) + body

    n = lambda x: struct.pack("<Q", x)
    data = b"btrfs-stream\0" + struct.pack("<I", 1) + b"".join([
        command(1, (15, b"vol")), command(4, (15, b"o1")), command(9, (15, b"o1"), (16, b"dir")), command(3, (15, b"o2")), command(15, (15, b"o2"), (18, n(2)), (19, b"hello")), command(9, (15, b"o2"), (16, b"dir/f")),
        command(17, (15, b"dir/f"), (4, n(6))), command(8, (15, b"l"), (17, b"dir/f")), command(3, (15, b"gone")), command(11, (15, b"gone")), command(3, (15, b"c")), command(16, (15, b"c"), (18, n(0)), (22, b"dir/f"), (23, n(2)), (24, n(3))),
        command(15, (15, b"c"), (18, n(0)), (19, b"XXX"), bad=True), command(18, (15, b"c"), (5, n(0o600))), command(15, (15, b"none"), (18, n(0)), (19, b"x")), command(21),
    ])
    assert streams.crc32c(b"123456789", 0xFFFFFFFF) ^ 0xFFFFFFFF == 0xE3069283
    got = list(extract.unpack(data, "btrfs_stream"))
    assert {(e.path, e.content) for e in got if e.content is not None} == {("dir/f", b"\0\0hell"), ("c", b"hel")}
    assert [e.link_target for e in got if e.type == "link"] == ["dir/f"] and sum(e.problem is not None for e in got) == 2
    assert [r[:3] for r in __import__("bytelode.operators.scan", fromlist=["scanner"]).scanner().search(data + b"tail") if r[0] == "btrfs_stream"] == [("btrfs_stream", 0, len(data))]


@pytest.mark.parametrize("second, solaris", [(False, False), (True, False), (False, True)])
def test_ufs(second, solaris):
    sb, width, fragment, block = (0x10000 if second else 0x2000), (256 if second else 128), 1024, 4096
    inodes = 100 if second else 40

    def inode(mode, size, pointers):
        head = struct.pack("<H", mode)
        at = (16, 112, "Q") if second else (8, 40, "I")
        body = pointers if isinstance(pointers, bytes) else struct.pack(f"<{len(pointers)}{at[2]}", *pointers)
        return pad({0: head, at[0]: struct.pack("<Q", size), at[1]: body}, width)

    def entry(number, name, step):
        return pad({0: struct.pack("<IH", number, step), 6: struct.pack("<H", len(name)) if solaris else bytes([0, len(name)]), 8: name}, step)

    folder = entry(2, b".", 12) + entry(2, b"..", 12) + entry(3, b"file", 16) + entry(4, b"sub", 16) + entry(5, b"link", 456)
    inner = entry(4, b".", 12) + entry(4, b"self", 500)
    big = b"".join(bytes([i]) * block for i in range(14))  # twelve direct blocks, and two by an indirect one
    base = 200
    table = [bytes(width)] * 2 + [inode(0o40755, 512, [base]), inode(0o100644, len(big), [base + 8 + 4 * i for i in range(12)] + [base + 4]), inode(0o40700, 512, [base + 1]), inode(0o120777, 4, b"file")]
    step = 8 if second else 4
    indirect = b"".join((base + 8 + 4 * i).to_bytes(step, "little") for i in (12, 13))
    fields = {16: inodes, 44: 1, 48: block, 52: fragment, 56: 4, 184: 64, 188: 1000}
    data = pad({**{sb + k: struct.pack("<I", v) for k, v in fields.items()}, inodes * fragment: b"".join(table), base * fragment: folder, (base + 1) * fragment: inner, (base + 4) * fragment: indirect, (base + 8) * fragment: big}, (base + 80) * fragment)
    got = list(extract.unpack(data, "ufs2" if second else "solaris_ufs1" if solaris else "ufs1"))
    assert [(e.path, e.type) for e in got] == [("file", "file"), ("sub", "dir"), ("sub/self", "dir"), ("link", "link")]
    assert got[0].content == big and got[3].link_target == "file"


def test_lvm():
    import zlib

    text = """vg {
id = "x" # a comment
extent_size = 2
physical_volumes { pv0 { id = "ABCDEF-0123-4567-89AB-CDEF-0123-456789" pe_start = 16 } pv1 { id = "other" pe_start = 16 } }
logical_volumes {
root { segment1 { start_extent = 0 extent_count = 1 type = "striped" stripe_count = 1 stripes = ["pv0", 1] } segment2 { start_extent = 1 extent_count = 1 type = "striped" stripe_count = 1 stripes = ["pv0", 0] } }
bad { segment1 { start_extent = 0 extent_count = 1 type = "mirror" } segment2 { start_extent = 1 extent_count = 1 type = "striped" stripe_count = 1 stripes = ["pv1", 0] } }
}
}
"""
    raw = text.encode()
    pv = b"ABCDEF0123456789ABCDEF0123456789" + struct.pack("<Q", 10240) + struct.pack("<4Q", 8192, 0, 0, 0) + struct.pack("<4Q", 4096, 2048, 0, 0)
    sector = pad({0: b"LABELONE", 8: struct.pack("<Q", 1), 20: struct.pack("<I", 32), 24: b"LVM2 001", 32: pv}, 512)
    crc = zlib.crc32(sector[20:], 0xF597A6CF ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    sector = sector[:16] + struct.pack("<I", crc) + sector[20:]
    cut = 200  # the text goes round the end of its area
    area = pad({4: b" LVM2 x[5A%r0N*>", 24: struct.pack("<QQQ", 4096, 2048, 0)[:0], 32: struct.pack("<Q", 2048), 40: struct.pack("<QQ", 2048 - cut, len(raw)), 512: raw[cut:], 2048 - cut: raw[:cut]}, 2048)
    data = pad({512: sector, 4096: area, 8192: b"A" * 1024 + b"B" * 1024}, 10240)
    got = {e.path: e for e in extract.unpack(data, "lvm2")}
    assert got["root.img"].content == b"B" * 1024 + b"A" * 1024 and got["root.img"].problem is None
    assert got["bad.img"].content == bytes(2048) and "mirror" in got["bad.img"].problem and "pv1" in got["bad.img"].problem
    from bytelode.operators.scan import scanner

    assert [r[:3] for r in scanner().search(data) if r[0] == "lvm2"] == [("lvm2", 0, 10240)]


def test_airoha():
    packed = lzma.compress(b"firmware" * 40, format=lzma.FORMAT_ALONE)
    for body, name, content in ((packed, "firmware.bin", b"firmware" * 40), (b"locked..", "firmware.encrypted", b"locked..")):
        data = pad({262: struct.pack("<II", 300, len(body)), 300: body}, 300 + len(body))
        assert [(e.path, e.content) for e in extract.unpack(data, "airoha")] == [(name, content)]


def test_moxa():
    import gzip

    packed = gzip.compress(b"page")
    row = lambda name, size, at: name.ljust(56, b"\0") + struct.pack("<II", size, at)
    files = pad({48: struct.pack("<I", 0x100), 56: struct.pack("<HH", 64, 2), 0x100: row(b"a.htm", 5, 0x200) + row(b"b.htm", len(packed), 0x210), 0x200: b"plain", 0x210: packed}, 0x300)
    data = pad({0: b"*FRM", 14: struct.pack("<H", 2), 64: struct.pack("<8I", 2, 0x60, len(files), 0, 1, 0x400, 8, 0), 0x60: files, 0x400: b"firmware"}, 0x408)
    assert [(e.path, e.content) for e in extract.unpack(data, "moxa_frm")] == [("a.htm", b"plain"), ("b.htm", b"page"), ("firmware.bin", b"firmware")]


@pytest.mark.parametrize("order, at", [("<", 0), ("<", 2), (">", 0)])
def test_yaffs(order, at):
    def page(body, sequence, number, chunk, size):
        return body.ljust(2048, b"\xff") + (b"\xff" * at + struct.pack(order + "4I", sequence, number, chunk, size)).ljust(64, b"\xff")

    def head(kind, parent, name, size=0, target=b"", same=0):
        return pad({0: struct.pack(order + "II", kind, parent), 8: b"\xff\xff", 10: name, 268: struct.pack(order + "I", 0o100640), 292: struct.pack(order + "II", size, same), 300: target}, 512)

    data = b"".join([
        page(head(3, 1, b"dir"), 0x1001, 257, 0, 0xFFFF), page(head(1, 257, b"file", 0), 0x1001, 258, 0, 0xFFFF), page(b"old" * 600, 0x1001, 258, 1, 1800), page(b"a" * 2048, 0x1001, 258, 1, 2048),
        page(b"b" * 100, 0x1001, 258, 2, 100), page(head(1, 257, b"file", 2148), 0x1001, 258, 0, 0xFFFF), page(head(2, 1, b"link", target=b"dir/file"), 0x1002, 259, 0, 0xFFFF),
        page(head(1, 3, b"gone", 0), 0x1002, 260, 0, 0xFFFF), page(head(4, 1, b"hard", same=258), 0x1002, 261, 0, 0xFFFF),
    ])
    got = [(e.path, e.type, e.content, e.link_target) for e in extract.unpack(data, "yaffs")]
    assert got == [("dir", "dir", None, None), ("dir/file", "file", b"a" * 2048 + b"b" * 100, None), ("link", "link", None, "dir/file"), ("hard", "hardlink", None, "dir/file")]
    assert [e.severity for e in extract.unpack(b"\3\0\0\0\1\0\0\0\xff\xff" + bytes(5000), "yaffs")] == ["ERROR"]
