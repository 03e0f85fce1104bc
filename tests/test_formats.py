"""Each format on what is made here: found where it is, with its exact range, and not where a check fails."""

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

import pytest
import zstandard

from bytelode.formats import FORMATS, alpha
from bytelode.functions.codecs import aes_cbc_decrypt
from bytelode.operators.scan import scanner

RAW = random.Random(5).randbytes(3000) + b"abc" * 2000


def pad(fields: dict[int, bytes], size: int) -> bytes:
    out = bytearray(size)
    for at, value in fields.items():
        out[at : at + len(value)] = value
    return bytes(out)


def le(x, n=4):
    return x.to_bytes(n, "little")


def be(x, n=4):
    return x.to_bytes(n, "big")


def zipped(encrypted=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("a.txt", "hello " * 50)
        f.comment = b"a comment"
    return out.getvalue()


def tarred():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as f:
        i = tarfile.TarInfo("a.txt")
        i.size = 5
        f.addfile(i, io.BytesIO(b"12345"))
    return out.getvalue()


def cpio(mark=b"070701"):
    def entry(name, data, mode=0o100644):
        head = mark + b"".join(b"%08X" % x for x in (1, mode, 0, 0, 1, 0, len(data), 0, 0, 0, 0, len(name) + 1, sum(data) if mark == b"070702" else 0))
        out = head + name + b"\0"
        out += b"\0" * (-len(out) % 4) + data
        return out + b"\0" * (-len(out) % 4)

    out = entry(b"a.txt", b"12345") + entry(b"TRAILER!!!", b"", 0)
    return out + b"\0" * (-len(out) % 512)


def ar():
    return b"!<arch>\n" + b"a.txt/".ljust(16) + b"0".ljust(12) + b"0".ljust(6) * 2 + b"644".ljust(8) + b"6".ljust(10) + b"`\n" + b"123456"


def crc_at(body: bytes, at: int, start: int, end: int, invert: bool) -> bytes:
    crc = zlib.crc32(body[start:end]) ^ (0xFFFFFFFF if invert else 0)
    return body[:at] + le(crc) + body[at + 4 :]


def romfs():
    body = bytearray(pad({0: b"-rom1fs-", 8: be(512), 16: b"vol"}, 512))
    total = -sum(struct.unpack(">128I", body)) & 0xFFFFFFFF
    body[12:16] = be(total)
    return bytes(body) + b"\0" * 512


def sevenzip():
    return crc_at(pad({0: b"7z\xbc\xaf\x27\x1c", 12: le(100, 8), 20: le(20, 8)}, 152), 8, 12, 32, False)


def cramfs():
    body = pad({0: le(0x28CD3D45), 4: le(4096), 8: le(1), 16: b"Compressed ROMFS", 100: b"data"}, 4096)
    return body[:32] + le(zlib.crc32(body)) + body[36:]


def btrfs():
    return b"btrfs-stream\0\1\0\0\0" + le(4) + le(1, 2) + le(0) + b"abcd" + le(0) + le(21, 2) + le(0)


def lzo():
    head = b"\x89LZO\0\r\n\x1a\n" + be(0x1030, 2) + be(0x2080, 2) + be(0x0940, 2) + b"\1" + b"\5" + be(1) + be(0o100644) + be(0) + be(0) + b"\0"
    return head + be(zlib.adler32(head[9:])) + be(4) + be(4) + be(zlib.adler32(b"abcd")) + b"abcd" + be(0)


MADE = {
    "zip": zipped(), "tar": tarred(), "gzip": gzip.compress(RAW) + gzip.compress(b"more"), "bzip2": bz2.compress(RAW), "xz": lzma.compress(RAW) + b"\0" * 8, "lzma": lzma.compress(RAW, format=lzma.FORMAT_ALONE),
    "zstd": zstandard.compress(RAW), "cpio_portable_ascii": cpio(), "cpio_portable_ascii_crc": cpio(b"070702"), "ar": ar(), "romfs": romfs(), "sevenzip": sevenzip(), "cramfs": cramfs(), "btrfs_stream": btrfs(), "lzo": lzo(),
    "cab": pad({0: b"MSCF\0\0\0\0", 8: le(200)}, 200), "moxa_frm": pad({0: b"*FRM\0\0\0\1", 8: le(150), 12: b"\x60\0\2\0"}, 150), "encrpted_img": b"encrpted_img" + be(64) + b"x" * 64,
    "bneg": pad({0: b"BNEG", 4: le(1), 8: le(1), 12: le(30), 16: le(40)}, 90), "stuffit": pad({0: b"SIT!", 6: be(120), 10: b"rLau"}, 120), "stuffit5": pad({0: b"StuffIt (c)1997-", 84: be(130)}, 130),
    "chk": pad({0: b"*#$^", 4: be(58), 24: be(30), 28: be(12), 40: b"U12H0000"}, 100), "trx_v1": crc_at(pad({0: b"HDR0", 4: le(100), 14: le(1, 2), 40: b"abc"}, 100), 8, 12, 100, True),
    "hdr1": crc_at(pad({0: b"HDR1", 4: le(48)}, 320), 8, 12, 320, True), "ecc": pad({0: b"ECC0101\0", 8: le(50), 12: le(32)}, 82), "sparse": le(0xED26FF3A) + pad({0: le(1, 2), 4: le(28, 2), 6: le(12, 2), 16: le(1)}, 24) + le(0xCAC1, 2) + le(0, 2) + le(1) + le(20) + b"x" * 8,
    "lz4_skippable": b"\x50\x2a\x4d\x18" + le(9) + b"x" * 9, "lz4_default": b"\x04\x22\x4d\x18\x60\x40\x82" + le(4 | 1 << 31) + b"abcd" + le(0), "ntfs": pad({0: b"\xeb\x52\x90NTFS    ", 11: le(512, 2), 40: le(7, 8), 510: b"\x55\xaa"}, 4096),
    "squashfs_v4_le": pad({0: b"hsqs", 28: le(4, 2), 40: le(5000, 8)}, 5000) + b"\0" * 3192, "squashfs_v3": pad({0: b"sqsh", 28: be(3, 2), 63: be(2000, 8)}, 2000) + b"\0" * 48, "ubifs": pad({0: b"\x31\x18\x10\x06", 20: b"\6\0\0\0", 36: le(100), 40: le(3)}, 300),
    "deafbead": b"\xde\xaf\xbe\xad\x86\2\0ab\x87\1\0c" + le(3) + b"xyz", "erofs": pad({0x400: b"\xe2\xe1\xf5\xe0", 0x40C: b"\x0c", 0x418: le(9, 8), 0x424: le(2)}, 8192), "xalz": b"XALZ" + le(0) + le(10) + b"x" * 20, "zlib": zlib.compress(RAW),
    "minix_fs_v1": pad({0x400: le(32, 2) + le(10, 2) + le(1, 2) + le(1, 2) + le(5, 2) + le(0, 2) + le(268966912) + le(0x137F, 2) + le(1, 2) + b"\0\0\0\0"}, 10240),
    "extfs": pad({0x404: le(8), 0x418: le(0), 0x438: b"\x53\xef\1\0\1\0"}, 8192), "shrs": pad({0: b"SHRS", 4: be(64), 156: hashlib.sha512(b"p" * 64).digest(), 1756: b"p" * 64}, 1820), "lzip": b"LZIP\1\x0c" + b"x" * 20 + b"y" * 12 + le(46, 8),
    "macho": pad({0: b"\xca\xfe\xba\xbe", 4: be(1), 16: be(100), 20: be(60)}, 160), "elf64": pad({0: b"\x7fELF\2\1\1", 16: le(2, 2), 18: le(62, 2), 20: le(1), 32: le(64, 8), 40: le(0, 8), 54: le(56, 2), 56: le(1, 2), 64: le(1), 72: le(0, 8), 96: le(400, 8)}, 400),
    "uzip": b"#L3.0\n" + pad({122: be(512) + be(1), 130: be(152, 8) + be(200, 8)}, 194), "bdl": pad({0: b"ibdl\1\0\1\0", 8: le(1321), 16: le(1), 1321: le(1337, 8) + le(20, 8)}, 1357), "fpkg": pad({0: b"CPKG\1\0\0\0", 8: be(12), 12: be(28), 20: be(10), 24: b"name"}, 50),
    "airoha": pad({240: b"\xff" * 16 + b"\x11\0\x0a\0\0\0", 262: le(300) + le(20)}, 320), "qnap_nas": b"\xf5\x7b\x47\x03" + b"e" * 60 + pad({0: b"icpnas", 6: le(60), 10: b"TS-1", 26: b"4.0"}, 74), "engenius": pad({32: be(180), 92: b"\x12\x34\x56xall"}, 180),
    "alpha_encimg_v2": pad({0: b"wapnd", 32: b"\x21\x03\x08\x20\x21\x03\x08\x20", 104: le(32)}, 160) + bytes(range(32, 64)),
}
START_ONLY = {"zlib", "xalz"}


@pytest.mark.parametrize("name", sorted(MADE))
def test_found(name):
    head = b"" if name in START_ONLY else b"\x11" * 24
    tail = b"" if name == "xalz" else b"\x11trailing"
    found = [r for r in scanner().search(head + MADE[name] + tail) if r[0] == name]
    assert found and found[0][1:3] == (len(head), len(head) + len(MADE[name])), found


@pytest.mark.parametrize("name", sorted(set(MADE) - {"xalz", "qnap_nas", "tar", "zip", "gzip", "xz", "bzip2", "ar", "fpkg", "lz4_skippable", "deafbead"}))
def test_cut_off(name):
    """Half of it isn't found, or isn't found to go beyond the file."""
    data = b"\x11" * 24 + MADE[name][: len(MADE[name]) // 2]
    assert all(r[2] is None or r[2] <= len(data) for r in scanner().search(data))


@pytest.mark.parametrize("name, at", [("sevenzip", 12), ("trx_v1", 50), ("hdr1", 100), ("cramfs", 200), ("shrs", 1800), ("romfs", 200), ("lzo", 20)])
def test_checksums_decide(name, at):
    data = bytearray(MADE[name])
    data[at] ^= 0x55
    assert not [r for r in scanner().search(bytes(data)) if r[0] == name]


def test_dmg_and_iso_start_before_their_mark():
    dmg = b"d" * 700 + pad({0: b"koly\0\0\0\4\0\0\2\0", 32: be(700, 8)}, 512)
    assert ("dmg", 0, 1212, False, None, None) in scanner().search(dmg)
    volume = pad({0: b"\1CD001", 80: le(20) + be(20), 128: le(2048, 2) + be(2048, 2)}, 2048)
    iso = b"\0" * 0x8000 + volume + b"\0" * (20 * 2048 - 0x8800)
    assert ("iso9660", 0, 40960, False, None, None) in scanner().search(iso)


def test_two_zips():
    def one(text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as f:
            f.writestr("hello.kitty", text)
        return out.getvalue()

    data = b"Hello " + one("Hello") + b" Kitty " + one("Kitty") + b"!"
    assert len(data) == 264 and [r[1:3] for r in scanner().search(data)] == [(6, 131), (138, 263)]


def test_random_bytes_raise_nothing():
    rng = random.Random(9)
    for _ in range(30):
        mark = rng.choice(list(MADE.values()))
        data = mark[: rng.randint(4, 64)] + rng.randbytes(rng.randint(0, 3000))
        assert not [r for r in scanner().search(data) if r[4] == "ERROR"]


def test_registry():
    assert len(FORMATS) >= 93 and len({f.name for f in FORMATS}) == len(FORMATS) - 1  # tar is there twice


def test_devices_keys_open_their_headers():
    for head, device, key, start in alpha.DEVICES:
        plain = aes_cbc_decrypt(bytes.fromhex(head), alpha.masked(device, key), alpha.masked(device, start))
        assert plain[:4] == be(alpha.MAGIC) and plain[12:] == b"sign" and 36 <= int.from_bytes(plain[4:8], "big") <= 44
