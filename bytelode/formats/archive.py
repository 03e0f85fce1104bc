"""Archives and firmware containers."""

from __future__ import annotations

import hashlib
import zlib

from bytelode.formats.base import Invalid, Reader, Span, fmt, need, up

ARCHIVE = "archive"


@fmt("deafbead", ARCHIVE, "DE AF BE AD (86 | 87)")
def deafbead(r: Reader) -> int:
    at = 4
    while r.upto(at, 1) in (b"\x86", b"\x87"):
        name = r.u16(at + 1)
        need(name)
        if r.u8(at) == 0x86:
            at += 3 + name
        else:
            size = r.u32(at + 3 + name)
            need(size)
            at += 7 + name + size
        need(r.base + at <= len(r.data))
    return at


@fmt("moxa_frm", ARCHIVE, "2A 46 52 4D 00 00 00 01 [4] 60 00 02 00")
def moxa_frm(r: Reader) -> int:
    return r.u32(8)


@fmt("chk", ARCHIVE, "2a 23 24 5e")
def chk(r: Reader) -> int:
    r = r.be()
    header = r.u32(4)
    need(40 <= header <= 1024)
    r.text(40, header - 40)
    return header + r.u32(24) + r.u32(28)


def trx(r: Reader) -> int:
    size = r.u32(4)
    need(size >= 28)
    need(r.crc(12, size - 12) ^ 0xFFFFFFFF == r.u32(8))
    return size


@fmt("trx_v1", ARCHIVE, "48 44 52 30 [10] 01 00")
def trx_v1(r: Reader) -> int:
    return trx(r)


@fmt("trx_v2", ARCHIVE, "48 44 52 30 [10] 02 00")
def trx_v2(r: Reader) -> int:
    return trx(r)


@fmt("encrpted_img", ARCHIVE, "re:encrpted_img")
def encrpted_img(r: Reader) -> int:
    size = r.int(12, 4, True)
    need(size >= 16)
    return 16 + size


@fmt("shrs", ARCHIVE, "53 48 52 53")
def shrs(r: Reader) -> int:
    size = r.int(4, 4, True)
    need(hashlib.sha512(r.raw(1756, size)).digest() == r.raw(156, 64))
    return 1756 + size


@fmt("fpkg", ARCHIVE, "(43 | 46) 50 4B 47 01 00 00 00")
def fpkg(r: Reader) -> int:
    r = r.be()
    at, any_entry = r.u32(8), False
    while at + 28 <= r.left:
        header, size = r.u32(at), r.u32(at + 8)
        if header != 28:
            break
        r.text(at + 12, 16)
        at, any_entry = at + header + size, True
    need(any_entry)
    return at


def hdr(r: Reader) -> int:
    end = r.u32(4) + 272
    need(r.crc(12, end - 12) ^ 0xFFFFFFFF == r.u32(8))
    return end


@fmt("hdr1", ARCHIVE, "48 44 52 31")
def hdr1(r: Reader) -> int:
    return hdr(r)


@fmt("hdr2", ARCHIVE, "48 44 52 32")
def hdr2(r: Reader) -> int:
    return hdr(r)


QNAP_FOOTER = b"icpnas"


@fmt("qnap_nas", ARCHIVE, "F5 7B 47 03")
def qnap_nas(r: Reader) -> int:
    at = r.find(QNAP_FOOTER)
    while at >= 0:
        try:
            for field in range(10, 74, 16):
                r.text(at + field, 16)
            if 0 < r.u32(at + 6) <= at:
                return at + 74
        except Invalid:
            pass
        at = r.find(QNAP_FOOTER, at + 1)
    raise Invalid


@fmt("qnap_networking", ARCHIVE, "69 63 70 6e 61 73")
def qnap_networking(r: Reader) -> Span:
    need(r.left == 74 and r.base > 0)
    need(not r.text(10, 16).startswith("QNAPNAS") and 0 < r.u32(6) <= r.base)
    return Span(0, len(r.data))


@fmt("bneg", ARCHIVE, "42 4E 45 47")
def bneg(r: Reader) -> int:
    first, second = r.u32(12), r.u32(16)
    need(r.u32(4) == 1 and r.u32(8) == 1 and first and second)
    return 20 + first + second


@fmt("bdl", ARCHIVE, "69 62 64 6C 01 00 01 00")
def bdl(r: Reader) -> int:
    return toc_16(r, (32, 288, 544, 809, 1065))


@fmt("ipkg", ARCHIVE, "69 70 6B 67 01 00 03 00")
def ipkg(r: Reader) -> int:
    return toc_16(r, (32, 288, 544))


def toc_16(r: Reader, texts: tuple[int, ...]) -> int:
    """Entries of the table of contents: an offset and a size of 64 bits each."""
    at, entries = r.u32(8), r.u32(16)
    need(at and 0 < entries < 65536)
    for field in texts:
        r.text(field, 256)
    return max(r.u64(at + 16 * i) + r.u64(at + 16 * i + 8) for i in range(entries))


@fmt("ar", ARCHIVE, "21 3C 61 72 63 68 3E 0A [58] 60 0A")
def ar(r: Reader) -> int:
    at = end = 8
    while r.upto(at + 58, 2) == b"`\n":
        digits = r.raw(at + 48, 10).strip()
        if not digits.isdigit():
            break
        at += 60 + int(digits)
        if r.base + at > len(r.data):
            break
        end = at
        at += at & 1
    need(end > 8)
    return min(up(end, 2), r.left) if r.upto(end, 1) == b"\n" else end


ARC = "1A (01 | 02 | 03 | 04 | 05 | 06 | 07) [12] (00 | F0 | F1 | F2 | F3 | F4 | F5 | F6 | F7 | F8 | F9 | FA | FB | FC | FD | FE | FF)"


@fmt("arc", ARCHIVE, ARC, tool="unar")
def arc(r: Reader) -> int:
    at = 0
    while True:
        need(r.u8(at) == 0x1A)
        kind = r.u8(at + 1)
        if kind == 0:
            need(at)
            return at + 2
        need(kind <= 7)
        r.text(at + 2, 13)
        # The oldest kind has no field for the uncompressed size.
        at += (25 if kind == 1 else 29) + r.u32(at + 15)


@fmt("arj", ARCHIVE, "60 EA [5] 0? [2] 0?", tool="7z")
def arj(r: Reader) -> int:
    def block(at: int) -> int:
        size = r.u16(at + 2)
        if size:
            need(size <= 2600 and r.crc(at + 4, size) == r.u32(at + 4 + size))
            need(r.u16(at + 8 + size) == 0)  # extended headers are not supported
        return size

    size = block(0)
    need(30 <= size)
    at = 10 + size
    while True:
        need(r.raw(at, 2) == b"\x60\xea")
        size = block(at)
        if not size:
            return at + 4
        at += 10 + size + r.u32(at + 16)


@fmt("cab", ARCHIVE, "4D 53 43 46 00 00 00 00", tool="7z")
def cab(r: Reader) -> int:
    need(r.u32(8) >= 36)
    return r.u32(8)


@fmt("msi", ARCHIVE, "D0 CF 11 E0 A1 B1 1A E1", tool="7z", note="Unpacked as a compound file; names are the internal ones.")
def msi(r: Reader) -> int:
    shift = r.u16(30)
    need(shift in (9, 12))
    sector, count, free = 1 << shift, r.u32(44), 0xFFFFFFFF
    place = lambda i: (i + 1) << shift
    tables = [x for x in (r.u32(76 + 4 * i) for i in range(109)) if x < 0xFFFFFFFA]
    following = r.u32(68)
    for _ in range(r.u32(72)):
        need(following < 0xFFFFFFFA)
        own = [r.u32(place(following) + 4 * i) for i in range(sector // 4)]
        tables += [x for x in own[:-1] if x < 0xFFFFFFFA]
        following = own[-1]
    last = -1
    for n, t in enumerate(tables[:count]):
        for i in range(sector // 4):
            if r.u32(place(t) + 4 * i) != free:
                last = n * (sector // 4) + i
    need(last >= 0)
    return (last + 2) * sector


def tar_sums(raw: bytes) -> bool:
    """The stored sum of the header's bytes, its own place being blanks; signed sums and a place without its end are met too."""
    said = raw[148:156].strip(b"\0 ")
    need(said and all(c in b"01234567" for c in said))
    body = raw[:148] + b" " * 8 + raw[156:512]
    return int(said, 8) in (sum(body), sum(c - 256 if c > 127 else c for c in body), sum(raw[:148] + b" " * 8 + raw[156:500]))


def tar_size(field: bytes) -> int:
    if field[0] & 0x80:
        return int.from_bytes(field, "big") & ((1 << 95) - 1)
    digits = field.split(b"\0")[0].strip()
    need(all(c in b"01234567" for c in digits))
    return int(digits or b"0", 8)


def tar(r: Reader) -> int:
    at, first = 0, True
    while at + 512 <= r.left:
        raw = r.raw(at, 512)
        if not raw.strip(b"\0"):
            break
        try:
            good = tar_sums(raw)
            step = 512 + (up(tar_size(raw[124:136]), 512) if raw[156:157] not in b"12345" else 0)
        except Invalid:
            good = False
        if not good:
            need(not first)
            break
        if at + step > r.left:
            break  # the last entry is cut off: the archive ends where it starts
        at, first = at + step, False
    need(at)
    # Zeros at the end, up to a whole record of 20 blocks.
    end = at
    while end < up(at + 1024, 10240) and end + 512 <= r.left and not r.raw(end, 512).strip(b"\0"):
        end += 512
    return end


@fmt("tar", ARCHIVE, "75 73 74 61 72 20 20 00", "75 73 74 61 72 00 30 30", offset=-257)
def tar_ustar(r: Reader) -> int:
    return tar(r)


_OCTAL = r"[0-7 \x00]{%d}"
OLD_TAR = "re:" + "".join([r"[0-7 ]{6,7}[ \x00]{1,2}" * 3, r"[0-7 ]{11}[ \x00]" * 2, r"[0-7 ]{6}[ \x00]{2}", r"[0-7\x00]"])


@fmt("tar", ARCHIVE, OLD_TAR, offset=-100)
def tar_unix(r: Reader) -> int:
    need(r.upto(257, 5) != b"ustar")
    return tar(r)


def cpio(r: Reader, mark: bytes, align: int, header: int, fields) -> int:
    at = 0
    while True:
        if r.left - at < header or r.raw(at, len(mark)) != mark:
            need(at)
            end = at
            break
        mode, name, size = fields(at)
        need(name and mode >> 12 in (0, 1, 2, 4, 6, 8, 10, 12))
        file_name = r.raw(at + header, name).rstrip(b"\0")
        need(r.upto(at + header + name - 1, 1) == b"\0")
        at = up(up(at + header + name, align) + size, align)
        if file_name == b"TRAILER!!!":
            end = at
            break
        need(r.base + at <= len(r.data) + align)
    full = up(end, 512)
    if r.base + full <= len(r.data) and not r.raw(end, full - end).strip(b"\0"):
        return full
    return min(end, r.left)


def hexed(r: Reader, at: int, base: int, size: int) -> int:
    try:
        return int(r.raw(at, size), base)
    except ValueError as e:
        raise Invalid from e


@fmt("cpio_portable_ascii", ARCHIVE, "30 37 30 37 30 31")
def cpio_ascii(r: Reader) -> int:
    return cpio(r, b"070701", 4, 110, lambda at: (hexed(r, at + 14, 16, 8), hexed(r, at + 94, 16, 8), hexed(r, at + 54, 16, 8)))


@fmt("cpio_portable_ascii_crc", ARCHIVE, "30 37 30 37 30 32")
def cpio_crc(r: Reader) -> int:
    return cpio(r, b"070702", 4, 110, lambda at: (hexed(r, at + 14, 16, 8), hexed(r, at + 94, 16, 8), hexed(r, at + 54, 16, 8)))


@fmt("cpio_portable_old_ascii", ARCHIVE, "30 37 30 37 30 37")
def cpio_old(r: Reader) -> int:
    return cpio(r, b"070707", 1, 76, lambda at: (hexed(r, at + 18, 8, 6), hexed(r, at + 59, 8, 6), hexed(r, at + 65, 8, 11)))


@fmt("cpio_binary", ARCHIVE, "c7 71")
def cpio_binary(r: Reader) -> int:
    return cpio(r, b"\xc7\x71", 2, 26, lambda at: (r.u16(at + 6), r.u16(at + 20), r.u16(at + 22) << 16 | r.u16(at + 24)))


@fmt("sevenzip", ARCHIVE, "37 7A BC AF 27 1C", tool="7z")
def sevenzip(r: Reader) -> int:
    need(r.crc(12, 20) == r.u32(8))
    return 32 + r.u64(12) + r.u64(20)


@fmt("rar", ARCHIVE, "52 61 72 21 1A 07 ( 00 | 01 00 )", tool="unar", note="Encrypted archives are not unpacked.")
def rar(r: Reader) -> Span:
    encrypted, at = False, 7
    if r.u8(6) == 1:
        at = 8

        def number(at: int) -> tuple[int, int]:
            out = shift = 0
            while True:
                byte = r.u8(at)
                out |= (byte & 0x7F) << shift
                at, shift = at + 1, shift + 7
                if not byte & 0x80:
                    return out, at
                need(shift < 63)

        while True:
            size, head = number(at + 4)
            kind, body = number(head)
            flags, body = number(body)
            extra = data = 0
            if flags & 1:
                extra, body = number(body)
            if flags & 2:
                data, body = number(body)
            need(r.crc(at + 4, head + size - at - 4) == r.u32(at) and kind in (1, 2, 3, 4, 5))
            encrypted |= kind == 4
            at = head + size + data
            if kind == 5 or kind == 4:
                break
    else:
        while True:
            kind, flags, size = r.u8(at + 2), r.u16(at + 3), r.u16(at + 5)
            need(0x72 <= kind <= 0x7B and size >= 7)
            need(r.crc(at + 2, size - 2) & 0xFFFF == r.u16(at) or kind == 0x72)
            encrypted |= kind == 0x73 and bool(flags & 0x80) or kind == 0x74 and bool(flags & 4)
            data = r.u32(at + 7) if flags & 0x8000 or kind in (0x74, 0x7A) else 0
            if kind == 0x74 and flags & 0x100:
                data |= r.u32(at + 32) << 32
            at += size + data
            if kind == 0x7B or at >= r.left:
                break
    return Span(r.base, r.base + at, encrypted)


def zip_end(r: Reader, central: bytes = b"PK\x01\x02", end_mark: bytes = b"PK\x05\x06") -> Span:
    at = r.find(end_mark)
    while at >= 0 and at + 22 <= r.left:
        size, offset, comment = r.u32(at + 12), r.u32(at + 16), r.u16(at + 20)
        wide = at >= 20 and r.raw(at - 20, 4) == b"PK\x06\x07"
        if wide:
            record = r.u64(at - 12)
            if r.upto(record, 4) == b"PK\x06\x06":
                size, offset = r.u64(record + 40), r.u64(record + 48)
        if offset + size == at or wide and offset + size <= at:
            encrypted, entry = False, offset
            while entry < offset + size and r.upto(entry, 4) == central:
                encrypted |= bool(r.u16(entry + 8) & 1)
                entry += 46 + r.u16(entry + 28) + r.u16(entry + 30) + r.u16(entry + 32)
            return Span(r.base, r.base + min(at + 22 + comment, r.left), encrypted)
        at = r.find(end_mark, at + 1)
    raise Invalid


@fmt("zip", ARCHIVE, "50 4B 03 04", note="Encrypted archives are not unpacked.")
def zip_(r: Reader) -> Span:
    return zip_end(r)


@fmt("instar_hd", ARCHIVE, "50 4b 03 07")
def instar_hd(r: Reader) -> Span:
    return zip_end(r, b"PK\x01\x08", b"PK\x05\x09")


@fmt("dmg", ARCHIVE, "6b 6f 6c 79 00 00 00 04 00 00 02 00", tool="7z")
def dmg(r: Reader) -> Span:
    b = r.be()
    start = r.base - max(b.u64(24) + b.u64(32), b.u64(40) + b.u64(48), b.u64(216) + b.u64(224))
    need(start >= 0)
    return Span(start, r.base + 512)


@fmt("stuffit", ARCHIVE, "53 49 54 21 [6] 72 4C 61 75", tool="unar")
def stuffit(r: Reader) -> int:
    return r.int(6, 4, True)


@fmt("stuffit5", ARCHIVE, "53 74 75 66 66 49 74 20 28 63 29 31 39 39 37 2D", tool="unar")
def stuffit5(r: Reader) -> int:
    return r.int(84, 4, True)


@fmt("engenius", ARCHIVE, "12 34 56 78 61 6c 6c", offset=-92, note="Not all firmware versions are supported.")
def engenius(r: Reader) -> int:
    size = r.int(32, 4, True)
    need(size > 136)
    return size


@fmt("ecc", ARCHIVE, "45 43 43 30 31 30 31 00")
def ecc(r: Reader) -> int:
    need(r.u32(12) == 0x20)
    return 0x20 + r.u32(8)


@fmt("partclone", ARCHIVE, r"re:partclone-image\x00\d+\.\d+\.\d+.*?0002(\xde\xc0|\xc0\xde)", tool="partclone.restore")
def partclone(r: Reader) -> int:
    r = Reader(r.data, r.base, r.find(b"\xc0\xde") == 34)
    # The header's checksum is left without its final complement.
    need(r.crc(0, 106) ^ 0xFFFFFFFF == r.u32(106))
    total, used, block = r.u64(60), r.u64(76), r.u32(84)
    width, every = r.u16(98), r.u32(100)
    sums = -(-used // every) * width if every and r.u16(96) else 0
    return 110 + -(-total // 8) + width + sums + used * block


SBFH = "53 42 46 48 1C 01 00 00 [7] [4] [265] 4D 52 56 4C 7B F1 9C 2E [4] (01 | 02 | 03 | 04 | 05 | 06 | 07 | 08 | 09) 00 00 00 [2] 00 1F"


@fmt("sbfh", ARCHIVE, SBFH)
def sbfh(r: Reader) -> int:
    need(r.u32(15))
    return r.u32(4) + r.u32(15)


@fmt("airoha", ARCHIVE, "FF FF FF FF FF FF FF FF FF FF FF FF FF FF FF FF 11 00 0A 00 ( 00 | 01 | 02 ) ( 00 | 01 | 02 )", offset=-240, note="Encrypted firmware is only carved.")
def airoha(r: Reader) -> int:
    offset, size = r.u32(262), r.u32(266)
    need(offset >= 256 and size)
    return offset + size


@fmt("rpm", ARCHIVE, "ED AB EE DB (03 | 04) ?? 00 (00 | 01) ?? ?? [65] 00 ?? ?? 00 05")
def rpm(r: Reader) -> int:
    r = r.be()

    def header(at: int) -> tuple[int, dict[int, int]]:
        need(r.raw(at, 3) == b"\x8e\xad\xe8")
        count, size = r.u32(at + 8), r.u32(at + 12)
        need(count < 65536)
        store = at + 16 + 16 * count
        tags = {}
        for i in range(count):
            tag, kind, offset = (r.u32(at + 16 + 16 * i + 4 * k) for k in range(3))
            if kind in (4, 5) and offset + 4 * (kind - 3) <= size:
                tags[tag] = r.int(store + offset, 4 if kind == 4 else 8)
        return store + size, tags

    end, tags = header(96)
    main = up(end, 8)
    header(main)
    size = tags.get(1000) or tags.get(270)
    need(size)
    return main + size
