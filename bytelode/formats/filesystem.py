"""File systems and disk images."""

from __future__ import annotations

import struct
import zlib
from collections import Counter

from bytelode.formats.base import Invalid, Reader, Span, fmt, need, up

FILE = "filesystem"


@fmt("cramfs", FILE, "28 CD 3D 45", "45 3D CD 28", tool="7z")
def cramfs(r: Reader) -> int:
    r = r.either(b"\x28\xcd\x3d\x45")
    size = r.u32(4)
    need(r.raw(16, 16) == b"Compressed ROMFS" and size)
    if r.u32(8) & 1:
        # The checksum is over the image with its own place zeroed.
        body = zlib.crc32(r.raw(36, size - 36), zlib.crc32(b"\0" * 4, zlib.crc32(r.raw(0, 32))))
        stored = r.raw(32, 4)
        need(body in (int.from_bytes(stored, "little"), int.from_bytes(stored, "big")))
    return size


@fmt("extfs", FILE, "53 ef ( 00 | 01 | 02 ) 00 ( 00 | 01 | 02 | 03 | 04 ) 00", offset=-0x438, tool="debugfs")
def extfs(r: Reader) -> int:
    block = r.u32(0x418)
    need(r.u16(0x43A) in (0, 1, 2, 4) and r.u16(0x43C) <= 3 and r.u32(0x448) <= 4 and r.u32(0x44C) <= 2 and block <= 6)
    return r.u32(0x404) * (1024 << block)


@fmt("fat", FILE, "( EB | E9 ) [13] ( 01 | 02 | 04 | 08 | 10 | 20 | 40 | 80 ) [495] 55 AA", tool="7z")
def fat(r: Reader) -> int:
    sector, cluster, reserved, fats = r.u16(11), r.u8(13), r.u16(14), r.u8(16)
    need(sector in (512, 1024, 2048, 4096) and reserved and fats in (1, 2) and r.u8(21) >= 0xF0)
    total = r.u16(19) or r.u32(32)
    size, fat_sectors = total * sector, r.u16(22) or r.u32(36)
    need(total and fat_sectors and cluster)
    if size <= r.left:
        return size
    # The image was cut after its last used cluster.
    wide = r.u16(22) == 0
    entries = r.raw(reserved * sector, fat_sectors * sector)
    root = 0 if wide else up(r.u16(17) * 32, sector) // sector
    data = reserved + fats * fat_sectors + root
    clusters = (total - data) // cluster
    bits = 32 if wide else 12 if clusters < 4085 else 16

    def entry(i: int) -> int:
        if bits == 12:
            pair = int.from_bytes(entries[i * 3 // 2 : i * 3 // 2 + 2], "little")
            return pair >> 4 if i & 1 else pair & 0xFFF
        return int.from_bytes(entries[i * bits // 8 : (i + 1) * bits // 8], "little")

    last = max((i for i in range(2, min(clusters + 2, len(entries) * 8 // bits)) if entry(i)), default=1)
    return (data + (last - 1) * cluster) * sector


def jffs2(r: Reader, old: bool) -> int:
    mark = 0x1984 if old else 0x1985
    r = Reader(r.data, r.base, r.raw(0, 2) == mark.to_bytes(2, "big"))
    at = 0
    while at + 12 <= r.left:
        if r.u16(at) != mark:
            after = r.skip(at, b"\0\xff")
            if after == at:
                break
            step = up(after, 4) if up(after, 4) - after < 4 and r.upto(after, 2) != mark.to_bytes(2, "big" if r.big else "little") else after
            if step + 12 > r.left or r.u16(step) != mark:
                break
            at = step
            continue
        kind, size = r.u16(at + 2), r.u32(at + 4)
        need(size >= 12)
        if kind & 0x2000:
            # The checksum has neither start nor final complement.
            need((zlib.crc32(r.raw(at, 8), 0xFFFFFFFF) ^ 0xFFFFFFFF) & 0xFFFFFFFF == r.u32(at + 8))
        at += up(size, 4)
        need(at <= up(r.left, 4))
    need(at)
    return min(at, r.left)


@fmt("jffs2_new", FILE, "85 19 ( 01 | 02 | 03 | 04 | 06 | 08 | 09 ) ( e0 | 20 )", "19 85 ( e0 | 20 ) ( 01 | 02 | 03 | 04 | 06 | 08 | 09 )", tool="jefferson")
def jffs2_new(r: Reader) -> int:
    return jffs2(r, old=False)


@fmt("jffs2_old", FILE, "84 19 ( 01 | 02 | 03 | 04 | 06 | 08 | 09 ) ( e0 | 20 )", "19 84 ( e0 | 20 ) ( 01 | 02 | 03 | 04 | 06 | 08 | 09 )", tool="jefferson")
def jffs2_old(r: Reader) -> int:
    return jffs2(r, old=True)


@fmt("minifs", FILE, "4D 49 4E 49 46 53 00 00 00 00 00 00 00 00 00 00 00 00 00 03", note="Other versions may exist.")
def minifs(r: Reader) -> int:
    r = r.be()
    files, names = r.u32(20), r.u32(28)
    table = 32 + names
    need(files)
    chunks = max(r.u32(table + 20 * i + 8) for i in range(files)) + 1
    entries = table + 20 * files
    data = entries + 12 * chunks
    return data + max(r.u32(entries + 12 * i) + r.u32(entries + 12 * i + 4) for i in range(chunks))


def minix(r: Reader, version: int) -> int:
    sb = Reader(r.data, r.base + 0x400)
    if version == 3:
        sb = sb.either(b"\x4d\x5a", 24)
        inodes, imap, zmap, first, log, zones, block = sb.u32(0), sb.u16(6), sb.u16(8), sb.u16(10), sb.u16(12), sb.u32(20), sb.u16(28)
        need(block in (1024, 2048, 4096))
    else:
        low = {1: (b"\x7f\x13", b"\x8f\x13"), 2: (b"\x68\x24", b"\x78\x24")}[version]
        sb = Reader(sb.data, sb.base, sb.raw(16, 2) not in low)
        inodes, imap, zmap, first, log, block = sb.u16(0), sb.u16(4), sb.u16(6), sb.u16(8), sb.u16(10), 1024
        zones = sb.u16(2) if version == 1 else sb.u32(20)
    need(inodes and zones and imap and zmap and log <= 8 and 2 + imap + zmap <= first < zones)
    need(inodes <= imap * block * 8 and zones <= zmap * block * 8 + first)
    size = (zones << log) * block
    need(size <= r.left)
    return size


@fmt("minix_fs_v1", FILE, "[16] (7f | 8f) 13 (00 | 01 | 02) 00 [2] 00 00 00 00", "[16] 13 (7f | 8f) 00 (00 | 01 | 02) [2] 00 00 00 00", offset=-0x400)
def minix1(r: Reader) -> int:
    return minix(r, 1)


@fmt("minix_fs_v2", FILE, "[16] (68 | 78) 24 (00 | 01 | 02) 00 [4] 00 00 00 00", "[16] 24 (68 | 78) 00 (00 | 01 | 02) [4] 00 00 00 00", offset=-0x400)
def minix2(r: Reader) -> int:
    return minix(r, 2)


@fmt("minix_fs_v3", FILE, "[4] 00 00 [18] 5a 4d 00 00", "[4] 00 00 [18] 4d 5a 00 00", offset=-0x400)
def minix3(r: Reader) -> int:
    return minix(r, 3)


@fmt("ntfs", FILE, r"re:\xEB\x52\x90\x4E\x54\x46\x53\x20\x20\x20\x20[\x00-\xFF][\x01-\xFF][\x00-\xFF]{497}\x55\xAA", tool="7z")
def ntfs(r: Reader) -> int:
    sector, total = r.u16(11), r.u64(40)
    need(sector * total)
    # One more sector holds the copy of the boot sector.
    return (total + 1) * sector


@fmt("romfs", FILE, "2D 72 6F 6D 31 66 73 2d")
def romfs(r: Reader) -> int:
    r = r.be()
    size = r.u32(8)
    need(size >= 32)
    head = r.raw(0, min(512, size))
    need(sum(struct.unpack(f">{len(head) // 4}I", head[: len(head) // 4 * 4])) & 0xFFFFFFFF == 0)
    need(r.base + size <= len(r.data))
    return r.skip(size, b"\0")


def squashfs(r: Reader, at: int, width: int, big: bool) -> int:
    used = Reader(r.data, r.base, big).int(at, width)
    need(used)
    # Images are padded with zeros; take the padding along where it is there.
    for unit in (4096, 1024):
        end = up(used, unit)
        if r.base + end <= len(r.data) and not r.raw(used, end - used).strip(b"\0"):
            return end
    return used


def squash(name: str, big: str, little: str, version: str, at: int, width: int) -> None:
    patterns = [f"{m} [24] {version if m is big else version[3:] + ' ' + version[:2]}" for m in (big, little) if m]
    mark = bytes.fromhex(big) if big else None

    @fmt(name, FILE, *patterns, tool="sasquatch")
    def rule(r: Reader) -> int:
        return squashfs(r, at, width, r.raw(0, 4) == mark)


squash("squashfs_v1", "73 71 73 68", "68 73 71 73", "00 01", 8, 4)
squash("squashfs_v2", "73 71 73 68", "68 73 71 73", "00 02", 8, 4)
squash("squashfs_v2_nonstandard", "73 71 6c 7a", "7a 6c 71 73", "00 02", 8, 4)
squash("squashfs_v3", "73 71 73 68", "68 73 71 73", "00 03", 63, 8)
squash("squashfs_v3_ddwrt", "74 71 73 68", "68 73 71 74", "00 03", 63, 8)
squash("squashfs_v3_broadcom", "71 73 68 73", "73 68 73 71", "00 03", 63, 8)
squash("squashfs_v3_nonstandard", "73 71 6c 7a", "7a 6c 71 73", "00 03", 63, 8)
squash("squashfs_v4_le", "", "68 73 71 73", "00 04", 40, 8)
squash("squashfs_v4_be", "73 71 73 68", "", "00 04", 40, 8)
squash("squashfs_v4_broadcom", "71 73 68 73", "73 68 73 71", "00 04", 40, 8)


@fmt("ubi", FILE, "55 42 49 23 01", tool="ubireader_extract_images")
def ubi(r: Reader) -> int:
    places, at = [0], 0
    while (at := r.find(b"UBI#\x01", at + 1)) >= 0:
        places.append(at)
    gaps = Counter(b - a for a, b in zip(places, places[1:]))
    need(gaps)
    # The commonest distance is the block size; of several the one seen first.
    block = gaps.most_common(1)[0][0]
    end = 0
    while r.upto(end, 5) == b"UBI#\x01":
        end += block
    return min(end, r.left) if end - r.left < block else end


@fmt("ubifs", FILE, "31 18 10 06 [16] 06 ( 00 | 01 | 02 ) 00 00", "06 10 18 31 [16] 06 ( 00 | 01 | 02 ) 00 00", tool="ubireader_extract_files")
def ubifs(r: Reader) -> int:
    r = r.either(b"\x06\x10\x18\x31")
    return r.u32(36) * r.u32(40)


YAFFS = ("03 00 00 00 01 00 00 00 ff ff", "01 00 00 00 01 00 00 00 ff ff", "00 00 00 03 00 00 00 01 ff ff", "00 00 00 01 00 00 00 01 ff ff")


@fmt("yaffs", FILE, *YAFFS)
def yaffs(r: Reader) -> int:
    r = r.either(b"\0\0\0", 0)
    # Object headers tell pages from data: a type of 1 to 5, then a parent, a checksum of ff ff, and a name.
    def header(at: int) -> bool:
        return at + 512 <= r.left and 1 <= r.u32(at) <= 5 and 1 <= r.u32(at + 4) < 1 << 18 and r.raw(at + 8, 2) == b"\xff\xff"

    for page, spare in ((512, 16), (2048, 64), (4096, 128), (8192, 256), (1024, 32), (16384, 512)):
        step = page + spare
        if not header(step) and r.left > step:
            continue
        end = 0
        while end + step <= r.left:
            if header(end):
                size = r.u32(end + 292) if r.u32(end) == 1 else 0
                pages = 1 + (-(-size // page) if size < 0xFFFFFFFF else 0)
                need(pages * step <= r.left - end or end)
                end += min(pages, (r.left - end) // step) * step
            else:
                break
        if end:
            return r.skip(end, b"\xff")
    raise Invalid


@fmt("sparse", FILE, r"re:\x3A\xFF\x26\xED\x01\x00[\x00-\xFF]{2}\x1C\x00\x0C\x00")
def sparse(r: Reader) -> int:
    at = 28
    for _ in range(r.u32(20)):
        size = r.u32(at + 8)
        need(r.u16(at) in (0xCAC1, 0xCAC2, 0xCAC3, 0xCAC4) and size >= 12)
        at += size
    return at


@fmt("erofs", FILE, "e2 e1 f5 e0", offset=-0x400, tool="fsck.erofs")
def erofs(r: Reader) -> int:
    bits = r.u8(0x40C)
    r.text(0x440, 16)
    need(9 <= bits <= 24 and r.u64(0x418) > 0)
    return r.u32(0x424) << bits


@fmt("iso9660", FILE, "( 00 | 01 | 02 | 03 ) 43 44 30 30 31", tool="7z")
def iso9660(r: Reader) -> Span:
    sectors, block = r.u32(80), r.u16(128)
    need(r.int(84, 4, True) == sectors and r.int(130, 2, True) == block and r.base >= 0x8000)
    start = r.base - 0x8000
    return Span(start, start + sectors * block)


def ufs(r: Reader, at: int, size: int) -> int:
    fragment, fragments, block = r.u32(at + 52), r.u32(at + 56), r.u32(at + 48)
    need(fragment and block and r.u32(at + 44) and fragment <= block <= 65536 and fragments == block // fragment)
    return size * fragment


@fmt("ufs1", FILE, "( 01 | 02 ) 00 00 00 [8] 54 19 01 00", offset=-0x2550)
def ufs1(r: Reader) -> int:
    return ufs(r, 0x2000, r.u32(0x2024))


@fmt("ufs2", FILE, "19 01 54 19 00", offset=-0x1055C)
def ufs2(r: Reader) -> int:
    # fs_size of 64 bits: at 1080 of the superblock.
    return ufs(r, 0x10000, r.u64(0x10000 + 1080))


@fmt("solaris_ufs1", FILE, "08 00 00 00 [8] 54 19 01 00", offset=-0x2550)
def solaris(r: Reader) -> int:
    return ufs(r, 0x2000, r.u32(0x2024))


@fmt("btrfs_stream", FILE, "62 74 72 66 73 2d 73 74 72 65 61 6d 00 (01 | 02) 00 00 00", note="Incremental streams are not unpacked.")
def btrfs_stream(r: Reader) -> int:
    at = 17
    while True:
        size, command = r.u32(at), r.u16(at + 4)
        need(1 <= command <= 25)
        at += 10 + size
        need(r.base + at <= len(r.data))
        if command == 21:
            return at


LVM_NOTE = "Each physical volume gives partial images; only linear segments are unpacked."


@fmt("lvm2", FILE, "4c 41 42 45 4c 4f 4e 45 [16] 4c 56 4d 32 20 30 30 31", note=LVM_NOTE)
def lvm2(r: Reader) -> Span:
    sector, header = r.u64(8), r.u32(20)
    need(sector < 4 and header >= 32)
    # The label's checksum starts from a fixed value and is not complemented.
    need(zlib.crc32(r.raw(20, 492), 0xF597A6CF ^ 0xFFFFFFFF) ^ 0xFFFFFFFF == r.u32(16))
    start, size = r.base - sector * 512, r.u64(header + 32)
    need(start >= 0 and size and start + size <= len(r.data))
    return Span(start, start + size)
