"""Executables."""

from __future__ import annotations

from bytelode.formats.base import Reader, fmt, need

EXECUTABLE = "executable"
MODULE = b"~Module signature appended~\n"


def elf(r: Reader, wide: bool) -> int:
    r = Reader(r.data, r.base, r.u8(5) == 2)
    at = (32, 40, 54, 56, 58, 60) if wide else (28, 32, 42, 44, 46, 48)
    word = 8 if wide else 4
    programs, sections = r.int(at[0], word), r.int(at[1], word)
    program_size, program_count, section_size, section_count = (r.u16(x) for x in at[2:])
    need(r.u16(16) and r.u32(20) == 1)
    end = max(64 if wide else 52, programs + program_size * program_count, sections + section_size * section_count)
    need(r.base + programs + program_size * program_count <= len(r.data))
    if r.base + sections + section_size * section_count <= len(r.data):
        for i in range(section_count):
            s = sections + section_size * i
            if r.u32(s + 4) != 8:
                end = max(end, r.int(s + (24 if wide else 16), word) + r.int(s + (32 if wide else 20), word))
    for i in range(program_count):
        p = programs + program_size * i
        end = max(end, r.int(p + (8 if wide else 4), word) + r.int(p + (32 if wide else 16), word))
    # A signed kernel module ends in its signature, a record of 12 bytes with the signature's size, and a line.
    tail = r.upto(end, 1 << 16)
    if (mark := tail.find(MODULE)) >= 12 and int.from_bytes(tail[mark - 4 : mark], "big") == mark - 12:
        end += mark + len(MODULE)
    return end


@fmt("elf32", EXECUTABLE, "7F 45 4C 46 01 (01 | 02) 01")
def elf32(r: Reader) -> int:
    return elf(r, wide=False)


@fmt("elf64", EXECUTABLE, "7F 45 4C 46 02 (01 | 02) 01")
def elf64(r: Reader) -> int:
    return elf(r, wide=True)


MACHO = ("CF FA ED FE [24]", "CE FA ED FE [24]", "FE ED FA CF [24]", "FE ED FA CE [24]", "CA FE BA BE 00 00 00 (01|02|03|04|05|06|07|08)")


@fmt("macho", EXECUTABLE, *MACHO)
def macho(r: Reader) -> int:
    mark = r.raw(0, 4)
    if mark == b"\xca\xfe\xba\xbe":
        r = r.be()
        return max(r.u32(8 + 20 * i + 8) + r.u32(8 + 20 * i + 12) for i in range(r.u32(4)))
    r = Reader(r.data, r.base, mark[0] == 0xFE)
    wide = 0xCF in (mark[0], mark[3])
    header = 32 if wide else 28
    end, at = header + r.u32(20), header
    for _ in range(r.u32(16)):
        command, size = r.u32(at), r.u32(at + 4)
        need(size >= 8)
        if command == (0x19 if wide else 0x01):
            where = (r.u64(at + 40), r.u64(at + 48)) if wide else (r.u32(at + 32), r.u32(at + 36))
            end = max(end, sum(where))
        at += size
    return end


@fmt("xalz", EXECUTABLE, r"re:\AXALZ")
def xalz(r: Reader) -> int:
    need(r.u32(8))
    return r.left
