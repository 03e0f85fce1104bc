"""The Unix file system of BSD and Solaris, versions 1 and 2: directories walked from the root inode."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from bytelode.operators.entry import Entry, extractor

ROOT = 2


class Ufs:
    """Places in fragments; the superblock's fields are those of the published layout."""

    def __init__(self, data: bytes, second: bool, solaris: bool):
        self.data, self.second, self.solaris = data, second, solaris
        sb = 0x10000 if second else 0x2000
        field = lambda at: struct.unpack_from("<I", data, sb + at)[0]
        self.inodes, self.offset, self.mask = field(16), field(24), field(28)
        self.block, self.fragment = field(48), field(52)
        self.each_inodes, self.each_fragments = field(184), field(188)
        self.width, self.pointer = (256, "Q") if second else (128, "I")

    def inode(self, number: int) -> tuple[int, int, int]:
        """(mode, size, place of its pointers)."""
        group, index = divmod(number, self.each_inodes)
        start = group * self.each_fragments
        if not self.second:
            start += self.offset * (group & ~self.mask & 0xFFFFFFFF)
        at = (start + self.inodes) * self.fragment + index * self.width
        mode = struct.unpack_from("<H", self.data, at)[0]
        size = struct.unpack_from("<Q", self.data, at + (16 if self.second else 8))[0]
        return mode, size, at + (112 if self.second else 40)

    def blocks(self, at: int, count: int) -> Iterator[int]:
        """Places of a file's blocks, 0 for holes."""
        step = struct.calcsize(self.pointer)
        per = self.block // step

        def below(place: int, levels: int, left: int) -> Iterator[int]:
            if not levels:
                yield place
                return
            span = per ** (levels - 1)
            for i in range(min(per, -(-left // span))):
                inner = struct.unpack_from("<" + self.pointer, self.data, place * self.fragment + step * i)[0] if place else 0
                yield from below(inner, levels - 1, min(span, left - i * span))

        pointers = struct.unpack_from(f"<15{self.pointer}", self.data, at)
        yield from pointers[: min(12, count)]
        left = count - 12
        for levels in (1, 2, 3):
            if left <= 0:
                break
            own = min(left, per**levels)
            yield from below(pointers[11 + levels], levels, own)
            left -= own

    def content(self, size: int, at: int) -> bytes:
        if size > len(self.data):
            raise ValueError("a file is larger than its file system")
        out = []
        for i, place in enumerate(self.blocks(at, -(-size // self.block))):
            n = min(self.block, size - i * self.block)
            out.append(self.data[place * self.fragment : place * self.fragment + n] if place else bytes(n))
        return b"".join(out)

    def listing(self, body: bytes) -> Iterator[tuple[int, str]]:
        at = 0
        while at + 8 <= len(body):
            number, step = struct.unpack_from("<IH", body, at)
            if step < 8:
                break
            length = struct.unpack_from("<H", body, at + 6)[0] if self.solaris else body[at + 7]
            name = body[at + 8 : at + 8 + length].decode("utf-8", "replace")
            if number and name not in (".", "..", ""):
                yield number, name
            at += step

    def walk(self, number: int, folder: str, above: frozenset[int]) -> Iterator[Entry]:
        _, size, at = self.inode(number)
        for child, name in self.listing(self.content(size, at)):
            mode, size, at = self.inode(child)
            kind, path = mode >> 12, folder + name
            if kind == 4:
                yield Entry(path, "dir", mode=mode & 0o7777)
                # A directory in itself would have no end.
                if child not in above:
                    yield from self.walk(child, path + "/", above | {child})
            elif kind == 8:
                yield Entry(path, content=self.content(size, at), mode=mode & 0o7777)
            elif kind == 10:
                # Short targets stand in place of the pointers.
                target = self.data[at : at + size] if size < (120 if self.second else 60) else self.content(size, at)
                yield Entry(path, "link", link_target=target.decode("utf-8", "replace"))
            else:
                yield Entry(path, "special", problem="a special file", resolution="Skipped.", severity="WARNING")


@extractor("ufs1")
def ufs1(data: bytes) -> Iterator[Entry]:
    return Ufs(data, second=False, solaris=False).walk(ROOT, "", frozenset({ROOT}))


@extractor("ufs2")
def ufs2(data: bytes) -> Iterator[Entry]:
    return Ufs(data, second=True, solaris=False).walk(ROOT, "", frozenset({ROOT}))


@extractor("solaris_ufs1")
def solaris_ufs1(data: bytes) -> Iterator[Entry]:
    return Ufs(data, second=False, solaris=True).walk(ROOT, "", frozenset({ROOT}))
