"""A log-structured flash file system: pages with tags in their spare area; of each page of a file the newest one counts."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from bytelode.operators.entry import Entry, extractor

LAYOUTS = ((2048, 64), (512, 16), (4096, 128), (8192, 256), (1024, 32), (16384, 512))
FILE, LINK, FOLDER, HARDLINK, SPECIAL = range(1, 6)
ROOT, UNLINKED, DELETED = 1, 3, 4


@dataclass
class Node:
    kind: int = 0
    parent: int = 0
    name: str = ""
    mode: int = 0
    size: int = 0
    target: str = ""
    same: int = 0
    pages: dict[int, bytes] = field(default_factory=dict)


def header(raw: bytes, order: str) -> bool:
    kind, parent = struct.unpack_from(order + "II", raw)
    return 1 <= kind <= 5 and 1 <= parent < 1 << 18 and raw[8:10] == b"\xff\xff"


def tags(spare: bytes, order: str, at: int) -> tuple[int, int, int, int]:
    """(sequence, object, page of the object, bytes)."""
    return struct.unpack_from(order + "4I", spare, at)


def layout(data: bytes) -> tuple[int, int, str, int] | None:
    """Page, spare, byte order and the tags' place in the spare area, such that the first pages make sense."""
    order = ">" if data[:3] == b"\0\0\0" else "<"
    for page, spare in LAYOUTS:
        step = page + spare
        for at in (0, 2, 1, 26, 34, 40):
            good = 0
            for start in range(0, min(len(data), 8 * step) - step + 1, step):
                if at + 16 > spare:
                    break
                sequence, number, chunk, size = tags(data[start + page : start + step], order, at)
                top = bool(chunk & 0x80000000)
                is_header = header(data[start:], order)
                if not (0x1000 <= sequence < 0xEFFFFF00 and 0 < number & 0xFFFFFFF < 1 << 18):
                    break
                if is_header and (top or chunk == 0) or not is_header and 0 < chunk < 1 << 20 and 0 < size <= page:
                    good += 1
                else:
                    break
            else:
                if good:
                    return page, spare, order, at
    return None


@extractor("yaffs")
def yaffs(data: bytes) -> Iterator[Entry]:
    found = layout(data)
    if found is None:
        yield Entry("", problem="the layout of pages isn't known", resolution="Not unpacked.", severity="ERROR")
        return
    page, spare, order, at = found
    step = page + spare
    nodes: dict[int, Node] = {}
    newest: dict[tuple[int, int], int] = {}
    for start in range(0, len(data) - step + 1, step):
        sequence, number, chunk, size = tags(data[start + page : start + step], order, at)
        number &= 0xFFFFFFF
        if sequence == 0xFFFFFFFF:
            continue
        own = 0 if chunk & 0x80000000 or chunk == 0 else chunk
        # Blocks are numbered as they are written; within a block the later page is the newer one.
        if newest.get((number, own), -1) > sequence:
            continue
        newest[number, own] = sequence
        node = nodes.setdefault(number, Node())
        if own:
            node.pages[own] = data[start : start + size]
        elif header(data[start : start + page], order):
            raw = data[start : start + page]
            node.kind, node.parent = struct.unpack_from(order + "II", raw)
            node.name = raw[10:266].split(b"\0", 1)[0].decode("utf-8", "replace")
            node.mode = struct.unpack_from(order + "I", raw, 268)[0]
            node.size, node.same = struct.unpack_from(order + "II", raw, 292)
            node.target = raw[300:460].split(b"\0", 1)[0].decode("utf-8", "replace")

    def path(number: int) -> str | None:
        parts: list[str] = []
        while number != ROOT:
            node = nodes.get(number)
            # Parents that are no folders, unlinked objects, and circles lead nowhere.
            if node is None or node.parent in (UNLINKED, DELETED) or len(parts) > 64 or parts and node.kind != FOLDER:
                return None
            parts.append(node.name)
            number = node.parent
        return "/".join(reversed(parts)) or None

    for number, node in sorted(nodes.items()):
        where = path(number) if node.kind else None
        if where is None:
            continue
        if node.kind == FOLDER:
            yield Entry(where, "dir", mode=node.mode & 0o7777)
        elif node.kind == FILE:
            if node.size > page * (max(node.pages, default=0) + 1):
                yield Entry(where, problem="pages are missing", resolution="Skipped.", severity="WARNING")
                continue
            content = b"".join(node.pages.get(i, b"").ljust(page, b"\0") for i in range(1, -(-node.size // page) + 1))
            yield Entry(where, content=content[: node.size], mode=node.mode & 0o7777)
        elif node.kind == LINK:
            yield Entry(where, "link", link_target=node.target)
        elif node.kind == HARDLINK:
            yield Entry(where, "hardlink", link_target=path(node.same))
        else:
            yield Entry(where, "special", problem="a special file", resolution="Skipped.", severity="WARNING")
