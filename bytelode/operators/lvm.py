"""Logical volumes of one physical volume: text metadata, and linear segments copied into images."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from bytelode.operators.entry import Entry, extractor

AREA = b" LVM2 x[5A%r0N*>"
SECTOR = 512
MOST = 1 << 30
TOKEN = re.compile(r'\s+|#[^\n]*|(?P<text>"(?:[^"\\]|\\.)*")|(?P<word>[\w.+-]+)|(?P<mark>[{}\[\]=,])')


def parsed(text: str) -> dict:
    """Nested sections of ``name = value`` and ``name { ... }``."""
    tokens = [m for m in TOKEN.finditer(text) if m.lastgroup]
    at = 0

    def value():
        nonlocal at
        m = tokens[at]
        at += 1
        if m["mark"] == "[":
            out = []
            while tokens[at]["mark"] != "]":
                if tokens[at]["mark"] == ",":
                    at += 1
                else:
                    out.append(value())
            at += 1
            return out
        if m["text"]:
            return re.sub(r"\\(.)", r"\1", m["text"][1:-1])
        return int(m["word"]) if re.fullmatch(r"-?\d+", m["word"] or "") else m["word"]

    def section() -> dict:
        nonlocal at
        out = {}
        while at < len(tokens) and tokens[at]["mark"] != "}":
            name = tokens[at]["word"]
            at += 2
            if tokens[at - 1]["mark"] == "=":
                out[name] = value()
            else:
                out[name] = section()
                at += 1
        return out

    return section()


def metadata(data: bytes, areas: list[tuple[int, int]]) -> dict | None:
    for start, _ in areas:
        if data[start + 4 : start + 20] != AREA:
            continue
        size = struct.unpack_from("<Q", data, start + 32)[0]
        offset, length = struct.unpack_from("<QQ", data, start + 40)
        # The text may go round the area's end, to right after its header.
        ring = data[start + 512 : start + size]
        raw = (ring + ring)[offset - 512 : offset - 512 + length]
        return parsed(raw.rstrip(b"\0").decode("utf-8", "replace"))
    return None


@extractor("lvm2")
def lvm2(data: bytes) -> Iterator[Entry]:
    label = next(s * SECTOR for s in range(4) if data[s * SECTOR : s * SECTOR + 8] == b"LABELONE")
    at = label + struct.unpack_from("<I", data, label + 20)[0]
    own, lists = data[at : at + 32].decode("ascii", "replace"), []
    at += 40
    for _ in range(2):  # data areas, then metadata areas
        found = []
        while (pair := struct.unpack_from("<QQ", data, at)) != (0, 0):
            found.append(pair)
            at += 16
        at += 16
        lists.append(found)
    tree = metadata(data, lists[1])
    if tree is None:
        yield Entry("", problem="there is no metadata", resolution="Not unpacked.", severity="ERROR")
        return
    group = next(v for v in tree.values() if isinstance(v, dict) and "physical_volumes" in v)
    extent = group["extent_size"] * SECTOR
    mine = {n: v["pe_start"] * SECTOR for n, v in group["physical_volumes"].items() if str(v["id"]).replace("-", "") == own}
    for name, volume in group.get("logical_volumes", {}).items():
        segments = [v for k, v in volume.items() if isinstance(v, dict) and k.startswith("segment")]
        size = max([0, *((s["start_extent"] + s["extent_count"]) * extent for s in segments)])
        if size > MOST:
            yield Entry(f"{name}.img", problem="the volume is larger than a row may hold", resolution="Skipped.", severity="ERROR")
            continue
        image = bytearray(size)
        problems = []
        for s in segments:
            stripes = s.get("stripes", [])
            if s.get("type") != "striped" or s.get("stripe_count") != 1:
                problems.append(f"a segment of type {s.get('type')} isn't supported")
            elif stripes[0] not in mine:
                problems.append(f"a segment is on {stripes[0]}")
            else:
                start, length = mine[stripes[0]] + stripes[1] * extent, s["extent_count"] * extent
                piece = data[start : start + length]
                image[s["start_extent"] * extent : s["start_extent"] * extent + len(piece)] = piece
                if len(piece) < length:
                    problems.append("a segment ends beyond the file")
        yield Entry(f"{name}.img", content=bytes(image), problem="; ".join(problems) or None, resolution="A hole was left." if problems else None, severity="WARNING" if problems else None)
