"""Search for embedded objects: one pass of all patterns over a blob, then a sweep that depends on order.

Anchors (the longest literal of each pattern that is no run of one byte, as padding is full of those) are found together by an
Aho-Corasick automaton; a pattern's regex is tried only where its anchor is.  The sweep goes through hits in order of their end, skips what lies in an accepted chunk,
asks the format for the exact range, and after each accepted chunk starts anew at its end.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from bytelode.formats import FORMATS, Format
from bytelode.functions.batches import map_batches
from bytelode.functions.patterns import TOKEN, compiled

CHUNKS = "file_id string, handler string, start long, end long, is_encrypted boolean, severity string, error string"
NAMES = [x.split()[0] for x in CHUNKS.split(", ")]


def anchor(pattern: str) -> tuple[int, bytes] | None:
    """(offset, bytes) of the longest literal at a fixed offset of the pattern, if it has three bytes or more, not all the same."""
    runs: list[tuple[int, bytes]] = []
    at, offset, depth = 0, 0, 0
    if pattern.startswith("re:"):
        found = re.match(r"(?:\\x([0-9A-Fa-f]{2})|([A-Za-z0-9_#-](?![*+?{])))+", pattern[3:])
        if found and "|" not in pattern[3 : 3 + found.end() + 1]:
            runs.append((0, b"".join(bytes([int(h, 16)]) if h else c.encode() for h, c in re.findall(r"\\x([0-9A-Fa-f]{2})|(.)", found[0]))))
    else:
        run, start, fixed = b"", 0, True
        while at < len(pattern) and fixed:
            m = TOKEN.match(pattern, at)
            at = m.end()
            if m["byte"] and "?" not in m["byte"]:
                run, offset = run + bytes.fromhex(m["byte"]), offset + 1
                continue
            if not (m["byte"] or m["low"] or m["mark"]):
                continue
            runs.append((start, run))
            if m["byte"]:
                offset += 1
            elif m["low"]:
                fixed, offset = not m["high"], offset + int(m["low"])
            elif m["mark"] == "(":
                # A group counts where all its parts have one width.
                close = depth + 1
                widths, width = set(), 0
                while close:
                    m = TOKEN.match(pattern, at)
                    at = m.end()
                    if m["mark"] == "(":
                        close, fixed = close + 1, False
                    elif m["mark"] == ")":
                        close -= 1
                    elif m["mark"] == "|":
                        widths.add(width)
                        width = 0
                    elif m["byte"]:
                        width += 1
                    elif m["low"]:
                        width, fixed = width + int(m["low"]), fixed and not m["high"]
                widths.add(width)
                fixed, offset = fixed and len(widths) == 1, offset + width
            run, start = b"", offset
        runs.append((start, run))
    best = max((r for r in runs if len(set(r[1])) > 1), key=lambda r: len(r[1]), default=(0, b""))
    return best if len(best[1]) >= 3 else None


@dataclass(frozen=True)
class Hit:
    end: int
    order: int
    start: int


class Ranges:
    """A union of ranges; looked up by bisection."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> None:
        low, high = bisect.bisect_left(self.ends, start), bisect.bisect_right(self.starts, end)
        if low < high:
            start, end = min(start, self.starts[low]), max(end, self.ends[high - 1])
        self.starts[low:high], self.ends[low:high] = [start], [end]

    def __contains__(self, at: int) -> bool:
        i = bisect.bisect_right(self.starts, at)
        return i > 0 and at < self.ends[i - 1]


class Scanner:
    """All patterns of some formats, compiled once."""

    def __init__(self, formats: Sequence[Format]):
        self.formats = tuple(formats)
        self.regexes, self.anchored, self.loose = [], [], []
        self.started: dict[int, re.Pattern] = {}
        self.automaton = ahocorasick.Automaton()
        literals: dict[bytes, list[tuple[int, int]]] = {}
        for order, f in enumerate(self.formats):
            for pattern in f.patterns:
                k = len(self.regexes)
                self.regexes.append((compiled(pattern), order))
                if r"\A" in (raw := self.regexes[k][0].pattern.decode("latin-1")):
                    self.anchored.append(k)
                    # Matched at a place, which is the start of what is scanned, to whatever length.
                    self.started[k] = re.compile(raw.replace(r"\A", "").encode("latin-1"), self.regexes[k][0].flags)
                elif found := anchor(pattern):
                    literals.setdefault(found[1], []).append((found[0], k))
                else:
                    # Bytes of any kind at the beginning are stepped over, not matched at every place.
                    lead = re.match(r"\s*\[\s*(\d+)\s*\]", pattern)
                    rest = pattern[lead.end() :] if lead and pattern[lead.end() :].strip() else pattern
                    self.loose.append((k, int(lead[1]) if rest is not pattern else 0, compiled(rest)))
        for literal, users in literals.items():
            self.automaton.add_word(literal.decode("latin-1"), (len(literal), users))
        if literals:
            self.automaton.make_automaton()
        self.ready = bool(literals)

    def hits(self, data: bytes) -> list[Hit]:
        out = set()
        if self.ready:
            for last, (size, users) in self.automaton.iter(data.decode("latin-1")):
                for offset, k in users:
                    start = last - size + 1 - offset
                    if start >= 0 and (m := self.regexes[k][0].match(data, start)):
                        out.add(Hit(m.end(), self.regexes[k][1], start))
        for k, lead, regex in self.loose:
            at = lead
            while m := regex.search(data, at):
                out.add(Hit(m.end(), self.regexes[k][1], m.start() - lead))
                at = m.start() + 1
        return sorted(out, key=lambda h: (h.end, h.order, h.start))

    def at_start(self, data: bytes, at: int) -> Iterator[Hit]:
        """Hits of the patterns that are tied to the start of what is scanned."""
        for k in self.anchored:
            if m := self.started[k].match(data, at):
                yield Hit(m.end(), self.regexes[k][1], at)

    def search(self, data: bytes) -> list[tuple]:
        """(handler, start, end, is_encrypted, severity, error): chunks, and errors with null end."""
        queue = [(h.end, h.order, h.start) for h in [*self.hits(data), *self.at_start(data, 0)]]
        heapq.heapify(queue)
        out: list[tuple] = []
        accepted = Ranges()
        cursor = 0
        while queue:
            _, order, start = heapq.heappop(queue)
            f = self.formats[order]
            real = start + f.offset
            # Scanning starts anew at the end of each chunk: what began before it is not seen.
            if start < cursor or real < 0 or real in accepted:
                continue
            try:
                span = f.span(data, real)
            except Exception as e:  # a defect of a format must not hide other chunks: it becomes a row
                out.append((f.name, real, None, None, "ERROR", f"{type(e).__name__}: {e}"))
                continue
            if span is None or span.end > len(data):
                continue
            accepted.add(span.start, span.end)
            out.append((f.name, span.start, span.end, span.encrypted, None, None))
            if span.end <= max(cursor, start):
                out.append((f.name, span.start, None, None, "WARNING", "the chunk ends before its mark"))
            else:
                cursor = span.end
                for h in self.at_start(data, cursor):
                    heapq.heappush(queue, (h.end, h.order, h.start))
        return out


@lru_cache(maxsize=8)
def scanner(names: tuple[str, ...] | None = None, extra: tuple[Format, ...] = ()) -> Scanner:
    return Scanner([*extra, *(f for f in FORMATS if names is None or f.name in names)])


def search_chunks(blobs: DataFrame, names: Iterable[str] | None = None, extra: tuple[Format, ...] = ()) -> DataFrame:
    """(file_id, content) to chunks and errors: see CHUNKS.  Each blob is searched where it is; nothing is shuffled."""
    chosen = tuple(sorted(names)) if names is not None else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(chosen, extra)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string())
        for batch in batches:
            out = [(i, *r) for i, x in zip(batch["file_id"].to_pylist(), batch["content"].to_pylist()) for r in own.search(x or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=NAMES)

    return map_batches(blobs.select(blobs["file_id"].cast("string").alias("file_id"), "content"), rows, CHUNKS)


def literal_hits(blobs: DataFrame, markers: dict[str, bytes]) -> DataFrame:
    """(file_id, marker, at): places of literals, those of one marker not overlapping."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {n: re.compile(re.escape(m)) for n, m in markers.items()}
        for batch in batches:
            out = [(i, n, m.start()) for i, x in zip(batch["file_id"].to_pylist(), batch["content"].to_pylist()) for n, p in found.items() for m in p.finditer(x or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["file_id", "marker", "at"])

    return map_batches(blobs.select(blobs["file_id"].cast("long").alias("file_id"), "content"), rows, "file_id long, marker string, at long")
