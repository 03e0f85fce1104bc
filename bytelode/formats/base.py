"""What a format is: patterns that find it and a rule that gives its exact range."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass


class Invalid(ValueError):
    """The bytes are not of this format."""


def need(condition: object) -> None:
    if not condition:
        raise Invalid


@dataclass(frozen=True)
class Span:
    """Offsets in the blob, half open."""

    start: int
    end: int
    encrypted: bool = False


class Reader:
    """Fields at offsets from ``base``; reading beyond the blob raises EOFError."""

    def __init__(self, data: bytes, base: int, big: bool = False):
        self.data, self.base, self.big = data, base, big

    @property
    def left(self) -> int:
        return len(self.data) - self.base

    def raw(self, at: int, size: int) -> bytes:
        start = self.base + at
        if start < 0 or size < 0 or start + size > len(self.data):
            raise EOFError
        return bytes(self.data[start : start + size])

    def upto(self, at: int, size: int) -> bytes:
        return bytes(self.data[max(0, self.base + at) : max(0, self.base + at + size)])

    def int(self, at: int, size: int, big: bool | None = None) -> int:
        return int.from_bytes(self.raw(at, size), "big" if (self.big if big is None else big) else "little")

    def u8(self, at: int) -> int:
        return self.int(at, 1)

    def u16(self, at: int) -> int:
        return self.int(at, 2)

    def u32(self, at: int) -> int:
        return self.int(at, 4)

    def u64(self, at: int) -> int:
        return self.int(at, 8)

    def be(self) -> Reader:
        return Reader(self.data, self.base, True)

    def either(self, big: bytes, at: int = 0) -> Reader:
        """Big-endian if these bytes are found, else little."""
        return Reader(self.data, self.base, self.raw(at, len(big)) == big)

    def text(self, at: int, size: int) -> str:
        raw = self.raw(at, size).split(b"\0", 1)[0]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError as e:
            raise Invalid from e

    def find(self, what: bytes, at: int = 0) -> int:
        """Offset of the next place, -1 if there is none."""
        found = self.data.find(what, self.base + at)
        return found - self.base if found >= 0 else -1

    def crc(self, at: int, size: int, start: int = 0) -> int:
        return zlib.crc32(self.raw(at, size), start)

    def skip(self, at: int, values: bytes) -> int:
        """The first offset from ``at`` that holds none of these bytes."""
        pos = self.base + at
        while pos < len(self.data):
            block = bytes(self.data[pos : pos + 65536])
            rest = block.lstrip(values)
            pos += len(block) - len(rest)
            if rest:
                break
        return pos - self.base


#: Takes a reader at the start; gives the size, or a Span.
Rule = Callable[[Reader], "int | Span"]


@dataclass(frozen=True)
class Format:
    name: str
    kind: str
    patterns: tuple[str, ...]
    offset: int
    rule: Rule
    tool: str | None
    note: str

    def span(self, data: bytes, start: int) -> Span | None:
        """The range of what starts (or is marked) here; None if it isn't this format.  Other errors are the caller's."""
        try:
            found = self.rule(Reader(data, start))
        except (Invalid, EOFError):
            return None
        out = found if isinstance(found, Span) else Span(start, start + found)
        return out if 0 <= out.start < out.end else None


REGISTRY: list[Format] = []


def fmt(name: str, kind: str, *patterns: str, offset: int = 0, tool: str | None = None, note: str = "") -> Callable[[Rule], Rule]:
    """Registers a rule; ``tool``: the command that unpacks the format, where the library doesn't."""

    def add(rule: Rule) -> Rule:
        REGISTRY.append(Format(name, kind, patterns, offset, rule, tool, note))
        return rule

    return add


def up(x: int, to: int) -> int:
    return -(-x // to) * to
