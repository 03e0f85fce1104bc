"""What unpacking gives, and who unpacks what."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Entry:
    path: str
    type: str = "file"
    content: bytes | None = None
    mode: int = 0o644
    link_target: str | None = None
    problem: str | None = None
    resolution: str | None = None
    severity: str | None = None


Extractor = Callable[[bytes], Iterator[Entry]]
EXTRACTORS: dict[str, Extractor] = {}


def extractor(*names: str) -> Callable[[Extractor], Extractor]:
    def add(f: Extractor) -> Extractor:
        EXTRACTORS.update(dict.fromkeys(names, f))
        return f

    return add
