"""Known formats; ``FORMATS`` lists them in the order in which equal hits are tried."""

from bytelode.formats import alpha, archive, compression, executable, filesystem  # noqa: F401
from bytelode.formats.base import REGISTRY, Format, Invalid, Reader, Span

FORMATS: tuple[Format, ...] = tuple(REGISTRY)

__all__ = ["FORMATS", "Format", "Invalid", "Reader", "Span"]
