"""Hex patterns and their translation to regular expressions over bytes.

``00 ff`` bytes; ``??`` any byte; ``4?`` and ``?4`` any low or high half; ``[3]`` and ``[2-5]`` so many bytes of any kind;
``( 01 | 02 03 )`` alternatives, which nest; ``^`` first and ``$`` last tie to the ends; ``//`` starts a comment.
"""

from __future__ import annotations

import re
from functools import lru_cache

TOKEN = re.compile(r"\s+|//[^\n]*|(?P<byte>[0-9a-fA-F?]{2})|\[\s*(?P<low>\d+)\s*(?:-\s*(?P<high>\d+)\s*)?\]|(?P<mark>[()|^$])")
ANY = b"[\\x00-\\xff]"


class PatternError(ValueError):
    """The text is not a pattern."""


def byte_class(pair: str) -> bytes:
    high, low = pair.lower()
    if pair == "??":
        return ANY
    if high == "?":
        return b"[" + b"".join(b"\\x%x%s" % (h, low.encode()) for h in range(16)) + b"]"
    if low == "?":
        return b"[\\x%s0-\\x%sf]" % (high.encode(), high.encode())
    return b"\\x" + pair.lower().encode()


def to_regex(pattern: str) -> bytes:
    """The pattern as a byte regex, to be compiled with ``re.DOTALL``."""
    out: list[bytes] = []
    at, depth, filled, ended = 0, 0, False, False
    while at < len(pattern):
        m = TOKEN.match(pattern, at)
        if not m:
            raise PatternError(f"{pattern!r} at {at}")
        at = m.end()
        if m["byte"]:
            if ended:
                raise PatternError("$ is not last")
            out.append(byte_class(m["byte"]))
            filled = True
        elif m["low"]:
            if ended:
                raise PatternError("$ is not last")
            out.append(ANY + b"{%s}" % (f"{m['low']},{m['high']}" if m["high"] else m["low"]).encode())
            filled = True
        elif m["mark"] == "^":
            if out:
                raise PatternError("^ is not first")
            out.append(rb"\A")
        elif m["mark"] == "$":
            if not filled or depth or ended:
                raise PatternError("$ is not last")
            out.append(rb"\Z")
            ended = True
        elif m["mark"] == "(":
            depth += 1
            out.append(b"(?:")
            filled = False
        elif m["mark"]:
            if not depth or not filled:
                raise PatternError("empty or unopened alternative")
            depth -= m["mark"] == ")"
            out.append(m["mark"].encode())
            filled = m["mark"] == ")"
    if depth or not filled:
        raise PatternError("the pattern is empty or not closed")
    return b"".join(out)


@lru_cache(maxsize=1024)
def compiled(pattern: str) -> re.Pattern[bytes]:
    """A pattern, or after ``re:`` a regex of its own."""
    source = pattern[3:].encode("latin-1") if pattern.startswith("re:") else to_regex(pattern)
    return re.compile(source, re.DOTALL)


def java_regex(pattern: str) -> str:
    """The same for ``rlike`` on ISO-8859-1 text: ``(?s)`` and the regex."""
    return "(?s)" + to_regex(pattern).decode("latin-1")
