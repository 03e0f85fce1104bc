"""Path safety as pure algebra: nothing here touches a disk."""

from __future__ import annotations

import hashlib
import posixpath


def normal(path: str) -> str | None:
    """The path below its root, without ``.`` and ``..``; None if it leaves the root or is absolute."""
    if not path or path.startswith("/") or "\0" in path:
        return None
    parts: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if not parts:
                return None
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


def safe(path: str) -> bool:
    return normal(path) is not None


def without_root(path: str) -> str:
    """An absolute path as one below the root."""
    return path.lstrip("/")


def lost_and_found(path: str) -> str:
    """Where an unsafe path goes: a folder named after its own, and its last part."""
    folder, name = posixpath.split(path)
    return f".lost+found/{hashlib.sha224(folder.encode('utf-8', 'surrogatepass')).hexdigest()[:16]}/{name.replace('..', '_') or '_'}"


def link_target(path: str, target: str, absolute_is_root: bool = True) -> str | None:
    """A symbolic link's target, seen from the link; absolute ones are made relative to the root.  None: it escapes or is itself."""
    folder = posixpath.dirname(path)
    if target.startswith("/"):
        if not absolute_is_root:
            return None
        inside = normal(without_root(target))
    else:
        inside = normal(posixpath.join(folder, target)) if target else None
    if inside is None or inside == normal(path):
        return None
    return posixpath.relpath(inside or ".", folder or ".")
