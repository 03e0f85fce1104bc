"""Send streams of a copy-on-write file system, replayed in memory: a log of commands in which the last writer wins."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import zstandard

from bytelode.operators.entry import Entry, extractor

SNAPSHOT, MKFILE, MKDIR, MKNOD, MKFIFO, MKSOCK, SYMLINK, RENAME, LINK, UNLINK, RMDIR = range(2, 13)
WRITE, CLONE, TRUNCATE, CHMOD, END, ENCODED_WRITE = 15, 16, 17, 18, 21, 25
SIZE, MODE, PATH, PATH_TO, PATH_LINK, FILE_OFFSET, DATA = 4, 5, 15, 16, 17, 18, 19
CLONE_PATH, CLONE_OFFSET, CLONE_LEN = 22, 23, 24
WHOLE_FILE, WHOLE, SKIPPED, COMPRESSION = 28, 29, 30, 31
MOST = 1 << 30


@lru_cache(maxsize=1)
def table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0x82F63B78 if i & 1 else 0)
        out.append(i)
    return out


def crc32c(data: bytes, crc: int = 0) -> int:
    """Castagnoli's checksum without its usual complements."""
    own = table()
    for byte in data:
        crc = crc >> 8 ^ own[(crc ^ byte) & 0xFF]
    return crc


def attributes(body: bytes, version: int) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 2 <= len(body):
        kind = int.from_bytes(body[at : at + 2], "little")
        if kind == DATA and version >= 2:
            out[kind] = body[at + 2 :]
            break
        size = int.from_bytes(body[at + 2 : at + 4], "little")
        out[kind] = body[at + 4 : at + 4 + size]
        at += 4 + size
    return out


class Tree:
    """Files by path: (kind, mode, content or target)."""

    def __init__(self):
        self.nodes: dict[str, list] = {}

    def write(self, path: str, offset: int, data: bytes) -> None:
        content = self.nodes[path][2]
        if offset + len(data) > MOST:
            raise ValueError("a file is larger than a row may hold")
        if len(content) < offset:
            content.extend(bytes(offset - len(content)))
        content[offset : offset + len(data)] = data

    def rename(self, path: str, to: str) -> None:
        for name in [n for n in self.nodes if n == path or n.startswith(path + "/")]:
            self.nodes[to + name[len(path) :]] = self.nodes.pop(name)


def opened(a: dict[int, bytes], number) -> bytes:
    kind, data = number(COMPRESSION), a.get(DATA, b"")
    if kind == 1:
        data = zlib.decompressobj().decompress(data)
    elif kind == 2:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    elif kind:
        raise ValueError("the compression isn't supported")
    return (data + bytes(max(0, number(WHOLE) - len(data))))[number(SKIPPED) :][: number(WHOLE_FILE)]


@extractor("btrfs_stream")
def btrfs_stream(data: bytes) -> Iterator[Entry]:
    version, at, tree = struct.unpack_from("<I", data, 13)[0], 17, Tree()
    while at + 10 <= len(data):
        size, command, said = struct.unpack_from("<IHI", data, at)
        body = data[at + 10 : at + 10 + size]
        good = crc32c(body, crc32c(data[at : at + 6] + bytes(4))) == said
        at += 10 + size
        if command == END:
            break
        if not good:
            yield Entry("", problem="the checksum of a command differs", resolution="Skipped.", severity="WARNING")
            continue
        a = attributes(body, version)
        number = lambda kind, a=a: int.from_bytes(a.get(kind, b""), "little")
        text = lambda kind, a=a: a.get(kind, b"").decode("utf-8", "surrogateescape")
        path = text(PATH)
        if command == SNAPSHOT:
            yield Entry("", problem="the stream is incremental", resolution="Not unpacked.", severity="ERROR")
            return
        try:
            if command == MKFILE:
                tree.nodes[path] = ["file", 0o644, bytearray()]
            elif command == MKDIR:
                tree.nodes[path] = ["dir", 0o755, None]
            elif command in (MKNOD, MKFIFO, MKSOCK):
                tree.nodes[path] = ["special", 0, None]
            elif command == SYMLINK:
                tree.nodes[path] = ["link", 0, text(PATH_LINK)]
            elif command == LINK:
                tree.nodes[path] = tree.nodes[text(PATH_LINK)]
            elif command == RENAME:
                tree.rename(path, text(PATH_TO))
            elif command in (UNLINK, RMDIR):
                tree.nodes.pop(path)
            elif command == WRITE:
                tree.write(path, number(FILE_OFFSET), a.get(DATA, b""))
            elif command == ENCODED_WRITE:
                tree.write(path, number(FILE_OFFSET), opened(a, number))
            elif command == CLONE:
                start = number(CLONE_OFFSET)
                tree.write(path, number(FILE_OFFSET), bytes(tree.nodes[text(CLONE_PATH)][2][start : start + number(CLONE_LEN)]))
            elif command == TRUNCATE:
                content = tree.nodes[path][2]
                if number(SIZE) > MOST:
                    raise ValueError("a file is larger than a row may hold")
                del content[number(SIZE) :]
                content.extend(bytes(number(SIZE) - len(content)))
            elif command == CHMOD:
                tree.nodes[path][1] = number(MODE) & 0o7777
        except (KeyError, TypeError, ValueError, zlib.error, zstandard.ZstdError) as e:
            yield Entry(path, problem=f"{type(e).__name__}: {e}", resolution="The command was skipped.", severity="WARNING")
    for path, (kind, mode, content) in tree.nodes.items():
        if kind == "file":
            yield Entry(path, content=bytes(content), mode=mode)
        elif kind == "link":
            yield Entry(path, "link", link_target=content)
        elif kind == "dir":
            yield Entry(path, "dir", mode=mode)
        else:
            yield Entry(path, "special", problem="a special file", resolution="Skipped.", severity="WARNING")
