"""Files in several parts: which sets there are, which are valid, and their content put together."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelode.functions import binary as b
from bytelode.sources.files import groups


@dataclass(frozen=True)
class Parts:
    """name; pattern with a group for the stem and one for the part; first: the part that a set must have; least: so many;
    valid: of the first bytes of all parts and the set's length; each: of the whole content of a part, where the part is."""

    name: str
    pattern: str
    first: str | None
    least: int
    valid: Callable[[list[bytes], int], bool]
    each: Callable[[Column], Column] = lambda content: F.lit(True)


def sevenzip(heads: list[bytes], length: int) -> bool:
    h = heads[0]
    return h[:6] == b"7z\xbc\xaf\x27\x1c" and zlib.crc32(h[12:32]) == int.from_bytes(h[8:12], "little") and length == 32 + int.from_bytes(h[12:20], "little") + int.from_bytes(h[20:28], "little")


def gzip(heads: list[bytes], length: int) -> bool:
    return heads[0][:3] == b"\x1f\x8b\x08" and heads[0][3] < 0x20


def par2(content: Column) -> Column:
    """Whether the first packet, whatever its length, has the checksum that it says."""
    size = b.integer(content, 8, 8)
    known = size.between(64, F.octet_length(content)) & (F.substring(content, 1, 8) == F.lit(b"PAR2\0PKT"))
    body = content.substr(F.lit(33), (size - 32).cast("int"))
    return F.coalesce(F.when(known, F.md5(body) == F.lower(F.hex(F.substring(content, 17, 16)))), F.lit(False))


KINDS = (
    Parts("multi-sevenzip", r"^(.+\.7z)\.(\d+)$", "001", 1, sevenzip),
    Parts("multi-gzip", r"^(.+\.gz)\.(.+)$", None, 1, gzip),
    Parts("multi-par2", r"^(.+?)(?:\.vol\d+\+\d+)?\.(par2)$", None, 2, lambda heads, length: True, par2),
)
HEAD = 64


def checked(kind: Parts):
    def valid(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path")
        length = int(pdf["length"].iloc[0])
        row = (kind.name, pdf["folder"].iloc[0], pdf["stem"].iloc[0], list(pdf["path"]), length)
        good = pdf["sound"].all() and kind.valid([bytes(h) for h in pdf["head"]], length)
        return pd.DataFrame([row] if good else [], columns=["handler", "folder", "name", "paths", "length"])

    return valid


def multi_files(files: DataFrame, kinds: tuple[Parts, ...] = KINDS) -> DataFrame:
    """(handler, folder, name, paths, length) of valid sets.  Of each part, its first bytes and what ``each`` finds are passed on."""
    out = None
    for kind in kinds:
        sets = groups(files, kind.pattern).filter(F.col("parts") >= kind.least)
        if kind.first:
            sets = sets.filter(F.col("first").endswith(f".{kind.first}"))
        ours = files.filter(F.element_at(F.split("path", "/"), -1).rlike(kind.pattern))
        looked = ours.select("path", F.substring("content", 1, HEAD).alias("head"), kind.each(F.col("content")).alias("sound"))
        heads = sets.select("folder", "stem", F.explode("paths").alias("path"), "length").join(looked, "path")

        found = heads.groupBy("folder", "stem").applyInPandas(checked(kind), "handler string, folder string, name string, paths array<string>, length long")
        out = found if out is None else out.unionByName(found)
    return out
