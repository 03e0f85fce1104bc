import io
import tarfile
import zipfile

import pytest

from bytelode.functions import paths
from bytelode.operators import extract
from test_formats import MADE, RAW, cpio, zipped


@pytest.mark.parametrize("name", ["bzip2", "xz", "lzma", "zstd", "zlib"])
def test_streams(name):
    assert [e.content for e in extract.unpack(MADE[name], name)] == [RAW]


def test_gzip_members_and_name():
    assert next(extract.unpack(MADE["gzip"], "gzip")).content == RAW + b"more"
    out = io.BytesIO()
    import gzip

    with gzip.GzipFile("dir/../name.bin", "wb", fileobj=out) as f:
        f.write(b"x")
    assert next(extract.unpack(out.getvalue(), "gzip")).path == "name.bin"


def test_archives():
    assert [(e.path, e.content) for e in extract.unpack(MADE["ar"], "ar")] == [("a.txt", b"123456")]
    assert [(e.path, e.content) for e in extract.unpack(MADE["tar"], "tar")] == [("a.txt", b"12345")]
    assert [(e.path, e.content) for e in extract.unpack(cpio(), "cpio_portable_ascii")] == [("a.txt", b"12345")]
    assert [e.path for e in extract.unpack(zipped(), "zip")] == ["a.txt"]
    assert [(e.path, e.type) for e in extract.unpack(MADE["deafbead"], "deafbead")] == [("ab", "dir"), ("c", "file")]
    assert [len(e.content) for e in extract.unpack(MADE["bneg"], "bneg")] == [30, 40]


def test_hostile_tar():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as f:
        for name, link in (("../up", None), ("/abs", None), ("a", None), ("a", None), ("esc", "../../etc"), ("ok", "a"), ("self", "self")):
            i = tarfile.TarInfo(name)
            if link:
                i.type, i.linkname = tarfile.SYMTYPE, link
            else:
                i.size = 1
            f.addfile(i, io.BytesIO(b"x"))
    got = list(extract.unpack(out.getvalue(), "tar"))
    assert [e.resolution for e in got] == ["Moved to lost and found.", "Made relative.", None, "Replaced it.", "Removed.", None, "Removed."]
    assert all(paths.safe(e.path) for e in got)


def test_crc_problem_is_kept():
    bad = cpio(b"070702").replace(b"12345", b"12346", 1)
    (e,) = extract.unpack(bad, "cpio_portable_ascii_crc")
    assert e.content == b"12346" and e.resolution == "Extracted anyway."


def test_damage_is_an_entry():
    assert [e.severity for e in extract.unpack(b"\x1f\x8b\x08\0broken stream of bytes", "gzip")] == ["ERROR"]
    assert [e.problem for e in extract.unpack(b"7z", "sevenzip")] == ["7z is needed"]
    assert [e.severity for e in extract.unpack(b"", "zip", encrypted=True)] == ["ERROR"]


@pytest.mark.parametrize("path, normal", [("a/b", "a/b"), ("a/../b", "b"), ("../b", None), ("/b", None), ("", None), ("a/./b/", "a/b"), ("a/../../b", None)])
def test_paths(path, normal):
    assert paths.normal(path) == normal


def test_links():
    assert paths.link_target("d/l", "/e/f") == "../e/f"
    assert paths.link_target("d/l", "../../x") is None
    assert paths.link_target("d/l", "l") is None
    assert paths.link_target("l", "") is None
    assert paths.safe(paths.lost_and_found("../../etc/passwd"))


def test_frame(spark):
    df = spark.createDataFrame([("c", "zip", bytearray(zipped()), False), ("n", "zip", None, False)], "chunk_id string, handler string, content binary, is_encrypted boolean")
    rows = extract.entries(df).collect()
    assert {(r.parent_id, r.path, r.severity) for r in rows} == {("c", "a.txt", None), ("n", "", "ERROR")}


def test_zip_link():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        i = zipfile.ZipInfo("l")
        i.external_attr = 0o120777 << 16
        f.writestr(i, "/etc/passwd")
    assert [(e.type, e.link_target) for e in extract.unpack(out.getvalue(), "zip")] == [("link", "etc/passwd")]
