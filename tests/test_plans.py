import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from bytelode.plans import recursion, reports

FILES = "file_id string, path string, length long, content binary"


def zipped(name, data):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        f.writestr(name, data)
    return out.getvalue()


def nested():
    inner = zipped("hello.kitty", "Hello")
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as f:
        i = tarfile.TarInfo("inner.zip")
        i.size = len(inner)
        f.addfile(i, io.BytesIO(inner))
    return b"junk" + gzip.compress(out.getvalue()) + b"\xff\xff\xff"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    data = nested()
    files = spark.createDataFrame([("f", "/in/f", len(data), bytearray(data)), ("e", "/in/e", 0, bytearray(b"")), ("p", "/in/p.png", 12, bytearray(b"\x89PNG\r\n\x1a\n1234")), ("t", "/in/t", 5, bytearray(b"plain"))], FILES)
    return recursion.analyse(files, str(tmp_path_factory.mktemp("analysis")))


def test_levels(made):
    assert {(r.handler, r.depth) for r in made.chunks.collect()} == {("gzip", 0), ("tar", 1), ("zip", 2)}
    assert made.entries.filter("path = 'hello.kitty'").first().content == b"Hello"
    assert [r["count"] for r in made.tasks.groupBy("depth").count().orderBy("depth").collect()] == [4, 1, 1, 1]


def test_parents(made):
    ids = made.chunks.select(F.col("chunk_id").alias("blob_id"))
    assert made.tasks.filter("depth > 0").join(ids, "blob_id").count() == 3


def test_gaps_and_randomness(made):
    assert {(r.kind, r.start) for r in made.gaps.filter("depth = 0").collect()} >= {("unknown", 0)}
    assert made.gaps.filter("depth = 0 AND kind = 'padding'").count() == 1
    assert {r.file_id for r in made.randomness.collect()} == {"f", "t"}


def test_depth_limit(spark, tmp_path):
    data = nested()
    files = spark.createDataFrame([("f", "/f", len(data), bytearray(data))], FILES)
    got = recursion.analyse(files, str(tmp_path), recursion.Config(max_depth=1))
    assert {r.handler for r in got.chunks.collect()} == {"gzip"}
    only = recursion.analyse(files, str(tmp_path), recursion.Config(skip_extraction=True))
    assert only.entries.count() == 0 and only.chunks.count() == 1


def test_reports(made):
    rows = reports.of_analysis(made)
    counts = {r.typename: r["count"] for r in rows.groupBy("typename").count().collect()}
    assert counts["ChunkReport"] == 4 and counts["StatReport"] == 7
    texts = reports.to_json(rows)
    assert all("__typename__" in json.loads(r.json) for r in texts.collect())
    assert sorted(map(str, reports.from_json(texts).collect())) == sorted(map(str, rows.collect()))


def test_unknown_type_raises(spark):
    for text in ('{"__typename__": "NoSuch"}', "{}"):
        with pytest.raises(Exception, match="unknown type"):
            reports.from_json(spark.createDataFrame([("f", text)], "file_id string, json string")).collect()
    with pytest.raises(reports.UnknownType):
        reports.reports(spark.createDataFrame([("f",)], "file_id string"), "NoSuch")
    with pytest.raises(ValueError):
        reports.register("StatReport", ())


def test_summaries(spark):
    chunks = spark.createDataFrame([("zip", 2048), ("zip", 1024), ("padding", 1024)], "handler string, size long")
    rows = reports.ranked(reports.distribution(chunks)).collect()
    assert [(r.handler, r.shown, r.percent) for r in rows] == [("zip", "3.00 KB", 75.0), ("padding", "1.00 KB", 25.0), ("unknown", "0.00 B", 0.0)]
    errors = spark.createDataFrame([("WARNING",)], "severity string")
    assert reports.exit_code(errors).first().exit_code == 0
    assert reports.exit_code(errors.union(spark.createDataFrame([("ERROR",)], "severity string"))).first().exit_code == 1
    assert reports.exit_code(errors.limit(0)).first().exit_code == 0


def test_tables(spark):
    assert reports.formats_table(spark).count() >= 91
    assert "7z" in {r.tool for r in reports.tools(spark).collect()}
    assert reports.plot([0, 50, 100]).count("#") == 15
    with pytest.raises(TypeError):
        reports.plot([])
