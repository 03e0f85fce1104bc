import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from bytelode import plugins
from bytelode.functions import binary as b
from bytelode.operators import scan
from bytelode.operators.multifile import multi_files
from bytelode.queries import HUMAN, QUERIES, SQL
from bytelode.sources import files as source
from bytelode.streaming import arrivals
from test_formats import zipped


def test_read_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.bin").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "d" / "b.rlib").write_bytes(b"12345")
    (tmp_path / "c").write_bytes(b"12345")
    (tmp_path / "empty").write_bytes(b"")
    files = source.read_files(spark, str(tmp_path))
    assert files.count() == 3  # Spark's reader gives no row for an empty file
    assert [r.path.rsplit("/", 1)[1] for r in source.to_search(files).collect()] == ["c"]
    assert source.to_search(files, depth=10).count() == 0
    row = source.hashes(files.filter(F.col("path").endswith("c"))).first()
    assert row.sha256 == hashlib.sha256(b"12345").hexdigest()
    plan = files.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan[plan.index("ReadSchema") :]


def test_children(spark):
    paths = lambda *x: spark.createDataFrame([(p,) for p in x], "path string") if x else spark.createDataFrame([], "path string")
    assert [r.path for r in source.children(paths("a", "b", "c"), paths("a"), paths("c")).collect()] == ["b"]


def parts(spark, rows):
    return spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], "path string, length long, content binary")


def test_multi_files(spark):
    body = b"x" * 100
    head = (0).to_bytes(2, "little") + b"\0\0"
    start = (80).to_bytes(8, "little") + (20).to_bytes(8, "little") + b"\0" * 4
    seven = b"7z\xbc\xaf\x27\x1c\0\4" + zlib.crc32(start).to_bytes(4, "little") + start + body
    packet = b"PAR2\0PKT" + (64).to_bytes(8, "little") + hashlib.md5(b"p" * 32).digest() + b"p" * 32
    rows = [("/d/a.7z.001", seven[:50]), ("/d/a.7z.002", seven[50:]), ("/d/bad.7z.001", b"7z" + head), ("/d/x.par2", packet), ("/d/x.vol0+1.par2", packet), ("/d/y.par2", packet), ("/d/g.gz.aa", b"\x1f\x8b\x08\0rest")]
    found = multi_files(parts(spark, rows)).collect()
    assert {(r.handler, r.name, tuple(p.rsplit("/", 1)[1] for p in r.paths)) for r in found} == {("multi-sevenzip", "a.7z", ("a.7z.001", "a.7z.002")), ("multi-par2", "x", ("x.par2", "x.vol0+1.par2")), ("multi-gzip", "g.gz", ("g.gz.aa",))}


def test_par2_with_large_packets(spark):
    """A recovery packet holds a whole block, which may be larger than any prefix."""
    body = b"p" * 32 + bytes(range(256)) * 12_000
    packet = b"PAR2\0PKT" + (32 + len(body)).to_bytes(8, "little") + hashlib.md5(body).digest() + body
    small = b"PAR2\0PKT" + (64).to_bytes(8, "little") + hashlib.md5(b"p" * 32).digest() + b"p" * 32
    rows = [("/d/x.par2", small + b"more"), ("/d/x.vol0+1.par2", packet + small), ("/d/y.par2", small), ("/d/y.vol0+1.par2", packet[:-1]), ("/d/z.par2", small), ("/d/z.vol0+1.par2", packet[:-1] + b"x"), ("/d/s.par2", small), ("/d/s.vol.par2", b""), ("/d/s.vol0+1.par2", small[:40])]
    assert [(r.handler, r.name, len(r.paths)) for r in multi_files(parts(spark, rows)).collect()] == [("multi-par2", "x", 2)]


def test_collisions(spark):
    sets = spark.createDataFrame([(["a", "b"],), (["b", "c"],)], "paths array<string>")
    assert [(r.path, r.sets) for r in source.collisions(sets).collect()] == [("b", 2)]


def test_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04\xff\xff\xff\xff\xff\xff\xff\xff"), 1000, 1536)], "c binary, n long, s long")
    row = df.select(
        b.integer(F.col("c"), 0, 4).alias("le"), b.integer(F.col("c"), 0, 4, True).alias("be"), b.integer(F.col("c"), 4, 8).alias("big"), b.integer(F.col("c"), 10, 4).alias("short"), b.round_up(F.col("n"), 512).alias("up"),
        b.human_size(F.col("s")).alias("size"), b.single_byte(F.substring("c", 5, 8)).alias("one"), b.single_byte(F.col("c")).alias("many"), b.range_hex(F.col("n"), F.col("s")).alias("hex"),
    ).first()
    assert (row.le, row.be, int(row.big), row.short, row.up, row.size, row.one, row.many, row.hex) == (0x04030201, 0x01020304, 2**64 - 1, None, 1024, "1.50 KB", True, False, "0x3e8-0x600")


def test_human_sizes_round_half_to_even(spark):
    """As SQL's printf does: ties, carries, negative sizes, and sizes that no double holds."""
    sizes = [0, -1536, 1023, 1024, 1152, 1408, 1664, 1920, 1024**2 - 1, 1024**2 + 131072, 1024**3 * 5 // 8, 1024**4 * 3 + 1024**4 // 8, 2**53 + 1, 2**63 - 1, -(2**63)]
    found = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", b.human_size(F.col("n")).alias("shown")).collect()
    rows = ", ".join(f"({n}::BIGINT)" if n > -(2**63) else "((-9223372036854775807 - 1)::BIGINT)" for n in sizes)
    assert {r.n: r.shown for r in found} == dict(duckdb.sql(f"SELECT n, {HUMAN.format(x='n')} FROM (VALUES {rows}) v(n)").fetchall())
    assert {r.n: r.shown for r in found}[1152] == "1.12 KB"


def test_half_sizes_go_to_even_numbers(spark, tmp_path):
    spark.createDataFrame([(1, 0.5), (1, 1.5), (3, 0.5), (5, 0.5)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert sorted(map(tuple, QUERIES["human_size"](spark, str(tmp_path)).collect())) == sorted(duck.execute(SQL["human_size"]).fetchall())


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"junk" + zipped() + b"tail")
    for n in range(2):
        arrivals.write(arrivals.found(arrivals.arriving(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == n + 1
        (tmp_path / "in" / "b").write_bytes(zipped())


def test_plugins(spark, tmp_path):
    (tmp_path / "mine.py").write_text("from bytelode.formats import Format\ndef formats():\n    return [Format('mine', 'toy', ('6d 69 6e 65 21',), 0, lambda r: 8, None, '')]\n")
    (found,) = plugins.load(tmp_path)
    assert scan.Scanner([found]).search(b"..mine!123..") == [("mine", 2, 10, False, None, None)]
    (tmp_path / "bad.py").write_text("def formats():\n    return [1]\n")
    with pytest.raises(plugins.PluginError):
        plugins.load(tmp_path)
    assert plugins.installed() == ()
