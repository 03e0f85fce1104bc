"""Unpackers that need no other program, those that do, and the sweep's ranges."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from bytelode import samples
from bytelode.functions import codecs
from bytelode.operators import extract, intervals
from bytelode.operators.scan import Ranges, scanner


def test_ranges_against_a_set():
    rng = random.Random(2)
    for _ in range(50):
        union, truth = Ranges(), set()
        for _ in range(30):
            start = rng.randrange(200)
            end = start + rng.randint(1, 30)
            union.add(start, end)
            truth |= set(range(start, end))
            assert all((x in union) == (x in truth) for x in range(0, 240, 3))
        assert union.starts == sorted(union.starts) and all(a < b for a, b in zip(union.ends, union.starts[1:]))


def test_many_chunks_are_linear():
    import time

    one = samples.gzip.compress(b"x", mtime=0) + b"\x11" * 9
    took = []
    for n in (2000, 8000):
        start = time.perf_counter()
        assert len(scanner().search(one * n)) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0]


def test_ranges_of_a_file_as_of_a_table(spark):
    rng = random.Random(3)
    rows = [(str(i), start := rng.randrange(40), start + rng.randint(1, 15)) for i in range(30) for _ in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "file_id string, start long, end long")
    lengths = df.select("file_id").distinct().withColumn("length", F.lit(60))
    outer = intervals.outer(df)
    of = {i: [(a, b) for f, a, b in rows if f == i] for i in {r[0] for r in rows}}
    kept = {i: [own[k] for k in intervals.outer_of(own)] for i, own in of.items()}
    assert sorted(map(tuple, outer.collect())) == sorted((i, *r) for i, own in kept.items() for r in own)
    gaps = [(r.file_id, r.start, r.end) for r in intervals.gaps(outer, lengths).collect() if not r.overlap]
    assert sorted(gaps) == sorted((i, *g) for i, own in kept.items() for g in intervals.gaps_of(own, 60))


def test_ciphers_are_inverse():
    rng = random.Random(4)
    for size in (16, 32):
        key, start, plain = rng.randbytes(size), rng.randbytes(16), rng.randbytes(80)
        assert codecs.aes_cbc_decrypt(codecs.aes_cbc_encrypt(plain, key, start), key, start) == plain


def test_lzo_matches():
    # Four literals, a match of 4 bytes 4 back that carries one literal, and the end.
    assert codecs.lzo1x(bytes([17 + 4]) + b"abcd" + bytes([(4 - 2 + 1) << 5 | 3 << 2 | 1, 0]) + b"e" + b"\x11\0\0", 100) == b"abcdabcde"
    # A long match of one byte over and over.
    assert codecs.lzo1x(bytes([17 + 4]) + b"zzzz" + bytes([32, 9, 0, 0]) + b"\x11\0\0", 100) == b"z" * (4 + 31 + 2 + 9)
    with pytest.raises(ValueError):
        codecs.lzo1x(bytes([17 + 4]) + b"abcd" + bytes([(4 - 2 + 1) << 5 | 7 << 2, 0]) + b"\x11\0\0", 100)


def test_lz4_blocks_that_reach_back():
    assert codecs.lz4_block(b"\x04\x04\x00", 100, b"abcd") == b"abcdabcd"[:8]


def test_lzw_widens():
    """Random bytes make a phrase each, so that codes grow to 10 bits; groups of eight codes are filled up."""
    data = random.Random(6).randbytes(700)
    table, free, bits, acc, at, group, w = {bytes([i]): i for i in range(256)}, 257, 9, 0, 0, 0, b""
    for c in data + b"":
        if w + bytes([c]) in table:
            w += bytes([c])
            continue
        acc |= table[w] << at
        at += bits
        table[w + bytes([c])] = free
        free, w = free + 1, bytes([c])
        if free > 1 << bits:
            at = group + -(-(at - group) // (8 * bits)) * 8 * bits
            bits, group = bits + 1, at
    acc |= table[w] << at
    packed = acc.to_bytes(-(-(at + bits) // 8), "little")
    assert bits == 10 and codecs.lzw(packed, 16, True) == data


def test_first_files_of_a_kernel():
    assert [(e.path, e.content) for e in extract.unpack(samples.kernel(), "elf64")] == [("initramfs", samples.cpio())]
    assert list(extract.unpack(samples.elf(False), "elf32")) == []


SCRIPT = """
import os, sys, time
mode, file, folder = sys.argv[1:]
open(os.path.join(folder, "a"), "wb").write(open(file, "rb").read()[::-1])
os.symlink("/etc/passwd", os.path.join(folder, "l"))
if mode == "late": time.sleep(30)
sys.exit(3 if mode == "bad" else 0)
"""


@pytest.mark.parametrize("mode, problem", [("good", None), ("bad", "x ended with 3"), ("late", "x took over")])
def test_commands(monkeypatch, mode, problem):
    monkeypatch.setitem(extract.COMMANDS, "x", (sys.executable, "-c", SCRIPT, mode, "{file}", "{folder}"))
    got = list(extract.command(b"abc", "x", timeout=5))
    assert [(e.path, e.content) for e in got if e.type == "file" and e.content] == [("a", b"cba")] and [e.path for e in got if e.type == "link"] == ["l"]
    assert [e.problem.startswith(problem) for e in got if e.problem] == ([True] if problem else [])


def test_commands_are_off_and_missing_ones_are_told(monkeypatch):
    assert [e.problem for e in extract.unpack(b"x", "cramfs")] == ["7z is needed"]
    monkeypatch.setitem(extract.COMMANDS, "7z", ("no-such-program", "{file}"))
    assert [e.problem for e in extract.unpack(b"x", "cramfs", commands=True)] == ["7z is needed"]
    assert [e.severity for e in extract.unpack(samples.made()["ecc"], "ecc")] == ["WARNING"]
