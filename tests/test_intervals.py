import random

import pytest

from bytelode.operators import intervals

CHUNKS = "file_id string, handler string, start long, end long"


def chunks(spark, ranges, file_id="f"):
    return spark.createDataFrame([(file_id, "h", a, b) for a, b in ranges], CHUNKS)


@pytest.mark.parametrize(
    "ranges, expected",
    [
        ([(0, 5), (1, 2)], [(0, 5)]),
        ([(11, 13), (10, 20), (14, 19)], [(10, 20)]),
        ([(1, 5), (2, 3), (6, 10), (7, 8)], [(1, 5), (6, 10)]),
        ([(1, 5), (1, 5)], [(1, 5), (1, 5)]),
        ([(0, 5), (3, 8)], [(0, 5), (3, 8)]),
        ([], []),
    ],
)
def test_outer(spark, ranges, expected):
    assert sorted((r.start, r.end) for r in intervals.outer(chunks(spark, ranges)).collect()) == expected


def test_outer_against_pairs(spark):
    rng = random.Random(3)
    rows = [(str(f), "h", a, a + rng.randint(1, 9)) for f in range(60) for a in [rng.randint(0, 12) for _ in range(6)]]
    inside = lambda x, y: y[0] == x[0] and y[2] <= x[2] and y[3] >= x[3] and (y[2], y[3]) != (x[2], x[3])
    expected = sorted(r for r in rows if not any(inside(r, o) for o in rows))
    assert sorted(tuple(r) for r in intervals.outer(spark.createDataFrame(rows, CHUNKS)).select("file_id", "handler", "start", "end").collect()) == expected


@pytest.mark.parametrize(
    "ranges, size, expected",
    [
        ([], 10, []),
        ([(0, 5), (5, 10)], 12, [(10, 12)]),
        ([(3, 5)], 5, [(0, 3)]),
        ([(8, 10), (0, 5), (15, 20)], 20, [(5, 8), (10, 15)]),
    ],
)
def test_gaps(spark, ranges, size, expected):
    files = spark.createDataFrame([("f", size)], "file_id string, length long")
    assert sorted((r.start, r.end) for r in intervals.gaps(chunks(spark, ranges), files).collect()) == expected


def test_overlap_is_a_row(spark):
    files = spark.createDataFrame([("f", 8)], "file_id string, length long")
    rows = intervals.gaps(chunks(spark, [(0, 5), (3, 8)]), files).collect()
    assert [(r.start, r.end, r.overlap) for r in rows] == [(3, 5, True)]


def test_padding(spark):
    files = spark.createDataFrame([("f", 9, bytearray(b"\xff\xff\xffABab\x00\x00"))], "file_id string, length long, content binary")
    found = intervals.padded(intervals.gaps(chunks(spark, [(3, 5)]), files), files)
    assert sorted((r.start, r.end, r.kind) for r in found.collect()) == [(0, 3, "padding"), (5, 9, "unknown")]


def test_mode_takes_the_smallest_of_ties(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 3), ("a", 1), ("a", 1), ("a", 2)], "k string, v int")
    assert [(r.v, r.n) for r in intervals.mode(rows, "k", "v").collect()] == [(1, 2)]
