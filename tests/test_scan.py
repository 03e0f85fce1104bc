import pytest

from bytelode.formats import FORMATS, Format, Invalid, Span
from bytelode.functions.patterns import compiled
from bytelode.operators.scan import Scanner, anchor, literal_hits, search_chunks


def toy(name, patterns, rule, offset=0):
    return Format(name, "toy", patterns, offset, rule, None, "")


def fails(error):
    def rule(r):
        raise error

    return rule


BUFFER = 1 << 16
TOYS = (
    toy("A", ("41",), lambda r: 5),
    toy("B", ("42 42", "42 43"), lambda r: 10, offset=-1),
    toy("D", ("44",), fails(Invalid())),
    toy("EOF", ("45 4f 46",), fails(EOFError())),
    toy("EXC", ("45 58 43",), fails(ValueError("broken"))),
    toy("L", ("4c",), lambda r: 2 * BUFFER),
)


def ranges(data):
    return [(s, e) for _, s, e, _, _, error in Scanner(TOYS).search(data) if error is None]


@pytest.mark.parametrize(
    "data, expected",
    [
        (b"", []), (b"00A23450", [(2, 7)]), (b"0BB34A678900", [(0, 10)]), (b"A23450BB3456789", [(0, 5), (5, 15)]), (b"0BC34A67890A2345", [(0, 10), (11, 16)]), (b"A23450BB34", [(0, 5)]),
        (b"0BBA2345", [(3, 8)]), (b"BB34A678900", [(4, 9)]), (b"EOFA2345", [(3, 8)]), (b"DA2345", [(1, 6)]), (b"L" + b"1" * BUFFER + b"A2345" + b"1" * BUFFER, [(0, 2 * BUFFER)]),
    ],
)
def test_sweep(data, expected):
    assert ranges(data) == expected


def test_errors_are_rows():
    found = Scanner(TOYS).search(b"EXCA2345")
    assert [(r[0], r[1], r[2]) for r in found] == [("EXC", 0, None), ("A", 3, 8)]
    assert found[0][4:] == ("ERROR", "ValueError: broken")


def test_backward_chunks_do_not_loop():
    back = toy("back", ("5a 5a",), lambda r: Span(0, r.base - 1))
    found = Scanner((back,)).search(b"....ZZ..ZZ")
    assert ("back", 0, 3, False, None, None) in found and any(r[4] == "WARNING" for r in found)


def test_tied_patterns_match_again_after_a_chunk():
    tied = toy("T", ("^ 58 59",), lambda r: 3)
    assert [r[1:3] for r in Scanner((tied,)).search(b"XY1XY2.XY3")] == [(0, 3), (3, 6)]


def test_anchors():
    assert anchor("( 00 | 01 ) 41 42 43 ??") == (1, b"ABC")
    assert anchor("( 00 | 01 02 ) 41 42 43") is None
    assert anchor("[2] 41 42 43 44") == (2, b"ABCD")
    assert anchor("41 42") is None


def test_padding_is_no_anchor():
    """A run of one byte, which padding is full of, is not where a regex is tried; what it would have found is found."""
    assert anchor("[2] 13 ( 7f | 8f ) 00 00 00 00") is None and anchor("00 00 00 00 41 42 43") == (0, bytes(4) + b"ABC")
    own = Scanner([toy("a", ["[2] 13 ( 7f | 8f ) 00 00 00 00"], lambda r: 8)])
    data = bytes(50) + b"\x13\x7f" + bytes(9) + b"\x13\x8f" + bytes(4)
    whole = compiled("[2] 13 ( 7f | 8f ) 00 00 00 00")
    assert [(h.start, h.end) for h in own.hits(data)] == [(m.start(), m.end()) for at in range(len(data)) if (m := whole.match(data, at))] == [(48, 56), (59, 67)]
    assert own.hits(b"\x13\x7f" + bytes(4)) == []
    every = Scanner(FORMATS)
    assert not any(True for _ in every.automaton.iter("\0" * 1000 + "\xff" * 1000))


def test_frame(spark):
    df = spark.createDataFrame([("x", bytearray(b"00A23450")), ("y", bytearray(b"")), ("z", None)], "file_id string, content binary")
    assert [(r.file_id, r.handler, r.start, r.end) for r in search_chunks(df, names=(), extra=TOYS[:1]).collect()] == [("x", "A", 2, 7)]
    hits = literal_hits(spark.createDataFrame([(1, bytearray(b"aaa.aa"))], "file_id long, content binary"), {"m": b"aa"})
    assert [r["at"] for r in hits.collect()] == [0, 4]
