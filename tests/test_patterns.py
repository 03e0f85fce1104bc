import re

import pytest

from bytelode.functions.patterns import PatternError, java_regex, to_regex


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("00 ?? 02", [b"\x00\xff\x02", b"\x00\n\x02"], [b"\x00\x02"]),
        ("00 8? 02", [b"\x00\x80\x02", b"\x00\x8f\x02"], [b"\x00\x90\x02"]),
        ("00 ?8 02", [b"\x00\x08\x02", b"\x00\xf8\x02"], [b"\x00,\x02", b"\x00\x09\x02"]),
        ("00 [3] 02", [b"\x00abc\x02"], [b"\x00ab\x02"]),
        ("00 [2-4] 02", [b"\x00ab\x02", b"\x00abcd\x02"], [b"\x00a\x02", b"\x00abcde\x02"]),
        ("00 ( 01 | 02 03 ) 04", [b"\x00\x01\x04", b"\x00\x02\x03\x04"], [b"\x00\x02\x04"]),
        ("00 ( 01 | ( 02 | 03 ) 05 ) 04", [b"\x00\x01\x04", b"\x00\x03\x05\x04"], [b"\x00\x03\x04"]),
        ("// a comment\n00 01", [b"\x00\x01"], [b"\x00"]),
    ],
)
def test_matches(pattern, yes, no):
    regex = re.compile(to_regex(pattern), re.DOTALL)
    assert all(regex.fullmatch(x) for x in yes)
    assert not any(regex.fullmatch(x) for x in no)


def test_ends():
    assert re.compile(to_regex("^ 00"), re.DOTALL).search(b"\x00\x01") and not re.compile(to_regex("^ 00"), re.DOTALL).search(b"\x01\x00")
    assert re.compile(to_regex("00 $"), re.DOTALL).search(b"\x01\x00") and not re.compile(to_regex("00 $"), re.DOTALL).search(b"\x00\x01")


@pytest.mark.parametrize("pattern", ["fancy text", "00 ^", "00 ^ 01", "$ 00", "00 $ 01", "", "( 00", "00 )", "( | 00 )"])
def test_invalid(pattern):
    with pytest.raises(PatternError):
        to_regex(pattern)


def test_java_form(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bytearray(b"\x00\xab\n\x02"),)], "c binary")
    assert df.select(F.decode("c", "ISO-8859-1").rlike(java_regex("00 ab ?? 02"))).first()[0]
