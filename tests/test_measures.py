import random

import numpy as np
import pytest

from bytelode.operators import measures


@pytest.mark.parametrize("data, bits", [(b"", 0), (b"\0", 0), (b"\x01\x01\0\0", 1), (b"\x01\x01\0\0" * 1000, 1), (bytes(range(4)), 2), (bytes(range(256)), 8), (b"\0" * 256, 0)])
def test_entropy(data, bits):
    assert measures.entropy_of(measures.histogram(data)) == pytest.approx(bits)


def test_chi_square():
    assert measures.chi_square_of(measures.histogram(b"")) == 0
    assert measures.chi_square_of(measures.histogram(bytes(range(256)))) == 1
    assert measures.chi_square_of(measures.histogram(b"\0" * 4096)) == pytest.approx(0)
    assert measures.survival(255, 255) == pytest.approx(0.4882, abs=1e-4)
    assert measures.survival(293.2478, 255) == pytest.approx(0.05, abs=1e-4)
    assert 0.001 < measures.chi_square_of(measures.histogram(np.random.default_rng(1).bytes(1 << 16))) < 0.999


@pytest.mark.parametrize("size, block", [(0, 1024), (10, 1024), (1024 * 80, 1024), (1024 * 80 * 2, 2048), (1 << 30, 1 << 20)])
def test_block_size(size, block):
    assert measures.block_size_of(size) == block


def test_blocks():
    rng = random.Random(1)
    data = b"\0" * 1024 + bytes(range(64)) * 16 + b"".join(bytes(rng.sample(range(256), 256)) for _ in range(62 * 4))
    shannon, chi = measures.randomness(data)
    assert shannon["block_size"] == 1024 and shannon["percentages"] == [0, 75] + [100] * 62
    assert chi["percentages"] == [0, 0] + [100] * 62
    assert shannon["mean"] == pytest.approx(98.05, abs=0.01)


def test_frames(spark):
    df = spark.createDataFrame([("a", bytearray(b"\x00\x01" * 3)), ("b", bytearray(b""))], "file_id string, content binary")
    got = {r.file_id: r for r in measures.with_randomness(df).collect()}
    assert got["a"].shannon.percentages == [12.5] and got["b"].shannon.percentages == []
    assert {(r.byte, r.n) for r in measures.byte_counts(df, ["file_id"]).collect()} == {("\0", 3), ("\x01", 3)}
    pieces = measures.blocks(df, 4).collect()
    assert [(r.block_no, bytes(r.content)) for r in sorted(pieces, key=lambda r: r.block_no)] == [(0, b"\0\x01\0\x01"), (1, b"\0\x01")]
