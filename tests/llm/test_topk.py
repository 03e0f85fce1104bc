import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from bytelode.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every, cast=np.float32):
    """In whole numbers of any size; each row is a query, or a candidate, of its own."""
    good = [(i, [math.floor(256 * Fraction(float(cast(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(good):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for j, (i, b) in enumerate(good) if j != at and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], schema)


def found(df, **options):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, **options).collect())


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # ties
    for options in ({}, {"query_block": 4, "row_block": 50}, {"pivots": 3}, {"row_block": 20, "share": 2, "most_blocks": 40}):
        assert found(table(spark, rows), **options) == brute(rows, 5, 50)


def test_repeated_rows_and_ids(spark):
    rng = random.Random(8)
    rows = [(i % 110, [rng.gauss(0, 1) for _ in range(6)]) for i in range(230)]
    rows += rows[:60] * 2
    assert found(table(spark, rows), row_block=30) == brute(rows, 5, 50)


def test_wide_vectors(spark):
    """Components of a million and more, beside small ones; none is left out, and no digit of a score is lost."""
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    rows += [(200 + i, [rng.uniform(-1e6, 1e6) for _ in range(8)]) for i in range(40)] + [(300, [1e7] * 8), (301, [-3e7, *[0.25] * 7])]
    assert found(table(spark, rows)) == brute(rows, 5, 50)
    assert {200, 300} <= {q for q, *_ in found(table(spark, rows))}
    double = "vec_id long, embedding array<double>, label int"
    assert found(table(spark, [(0, [1e-300, 3.0]), (1, [1e300, 0.25]), (2, [0.0, 1.0])], double), k=2) == brute([(0, [1e-300, 3.0]), (1, [1e300, 0.25]), (2, [0.0, 1.0])], 2, 50, float)


def test_score_beyond_a_long_is_an_error(spark):
    rows = [(0, [1e30, 0.0]), (1, [1e30, 1.0]), (2, [0.5, 0.5])]
    with pytest.raises(Exception, match="does not fit a long: query 0"):
        found(table(spark, rows))
    # Where it is not among the best, it is no error.
    rows = [(0, [1.0, 1e15]), (1, [0.0, -1e15]), (2, [3.0, 0.0]), (3, [4.0, 0.0])]
    assert found(table(spark, rows), k=2) == brute(rows, 2, 50)


def test_clashing_columns(spark):
    df = table(spark, [(i, [float(i), 1.0]) for i in range(12)])
    for name in ("row", "dim", "vec", "norm", "far", "cell", "grp", "block", "part", "asks", "wide", "least", "rank", "score"):
        df = df.withColumn(name, df["vec_id"])
    assert found(df) == brute([(i, [float(i), 1.0]) for i in range(12)], 5, 50)


def clustered(n=4000, centers=20, width=8):
    rng = random.Random(7)
    middle = [[rng.gauss(0, 8) for _ in range(width)] for _ in range(centers)]
    return [(i, [c + rng.gauss(0, 0.05) for c in middle[i % centers]]) for i in range(n)]


def test_bounds_spare_work(spark):
    rows = clustered()
    x = np.floor(256 * np.array([v for _, v in rows], np.float32).astype(float))
    norms = (x * x).sum(1)
    group = topk.Group(0, float(norms.max()), x[:16])
    pdf = pd.DataFrame({"row": range(len(rows)), "vec_id": [i for i, _ in rows], "wide": False, "norm": norms, "vec": [v.astype(np.int32).tobytes() for v in x], "asks": False})
    asks = pdf[pdf["vec_id"] == 50].assign(asks=True, far=[r.tobytes() for r in group.far(x[50:51], norms[50:51], False)])
    pdf["far"] = [r.tobytes() for r in group.far(x, norms, True)]
    found = topk.search(5, {0: group}, step=64)((0, 0, 0), pd.concat([asks, pdf]))
    assert found["evaluated"].max() < 4000 and len(found) == 5
    # Of blocks that are far away, none is looked at.
    near = group.far(x, norms, True).argmin(1)
    far = group.far(x, norms, True)
    blocks = {0: (np.arange(16), np.stack([far[near == b].min(0) for b in range(16)]), np.stack([far[near == b].max(0) for b in range(16)]))}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"grp": [0], "norm": [float(norms[50])], "far": [asks["far"].iloc[0]], "least": [int(found["score"].min())]})
    goes = sum(b.num_rows for b in topk.reaching({0: group}, blocks)([batch]))
    assert 1 <= goes < 16


def test_clusters_against_brute_force(spark):
    rows = clustered(600, 12)
    assert found(table(spark, rows), row_block=25, pivots=16) == brute(rows, 5, 50)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [-1.0, 3.0]), (8, [-1.0, 3.0])]
    assert found(table(spark, rows)) == brute(rows, 5, 50)
    assert topk.top_k(table(spark, []).limit(0)).collect() == []
