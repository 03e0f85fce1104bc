import random
from collections import defaultdict

import pytest
from helpers import docs, empty, exchanged, odd
from pyspark.sql import functions as F

from bytelode.llm import mixing
from bytelode.llm.mixing import Mix
from conftest import DATA


def water(sizes, weights, share, cap):
    """Targets by raising a common level until the share is given out."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= cap * sizes[s]}
        if not full:
            out.update({s: level * w[s] for s in open_})
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_targets_and_taken(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.mix_documents(d).collect()
    words = {r.doc_id: len((r.text or "").split()) for r in d.collect()}
    assert {r.doc_id: r.size for r in rows} == words
    own, taken, target = defaultdict(int), defaultdict(int), {}
    source = {r.doc_id: r.source for r in d.collect()}
    for r in rows:
        own[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 2 * r.size
    expected = water(own, (5, 2, 1), 1.5, 2.0)
    for s, t in expected.items():
        assert target[s] == pytest.approx(t)
        assert abs(taken[s] - t) <= 2 * 64
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_documents(d.repartition(7)).collect()))


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long"), Mix()).alias("p"))
        got = [r.p for r in df.collect()]
        assert sorted(got) == list(range(n))
    assert got != sorted(got)


def test_draws_are_multinomial_with_quotas(spark):
    sources = spark.createDataFrame([(0, 1000), (1, 300), (2, 0), (3, 700)], "sid int, quota long")
    slots = mixing.draw(spark, sources, Mix(shard=128)).collect()
    turns = defaultdict(list)
    shards = defaultdict(int)
    for r in slots:
        turns[r.sid].append(r.turn)
        shards[r.shard] += 1
    assert {s: sorted(t) for s, t in turns.items()} == {0: list(range(1000)), 1: list(range(300)), 3: list(range(700))}
    assert sorted(shards.values(), reverse=True)[0] == 128 and sum(shards.values()) == 2000
    counts = [sum(1 for r in slots if r.shard == h and r.sid == 0) for h in range(15)]
    assert len(set(counts)) > 3 and 40 < sum(counts) / 15 < 90


def test_text_is_what_is_taken(spark):
    rng = random.Random(2)
    d = docs(spark, [(i, " ".join(f"{i}_{k}" for k in range(rng.randint(0, 300))), "en", f"s{i % 3}") for i in range(40)])
    sizes = {r.doc_id: r.taken for r in mixing.mix_documents(d).collect()}
    rows = mixing.mixed_texts(d).collect()
    assert len(rows) == 40
    for r in rows:
        words = r.text.split()
        assert len(words) == r.taken == sizes[r.doc_id]
        assert all(w.startswith(f"{r.doc_id}_") for w in words) and max([0, *(words.count(w) for w in set(words))]) <= 2


def test_odd_rows(spark):
    rows = mixing.mix_documents(odd(spark)).collect()
    assert len(rows) == 8 and sum(r.size for r in rows if r.doc_id == 3) == 0
    assert mixing.mixed_texts(odd(spark)).count() == 8
    assert mixing.mix_documents(empty(spark)).collect() == []
    assert [r.taken for r in mixing.mix_documents(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_texts_are_shuffled_once(spark):
    """Where no row is repeated and tables are too large for broadcasts."""
    d, name = spark.read.parquet(f"{DATA}/documents.parquet"), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        assert sum("text" in columns for columns in exchanged(mixing.mixed_texts(d))) == 1
    finally:
        spark.conf.set(name, before)


def test_repeated_rows_are_told_apart(spark):
    words = lambda i: " ".join(f"{i}_{k}" for k in range(100 + i))
    rows = [(i, words(i), "en", f"s{i % 3}") for i in range(30)] + [(4, words(4), "en", "s1"), (4, words(4), "en", "s0"), (4, words(5), "en", "s0"), (None, words(6), "en", "s1"), (None, words(6), "en", None)]
    got = mixing.mixed_texts(docs(spark, rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source or "") for r in got) == sorted((-1 if i is None else i, len(t.split()), s or "") for i, t, _, s in rows)
    assert all(len(r.text.split()) == r.taken for r in got)
    sizes = mixing.mix_documents(docs(spark, rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.taken) for r in got) == sorted((-1 if r.doc_id is None else r.doc_id, r.taken) for r in sizes)
