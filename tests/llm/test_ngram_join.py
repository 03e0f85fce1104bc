import random

import numpy as np
import pytest
from helpers import docs, empty, odd

from bytelode.llm import ngram_join
from bytelode.llm.ngram_join import Join


def brute(rows, n, percent):
    """doc_id: (size of its set, component, links), over all pairs."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    ids = sorted(sets)
    near = {i: [j for j in ids if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in ids}
    root = {}
    for i in ids:
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo += near[x]
    return {i: (len(sets[i]), root[i], len(near[i])) for i in ids}


def corpus(seed, groups=12, size=25):
    rng = random.Random(seed)
    rows, words = [], [f"w{k}" for k in range(400)]
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 20, 60, 200, 400]))]
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, join", [(1, Join()), (2, Join(n=5, percent=80)), (3, Join(block=4, sketch=8)), (4, Join(n=2, percent=60, block=8))])
def test_against_all_pairs(spark, seed, join):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.linked(docs(spark, rows), join).collect()}
    assert got == brute(rows, join.n, join.percent)


def test_large_near_copies_meet_in_tiles(spark):
    rng = random.Random(8)
    base = [f"t{k}" for k in range(150)]
    rows = []
    for i in range(120):
        own = list(base)
        own[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(own)))
    join = Join(block=16)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.linked(docs(spark, rows), join).collect()}
    assert got == brute(rows, 3, 90)


def test_products():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 40).astype(np.uint64) % np.uint64(60) * np.uint64(2**57)) for _ in range(20)]
    got = ngram_join.products(sets, width=7, part=50)
    for a in range(20):
        for b in range(20):
            if a != b:
                assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 6), (6, 7), (7, 8), (8, 9), (9, 5), (3, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in (1, 2, 3)} == {1} and {got[x] for x in range(5, 10)} == {5} and got[11] == 10 and {got[100 + i] for i in range(41)} == {100}
    assert ngram_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    got = ngram_join.linked(odd(spark)).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got}
    assert (by[2].n_shingles, by[2].component_id, by[2].n_links) == (0, 2, 0) and by[3].n_shingles == 0 and by[4].n_shingles == 0
    assert by[None].component_id is None and by[1].n_links == 1
    assert ngram_join.linked(empty(spark)).collect() == []
    kept = ngram_join.representatives(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == 7  # of the repeated row one stays


def test_one_of_each_group_stays(spark):
    text = " ".join(f"a{k}" for k in range(60))
    d = docs(spark, [(4, text), (2, text), (3, text + " more"), (9, "quite another text of some words")])
    assert sorted(r.doc_id for r in ngram_join.representatives(d).collect()) == [2, 9]


def test_rows_that_fit_nobody_leave_their_list(spark):
    rows = [(1, "a", 100, 0), (1, "b", 89, 1), (1, "c", 90, 2), (1, "d", 50, 0), (2, "a", 100, 1), (2, "d", 50, 1), (3, "e", 7, 0), (4, "e", 7, 1), (4, "f", 7, 3)]
    got = ngram_join.meeting(spark.createDataFrame(rows, "g long, fp string, n long, pos int"), Join()).collect()
    assert sorted((r.g, r.fp, r.m) for r in got) == [(1, "a", 4), (1, "b", 4), (1, "c", 4), (4, "e", 2), (4, "f", 2)]
