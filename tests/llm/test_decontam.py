import random

from helpers import docs, empty, odd

from bytelode.llm import decontam
from conftest import DATA


def brute(item, doc, least):
    """Tiles by trying every pair of places, again and again."""
    free_i, free_d, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while p + n < len(item) and q + n < len(doc) and free_i[p + n] and free_d[q + n] and item[p + n] == doc[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        if best[0] < least:
            return sum(n for n, _, _ in tiles)
        n, p, q = best
        free_i[p : p + n] = free_d[q : q + n] = [False] * n
        tiles.append(best)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_against_brute_force():
    rng, tokens = random.Random(4), decontam.Tokens()
    for _ in range(150):
        words = [f"w{k}" for k in range(rng.choice([3, 8, 30]))]
        item = [rng.choice(words) for _ in range(rng.randint(1, 30))]
        doc = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.7 and len(item) > 4:
            cut = rng.randint(1, len(item) - 1)
            doc[3:3] = item[cut:] + ["x"] + item[:cut]
        least = min(3, len(item))
        got = decontam.leaks(" ".join(doc), decontam.indexed([(1, " ".join(item))], 3, 0.0), tokens, 3, 0.0)
        covered = sum(t["words"] for g in got for t in g["tiles"])
        assert covered == brute(item, doc, least), (item, doc)
        for g in got:
            for t in g["tiles"]:
                assert item[t["item_start"] : t["item_start"] + t["words"]] == doc[t["doc_start"] : t["doc_start"] + t["words"]]


def test_reordered_and_clean(spark):
    passage = [f"term{i}" for i in range(40)]
    mixed = passage[25:40] + ["and", "then"] + passage[10:25] + ["but"] + passage[0:10]
    bench = items(spark, [(7, " ".join(passage)), (8, "short one"), (9, None), (10, "")])
    d = docs(spark, [(1, "before " + " ".join(passage) + " after"), (2, "x " + " ".join(mixed).upper() + "."), (3, " ".join(passage[:10]) + " else"), (4, "nothing of it"), (5, "a Short one, here"), (6, None)])
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontam.report(d, bench).collect()}
    assert got == {1: (True, [7]), 2: (True, [7]), 3: (False, []), 4: (False, []), 5: (True, [8]), 6: (False, [])}
    assert sorted(r.doc_id for r in decontam.decontaminate(d, bench).collect()) == [3, 4, 6]


def test_joined_seeds_give_the_same(spark):
    key = lambda rows: sorted((r.doc_id if r.doc_id is not None else -1, sorted((x.item_id if x.item_id is not None else -1, x.coverage, str(x.tiles)) for x in r["_leaks"])) for r in rows)
    d, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    one, many = decontam.with_leaks(d, bench), decontam.with_leaks(d, bench, part=300)
    assert one.columns == many.columns and key(one.collect()) == key(many.collect()) and sum(bool(r["_leaks"]) for r in one.collect()) > 0
    few = items(spark, [(1, "the quick brown fox jumps over"), (1, "the quick brown fox jumps over"), (None, "some text of no id at all"), (2, "12345"), (3, None)])
    assert key(decontam.with_leaks(odd(spark), few, part=1, name="_leaks2").withColumnRenamed("_leaks2", "x").drop("_leaks").withColumnRenamed("x", "_leaks").collect()) == key(decontam.with_leaks(odd(spark).drop("_leaks"), few).collect())


def test_odd_rows(spark):
    bench = items(spark, [(1, "the quick brown fox jumps over"), (1, "the quick brown fox jumps over"), (None, "some text of no id at all")])
    rows = decontam.report(odd(spark), bench).collect()
    assert len(rows) == 8 and [r.item_ids for r in rows if r.doc_id == 1] == [[1, 1]] * 2 and [r.item_ids for r in rows if r.doc_id is None] == [[None]]
    assert decontam.decontaminate(odd(spark), bench).columns == odd(spark).columns
    assert decontam.report(empty(spark), bench).collect() == []
    assert not any(r.contaminated for r in decontam.report(odd(spark), bench.limit(0)).collect())


def test_phrases_that_many_items_have():
    """Items that share a stock phrase are found by what else they have; every item and document is compared for the truth."""
    rng = random.Random(12)
    words, stock = [f"w{i}" for i in range(60)], [f"s{i}" for i in range(9)]
    items = [stock + [rng.choice(words) for _ in range(rng.randint(0, 25))] for _ in range(80)]
    index = decontam.indexed([(i, " ".join(item)) for i, item in enumerate(items)], 4, 0.5)
    tokens = decontam.Tokens()
    listed = sum(len(found) for _, _, found, _ in index.seeds.values())
    assert listed < sum(len(set(h.tolist())) for h in index.hashes)
    for _ in range(40):
        doc = [rng.choice(words) for _ in range(30)] + stock
        for _ in range(3):
            item = rng.choice(items)
            cut = rng.randint(0, len(item))
            doc += item[cut:] + item[: max(0, cut - rng.randint(0, 12))]
        got = {f["item_id"]: f["coverage"] for f in decontam.leaks(" ".join(doc), index, tokens, 4, 0.5)}
        expected = {}
        for i, item in enumerate(items):
            tiles = decontam.tiling(tokens.of(" ".join(item)), tokens.of(" ".join(doc)), 4)
            if (share := sum(n for *_, n in tiles) / len(item)) >= 0.5:
                expected[i] = share
        assert got == expected
