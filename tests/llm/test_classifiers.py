import random
import zlib

import numpy as np
import pytest
from helpers import docs, empty, odd

from bytelode.llm import langid, quality, toxicity
from conftest import DATA


def auc(scores, labels):
    order = sorted(zip(scores, labels))
    ones = sum(labels)
    ranks = sum(i + 1 for i, (_, y) in enumerate(order) if y)
    return (ranks - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def data(spark):
    d = DATA.replace("0.001", "0.01")
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.mark.parametrize("module, label, modulus, held, least", [(quality, "quality", 4, 2, 0.97), (toxicity, "toxic", 5, 0, 0.93)])
def test_held_out(data, module, label, modulus, held, least):
    d, labels = data
    rows = module.classify(d, labels).collect()
    known = {r.doc_id: r[label] for r in labels.collect()}
    assert len(rows) == d.count() and all(0 <= r.score <= 1 and r.held_out == (fold(r.doc_id, modulus) == held) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in known]
    assert auc([r.score for r in out], [known[r.doc_id] for r in out]) > least
    assert sum(r.predicted == known[r.doc_id] for r in out) / len(out) > 0.94
    assert sorted(map(str, rows)) == sorted(map(str, module.classify(d.repartition(5), labels).collect()))


@pytest.mark.parametrize("module, label, modulus, held", [(quality, "quality", 4, 2), (toxicity, "toxic", 5, 0)])
def test_held_out_labels_are_not_learned(spark, data, module, label, modulus, held):
    d, labels = data
    from pyspark.sql import functions as F

    other = labels.withColumn(label, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == held, 1 - F.col(label)).otherwise(F.col(label)))
    assert sorted(map(str, module.classify(d, labels).collect())) == sorted(map(str, module.classify(d, other).collect()))


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, data, module):
    d, labels = data
    few = labels.limit(0)
    assert len(module.classify(odd(spark), labels).collect()) == 8
    assert len(module.classify(odd(spark), few).collect()) == 8
    assert module.classify(empty(spark), labels).collect() == []
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 1), (1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(module.classify(odd(spark), nulls).collect()) == 8


def test_without_labels_all_pass(spark, data):
    assert quality.accepted(data[0], data[1].limit(0)).count() == data[0].count()
    assert quality.accepted(data[0], data[1]).columns == data[0].columns


def test_quality_learns_from_every_label(spark, monkeypatch):
    """Labelled rows beyond any bound of a sample count, in blocks that all hold both labels; the cut is an exact quantile of all."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality, "BLOCK", 1000)
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    docs = ids.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("BAD!! 12 "), "doc_id")).otherwise(F.lit("some good words here")))
    labels = ids.withColumn("quality", (F.col("doc_id") % 10 != 0).cast("int"))
    rows = quality.vectors_of(docs, labels)
    assert rows.count() == labels.filter(quality.fold("doc_id", 4) != 2).count() > 14_000
    wrong = quality.classify(docs, labels).join(labels, "doc_id").filter("predicted <> quality").count()
    assert wrong == 0
    scores = spark.createDataFrame([(float(i * i % 101),) for i in range(300)] + [(5.0,)] * 50, "s double")
    s = sorted(r.s for r in scores.collect())
    assert quality.at_ranks(scores, [0, 40, 349]) == [s[0], s[40], s[349]]


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = (x @ [2, -1, 0, 0, 0.5] + rng.normal(0, 0.3, 400) > 0).astype(int)
    model = quality.fit(x, y)
    better, worse = x[y == 1], x[y == 0]
    i, j = rng.integers(len(better), size=2000), rng.integers(len(worse), size=2000)
    assert ((better[i] - worse[j]) @ model.weights > 0).mean() > 0.97
    assert abs((model.score(x) >= 0.7).mean() - y.mean()) < 0.01


def test_shapes():
    assert [quality.shape(w) for w in ("word", "Word", "WORD!!", "a1b22", "***", "été,", "x|y")] == ["a", "Aa", "A!", "a0a0", "*", "a,", "a|a"]


def test_machine_learns_interactions():
    """An insult or a group alone is fine, both together are not: no sum of weights tells that."""
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(30)}" for _ in range(5)] + ["zzinsult"] * insult + ["qqgroup"] * group
        known = toxicity.Terms()
        rows.append((np.sort(np.array(known.of(" ".join(words)), np.int32)), int(insult and group)))
    model = toxicity.fit(rows, steps=400)
    kept = toxicity.Terms(model.kept)
    score = lambda t: model.score(kept.of(t))
    assert score("w1 w2 zzinsult qqgroup") > 0.5 > max(score("w1 w2 zzinsult w4"), score("w1 qqgroup w3"), score("w1 w2 w3"))


def test_automaton_and_phrases():
    rng = random.Random(2)
    for _ in range(40):
        train = [rng.randint(1, 4) for _ in range(rng.randint(1, 60))]
        text = [rng.randint(0, 4) for _ in range(rng.randint(1, 80))]
        table = langid.automaton(np.array(train, np.uint8), 5)
        inside = {tuple(train[i:j]) for i in range(len(train)) for j in range(i + 1, len(train) + 1)}
        expected, at = 0, 0
        while at < len(text):
            n = 1
            while at + n < len(text) and tuple(text[at : at + n + 1]) in inside:
                n += 1
            expected, at = expected + 1, at + n
        assert langid.phrases([np.array(text, np.uint8)], table)[0] == expected
    pieces = [np.array(text[:k], np.uint8) for k in (60, 30, 30, 2, 1)] if len(text) >= 60 else [np.array(text, np.uint8)]
    assert list(langid.phrases(pieces, table)) == [langid.phrases([p], table)[0] for p in pieces]


def test_languages(data):
    d, _ = data
    rows = {r.doc_id: r for r in langid.identify(d).collect()}
    truth = {r.doc_id: r.lang for r in d.collect()}
    held = [i for i, r in rows.items() if r.held_out]
    assert all(rows[i].held_out == (fold(i, 5) == 0) and 0 <= rows[i].score <= 1 for i in rows)
    assert sum(rows[i].lang_pred == truth[i] for i in held) / len(held) > 0.98


def test_languages_odd(spark):
    rows = langid.identify(odd(spark)).collect()
    assert len(rows) == 8
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert langid.identify(empty(spark)).collect() == []
    assert [r.lang_pred for r in langid.identify(docs(spark, [(1, "some text", None), (2, "123")])).collect()] == ["und", "und"]


def test_many_languages_and_letters(spark):
    """300 languages of 12 letters each, of which some overlap; every third has only documents of over 5,000 characters."""
    rng = random.Random(8)
    letters = [chr(c) for start in (0x61, 0x3B1, 0x430, 0x5D0, 0x915, 0x4E00) for c in range(start, start + (2500 if start == 0x4E00 else 24)) if chr(c).isalpha()]
    rows = []
    for k in range(300):
        own = letters[8 * k : 8 * k + 12]
        for n in range(4):
            words = ["".join(rng.choice(own) for _ in range(rng.randint(2, 6))) for _ in range(1400 if k % 3 == 0 else 40)]
            rows.append((4 * k + n, " ".join(words), f"lang{k:03d}"))
    assert all(len(t) > 5000 for _, t, lang in rows if int(lang[4:]) % 3 == 0)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs(spark, rows)).collect()}
    learned = {lang for i, _, lang in rows if fold(i, 5)}
    assert len(learned) == 300 and all(got[i] == lang for i, _, lang in rows)


def test_lists_of_steps_are_like_tables():
    rng = np.random.default_rng(4)
    steps = langid.Steps.of(langid.suffixes(rng.integers(1, 9, 500)), 9)
    pieces = [rng.integers(0, 9, n).astype(np.int32) for n in (300, 40, 40, 1)]
    assert list(langid.phrases(pieces, steps)) == list(langid.phrases(pieces, steps.table()))


def test_machine_keeps_terms_that_say_nothing_alone():
    """A group is as common in toxic as in clean rows, and turns what an insult means; 2,000 chance terms fit the labels better alone."""
    rng = random.Random(6)
    rows = []
    for _ in range(800):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        toxic = int(insult == group)
        words = [f"chance{toxic}{rng.randrange(1000)}" for _ in range(12)] * (rng.random() < 0.5) + ["zzinsult"] * insult + ["qqgroup"] * group
        rows.append((np.sort(np.array(toxicity.Terms().of(" ".join(words)), np.int32)), toxic))
    model = toxicity.fit(rows, steps=400)
    kept = toxicity.Terms(model.kept)
    score = lambda t: model.score(kept.of(t))
    assert min(score("zzinsult qqgroup"), score("nothing")) > 0.5 > max(score("zzinsult"), score("qqgroup"))
