import random
from pathlib import Path
from urllib.parse import urlparse

import duckdb
import pytest
from helpers import exchanged, odd
from pyspark.sql import functions as F

import corpus_pipeline
from bytelode.llm import common, decontam, linededup, ngram_join, quality, queries
from bytelode.llm.common import materialize, shared_dir, table
from conftest import DATA
from test_ngram_join import brute


WORDS = [f"word{i}" for i in range(400)]


def test_stages_one_by_one(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        made[name] = before, docs = docs, stage(spark, docs, DATA)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        made[name] = before, docs
        if name != "mixing":
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = made["quality"]
    rejected = {r.doc_id for r in quality.classify(before, table(spark, DATA, "labels")).filter("predicted = 0").collect()}
    assert ids(before) - ids(after) == rejected
    before, after = made["line_dedup"]
    assert ids(before) == ids(after)
    assert linededup.digest(before).agg(F.sum("n_dropped")).first()[0] > 0 and linededup.digest(after).agg(F.sum("n_dropped")).first()[0] == 0
    assert all(r.n_chars == len(r.text or "") for r in after.collect())
    before, after = made["near_duplicates"]
    groups = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    own = {i for i, (_, root, _) in groups.items() if root == i}
    were = brute([(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect() if r.doc_id in own], 5, 80)
    assert ids(after) == {i for i in own if were[i][1] == i}
    before, after = made["decontamination"]
    assert ids(before) - ids(after) == {r.doc_id for r in decontam.report(before, table(spark, DATA, "benchmark")).filter("contaminated").collect()}
    before, after = made["mixing"]
    assert ids(before) == ids(after) and all(len((r.text or "").split()) == r.taken for r in after.collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 100 and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows(spark):
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() <= 8
    assert ngram_join.representatives(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df, other = queries.QUERIES[name](spark, DATA), c.execute(queries.SQL[name])
    columns = [d[0] for d in other.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(repr, other.fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_near_copies_go_from_end_to_end(spark, tmp_path):
    """Near copies of many lines, of which line dedup leaves only the lines that differ."""
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(12))
    texts, copies = {}, {}
    for i in range(60):
        texts[i] = [line() for _ in range(15)]
    for i in range(0, 60, 2):
        near = list(texts[i])
        near[rng.randrange(15)] = line()
        texts[100 + i], copies[100 + i] = near, i
    for i in range(0, 60, 6):
        texts[200 + i], copies[200 + i] = list(texts[i]), i
    docs = spark.createDataFrame([(i, "\n".join(t), "en", "s", 0) for i, t in texts.items()], table(spark, DATA, "documents").schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    stripped = materialize(stages["line_dedup"](spark, docs, str(tmp_path)), "stripped")
    kept = {r.doc_id for r in stages["near_duplicates"](spark, stripped, str(tmp_path)).collect()}
    assert kept == set(range(60))
    # On their own, what is left of near copies is no copy of anything; documents of another table than this one stay.
    assert len(kept & set(copies)) == 0 and ngram_join.representatives(stripped).count() > 60
    other = docs.withColumn("text", F.concat(F.lit("quite another text "), F.col("doc_id").cast("string"), F.lit(" of its own")))
    assert stages["near_duplicates"](spark, other, str(tmp_path)).count() == len(texts)


def test_tables_go_when_nothing_reads_them(spark):
    """Of what is written on the way, a stage leaves only what its result reads, and a run only the last stage's input."""
    at = Path(urlparse(shared_dir(spark)).path)
    names = lambda before: sorted(x.name.rsplit("-", 1)[0] for x in set(at.iterdir()) - before)
    docs, stages, before = table(spark, DATA, "documents"), dict(corpus_pipeline.STAGES), set(at.iterdir())
    rows = stages["near_duplicates"](spark, docs, DATA)
    assert names(before) == ["join-copies", "join-gone", "join-surplus"]
    assert rows.count() > 0
    before = set(at.iterdir())
    assert stages["line_dedup"](spark, docs, DATA).count() > 0 and names(before) == ["line-bitmaps"]
    before = set(at.iterdir())
    assert corpus_pipeline.run(spark, DATA).count() > 100
    assert [x for x in names(before) if not x.startswith("mix-")] == ["stage-decontamination"]


def test_near_duplicates_write_and_shuffle_few_texts(spark, tmp_path, monkeypatch):
    """Where tables are too large for broadcasts: no table of texts is written, and no exchange has texts but of possible copies."""
    written = []

    def seen(df, name):
        written.append((name, df.columns, [x for x in exchanged(df) if "text" in x]))
        return materialize(df, name)

    monkeypatch.setattr(ngram_join, "materialize", seen)
    monkeypatch.setattr(common, "materialize", seen)
    docs = table(spark, DATA, "documents")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.keep_representatives(spark, docs, DATA)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "join-copies" in {name for name, _, _ in written} and 0 < kept.count() < docs.count()
    assert [name for name, columns, _ in written if "text" in columns] == []
    # What may have gone is a copy in both tables or not; that is looked up by text.
    assert {name for name, _, texts in written if texts} <= {"join-copies"}


def test_only_documents_that_stay_count_as_they_were(spark, tmp_path):
    """Of three documents, each a near copy of the next, the middle one has gone: it links the others no more."""
    words = [f"w{i}" for i in range(200)]
    texts = {1: words, 2: words[12:] + [f"x{i}" for i in range(12)], 3: words[24:] + [f"x{i}" for i in range(24)], 4: words}
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in texts.items()], table(spark, DATA, "documents").schema)
    kept = lambda ids: sorted(r.doc_id for r in ngram_join.without_copies(docs.filter(F.col("doc_id").isin(ids)), docs).collect())
    assert kept([1, 2, 3, 4]) == [1]
    # Equal documents are one class, of which one alone may be there.
    assert kept([1, 3]) == [1, 3] and kept([3, 4]) == [3, 4] and kept([2, 3, 4]) == [2]


def test_repeated_ids(spark):
    """A row goes by its own text, not by its id; of a repeated representative one row stays."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (2, "a text of its own with some words in it"), (None, text), (3, None), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], table(spark, DATA, "documents").schema)
    got = sorted((r.doc_id or 0, (r.text or "")[:6]) for r in ngram_join.representatives(docs).collect())
    assert got == [(0, text[:6]), (1, text[:6]), (2, "a text"), (3, ""), (3, "")]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, name):
    docs = table(spark, DATA, "documents").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, DATA).count() == 0
