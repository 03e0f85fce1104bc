"""A training corpus from raw documents: five stages, each on what the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), and all but the last return the columns
of ``documents``.  The last returns the mix by document: see ``mixing.mixed_texts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.llm import decontam, linededup, mixing, ngram_join, quality
from bytelode.llm.common import concluded, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null, empty and very long texts are scored like any, and rows without an
    id too; repeated rows go or stay together; without labels of both kinds, and in an empty table, nothing goes."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go from the texts; ``n_chars`` follows.  No row goes: a text all of whose lines go is
    empty, a null text stays null; rows of one id are one holder, those without an id the last."""
    kept = linededup.dedup_texts(docs)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else kept


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more) stays.

    Line dedup leaves of a near copy the lines that differ, which are no copy of anything; so documents are then compared
    as they were in ``sf_dir`` too.
    """
    # Not written between: what stays is told by two small tables of what goes.
    return ngram_join.without_copies(ngram_join.representatives(docs), table(spark, sf_dir, "documents"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; null and empty texts leak nothing, repeated rows go together, long texts are
    searched as a whole; without items, and in an empty table, nothing goes."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the words that the mix takes of it; null and empty texts give none, a null source is a source of its
    own, repeated rows are rows of their own; an empty table gives an empty mix."""
    return mixing.mixed_texts(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_representatives),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]
#: Models and pseudorandom draws have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, staged(spark, sf_dir, STAGES[:-1]), sf_dir)


def staged(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    """What these stages make of the documents; each is written, and what it was made from goes."""
    if not stages:
        return table(spark, sf_dir, "documents")
    name, stage = stages[-1]
    return concluded(spark, lambda: stage(spark, staged(spark, sf_dir, stages[:-1]), sf_dir), f"stage-{name}")
