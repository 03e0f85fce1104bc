"""Mixing sources to target weights, with DataFrame operations only.

Each source's documents are laid end to end and cut into blocks of a fixed number of words.  A water-filling
pass turns weights into targets, and targets into quotas of blocks.  Every output shard draws multinomial
counts of slots for the sources; what a source has drawn beyond its quota goes to the sources that fell short,
so that the totals are the quotas.  A source's slots are mapped through a pseudorandom permutation of its block
indices, pass by pass, and blocks are joined to slots by index.

No block is taken more often than ``ceil(cap)`` times, so no document is either.

Defined cases: texts of any length are counted as a whole, and cut into as many pieces as they reach; sources of equal size and weight
reach their caps in their order; a null or empty text has 0 words and takes nothing; a null source is a source of its own, last in
order; repeated rows count as rows of their own; an empty table gives an empty result; columns besides ``doc_id``,
``source`` and ``text`` are not read, whatever their names.  If all sizes are 0, all targets are 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytelode.llm.common import WORD, materialize, with_maybe


@dataclass(frozen=True)
class Mix:
    """What a mix is made of.

    weights: of the sources in code-point order, repeating.  share: of all words, that the mix has.  cap: times a
    source's size that its target stops at.  block: words of a block.  shard: slots of an output shard.
    rounds: of the index permutation.  seed: of all draws.
    """

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    cap: float = 2.0
    block: int = 64
    shard: int = 8192
    rounds: int = 12
    seed: int = 20240229


def permuted(index: Column, size: Column, key: Column, mix: Mix) -> Column:
    """A keyed pseudorandom permutation of [0, size): swap-or-not rounds, which need no power of two."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, key, F.lit(mix.seed)), size) - x, size)
        bit = F.pmod(F.xxhash64(F.greatest(x, other), r, key), F.lit(2))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(mix.rounds)]), index, swap)


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """A row for each source: sid (its place in order), source_size, target, blocks, quota.

    ``sizes`` has (source, size).  The windows hold one row for each source, not for each document.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.pmod(F.col("sid"), F.lit(len(mix.weights))) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    ranked = (
        sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(mix.cap))
        .withColumn("budget", F.least(F.sum("source_size").over(every) * F.lit(mix.share), F.sum("most").over(every)))
    )
    # Sources in the order in which they reach their cap: one is full if an even share of what the fuller ones
    # leave reaches its cap; the first that isn't full gives the level for all that follow.
    order = every.orderBy(F.col("most") / F.col("weight"), "sid")
    filled = (
        ranked.withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("open"))
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
        .withColumn("common", F.min(F.when(~F.col("full"), F.struct("before", "sid", "level"))).over(every)["level"])
        .withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("common")))
    )
    passes = F.floor(F.col("target") / F.col("source_size"))
    rest = (F.col("target") - passes * F.col("source_size")) * F.col("blocks") / F.col("source_size")
    return (
        filled.withColumn("blocks", F.ceil(F.col("source_size") / mix.block))
        .withColumn("quota", F.when(F.col("source_size") > 0, passes * F.col("blocks") + F.least(F.round(rest).cast("long"), F.col("blocks"))).otherwise(F.lit(0)).cast("long"))
        .select("sid", "source", "source_size", "target", "blocks", "quota")
    )


def ranges(df: DataFrame, low: str, high: str, width: int, *keep: str) -> DataFrame:
    """Rows of half-open ranges, once for each cell of ``width`` that they reach, for lookups by an equi-join."""
    cells = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width)))
    return df.filter(F.col(high) > F.col(low)).select(low, high, *keep, cells.alias("cell"))


def draw(spark, sources: DataFrame, mix: Mix) -> DataFrame:
    """A row for each slot of the mix: shard, sid, turn (the source's how-manieth slot it is)."""
    total, n = sources.agg(F.sum("quota"), F.count("*")).first()
    total, n = total or 0, n or 0
    width = max(1, total // max(4096, n))
    placed = sources.withColumn("to", F.sum("quota").over(Window.orderBy("sid"))).withColumn("from", F.col("to") - F.col("quota"))
    cells = materialize(ranges(placed, "from", "to", width, "sid"), "mix-cells")
    slots = spark.range(0, total, 1, max(1, total // 2_000_000)).select(F.floor(F.col("id") / mix.shard).alias("shard"), F.pmod(F.xxhash64("id", F.lit(mix.seed)), F.lit(max(1, total))).alias("u"))
    drawn = slots.withColumn("cell", F.floor(F.col("u") / width)).join(cells, "cell").filter((F.col("u") >= F.col("from")) & (F.col("u") < F.col("to")))
    counts = drawn.groupBy("shard", "sid").agg(F.count("*").alias("n"))
    # In two steps, so that no window holds all shards of a source: within runs of shards, then over runs.
    counts = materialize(counts.withColumn("run", F.floor(F.col("shard") / 1024)), "mix-drawn")
    runs = counts.groupBy("sid", "run").agg(F.sum("n").alias("of_run"))
    runs = runs.withColumn("base", F.sum("of_run").over(Window.partitionBy("sid").orderBy("run")) - F.col("of_run")).drop("of_run")
    within = F.sum("n").over(Window.partitionBy("sid", "run").orderBy("shard")) - F.col("n")
    counts = materialize(counts.withColumn("within", within).join(runs, ["sid", "run"]).select("shard", "sid", "n", (F.col("base") + F.col("within")).alias("first")), "mix-counts")
    turns = (
        # A few rows stand for many slots: deal them out before they are unfolded.
        counts.join(sources.select("sid", "quota"), "sid").repartition(max(1, total // 200_000), "shard", "sid")
        .select("shard", "sid", "quota", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("turn"))
    )
    # What was drawn beyond a quota is numbered through all sources and handed to those that fell short.
    had = sources.join(counts.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left").select("sid", "quota", F.coalesce("n", F.lit(0)).alias("n"))
    along = Window.orderBy("sid")
    had = (
        had.withColumn("over", F.greatest(F.col("n") - F.col("quota"), F.lit(0))).withColumn("under", F.greatest(F.col("quota") - F.col("n"), F.lit(0)))
        .withColumn("over_from", F.sum("over").over(along) - F.col("over"))
        .withColumn("to", F.sum("under").over(along)).withColumn("from", F.col("to") - F.col("under"))
    )
    had = materialize(had, "mix-balance")
    short = ranges(had, "from", "to", width, F.col("sid").alias("taker"), F.col("n").alias("have"))
    moved = (
        turns.filter(F.col("turn") >= F.col("quota")).join(had.select("sid", "over_from"), "sid")
        .withColumn("o", F.col("over_from") + F.col("turn") - F.col("quota")).withColumn("cell", F.floor(F.col("o") / width))
        .join(short, "cell").filter((F.col("o") >= F.col("from")) & (F.col("o") < F.col("to")))
        .select("shard", F.col("taker").alias("sid"), (F.col("have") + F.col("o") - F.col("from")).alias("turn"))
    )
    return turns.filter(F.col("turn") < F.col("quota")).select("shard", "sid", "turn").unionByName(moved)


def mix_plan(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, slots, pieces).

    sources: see ``targets``.  slots: shard, sid, turn, block, pass.  pieces: a row for each block that a document
    reaches into: sid, block, bucket, row (with sid these name the document's row), doc_id, mark (a hash of its text),
    size, skip (words of the document before the piece), length (words); a document without words has one piece with
    null block.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialize(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("mark")), "mix-sizes")
    sources = materialize(targets(sizes, mix), "mix-sources")
    # Offsets in two steps, so that no window holds a whole source: within buckets of rows, then over buckets.
    buckets = max(1, int(sizes.count() ** 0.5))
    named = sources.select(F.col("source").alias("s"), "sid", "source_size", "target")
    rows = (
        sizes.join(named, sizes["source"].eqNullSafe(named["s"])).select("sid", "doc_id", "mark", "size", "source_size", "target")
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)))
    )
    order = Window.partitionBy("sid", "bucket").orderBy("doc_id", "mark")
    rows = rows.withColumn("row", F.row_number().over(order)).withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    base = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    base = base.withColumn("base", F.sum("words").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("words"))
    rows = rows.join(base.select("sid", "bucket", "base"), ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("at"))
    end = F.col("start") + F.col("size")
    reach = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / mix.block), F.floor((end - 1) / mix.block)))
    pieces = rows.select("*", F.explode_outer(reach).alias("block"))
    low, high = F.greatest(F.col("start"), F.col("block") * mix.block), F.least(end, (F.col("block") + 1) * mix.block)
    pieces = pieces.select("sid", "block", "bucket", "row", "doc_id", "mark", "size", "source_size", "target", (low - F.col("start")).alias("skip"), (high - low).alias("length"))
    slots = draw(spark, sources, mix).join(sources.select("sid", "blocks"), "sid")
    slots = slots.select("shard", "sid", "turn", permuted(F.pmod("turn", "blocks"), F.col("blocks"), F.xxhash64("sid", F.floor(F.col("turn") / F.col("blocks"))), mix).alias("block"), F.floor(F.col("turn") / F.col("blocks")).alias("pass"))
    return sources, slots, pieces


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of it, repeats counted), for each row."""
    _, slots, pieces = mix_plan(docs, mix)
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    taken = F.sum(F.coalesce(F.col("length") * F.col("times"), F.lit(0))).cast("long")
    return (
        pieces.join(times, ["sid", "block"], "left")
        .groupBy("sid", "bucket", "row").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], taken.alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def mixed_texts(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix by document: the columns of ``mix_documents`` and source, with ``text`` being the words taken, piece by
    piece, repeats included, and ``slots`` the (shard, turn) of each piece; a document of which nothing is taken has an
    empty text."""
    _, slots, pieces = mix_plan(docs, mix)
    part = F.when(F.col("turn").isNotNull(), F.struct("skip", "pass", "length", "shard", "turn"))
    picked = (
        pieces.join(slots, ["sid", "block"], "left")
        .groupBy("sid", "bucket", "row").agg(*[F.first(c).alias(c) for c in ("doc_id", "mark", "size", "source_size", "target")], F.coalesce(F.sum(F.when(F.col("turn").isNotNull(), F.col("length"))), F.lit(0)).alias("taken"), F.array_sort(F.collect_list(part)).alias("parts"))
    )
    same = Window.partitionBy("doc_id", "mark")
    picked = picked.withColumn("copy", F.row_number().over(same.orderBy("sid", "bucket", "row"))).withColumnRenamed("doc_id", "id")
    texts = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("mark"))
    # Only rows that may be repeated are numbered, as that shuffles their texts once more.
    key = F.xxhash64("doc_id", "mark").alias("key")
    repeated = materialize(texts.groupBy("doc_id", "mark").agg(F.count("*").alias("rows")).filter("rows > 1").select(key), "mix-repeated")
    if repeated.isEmpty():
        texts = texts.withColumn("copy", F.lit(1))
    else:
        texts = with_maybe(texts.select("*", key), repeated, "maybe", "key")
        copies = texts.filter("maybe").withColumn("copy", F.row_number().over(same.orderBy(F.col("source").asc_nulls_last())))
        texts = texts.filter(~F.col("maybe")).withColumn("copy", F.lit(1)).unionByName(copies)
    words = F.coalesce(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.array().cast("array<string>"))
    # The words are a lambda's variable, so that they are found once for a text and not for each of its pieces.
    cut = lambda w: F.flatten(F.transform("parts", lambda p: F.slice(w, (p["skip"] + 1).cast("int"), p["length"].cast("int"))))
    taken = F.element_at(F.transform(F.array(words), lambda w: F.array_join(cut(w), " ")), 1)
    return (
        texts.join(picked, texts["doc_id"].eqNullSafe(picked["id"]) & (texts["mark"] == picked["mark"]) & (texts["copy"] == picked["copy"]))
        .select("doc_id", "source", "size", "source_size", "target", "taken", taken.alias("text"), F.transform("parts", lambda p: F.struct(p["shard"], p["turn"])).alias("slots"))
    )
