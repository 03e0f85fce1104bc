"""Small tables with what real ones may hold: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    whole = [(*r, *((None, None)[len(r) - 2 :]), len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(whole, DOCS)


def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named as the operators name theirs."""
    long_text = " ".join(f"word{i % 977} and" for i in range(30_000))
    rows = [(1, "the quick brown fox jumps over the lazy dog", "en", "a"), (1, "the quick brown fox jumps over the lazy dog", "en", "a"), (2, "", "en", None), (3, None, None, "b"), (None, "some text of no id at all", "en", "b"), (4, " \t\n ", "de", "b"), (5, long_text, "en", "a"), (6, "12345 é\U0001f600 !!", "fr", "c")]
    df = docs(spark, rows)
    for name in ("score", "size", "n", "fp", "g", "mark", "keep", "h", "pos", "label", "taken", "sid", "block", "_maybe", "_word", "_bits", "_leaks", "_score", "_predicted", "_keep", "_id", "_mark", "n_lines", "quota", "words", "parts", "slots", "turn"):
        df = df.withColumn(name, df["doc_id"])
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def exchanged(df):
    """The columns of each exchange in the plan, but of broadcasts."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if node.nodeName() == "Exchange":
            out.append([node.output().apply(i).name() for i in range(node.output().size())])
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out
