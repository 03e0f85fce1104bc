"""A small format family for text: elements between an opening and a closing literal, found with SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelode.functions.binary import latin1

#: handler: (opening, closing).  An element must close before the next of its kind opens.
ELEMENTS = {"script": ("<script", "</script>"), "style": ("<style", "</style>"), "nav": ("<nav", "</nav>"), "list": ("<ul", "</ul>"), "item": ("<li", "</li>"), "link": ("<a ", "</a>")}


def elements(files: DataFrame, kinds: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(file_id, handler, start, end) in bytes, of files (file_id, content).

    One pass over the content, split at each kind's opening; what is shuffled are the parts' lengths, not the parts.
    """
    text = latin1(F.col("content"))

    def parts(handler: str, opening: str, closing: str):
        one = lambda p, i: F.struct(F.lit(handler).alias("handler"), F.lit(len(opening)).alias("o"), F.lit(len(closing)).alias("c"), i.alias("pos"), F.length(p).alias("length"), F.call_function("instr", p, F.lit(closing)).alias("close"))
        return F.transform(F.split(text, "\\Q" + opening + "\\E", -1), one)

    rows = files.select("file_id", F.inline(F.concat(*[parts(h, *marks) for h, marks in (kinds or ELEMENTS).items()])))
    order = Window.partitionBy("file_id", "handler").orderBy("pos")
    step = (F.col("length") + F.col("o")).cast("long")
    found = rows.withColumn("start", F.sum(step).over(order) - step - F.col("o")).filter("pos > 0 AND close > 0")
    return found.select("file_id", "handler", "start", (F.col("start") + F.col("o") + F.col("close") - 1 + F.col("c")).alias("end"))


def sql(kinds: dict[str, tuple[str, str]] | None = None, key: str = "page_id", text: str = "html", table: str = "pages") -> str:
    """Common table expressions ``files`` and ``chunks`` with the same rows, for an engine that counts characters."""
    parts = []
    for handler, (opening, closing) in (kinds or ELEMENTS).items():
        o, c = len(opening), len(closing)
        parts.append(f"""
  SELECT file_id, '{handler}' AS handler, start, (start + {o} + strlen(substr(part, 1, close - 1)) + {c})::BIGINT AS "end" FROM (
    SELECT *, (sum(strlen(part) + {o}) OVER (PARTITION BY file_id ORDER BY pos) - strlen(part) - {2 * o})::BIGINT AS start, instr(part, '{closing}') AS close FROM (
      SELECT file_id, unnest(string_split(content, '{opening}')) AS part, generate_subscripts(string_split(content, '{opening}'), 1) - 1 AS pos FROM files))
  WHERE pos > 0 AND close > 0""")
    return f"""files AS (SELECT {key}::VARCHAR AS file_id, coalesce({text}, '') AS content, strlen(coalesce({text}, ''))::BIGINT AS length FROM {table}), chunks AS ({' UNION ALL '.join(parts)})"""
