"""Lines and paragraphs of texts, relationally."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, start, end) of docs (doc_id, text); offsets are code points.

    A line's offset is a running sum over its document; one document is one sort group.
    """
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("line_no")) - F.length("line") - 1
    return split.withColumn("start", before).withColumn("end", F.col("start") + F.length("line"))


def line_spans(docs: DataFrame) -> DataFrame:
    """Non-blank lines without the white space around them: (doc_id, line_no, start, end)."""
    lead = F.length("line") - F.length(F.regexp_replace("line", rf"^[{X.WS}]+", ""))
    found = lines(docs).withColumn("body", X.strip(F.col("line"))).where("body <> ''")
    return found.select("doc_id", "line_no", (F.col("start") + lead).alias("start"), (F.col("start") + lead + F.length("body")).alias("end"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """Runs of non-blank lines: (doc_id, start, end)."""
    full = lines(docs).where(X.strip(F.col("line")) != "")
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return full.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def page_range(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """First and last page of chunks (doc_id, start, end) by page spans (doc_id, page, page_start).

    A page holds an offset if it is the last to begin at or before it; offsets before the
    first page count to that one. A document's pages come along as one sorted array.
    """
    spans = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_start", "page"))).alias("spans"))
    at = lambda offset: F.coalesce(F.try_element_at(F.filter("spans", lambda s: s["page_start"] <= offset), F.lit(-1))["page"], F.col("spans")[0]["page"])
    joined = chunks.join(spans, "doc_id", "left")
    return joined.withColumn("first_page", at(F.col("start"))).withColumn("last_page", at(F.greatest(F.col("start"), F.col("end") - 1))).drop("spans")
