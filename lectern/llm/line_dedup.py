"""Lines that many documents hold, dropped in all of them but one. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import ship
from lectern.llm.heavy import stored, with_facts

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text, split at \\n; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def text_key(text: Column) -> tuple[Column, Column]:
    """Two hashes of a text that together stand for it; those of a null and an empty text are equal."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def packed(borders: Column, n_lines: Column) -> Column:
    """A keep bitmap as bytes: the ascending line numbers at which keeping and dropping change.

    The first byte is the number of bytes (1, 2 or 4) that each number takes, big end
    first; lines before the first number are kept, those up to the second are not, and so on.
    """
    width = F.when(n_lines < 256, 1).when(n_lines < 65536, 2).otherwise(4)
    return F.unhex(F.concat(F.lit("0"), width.cast("string"), F.array_join(F.transform(borders, lambda b: F.lpad(F.hex(b), 2 * width, "0")), "")))


def unpacked(keep: Column) -> Column:
    """The line numbers in a keep bitmap made by ``packed``."""
    width = F.conv(F.hex(F.substring(keep, 1, 1)), 16, 10).cast("int")
    many = ((F.length(keep) - 1) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.conv(F.hex(keep.substr(k * width + 2, width)), 16, 10).cast("int"))


def borders_of(dropped: Column) -> Column:
    """Where runs of an ascending array of numbers begin and have ended, in turn."""
    begins = F.filter(dropped, lambda x, k: (k == 0) | (F.get(dropped, k - 1) != x - 1))
    ends = F.transform(F.filter(dropped, lambda x, k: F.coalesce(F.get(dropped, k + 1) != x + 1, F.lit(True))), lambda x: x + 1)
    return F.flatten(F.transform(begins, lambda x, k: F.array(x, F.get(ends, k))))


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, t1, t2, n_lines, line, h1, h2): the lines of docs (doc_id, text) whose keys have ``least_chars`` code points or more."""
    t1, t2 = text_key(F.col("text"))
    cut = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), lines_of(F.col("text")).alias("lines"))
    each = cut.select("doc_id", "t1", "t2", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("line", "text"))
    keyed = each.where(F.length("text") >= least_chars).withColumn("text", line_key(F.col("text"))).where(F.length("text") >= least_chars)
    return keyed.select("doc_id", "t1", "t2", "n_lines", "line", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))


def repeated_lines(lines: DataFrame, least_docs: int = 5) -> DataFrame:
    """(h1, h2, n_docs, keeper): of lines (doc_id, line, h1, h2) those that ``least_docs`` documents or more hold, and the largest doc_id of these.

    Hashes are dealt out by ranges and sorted by document and position within them, so that
    the first occurrence of a line in each document is found by streaming over a partition.
    Documents are part of the ranges: a line that a third of all documents hold spans many
    partitions, each of which then counts it before the small shuffle by hash.
    """
    shuffles = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.where("doc_id is not null").select("h1", "h2", "doc_id", "line").repartitionByRange(shuffles, "h1", "h2", "doc_id")
    order = Window.partitionBy("h1", "h2", "doc_id").orderBy("line")
    first = dealt.withColumn("seen", F.row_number().over(order)).where("seen = 1")
    return first.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= least_docs)


def keep_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """(doc_id, t1, t2, n_lines, n_dropped, keep) of the documents that lose lines; all others keep every line.

    A line whose key (``line_key``) has ``least_chars`` code points or more and is in
    ``least_docs`` documents or more goes from all of them but the one with the largest
    doc_id, where each of its occurrences stays. ``keep`` is a bitmap as ``packed`` makes it.

    t1 and t2 stand for the text (``text_key``): rows with the same doc_id are one document
    when documents are counted, but each text among them has a bitmap of its own; repeated
    rows have one between them. A row without an id counts as no document and keeps no
    line for others, but loses those that go elsewhere. Null and empty texts are one empty
    line and lose nothing; no length of text or line is cut. An empty table gives an empty
    result. Other columns are ignored, whatever their names.

    The hashes of long lines are written first: dealing them out by ranges looks at them
    once more, and the verdicts are joined to them, while texts are read once.
    """
    ship(docs.sparkSession)
    lines = stored(long_lines(docs.select("doc_id", "text"), least_chars))
    facts = stored(repeated_lines(lines, least_docs))
    if facts.isEmpty():
        judged = lines.withColumn("keeper", F.col("doc_id")).where(F.lit(False))
    else:
        judged = with_facts(lines, facts, ["h1", "h2"], "n_docs", ["doc_id", "line", "t1"])
    lost = judged.where(F.col("keeper").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    byrow = lost.groupBy("doc_id", "t1", "t2", "n_lines").agg(F.array_sort(F.collect_set("line")).alias("dropped"))
    keep = packed(borders_of(F.col("dropped")), F.col("n_lines"))
    return byrow.select("doc_id", "t1", "t2", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), keep.alias("keep"))


def with_kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row of docs (doc_id, text), the lines that its bitmap keeps joined by \\n.

    Bitmaps are written first, so that where they are small Spark sends them to the
    documents instead of moving texts. Lines are cut out run by run.
    """
    t1, t2 = text_key(F.col("text"))
    found = stored(bitmaps).select(F.col("doc_id").alias("of"), "t1", "t2", "n_dropped", "keep")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), t1.alias("k1"), t2.alias("k2"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")), "left")
    lines = lines_of(F.col("text"))
    edges = F.concat(F.array(F.lit(0)), unpacked(F.col("keep")), F.array(F.size("lines")))
    runs = F.transform(F.sequence(F.lit(0), (F.size("edges") / 2).cast("int") - 1), lambda k: F.slice(F.col("lines"), F.get("edges", 2 * k) + 1, F.get("edges", 2 * k + 1) - F.get("edges", 2 * k)))
    cut = both.withColumn("lines", F.when(F.col("keep").isNotNull(), lines)).withColumn("edges", F.when(F.col("keep").isNotNull(), edges))
    kept = F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    breaks = F.length(F.encode("text", "UTF-8")) - F.length(F.encode(F.replace("text", F.lit("\n"), F.lit("")), "UTF-8"))
    return cut.select("doc_id", (breaks + 1).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
