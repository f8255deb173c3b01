"""Queries over page geometry. Lines of documents stand for printed lines, twenty a page, with places made of their numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import layout as Y
from lectern.operators import structure as S
from lectern.plans.registry import query
from lectern.plans.text import LINES, collapsed
from lectern.sources.tables import table

SIZE = "CASE WHEN line_no = 0 THEN 14.0 WHEN line_no % 9 = 4 THEN 12.0 ELSE 9.5 END::DOUBLE"
PRINTED = (
    LINES
    + f""", p AS (SELECT doc_id, (line_no // 20 + 1)::INT AS page, (line_no % 20)::INT AS position, CASE WHEN line_no % 20 = 0 THEN 'Report  Page ' || (line_no // 20 + 1) ELSE line END AS text,
 (54 + CASE WHEN line_no % 6 = 2 THEN 12 ELSE 0 END)::DOUBLE AS x0, (54 + least(length(line), 90) * 5)::DOUBLE AS x1, (60 + (line_no % 20) * 14 + CASE WHEN line_no % 8 = 5 THEN 3 ELSE 0 END)::DOUBLE AS top, (70 + (line_no % 20) * 14)::DOUBLE AS bottom,
 {SIZE} AS size, line_no % 10 = 9 AS bold, 0 AS "column", 800.0::DOUBLE AS page_height FROM o)"""
)


def printed(spark, d):
    n = F.col("line_no")
    text = F.when(n % 20 == 0, F.concat(F.lit("Report  Page "), F.floor(n / 20).cast("int") + 1)).otherwise(F.col("line"))
    return S.lines(table(spark, d, "documents")).select(
        "doc_id", (F.floor(n / 20) + 1).cast("int").alias("page"), (n % 20).alias("position"), text.alias("text"),
        (54 + F.when(n % 6 == 2, 12).otherwise(0)).cast("double").alias("x0"), (54 + F.least(F.length("line"), F.lit(90)) * 5).cast("double").alias("x1"),
        (60 + (n % 20) * 14 + F.when(n % 8 == 5, 3).otherwise(0)).cast("double").alias("top"), (70 + (n % 20) * 14).cast("double").alias("bottom"),
        F.when(n == 0, 14.0).when(n % 9 == 4, 12.0).otherwise(9.5).alias("size"), (n % 10 == 9).alias("bold"), F.lit(0).alias("column"), F.lit(800.0).alias("page_height"),
    )


@query(
    PRINTED
    + f""", c AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS n FROM p), k AS (SELECT *, regexp_replace(lower({collapsed('text')}), '[0-9]+', '#', 'g') AS key, floor(top / page_height * 50)::INT AS slot FROM c WHERE n >= 3 AND (top / page_height <= 0.12 OR bottom / page_height >= 0.88)),
r AS (SELECT doc_id, key, slot FROM k WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT page) >= greatest(3, floor(any_value(n) * 0.5)))
SELECT k.doc_id, k.page, k.position FROM k JOIN r USING (doc_id, key, slot)"""
)
def running_rows(spark, d):

    rows = printed(spark, d).withColumn("page_count", F.max("page").over(Window.partitionBy("doc_id")))
    return Y.running_rows(rows).select("doc_id", "page", "position")


BODY = ", b AS (SELECT doc_id, quantile_cont(size, 0.5) AS body_size FROM (SELECT doc_id, size, unnest(range(greatest(1, length(text)))) FROM p) GROUP BY doc_id)"
CANDIDATES = BODY + ", h AS (SELECT p.*, body_size, text <> '' AND length(trim(text)) <= 120 AND right(trim(text), 1) NOT IN ('.', ';', ',') AND (size >= body_size * 1.15 OR (bold AND size >= body_size)) AS candidate FROM p JOIN b USING (doc_id))"
LEVELS = (
    CANDIDATES
    + ", ls AS (SELECT doc_id, list_sort(list_distinct(list(round(size, 1)) FILTER (WHERE candidate)), 'DESC') AS levels, avg(candidate::INT) AS share FROM h GROUP BY doc_id),"
    + " v AS (SELECT h.*, CASE WHEN candidate AND share <= 0.25 THEN least(coalesce(list_position(list_transform(levels[1:6], lambda s: abs(size - s) < 0.26), true), len(levels[1:6]) + 1), 6) END::INT AS level FROM h JOIN ls USING (doc_id))"
)


@query(PRINTED + BODY + " SELECT doc_id, round(body_size, 6) AS body_size FROM b")
def body_size(spark, d):
    return Y.body_size(printed(spark, d)).select("doc_id", F.round("body_size", 6).alias("body_size"))


@query(PRINTED + " SELECT doc_id, page, round(quantile_cont(size, 0.5), 6) AS size FROM (SELECT doc_id, page, size, unnest(range(greatest(1, length(text)))) FROM p) GROUP BY doc_id, page")
def line_size(spark, d):
    """The median size over the characters of a page, as of a line of words."""
    return printed(spark, d).groupBy("doc_id", "page").agg(F.round(F.expr("percentile(size, 0.5, greatest(1, length(text)))"), 6).alias("size"))


@query(PRINTED + CANDIDATES + " SELECT doc_id, page, position, candidate FROM h")
def heading_candidates(spark, d):
    return Y.heading_candidates(printed(spark, d)).select("doc_id", "page", "position", "candidate")


@query(PRINTED + LEVELS + " SELECT doc_id, page, position, level FROM v")
def heading_levels(spark, d):
    return Y.heading_levels(printed(spark, d)).select("doc_id", "page", "position", "level")


DEMOTED = LEVELS + (
    ", t AS (SELECT v.* EXCLUDE (level), CASE WHEN level = 1 AND row_number() OVER (PARTITION BY doc_id ORDER BY page, position) = 1 AND count(*) FILTER (WHERE level = 1) OVER (PARTITION BY doc_id) = 1 AND max(level) OVER (PARTITION BY doc_id) > 1 THEN NULL ELSE level END AS level FROM v)"
)


@query(PRINTED + DEMOTED + " SELECT doc_id, page, position, level FROM t")
def title_demotion(spark, d):
    return Y.demote_title(Y.heading_levels(printed(spark, d))).select("doc_id", "page", "position", "level")


@query(PRINTED + " SELECT doc_id, page, \"column\", min(x0) AS \"left\", max(x1) AS \"right\" FROM p GROUP BY doc_id, page, \"column\"")
def column_metrics(spark, d):
    return Y.column_edges(printed(spark, d))


HEIGHT = "SELECT doc_id, coalesce(quantile_cont(bottom - top, 0.5) FILTER (WHERE bottom > top), 12.0) AS line_height FROM p GROUP BY doc_id"


@query(PRINTED + f" SELECT doc_id, round(line_height, 6) AS line_height FROM ({HEIGHT})")
def median_height(spark, d):
    return Y.line_height(printed(spark, d)).select("doc_id", F.round("line_height", 6).alias("line_height"))


BREAKS = DEMOTED + (
    f""", m AS (SELECT doc_id, page, min(x0) AS l, max(x1) AS r FROM p GROUP BY doc_id, page), lh AS ({HEIGHT}),
e AS (SELECT t.*, x1 >= l + greatest(1.0, r - l) * 0.8 AS full_line, x0 > l + greatest(1.0, r - l) * 0.02 AS indented, line_height FROM t JOIN m USING (doc_id, page) JOIN lh USING (doc_id)),
g AS (SELECT *, lag(page) OVER w AS bp, lag(level) OVER w AS bl, lag(full_line) OVER w AS bf, top - lag(bottom) OVER w AS gap FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY page, position))"""
)
STARTS = "CASE WHEN bp IS NULL THEN true WHEN coalesce(level IS NOT NULL AND bl = level AND bp = page AND gap <= line_height * 1.2, false) THEN false WHEN level IS NOT NULL OR bl IS NOT NULL THEN true WHEN bp = page THEN gap > line_height * 0.75 OR indented OR NOT bf ELSE NOT (bf AND NOT indented) END"


def broken(spark, d):
    return Y.paragraph_breaks(Y.demote_title(Y.heading_levels(printed(spark, d))))


@query(PRINTED + BREAKS + f" SELECT doc_id, page, position, {STARTS} AS starts FROM g")
def paragraph_breaks(spark, d):
    return broken(spark, d).select("doc_id", "page", "position", "starts")


@query(PRINTED + BREAKS + f" SELECT doc_id, count(*) FILTER (WHERE {STARTS})::BIGINT AS n_groups, sum(length(text))::BIGINT AS chars FROM g GROUP BY doc_id")
def page_groups(spark, d):
    """How many groups a document's lines make, and that no character is lost: joined texts less their joints."""
    rows = broken(spark, d)
    made = Y.groups(rows).groupBy("doc_id").agg(F.count("*").alias("n_groups"))
    sizes = rows.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    return made.join(sizes, "doc_id")


@query(
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'con' || lower(lang) ELSE 'con' || CASE WHEN doc_id % 3 = 1 THEN '-' ELSE '--' END || ' ' || CASE WHEN doc_id % 3 = 1 THEN upper(lang) ELSE lang END END AS text FROM documents"
)
def dehyphenate(spark, d):
    k = F.col("doc_id") % 3
    parts = F.array(F.when(k == 2, "con--").otherwise("con-"), F.when(k == 1, F.upper("lang")).otherwise(F.col("lang")))
    return table(spark, d, "documents").select("doc_id", Y.joined_text(parts).alias("text"))


@query("SELECT doc_id, k::INT AS page, start, \"end\" FROM (SELECT doc_id, k, (k - 1) * (n_chars // 3) AS start, CASE WHEN k = 3 THEN n_chars ELSE k * (n_chars // 3) END AS \"end\" FROM documents CROSS JOIN (SELECT unnest([1, 2, 3]) AS k)) WHERE \"end\" > start")
def page_spans(spark, d):
    marks = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("total"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page"))
    return Y.page_spans(marks.withColumn("start", (F.col("page") - 1) * F.floor(F.col("total") / 3))).select("doc_id", "page", "start", "end")


def grid_words(spark, d):
    """Words of each benchmark text on pages of two columns, ten rows each, filled up with dots; a word fills its column's line."""
    words = F.filter(F.split("text", "[ \\n]+"), lambda w: w != "")
    made = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), words.alias("words")).withColumn("pages", F.ceil(F.size("words") / 20).cast("int"))
    every = made.select("doc_id", "pages", F.posexplode(F.concat("words", F.array_repeat(F.lit("."), 20 * F.col("pages") - F.size("words")))).alias("i", "text"))
    k, side, row = F.col("i") % 20, F.floor(F.col("i") % 20 / 10), F.col("i") % 10
    x0, top = (54 + 266 * side).cast("double"), (150 + 14 * row).cast("double")
    return every.select(
        "doc_id", (F.floor(F.col("i") / 20) + 1).cast("int").alias("page"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), F.col("pages").alias("page_count"), "text",
        x0.alias("x0"), (x0 + 226).alias("x1"), (top + k % 2 * 0.5).alias("top"), (top + 10).alias("bottom"), F.lit(9.5).alias("size"), F.lit("Serif").alias("fontname"),
    )


GRID = "SELECT item_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '') AS words, ceil(len(words) / 20)::INT AS pages FROM benchmark"


@query(f"SELECT item_id AS doc_id, array_to_string(words || list_transform(range(20 * pages - len(words)), lambda i: '.'), ' ') AS text FROM ({GRID}) WHERE len(words) > 0")
def reading_order(spark, d):
    """Rows, gutter and columns of pages: words set in two columns are read column by column."""
    lines = Y.page_lines(grid_words(spark, d))
    ordered = F.array_sort(F.collect_list(F.struct("page", "position", "text")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


@query(f"SELECT item_id AS doc_id, p::INT AS page, 10::BIGINT AS \"left\", 10::BIGINT AS \"right\", 0::BIGINT AS \"across\" FROM (SELECT item_id, unnest(range(1, pages + 1)) AS p FROM ({GRID}))")
def page_columns(spark, d):
    """How many lines each column of a page has, and how many run across."""
    count = lambda c: F.count_if(F.col("column") == c)
    return Y.page_lines(grid_words(spark, d)).groupBy("doc_id", "page").agg(count(0).alias("left"), count(1).alias("right"), count(Y.FULL_WIDTH).alias("across"))
