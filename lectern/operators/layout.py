"""Page geometry: from words with positions to lines, running headers, headings and paragraphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X

# Shares of a page or column, points, counts.
GUTTER_SHARE, GUTTER_POINTS, GUTTER_PLACE, GUTTER_INK = 0.025, 8.0, (0.25, 0.75), 0.2
ANCHOR, COLUMN_ROWS, PAGE_ROWS = 0.03, 3, 6
BAND, RUNNING_PAGES, RUNNING_SHARE, SLOTS = 0.12, 3, 0.5, 50
FULL_SHARE, INDENT, GAP, WRAP_GAP = 0.80, 0.02, 0.75, 1.2
BOLD = ("bold", "black", "heavy")
FULL_WIDTH = -1
LINES = "doc_id bigint, page int, position int, text string, x0 double, x1 double, top double, bottom double, size double, bold boolean, column int, page_width double, page_height double"


def rows_of(words: pd.DataFrame) -> list[pd.DataFrame]:
    """A page's words grouped by height, each row from left to right."""
    if words.empty:
        return []
    within = max(1.5, float((words["bottom"] - words["top"]).median()) * 0.5)
    words = words.assign(key=words["top"].round(2)).sort_values(["key", "x0"], kind="stable")
    rows, first = [], None
    for k, top in enumerate(words["top"].tolist()):
        if first is None or abs(top - first) > within:
            rows.append([])
            first = top
        rows[-1].append(k)
    return [words.iloc[r].sort_values("x0", kind="stable") for r in rows]


def gutter_of(rows: list[pd.DataFrame], width: float) -> float | None:
    """The middle of the widest quiet stripe between two columns of text, if there is one."""
    if len(rows) < PAGE_ROWS:
        return None
    left, right = min(r["x0"].min() for r in rows), max(r["x1"].max() for r in rows)
    extent = right - left
    if extent <= 0:
        return None
    bins = int(extent) + 1
    ink = np.zeros(bins, np.int64)
    for r in rows:
        own = np.zeros(bins, bool)
        for a, b in zip((r["x0"] - left).astype(int), (r["x1"] - left).astype(int), strict=True):
            own[max(0, a) : min(bins - 1, b) + 1] = True
        ink += own
    quiet = np.concatenate([[False], ink <= len(rows) * GUTTER_INK, [False]])
    turns = np.flatnonzero(quiet[1:] != quiet[:-1])
    best = None
    for a, b in zip(turns[::2], turns[1::2], strict=True):
        middle = left + (a + b) / 2
        if b - a >= max(GUTTER_POINTS, width * GUTTER_SHARE) and GUTTER_PLACE[0] <= (middle - left) / extent <= GUTTER_PLACE[1] and (best is None or b - a > best[0]):
            best = (b - a, float(middle))
    if best is None:
        return None
    sides = sum((r["x1"] <= best[1]).any() for r in rows), sum((r["x0"] >= best[1]).any() for r in rows)
    return best[1] if min(sides) >= COLUMN_ROWS else None


def line_of(words: pd.DataFrame, column: int) -> tuple:
    """(text, x0, x1, top, bottom, size, bold, column) of words of one line; size is the median over characters."""
    count = words["text"].str.len().clip(lower=1).to_numpy()
    bold = words["fontname"].fillna("").str.lower().str.contains("|".join(BOLD)).to_numpy()
    size = round(float(np.median(np.repeat(words["size"].fillna(0.0).to_numpy(), count))), 2)
    return " ".join(words["text"]).strip(), words["x0"].min(), words["x1"].max(), words["top"].min(), words["bottom"].max(), size, bool(2 * count[bold].sum() > count.sum()), column


def ordered(rows: list[pd.DataFrame], width: float) -> list[tuple]:
    """A page's lines in reading order: between full-width lines the left column, then the right."""
    gutter = gutter_of(rows, width)
    if gutter is None:
        return [line_of(r, 0) for r in rows]
    left, right = min(r["x0"].min() for r in rows), max(r["x1"].max() for r in rows)
    margin = max(1.0, right - left) * ANCHOR
    keyed, band = [], 0
    for k, r in enumerate(rows):
        crossing = ((r["x0"] < gutter) & (gutter < r["x1"])).any()
        if crossing and not (r["x0"].min() <= left + margin and r["x1"].max() < right - margin):
            keyed.append(((band + 1, 0, k), line_of(r, FULL_WIDTH)))
            band += 2
            continue
        side = (r["x0"] + r["x1"]) / 2 > gutter
        keyed += [((band, c, k), line_of(r[side == c], c)) for c in (0, 1) if (side == c).any()]
    return [x[1] for x in sorted(keyed, key=lambda x: x[0])]


def running_rows(rows: DataFrame) -> DataFrame:
    """Row texts (doc_id, page, text, top, bottom, page_height, page_count) that are running headers or footers.

    A text, numbers aside, in one slot of the top or bottom band on enough distinct pages.
    """
    banded = rows.where((F.col("page_height") > 0) & (F.col("page_count") >= RUNNING_PAGES) & ((F.col("top") / F.col("page_height") <= BAND) | (F.col("bottom") / F.col("page_height") >= 1 - BAND)))
    keyed = banded.withColumn("key", X.repetition_key(F.col("text"))).withColumn("slot", F.floor(F.col("top") / F.col("page_height") * SLOTS).cast("int")).where("key <> ''")
    often = keyed.groupBy("doc_id", "key", "slot").agg(F.count_distinct("page").alias("pages"), F.first("page_count").alias("of"))
    often = often.where(F.col("pages") >= F.greatest(F.lit(RUNNING_PAGES), F.floor(F.col("of") * RUNNING_SHARE)))
    return keyed.join(often.select("doc_id", "key", "slot"), ["doc_id", "key", "slot"], "left_semi")


def page_lines(words: DataFrame) -> DataFrame:
    """Lines in reading order from words (doc_id, page, page_width, page_height, page_count, text, x0, x1, top, bottom, size, fontname).

    Rows are made page by page; running ones are found over the whole document and taken
    out before columns are. A page is one group.
    """

    def rows(page: pd.DataFrame) -> pd.DataFrame:
        head = page.iloc[0]
        made = [(head["doc_id"], head["page"], k, " ".join(r["text"]).strip(), r["top"].min(), r["bottom"].max(), head["page_height"], head["page_count"]) for k, r in enumerate(rows_of(page))]
        return pd.DataFrame(made, columns=["doc_id", "page", "row", "text", "top", "bottom", "page_height", "page_count"])

    found = words.groupBy("doc_id", "page").applyInPandas(rows, "doc_id bigint, page int, row int, text string, top double, bottom double, page_height double, page_count int")
    running = running_rows(found).groupBy("doc_id", "page").agg(F.collect_set("row").alias("running"))

    def lines(page: pd.DataFrame) -> pd.DataFrame:
        head = page.iloc[0]
        drop = set(head["running"]) if head["running"] is not None else set()
        kept = [r for k, r in enumerate(rows_of(page)) if k not in drop]
        made = [(head["doc_id"], head["page"], k, *x, head["page_width"], head["page_height"]) for k, x in enumerate(ordered(kept, head["page_width"])) if x[0]]
        return pd.DataFrame(made, columns=[c.split()[0] for c in LINES.split(", ")])

    return words.join(running, ["doc_id", "page"], "left").groupBy("doc_id", "page").applyInPandas(lines, LINES)


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, body_size): the median line size over characters."""
    return lines.groupBy("doc_id").agg(F.expr("percentile(size, 0.5, greatest(1, length(text)))").alias("body_size"))


def document():
    return Window.partitionBy("doc_id")


def heading_candidates(lines: DataFrame) -> DataFrame:
    """Lines with body_size and candidate: short, without a closing stop, larger than the body or bold.

    Here and below what is known of a document or a column comes from windows, all of which
    one shuffle by document serves.
    """
    t = X.strip(F.col("text"))
    like = (t != "") & (F.length(t) <= 120) & ~F.substring(t, -1, 1).isin(".", ";", ",")
    large = (F.col("size") >= F.col("body_size") * 1.15) | (F.col("bold") & (F.col("size") >= F.col("body_size")))
    return lines.withColumn("body_size", F.expr("percentile(size, 0.5, greatest(1, length(text)))").over(document())).withColumn("candidate", like & large)


def heading_levels(lines: DataFrame) -> DataFrame:
    """Lines with their heading level: the place of their size among the candidates', null if it is none.

    Off in documents without candidates or where over a quarter of the lines are.
    """
    sizes = F.collect_set(F.when(F.col("candidate"), F.round("size", 1))).over(document())
    marked = heading_candidates(lines).withColumns({"levels": sizes, "share": F.avg(F.col("candidate").cast("int")).over(document())})
    marked = marked.withColumn("levels", F.slice(F.sort_array("levels", False), 1, 6))
    close = F.array_position(F.transform("levels", lambda s: (F.abs(F.col("size") - s) < 0.26).cast("int")), 1)
    level = F.least(F.when(close > 0, close).otherwise(F.size("levels") + 1), F.lit(6)).cast("int")
    on = F.col("candidate") & (F.col("body_size") > 0) & (F.col("share") <= 0.25) & (F.size("levels") > 0)
    return marked.withColumn("level", F.when(on, level)).drop("levels", "share")


def demote_title(lines: DataFrame) -> DataFrame:
    """The document's title is no heading: the first line, if it alone has level 1 and deeper levels exist."""
    order, whole = Window.partitionBy("doc_id").orderBy("page", "position"), Window.partitionBy("doc_id")
    lone = (F.row_number().over(order) == 1) & (F.sum((F.col("level") == 1).cast("int")).over(whole) == 1) & (F.max("level").over(whole) > 1)
    return lines.withColumn("level", F.when(lone & (F.col("level") == 1), None).otherwise(F.col("level")))


def column_edges(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id", "page", "column").agg(F.min("x0").alias("left"), F.max("x1").alias("right"))


def line_height(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.coalesce(F.median(F.when(F.col("bottom") > F.col("top"), F.col("bottom") - F.col("top"))), F.lit(12.0)).alias("line_height"))


def paragraph_breaks(lines: DataFrame) -> DataFrame:
    """Lines with starts: whether a new group begins there - heading, paragraph, or the document.

    Wrapped headings go on; else a gap, an indent or a short line before begins a paragraph;
    over a column or page break only fullness and indent count.
    """
    column = Window.partitionBy("doc_id", "page", "column")
    height = F.coalesce(F.median(F.when(F.col("bottom") > F.col("top"), F.col("bottom") - F.col("top"))).over(document()), F.lit(12.0))
    edged = lines.withColumns({"left": F.min("x0").over(column), "right": F.max("x1").over(column), "line_height": height})
    width = F.greatest(F.lit(1.0), F.col("right") - F.col("left"))
    edged = edged.withColumn("full", F.col("x1") >= F.col("left") + width * FULL_SHARE).withColumn("indented", F.col("x0") > F.col("left") + width * INDENT)
    order = Window.partitionBy("doc_id").orderBy("page", "position")
    before = lambda c: F.lag(c).over(order)
    same = (before("page") == F.col("page")) & (before("column") == F.col("column"))
    gap = F.col("top") - before("bottom")
    wrapped = F.col("level").isNotNull() & (before("level") == F.col("level")) & same & (gap <= F.col("line_height") * WRAP_GAP)
    heading = F.col("level").isNotNull() | before("level").isNotNull()
    fresh = F.when(same, (gap > F.col("line_height") * GAP) | F.col("indented") | ~before("full")).otherwise(~(before("full") & ~F.col("indented")))
    starts = F.when(before("page").isNull(), True).when(F.coalesce(wrapped, F.lit(False)), False).when(heading, True).otherwise(fresh)
    return edged.withColumn("starts", starts).drop("full", "indented", "left", "right", "line_height")


def joined_text(parts: Column) -> Column:
    """Lines of a paragraph as one text; a word broken by a hyphen at a line's end is mended."""
    mend = lambda a, b: a.rlike("(^|[^-])-$") & b.rlike(r"^\p{Ll}")
    return F.aggregate(parts, F.lit(None).cast("string"), lambda a, b: F.when(a.isNull(), b).when(mend(a, b), F.concat(F.regexp_replace(a, "-$", ""), b)).otherwise(F.concat(a, F.lit(" "), b)))


def groups(lines: DataFrame) -> DataFrame:
    """(doc_id, group, level, page, text): headings and paragraphs in order, from lines with starts and level."""
    order = Window.partitionBy("doc_id").orderBy("page", "position")
    numbered = lines.withColumn("group", F.sum(F.col("starts").cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("page", "position", "text")))
    made = numbered.groupBy("doc_id", "group").agg(F.min("level").alias("level"), F.min("page").alias("page"), parts.alias("parts"))
    return made.select("doc_id", "group", "level", "page", joined_text(F.transform("parts", lambda x: x["text"])).alias("text"))


def page_spans(marks: DataFrame) -> DataFrame:
    """(doc_id, page, start, end) from marks (doc_id, page, start, total), up to the next mark or the end; empty ones go."""
    order = Window.partitionBy("doc_id").orderBy("start", "page")
    return marks.withColumn("end", F.coalesce(F.lead("start").over(order), F.col("total"))).where("end > start").drop("total")


def read_pages(words: DataFrame) -> DataFrame:
    """Headings and paragraphs of documents given as words."""
    return groups(paragraph_breaks(demote_title(heading_levels(page_lines(words)))))
