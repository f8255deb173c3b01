"""Keyset pages, cursors and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, MOST = 50, 200


def newest_first(rows: DataFrame, time: str, key: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """One page by (time, key) descending, after the cursor, with has_more on every row.

    One row more than the page is read, so the plan is a top-n of the filtered scan.
    """
    if cursor is not None:
        at, last = F.lit(cursor[0]).cast("timestamp_ntz"), F.lit(cursor[1])
        rows = rows.where((F.col(time) < at) | ((F.col(time) == at) & (F.col(key) < last)))
    page = rows.orderBy(F.desc(time), F.desc(key)).limit(limit + 1)
    return _cut(page, [F.desc(time), F.desc(key)], limit)


def by_ordinal(rows: DataFrame, ordinal: str, limit: int, cursor: int | None = None) -> DataFrame:
    page = (rows if cursor is None else rows.where(F.col(ordinal) > cursor)).orderBy(ordinal).limit(limit + 1)
    return _cut(page, [F.col(ordinal)], limit)


def _cut(page: DataFrame, order: list[Column], limit: int) -> DataFrame:
    from pyspark.sql import Window

    whole = Window.orderBy(*order)  # a page of limit + 1 rows
    page = page.withColumn("rn", F.row_number().over(whole)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    return page.where(F.col("rn") <= limit).withColumn("has_more", F.col("n") > limit).drop("n")


def encode_cursor(payload: Column) -> Column:
    """A struct as URL-safe base64 of compact JSON without padding; fields in alphabetical order."""
    return F.rtrim(F.translate(F.base64(F.encode(F.to_json(payload), "utf-8")), "+/\r\n", "-_"), F.lit("="))


def decode_cursor(cursor: Column, schema: str) -> Column:
    """The struct in a cursor, null if it is none."""
    plain = F.translate(cursor, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.from_json(F.decode(F.try_to_binary(padded, F.lit("base64")), "utf-8"), schema)


def clamp(limit: Column) -> Column:
    """The page size for a request: 50 if none is given, 200 at most, null (an error) under 1."""
    return F.when(limit.isNull(), DEFAULT_LIMIT).when(limit < 1, None).otherwise(F.least(limit, F.lit(MOST)))


def merge_page(page: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The page's rows and the old rows that it lacks."""
    return page.unionByName(old.join(page.select(key), key, "left_anti"))
