"""Joins of rows to facts of their keys where a few keys hold most of the rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import shared_folder

#: Keys that may be broadcast. At most so many hold more than a share of 1 / MOST_HEAVY of all rows each.
MOST_HEAVY = 10_000


def stored(df: DataFrame, place: str | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again.

    Nothing behind them is computed a second time, a lost executor costs nothing that was
    written, and Spark knows how many bytes they have when it chooses a join.
    """
    place = place or f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def with_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], weight: str, scatter: Sequence[str]) -> DataFrame:
    """``rows`` with the other columns of ``facts``, null where a key has none; null keys are equal.

    ``facts`` is stored, has one row a key and counts in ``weight`` the rows that hold it.
    Keys with more than 1 / ``MOST_HEAVY`` of all counted rows are so few that they are
    broadcast whatever the data; their rows then go through the other join under a number
    of their own, made from ``scatter``, so that no task gets the rows of one heavy key. No
    other key can hold more than that share.
    """
    line = (facts.agg(F.sum(weight)).scalar()) / MOST_HEAVY
    values = [c for c in facts.columns if c not in keys]
    named = lambda df, kind: df.select(*[F.col(c).alias(f"{kind}_{c}") for c in keys], *[F.col(c).alias(f"{kind}_{c}") for c in values], F.lit(True).alias(f"{kind}_has"))
    same = lambda kind: [rows[c].eqNullSafe(F.col(f"{kind}_{c}")) for c in keys]
    heavy = named(facts.where(F.col(weight) > line), "heavy")
    light = named(facts.where(F.col(weight) <= line), "light").withColumn("light_dealt", F.lit(0))
    once = rows.join(F.broadcast(heavy), same("heavy"), "left")
    dealt = F.when(F.col("heavy_has"), F.pmod(F.xxhash64(*scatter), F.lit((1 << 30) - 1)).cast("int") + 1).otherwise(0)
    both = once.withColumn("dealt", dealt).join(light, [*same("light"), F.col("dealt") == F.col("light_dealt")], "left")
    return both.select(*[rows[c] for c in rows.columns], *[F.coalesce(f"heavy_{c}", f"light_{c}").alias(c) for c in values])
