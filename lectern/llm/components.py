"""Connected components by alternating stars (large star, small star) on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges`` (src, dst) with the smallest node it reaches.

    Returns (node, component). Self loops and nulls are ignored; a node without an
    edge is not in the result; an empty table gives an empty one. Each round hangs
    every neighbour on the smallest one seen; the number of rounds is logarithmic in
    the longest path. The rounds only exchange edges through shuffles and reliable
    checkpoints; the driver sees two numbers a round. Raises if ``most_rounds`` do
    not suffice rather than return a partial labelling.
    """
    e = edges.where("src is not null and dst is not null and src <> dst")
    e = durable(e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = _mark(e)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        hung = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = hung.groupBy("u").agg(F.min("v").alias("m"))
        pairs = hung.join(low.select(F.col("u").alias("w"), "m"), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(pairs.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(e)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(e: DataFrame) -> tuple:
    """Count and an order-free digest of the edges, to see when a round changes nothing."""
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
