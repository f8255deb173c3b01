"""An inverted file over vectors: chunks written by the cell of their nearest centre, questions put to few cells.

A search probes the cells nearest to a question, and more of them where its tenant has few
chunks there. Cells also keep how far their chunks are from the centre, so a search can go
on to every cell that may hold a nearer chunk, and is then exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import vectors as V
from lectern.operators.retrieval import BLOCK, TILE, Retrieval, first_of, matrix, ranked, summed, whole
from lectern.sources.tables import stored

#: Cells of an index; their centres are sent to every task.
MOST_CELLS = 4096
#: What rounding may take from a bound.
SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    """``chunks`` (document_id, ordinal, tenant, unit, cell), ``cells`` (cell, centre, least), ``counts`` (cell, tenant, n)."""

    chunks: DataFrame
    cells: DataFrame
    counts: DataFrame


def unit(embedding: Column) -> Column:
    """The vector in double precision, of length one."""
    length = V.norm(embedding)
    return F.transform(embedding, lambda x: x.cast("double") / length)


def build(chunks: DataFrame, place: str | None = None, cells: int | None = None, sample: int = 200_000, seed: int = 5) -> Index:
    """An index of chunks (document_id, ordinal, tenant, embedding), written to a folder by cell and read from there.

    Centres are found by k-means on about ``sample`` rows, chosen by a hash of their ids:
    the square root of the number of rows, but ``MOST_CELLS`` at most. All rows are then put
    to their nearest centre. Vectors of one length only, that of most rows; others and those
    without a direction are in no cell, and near to no question.
    """
    rows = whole(chunks, "embedding").select("document_id", "ordinal", "tenant", unit(F.col("embedding")).alias("unit"))
    sizes = rows.groupBy(F.size("unit").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        none = rows.withColumn("cell", F.lit(0)).limit(0)
        return Index(none, none.select("cell", F.col("unit").alias("centre"), F.lit(0.0).alias("least")), none.select("cell", "tenant", F.lit(0).cast("long").alias("n")))
    rows = rows.where(F.size("unit") == sizes["dim"]).withColumn("features", array_to_vector("unit"))
    n = cells or max(1, min(MOST_CELLS, ceil(sizes["count"] ** 0.5)))
    share = F.pmod(F.xxhash64("document_id", "ordinal"), F.lit(1 << 30)) < int(min(1.0, sample / sizes["count"]) * (1 << 30))
    model = KMeans(k=n, distanceMeasure="cosine", seed=seed, maxIter=10, initSteps=2, predictionCol="cell").fit(rows.where(share)) if n > 1 else None
    centres = [[float(x) for x in c] for c in model.clusterCenters()] if model else [list(rows.first()["unit"])]
    # each cell over as many tasks as its share of the rows is worth
    partitions = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    put = (model.transform(rows) if model else rows.withColumn("cell", F.lit(0))).drop("features")
    salt = F.pmod(F.xxhash64("document_id", "ordinal"), F.lit(max(1, partitions // n)))
    kept = stored(put.repartition(partitions, "cell", salt), place and f"{place}/chunks", ["cell"])
    spark = chunks.sparkSession
    # an empty centre draws no rows and gets no cell
    centre = spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>").withColumn("centre", unit(F.col("centre")))
    near = kept.join(F.broadcast(centre), "cell").groupBy("cell").agg(F.min(V.dot(F.col("unit"), F.col("centre"))).alias("least"))
    described = stored(centre.join(near, "cell"), place and f"{place}/cells")
    return Index(kept, described, stored(kept.groupBy("cell", "tenant").agg(F.count("*").alias("n")), place and f"{place}/counts"))


def opened(spark: SparkSession, place: str) -> Index:
    """The index that ``build`` has written to a folder."""
    return Index(*(spark.read.parquet(f"{place}/{name}") for name in ("chunks", "cells", "counts")))


def order_of_cells(index: Index, questions: DataFrame) -> DataFrame:
    """(question_id, tenant, qe, cell, near, bound, n, rank, before): for each question the cells with chunks of its tenant, nearest first.

    ``near`` is the cosine of question and centre, ``bound`` the largest that a chunk of the
    cell can have, ``before`` how many chunks of the tenant the nearer cells have.
    """
    at = questions.join(F.broadcast(index.counts), "tenant") if index.counts.count() <= 100_000 else questions.join(index.counts, "tenant")
    cells = at.join(F.broadcast(index.cells), "cell").withColumn("near", V.dot(F.col("qe"), F.col("centre")))
    angle = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
    bound = F.cos(F.greatest(F.lit(0.0), angle(F.col("near")) - angle(F.col("least") - SLACK))) + SLACK
    order = Window.partitionBy("question_id").orderBy(F.desc("near"), "cell")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.withColumn("bound", bound).withColumn("rank", F.row_number().over(order)).withColumn("before", before).drop("centre", "least")


def in_cells(index: Index, asked: DataFrame, questions: DataFrame | None = None, n: int = 1 << 40) -> DataFrame:
    """(question_id, document_id, ordinal, distance) of the asked cells (question_id, tenant, cell, n, last) of questions (question_id, qe): only their folders are read.

    The n nearest of every question in a cell, none further than ``last``, if that is given;
    without ``questions`` the asked cells have their vectors. The chunks of a
    tenant in a cell and the questions put to it are dealt by hashes of their ids into blocks
    of about ``BLOCK`` rows, and a pair of blocks is one matrix product. That only tells which
    pairs can be meant; their distances are then those of ``vectors.dot``, sum by sum.
    """
    keys = ["cell", "tenant", "dim", "c", "q"]
    questions = asked.select("question_id", "qe").distinct() if questions is None else questions
    asked = asked if "last" in asked.columns else asked.withColumn("last", F.lit(4.0))
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()]  # MOST_CELLS at most
    parts = 1 + questions.count() // BLOCK
    dealt = lambda salts, *ids: F.pmod(F.xxhash64(*ids), salts).cast("int")
    # a number of partitions of its own, as blocks are small for what is made of them
    partitions = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = (1 + F.col("n") / BLOCK).cast("int")
    left = index.chunks.where(F.col("cell").isin(cells)).join(index.counts, ["cell", "tenant"])
    left = left.select("cell", "tenant", F.size("unit").alias("dim"), dealt(salts, "document_id", "ordinal").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("q"), "document_id", "ordinal", "unit")
    right = asked.select("question_id", "cell", "tenant", "last", F.explode(F.sequence(F.lit(0), salts - 1)).alias("c")).join(questions.select("question_id", "qe"), "question_id")
    right = right.withColumn("dim", F.size("qe")).withColumn("q", dealt(F.lit(parts), "question_id"))
    schema = T.StructType([right.schema["question_id"], left.schema["document_id"], left.schema["ordinal"], T.StructField("distance", T.DoubleType())])

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y, last = matrix(a.column("unit")), matrix(b.column("qe")), b.column("last").to_numpy()
        found = []
        for k in range(0, len(y) if len(x) else 0, TILE):
            guess = y[k : k + TILE] @ x.T
            least = np.partition(guess, -n, axis=1)[:, -n] if n < len(x) else np.full(len(guess), -np.inf)
            rows, columns = np.nonzero(guess >= np.maximum(least, 1.0 - last[k : k + TILE])[:, None] - SLACK)
            distance = 1.0 - summed(x[columns], y[k + rows])
            near = distance <= last[k + rows]
            found.append((k + rows[near], columns[near], distance[near]))
        return first_of(a.select(["document_id", "ordinal"]), b.column("question_id"), found, n)

    left, right = (df.repartition(partitions, *keys).groupBy(*keys) for df in (left, right))
    return left.cogroup(right).applyInArrow(search, schema)


def best_of(near: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy("distance", "document_id", "ordinal")
    return near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)


def retrieve(index: Index, questions: DataFrame, how: Retrieval = Retrieval(), probes: int = 8, exact: bool = False) -> DataFrame:
    """``retrieval.retrieve_batch`` from an index, for questions (question_id, tenant, qe).

    A question goes to its ``probes`` nearest cells and on to the next ones until these have
    twice as many chunks of its tenant as candidates are wanted. If ``exact``, it then also
    goes to all cells that may hold a nearer chunk than the last candidate found, and the
    result is that of all chunks. Questions without a direction find nothing.
    """
    asked = stored(whole(questions, "qe").select("question_id", "tenant", unit(F.col("qe")).alias("qe")))
    cells = stored(order_of_cells(index, asked).select("question_id", "tenant", "cell", "bound", "n", "rank", "before"))
    first = (F.col("rank") <= probes) | (F.col("before") < 2 * how.candidates)
    near = in_cells(index, cells.where(first).withColumn("last", F.lit(4.0)), asked, how.candidates)
    if exact:
        near = stored(best_of(near, how.candidates).drop("n"))
        last = near.groupBy("question_id").agg(F.when(F.count("*") >= how.candidates, F.max("distance")).otherwise(F.lit(4.0)).alias("last"))
        more = cells.where(~first).join(last, "question_id", "left").withColumn("last", F.coalesce("last", F.lit(4.0))).where(1.0 - F.col("bound") <= F.col("last"))
        near = near.unionByName(in_cells(index, more, asked, how.candidates))
    return ranked(near, how)
