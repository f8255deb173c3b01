"""Passage retrieval: candidates, cap, floor and order, for one question or for many."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as X
from lectern.functions import vectors as V

#: Rows of a block of chunks or questions, and questions whose products with a block are held at once.
BLOCK, TILE = 8192, 256
#: What rounding may take from a product of unit vectors.
SLACK = 1e-9


@dataclass(frozen=True)
class Retrieval:
    """How many passages to return, at what similarity, from how many candidates, how many a document."""

    top_k: int = 8
    floor: float = 0.35
    cap: int = 4
    overfetch: int = 6

    @property
    def candidates(self) -> int:
        return max(self.top_k, self.top_k * self.overfetch)


def scoped(chunks: DataFrame, document_ids: list | None) -> DataFrame:
    """Chunks of the named documents; None names all, an empty list none."""
    if document_ids is None:
        return chunks
    return chunks.where(F.col("document_id").isin(document_ids)) if document_ids else chunks.where(F.lit(False))


def candidates(chunks: DataFrame, question: DataFrame, n: int) -> DataFrame:
    """The n chunks nearest to the one question vector (qe), by cosine distance.

    Ties go by document and ordinal. The question is a single row, so it is broadcast; the
    cut is a top-n of every partition and then of those.
    """
    near = chunks.crossJoin(F.broadcast(question.select("qe").limit(1))).withColumn("distance", 1.0 - V.cosine(F.col("embedding"), F.col("qe")))
    return near.drop("qe", "embedding").orderBy("distance", "document_id", "ordinal").limit(n)


def capped(found: DataFrame, cap: int, by: tuple = ()) -> DataFrame:
    order = Window.partitionBy(*by, "document_id").orderBy("distance", "ordinal")
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap).drop("rn")


def retrieve(chunks: DataFrame, question: DataFrame, how: Retrieval = Retrieval(), document_ids: list | None = None) -> DataFrame:
    """Passages for one question from chunks (document_id, ordinal, embedding) of one tenant.

    In this order: candidates, cap per document, floor (inclusive), best top_k.
    """
    found = capped(candidates(scoped(chunks, document_ids), question, how.candidates), how.cap)
    found = found.where(F.col("distance") <= 1.0 - how.floor)
    return found.orderBy("distance", "document_id", "ordinal").limit(how.top_k).withColumn("similarity", 1.0 - F.col("distance"))


def whole(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a direction: not null or empty, no null or non-finite component, not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.size(vector) > 0).where(sound).where(F.exists(vector, lambda x: x != 0))


def retrieve_batch(chunks: DataFrame, questions: DataFrame, how: Retrieval = Retrieval()) -> DataFrame:
    """``retrieve`` for every question (question_id, tenant, qe) over chunks with a tenant column.

    Rows without a tenant or a vector that has a direction are near to none, as are vectors of
    different lengths.
    """
    return ranked(nearest(chunks, questions, how.candidates), how)


def nearest(chunks: DataFrame, questions: DataFrame, n: int) -> DataFrame:
    """The columns of chunks but the embedding, with question_id and distance: of each block of chunks the n nearest of every question.

    Chunks and questions of a tenant are dealt by hashes of their ids into blocks of about
    ``BLOCK`` rows, every block of the one is sent once to every block of the other, and a
    pair of blocks is one matrix product. The product only tells which pairs can be among the
    n nearest; their distances are then those of ``vectors.cosine``, sum by sum, so equal
    vectors are equally far in every block.
    """
    keys = ["tenant", "dim", "c", "q"]
    sound = lambda rows, vector: whole(rows.where("tenant is not null"), vector).withColumn("dim", F.size(vector))
    chunks, questions = sound(chunks, "embedding"), sound(questions.select("question_id", "tenant", "qe"), "qe")
    c, q = (1 + df.count() // BLOCK for df in (chunks, questions))
    dealt = lambda salts, *ids: F.pmod(F.xxhash64(*ids), F.lit(salts)).cast("int")
    every = lambda salts: F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    # a number of partitions of its own, as blocks are small for what is made of them
    partitions = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = chunks.withColumn("c", dealt(c, "document_id", "ordinal")).withColumn("q", every(q)).repartition(partitions, *keys)
    right = questions.withColumn("q", dealt(q, "question_id")).withColumn("c", every(c)).repartition(partitions, *keys)
    kept = [f for f in left.schema if f.name not in ("embedding", "dim", "c", "q")]
    schema = T.StructType([right.schema["question_id"], *kept, T.StructField("distance", T.DoubleType())])
    names = [f.name for f in kept]

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = matrix(a.column("embedding")), matrix(b.column("qe"))
        found = [(k + rows, columns, distance) for k in range(0, len(y), TILE) for rows, columns, distance in [near(x, y[k : k + TILE], n)]]
        return first_of(a.select(names), b.column("question_id"), found, n)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)


def first_of(chunks: pa.Table, questions: pa.ChunkedArray, found: list[tuple], n: int) -> pa.Table:
    """Of the found (row of questions, row of chunks, distance) the n nearest of every question, with the columns of chunks."""
    rows, columns, distance = (np.concatenate(part) if found else np.zeros(0, np.int64) for part in (list(zip(*found, strict=True)) or [[]] * 3))
    made = pa.table([questions.take(rows), *chunks.take(columns).columns, pa.array(distance.astype(np.float64))], names=["question_id", *chunks.column_names, "distance"])
    order = pc.sort_indices(pa.table({"row": rows, "distance": distance, "document_id": made.column("document_id"), "ordinal": made.column("ordinal")}), [(k, "ascending") for k in ("row", "distance", "document_id", "ordinal")], null_placement="at_start").to_numpy()
    first = rows[order]
    place = np.arange(len(first)) - np.searchsorted(first, first)
    return made.take(order[place < n])


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix in double precision."""
    flat = np.concatenate([np.zeros(0), *(x.flatten().to_numpy(zero_copy_only=False) for x in vectors.chunks)])
    return flat.reshape(len(vectors), len(flat) // max(1, len(vectors)))  # one of the sides of a pair can be empty


def near(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of y, row of x, distance) of at least the n rows of x nearest to each of y, and all as near as those."""
    if not len(x) or not len(y):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    size = lambda v: np.sqrt(summed(v, v))
    a, b = size(x), size(y)
    guess = (y / b[:, None]) @ (x / a[:, None]).T
    least = np.partition(guess, -n, axis=1)[:, -n] if n < len(x) else np.full(len(y), -np.inf)
    rows, columns = np.nonzero(~(guess < least[:, None] - SLACK))
    return rows, columns, 1.0 - summed(x[columns], y[rows]) / (a[columns] * b[rows])


def summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up in the order of the components as ``vectors.dot`` does."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total


def ranked(near: DataFrame, how: Retrieval) -> DataFrame:
    """What each question gets of near (question_id, document_id, ordinal, distance): candidates, cap, floor, best top_k with a rank."""
    order = Window.partitionBy("question_id").orderBy("distance", "document_id", "ordinal")
    first = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= how.candidates).drop("n")
    kept = capped(first, how.cap, ("question_id",)).where(F.col("distance") <= 1.0 - how.floor)
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.top_k)
    return best.withColumn("similarity", 1.0 - F.col("distance"))


def citations(passages: DataFrame, by: tuple = ("question_id",)) -> DataFrame:
    """Passages (distance, document_id, ordinal, similarity, text) as numbered citations with a snippet."""
    order = Window.partitionBy(*by).orderBy("distance", "document_id", "ordinal")
    return passages.withColumn("index", F.row_number().over(order)).withColumn("similarity", F.round("similarity", 3)).withColumn("snippet", X.shorten(F.col("text"), X.SNIPPET_LENGTH))


def neighbours(chunks: DataFrame) -> DataFrame:
    """Each chunk with the ordinals before and after it in its document, null at the edges."""
    order = Window.partitionBy("document_id").orderBy("ordinal")
    return chunks.withColumn("previous", F.lag("ordinal").over(order)).withColumn("next", F.lead("ordinal").over(order))
