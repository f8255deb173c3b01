"""Approximate nearest neighbours by a forest of hash prefixes."""

from __future__ import annotations

from math import acos, log, pi
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import durable

BITS = 32
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def uniform_share(rows: int, dim: int, k: int, trees: int, misses: float = 2.5) -> float:
    """The share of all rows that must be candidates where the data are hardest: spread evenly in all directions.

    There the k-th neighbour is at the angle beyond which k of ``rows`` lie. A tree's prefix
    of L bits is shared by it with the chance p^L, by any other row with 2^-L; L is taken so
    deep that a neighbour at that angle is missed by all trees with the chance e^-misses.
    Nearer ones are missed less, and data with any structure have nearer ones.
    """
    if rows <= 2 * k:
        return 1.0
    t = min(0.999, NormalDist().inv_cdf(1 - k / rows) / dim**0.5)
    p = 1 - acos(t) / pi
    depth = min(BITS, max(0.0, log(trees / misses) / -log(p)))
    return 1 - (1 - 2.0**-depth) ** trees


class PrefixForest:
    """Trees over the vectors of one shard: each the sorted array of their hash strings.

    A hash string holds the signs of random projections, so vectors at a small angle share
    long prefixes. Vectors are first given one more coordinate that makes their lengths
    equal, so that a large inner product is a small angle.
    """

    def __init__(self, vectors: np.ndarray, trees: int, seed: int = 7):
        self.vectors = vectors
        squares = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
        scale = max(float(squares.max()), 1e-300) ** 0.5
        extra = np.sqrt(np.maximum(1.0 - squares / scale**2, 0.0))
        whole = np.ascontiguousarray(vectors + vectors.dtype.type(0))  # no negative zeros
        self.kind = np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel(), return_inverse=True)[1]
        self.kinds = int(self.kind.max()) + 1
        self.planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((trees, vectors.shape[1] + 1, BITS)).astype(np.float32)
        full = np.column_stack([vectors / scale, extra]).astype(np.float32)
        self.order, self.hashes = np.empty(trees * len(vectors), np.int32), []
        for k, plane in enumerate(self.planes):
            h = self._string(full, plane)
            order = np.argsort(h, kind="stable")
            self.order[k * len(h) : (k + 1) * len(h)] = order
            self.hashes.append(h[order])

    @staticmethod
    def _string(full: np.ndarray, plane: np.ndarray) -> np.ndarray:
        return np.packbits(full @ plane > 0, axis=1, bitorder="big").view(">u4").ravel().astype(np.uint32)

    def ranges(self, strings: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the entries that share ``depth`` leading bits with the query."""
        rest = ((np.uint64(1) << (BITS - depth).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        first = np.array([np.searchsorted(h, x) for h, x in zip(self.hashes, strings & ~rest, strict=True)])
        last = np.array([np.searchsorted(h, x, side="right") for h, x in zip(self.hashes, strings | rest, strict=True)])
        return first, last

    def candidates(self, queries: np.ndarray, least: int):
        """For each query the rows of its candidates, in order.

        Descends to the longest prefixes that any entry shares and then ascends in all
        trees together, a bit at a time, until there are ``least`` different vectors beside
        the query's own, or all; what several trees hold and equal vectors count once, so
        that a group of copies does not end the search. All entries of that depth are
        candidates, however many. Entries that count again for each tree are no fewer, so
        the ascent starts where these suffice, which is found by halving.
        """
        full = np.column_stack([queries / max(float(np.abs(queries).max()), 1e-300), np.zeros(len(queries))]).astype(np.float32)
        strings = np.array([self._string(full, plane) for plane in self.planes])
        needed = min(least + 1, self.kinds)
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), BITS)
        while (low < high).any():
            middle = (low + high + 1) // 2
            first, last = self.ranges(strings, middle)
            enough = (last - first).sum(axis=0) >= needed
            low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
        out: list = [None] * len(queries)
        trees = np.arange(len(self.planes))
        short = np.arange(len(queries))
        while len(short):
            first, last = self.ranges(strings[:, short], low[short])
            for j, q in enumerate(short.tolist()):
                size = last[:, j] - first[:, j]
                at = np.cumsum(size)
                seen = np.zeros(len(self.vectors), bool)
                seen[self.order[np.repeat(first[:, j] + trees * len(seen) - at + size, size) + np.arange(at[-1])]] = True
                rows = np.flatnonzero(seen).astype(np.int32)
                if low[q] == 0 or len(rows) >= needed and np.count_nonzero(np.bincount(self.kind[rows], minlength=self.kinds)) >= needed:
                    out[q] = rows
            short = np.array([q for q in short.tolist() if out[q] is None], np.int64)
            low[short] -= 1
        return out


def best_of(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest inner products in double precision, ties to the smaller id, as (ids, scores).

    Products are summed in order of the components, so equal vectors have equal scores;
    a quicker product in the vectors' own precision first leaves out what is clearly not
    among the k.
    """
    mine = ids != own
    rough = (vectors @ query)[mine]
    at = np.flatnonzero(mine)
    if len(at) > k:
        line = np.partition(rough, len(rough) - k)[len(rough) - k]
        slack = 8 * len(query) * np.finfo(vectors.dtype).eps * float(np.linalg.norm(query)) * float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max()))
        at = at[rough >= line - slack]
    ids = ids[at]
    score = np.add.accumulate(vectors[at].astype(np.float64) * query.astype(np.float64), axis=1)[:, -1] if len(ids) else np.zeros(0)
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def nearest(embeddings: DataFrame, is_query, k: int = 20, trees: int = 160, share: float | None = None, least: int = 1200, shards: int = 64, shard_rows: tuple[int, int] = (32_768, 131_072), block_rows: int = 8192) -> DataFrame:
    """The ``k`` nearest rows by inner product of every row that ``is_query`` (a column) picks.

    ``embeddings`` has vec_id and embedding; every row is a candidate but the query's own.
    Rows are dealt into shards by a hash of the id and queries into blocks; a forest is
    built over each shard and searched for each block, with at least ``share`` times the
    shard's rows (and ``least``, and ``k``) different vectors taken from the trees together,
    or all there are; the best of all shards are then the result: query_id, rank
    (from 1), vec_id, score. Without a ``share`` it is ``uniform_share`` of the whole table,
    which falls as the table grows. There are ``shards`` shards, but each holds at least and
    at most about ``shard_rows`` rows, so that queries are sent to few places.

    Fewer candidates than ``k`` are all returned. Vectors that are null, zero or hold a null
    or non-finite component, and rows without an id, take no part; only vectors of a query's
    dimension can be its neighbours; rows with the same id and different vectors are
    candidates each, a query each, and never each other's neighbours. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    plain = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kind = "float" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "double"
    rows = embeddings.where(plain & finite & F.exists("embedding", lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), F.size("embedding").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"))
    held = F.least(F.lit(shard_rows[1]), F.greatest(F.lit(shard_rows[0]), F.ceil(F.col("n") / shards)))
    sizes = sizes.select("dim", "n", F.ceil(F.col("n") / held).cast("int").alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("q") / block_rows)).cast("int").alias("blocks"))
    sizes = durable(sizes)
    rows = rows.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "dim")
    key = F.xxhash64("vec_id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = rows.withColumn("shard", F.pmod(key, "shards").cast("int")).select("dim", "n", "shard", every("blocks").alias("block"), "vec_id", "embedding")
    asked = rows.where("is_query").select(F.col("dim").alias("of_dim"), every("shards").alias("of_shard"), F.pmod(F.xxhash64(key), "blocks").cast("int").alias("of_block"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))

    def matrix(table: pa.Table, ids: str, values: str) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column(ids).to_numpy()
        values = pa.concat_arrays(table.column(values).chunks).flatten().to_numpy()
        order = np.argsort(ids, kind="stable")
        values = values.reshape(len(ids), -1)[order]
        return ids[order], values.astype(np.float64) if np.abs(values).max() > 1e12 else values

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if shard.num_rows and block.num_rows:
            (ids, vectors), (query_ids, queries) = matrix(shard, "vec_id", "embedding"), matrix(block, "query_id", "query")
            part_of_all = uniform_share(shard.column("n")[0].as_py(), vectors.shape[1], k, trees) if share is None else share
            forest = PrefixForest(vectors, trees)
            for at in range(0, len(queries), 256):
                part = queries[at : at + 256]
                found = forest.candidates(part, max(least, k, int(part_of_all * len(ids))))
                for own, query, rows in zip(query_ids[at : at + 256].tolist(), part, found, strict=True):
                    near, score = best_of(vectors[rows], ids[rows], query, own, k)
                    out[0].append(np.full(len(near), own))
                    out[1].append(near)
                    out[2].append(score)
        return pa.Table.from_arrays([pa.array(np.concatenate(x) if x else [], f.type) for x, f in zip(out, FOUND, strict=True)], schema=FOUND)

    found = asked.groupBy("of_dim", "of_shard", "of_block").cogroup(dealt.groupBy("dim", "shard", "block")).applyInArrow(lambda q, s: search(s, q), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
