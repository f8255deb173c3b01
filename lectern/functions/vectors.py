"""Vectors in double precision: column builders, and the hash embedding for tests and offline use."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_TOLERANCE = 1e-3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def vector_problem(a: Column, dimension: int) -> Column:
    """What is wrong with a vector that should be a finite unit vector of the dimension, or null."""
    odd = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (
        F.when(a.isNull() | (F.size(a) != dimension), "dimension")
        .when(odd, "not finite")
        .when(F.abs(norm(a) - 1.0) >= NORM_TOLERANCE, "not unit length")
    )


def hash_vector(text: str, dimension: int) -> list[float]:
    """A unit vector that the text alone decides: a seeded normal draw, scaled."""
    return seeded_vector(hashlib.sha256(text.encode("utf-8")).digest(), dimension)


def seeded_vector(digest: bytes, dimension: int) -> list[float]:
    """The hash vector of a text with this SHA-256."""
    draw = random.Random(int.from_bytes(digest[:8], "big"))
    raw = [draw.gauss(0.0, 1.0) for _ in range(dimension)]
    length = math.sqrt(math.fsum(x * x for x in raw))
    return [x / length for x in raw] if length else [1.0] + [0.0] * (dimension - 1)


def hash_embedding(dimension: int):
    """A function of a column of texts that gives their hash vectors. Only digests of the texts go to Python, some thousands at a time."""

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for digests in batches:
            made = []
            for at in range(0, len(digests), 1000):
                vectors = [seeded_vector(d, dimension) if d is not None else None for d in digests.slice(at, 1000).to_pylist()]
                made.append(pa.array(vectors, pa.list_(pa.float64())))
            yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.float64()))

    return lambda texts: embed(F.unhex(F.sha2(texts, 256)))


def hash_seed(text: Column) -> Column:
    """The seed of a text's hash vector, as decimal text."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10)
