"""Outside services as pluggable parts: embedders, answerers and readers of page words."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.vectors import NORM_TOLERANCE, hash_vector
from lectern.operators.jobs import LEAST_BATCH, MOST_BATCH, STEPS
from lectern.operators.uploads import RETRIED

DELAYS, JITTER = (1.0, 2.0, 4.0, 8.0), 0.25
MOST_TOKENS = 32_000


class Embedder(Protocol):
    """Texts to one answer item each, {'index': i, 'embedding': [...]}, in any order."""

    dimension: int

    def __call__(self, texts: Sequence[str]) -> Iterable[dict]: ...


class ServiceError(RuntimeError):
    """A failed call; a status that may pass is tried again."""

    def __init__(self, status: int | None, note: str = ""):
        super().__init__(f"{status} {note}".strip())
        self.status = status


class ContractError(RuntimeError):
    """Vectors that break the agreement; never stored, never retried."""


class HashEmbedder:
    """The offline embedder: a text's vector depends on the text alone."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def __call__(self, texts: Sequence[str]) -> list[dict]:
        return [{"index": i, "embedding": hash_vector(t, self.dimension)} for i, t in reversed(list(enumerate(texts)))]


def in_order(items: Iterable[dict], expected: int) -> list[list[float]]:
    """Vectors by their index; one missing, twice or out of range is an error that may pass."""
    slots: dict[int, list[float]] = {}
    for item in items:
        i, v = item.get("index"), item.get("embedding")
        if not isinstance(i, int) or not 0 <= i < expected or i in slots or not isinstance(v, (list, tuple)):
            raise ServiceError(None, "answer does not fit the request")
        slots[i] = [float(x) for x in v]
    if len(slots) != expected:
        raise ServiceError(None, "answer lacks vectors")
    return [slots[i] for i in range(expected)]


def checked(vectors: list[list[float]], dimension: int) -> list[list[float]]:
    for v in vectors:
        if len(v) != dimension or not abs(sum(x * x for x in v) ** 0.5 - 1.0) < NORM_TOLERANCE:
            raise ContractError(f"a vector of {len(v)} components is no unit vector of {dimension}")
    return vectors


def call(embedder: Embedder, texts: Sequence[str], side: str = "documents", sleep: Callable[[float], None] = time.sleep, chance: Callable[[], float] = random.random) -> list[list[float]]:
    """One request with retries: doubling delays with jitter on statuses that may pass."""
    for delay in (*DELAYS, None):
        try:
            return checked(in_order(embedder(texts), len(texts)), embedder.dimension)
        except ServiceError as e:
            if delay is None or e.status is not None and e.status not in RETRIED[side]:
                raise
            sleep(delay * (1 + JITTER * chance()))
    raise AssertionError


def batches(n: int, configured: int = MOST_BATCH) -> int:
    """Texts a request for a document of n passages: an eighth, within 16 and 128."""
    ceiling = min(configured, MOST_BATCH)
    return ceiling if n <= 0 else max(1, min(ceiling, max(LEAST_BATCH, -(-n // STEPS))))


def embed(chunks: DataFrame, embedder: Embedder, configured: int = MOST_BATCH) -> DataFrame:
    """Chunks (with text) and their vectors, all other columns kept; an executor asks batch by batch.

    With a document_id a request holds passages of one document, as many as suit the number
    that this document has, wherever the rows lie; else the rows at hand count as one.
    """
    from lectern.operators.passages import truncate

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    by_document = "document_id" in chunks.columns
    if by_document:
        chunks = chunks.withColumn("of_document", F.count("*").over(Window.partitionBy("document_id")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [truncate(t, MOST_TOKENS) for t in part["text"]]
            runs = [(0, len(texts), len(texts))]
            if by_document:
                owner = part["document_id"].tolist()
                cuts = [0, *(k for k in range(1, len(owner)) if owner[k] != owner[k - 1]), len(owner)]
                runs = [(a, b, int(part["of_document"].iloc[a])) for a, b in zip(cuts, cuts[1:]) if b > a]
            vectors: list = []
            for a, b, n in runs:
                size = batches(n, configured)
                for k in range(a, b, size):
                    vectors += call(embedder, texts[k : min(b, k + size)])
            yield part.drop(columns="of_document", errors="ignore").assign(embedding=vectors)

    return chunks.mapInPandas(run, f"{fields}, embedding array<double>")


class Scripted:
    """An answerer for tests: says the given pieces, or fails after them."""

    def __init__(self, deltas: Sequence[str], error: Exception | None = None):
        self.deltas, self.error = list(deltas), error

    def __call__(self, system: str, messages: Sequence[dict]) -> Iterator[str]:
        yield from self.deltas
        if self.error:
            raise self.error


def answer(prompts: DataFrame, answerer: Callable[[str, Sequence[dict]], Iterator[str]]) -> DataFrame:
    """Deltas (conv_id, seq, delta, n_sources) of prompts (conv_id, block, question, n_sources); none without sources."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [
                (r.conv_id, k, d, r.n_sources)
                for r in part.itertuples() if r.n_sources
                for k, d in enumerate(answerer(r.block, [{"role": "user", "content": r.question.strip()}]))
            ]
            yield pd.DataFrame(rows, columns=["conv_id", "seq", "delta", "n_sources"])

    return prompts.mapInPandas(run, "conv_id bigint, seq int, delta string, n_sources int")


WORDS = "doc_id bigint, page int, page_width double, page_height double, page_count int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string"


def page_words(files: DataFrame, read: Callable[[bytes], Iterable[Sequence]]) -> DataFrame:
    """Words with places of files (doc_id, content), by a reader of one file's bytes.

    The reader gives rows of all fields but doc_id; a page that it cannot read it leaves out.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(d, *w) for d, c in zip(part["doc_id"], part["content"], strict=True) for w in read(bytes(c))]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in WORDS.split(", ")])

    return files.select("doc_id", "content").mapInPandas(run, WORDS)
