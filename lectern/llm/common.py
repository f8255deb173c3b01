"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Iterator, Sequence
from contextlib import suppress
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder, read by Spark's own reader."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the session names in ``spark.checkpoint.dir``; only where
    that is unset (tests, a single machine) a temporary folder is taken.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids have no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def unit_hash(column: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the value and the salt only."""
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def slices(batch: pa.RecordBatch, text: str, most_bytes: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut a batch into runs of rows of about ``most_bytes`` bytes of text, one row at least.

    Yields the rows and their texts (null: None), made only when they are asked for. No row
    is cut, so a run can exceed the size by one text.
    """
    values = column_of(batch, text)
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy().tolist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start), values.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start), values.slice(start).to_pylist()


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def records(arrays: Sequence, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of this schema from arrays, lists or numpy arrays."""
    made = [a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, type=f.type) for a, f in zip(arrays, schema, strict=True)]
    return pa.RecordBatch.from_arrays(made, schema=schema)


#: What a Python worker keeps for the next tasks of the same operator, by the operator's module and a key.
worker_tables: dict[tuple, object] = {}


def give_back() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def drop_others(module: str) -> None:
    """Drop the tables of all operators but this one."""
    if others := [k for k in worker_tables if k[0] != module]:
        for k in others:
            del worker_tables[k]
        give_back()


def tidied(run):
    """``run`` (batches to batches), which gives back to the system what it has freed when it ends.

    Python workers live on from task to task, so what a task leaves in the allocators' hands
    would add to the memory of the next ones; so would the tables that another operator has
    kept for its own tasks, which go first.
    """

    @wraps(run)
    def wrapped(batches):
        drop_others(run.__module__)
        yield from run(batches)
        give_back()

    return wrapped


def keep_rows(docs: DataFrame, decide, most_bytes: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, for whose text ``decide`` (texts to booleans) says so. No shuffle.

    Columns go through under numbers, so their names may hold anything.
    """
    text = f"c{docs.columns.index('text')}"

    @tidied
    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, text, most_bytes):
                yield rows.filter(pa.array(decide(texts), pa.bool_()))

    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in ``spark.checkpoint.dir``.

    Only where that is unset and all runs on this one machine a temporary folder is taken;
    elsewhere executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="lectern-shared-")
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder, in whatever store it is, through Spark's own access to it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
