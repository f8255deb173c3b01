"""Reading the tables of a folder, and writing what is read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.session import shared_folder, ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a scan has fewer partitions than those; a large table is left as it is.

    A small file is often one row group, which one task would read and compute alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame, place: str | None = None, by: list[str] | None = None) -> DataFrame:
    """The rows, written to a folder (a new one of the shared folder) and read from there.

    What is behind them is computed once, nothing written is lost with an executor, and
    Spark knows the size when it chooses a join.
    """
    place = place or f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*(by or [])).parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
