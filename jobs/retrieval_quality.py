"""Judge how well lexical retrieval finds the passages that it should.

    spark-submit jobs/retrieval_quality.py DOCUMENTS CASES TARGET [--config jobs/retrieval_quality.json]

Every case is a passage that some documents hold; put as a question, it should bring one of
them up first. Writes ``cases`` (partitioned by run and outcome) and ``summary`` (partitioned
by run): coverage, hit rates, mean reciprocal rank, and whether these reach the floors of the
config file.
"""

from __future__ import annotations

import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, started
from lectern.operators import lexical as L
from lectern.session import ship
from lectern.sources.tables import stored

#: The least values at which retrieval is good enough; the mean reciprocal rank is called mrr.
FLOORS = {"coverage": 1.0, "hit_at_1": 0.75, "hit_at_3": 1.0, "mrr": 0.8}


def outcome() -> F.Column:
    """What became of a case, by how many documents hold it and the rank of the first."""
    rank = F.col("rank")
    return F.when(F.col("containing") == 0, "absent").when(rank == 1, "first").when(rank <= 3, "among_three").when(rank <= 10, "among_ten").otherwise("later")


def retrieval_quality(spark: SparkSession, documents: str, cases: str, target: str, run: str = "latest", floors: dict | None = None) -> None:
    """Rank all documents (doc_id, text) for each case (item_id, text), and write what came of it.

    A run replaces its own partitions of TARGET whole and leaves those of others, so it can
    be run again; the same input gives the same rows. The index is made anew, into the
    session's shared folder. Null texts hold nothing; a case without a text is absent. Of rows
    with the same id the greatest text counts; rows without an id are left out.
    """
    docs = stored(ship(spark).read.parquet(documents).where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text")))
    every = spark.read.parquet(cases).where("item_id is not null").groupBy("item_id").agg(F.max("text").alias("text"))
    judged = L.quality_ranks(docs, every).select("item_id", "containing", F.col("rank").cast("long").alias("rank")).withColumn("outcome", outcome())
    judged.write.mode("overwrite").partitionBy("outcome").parquet(f"{target}/cases/run={run}")
    made = spark.read.schema("item_id bigint, containing bigint, rank bigint, outcome string").parquet(f"{target}/cases/run={run}")
    summary(made, floors or FLOORS).write.mode("overwrite").parquet(f"{target}/summary/run={run}")
    log.info("retrieval_quality: read %d rows of %s and %d of %s; wrote %d cases and a summary of run %s to %s", spark.read.parquet(documents).count(), documents, spark.read.parquet(cases).count(), cases, made.count(), run, target)


def summary(cases: DataFrame, floors: dict) -> DataFrame:
    """One row: the figures of all cases, and whether each reaches its floor."""
    figures = L.quality_report(cases)
    reached = F.lit(True)
    for name, least in floors.items():
        reached = reached & (F.col(name) >= least)
    return figures.withColumn("reached", reached)


def main(arguments: list[str]) -> None:
    spark, given = started("retrieval_quality", arguments, os.path.join(os.path.dirname(os.path.abspath(__file__)), "retrieval_quality.json"), ["documents", "cases", "target"])
    try:
        retrieval_quality(spark, **given)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
