"""Keep the term index of a growing folder of documents.

    spark-submit jobs/index_documents.py DOCUMENTS TARGET CHECKPOINT [--config jobs/index_documents.json]

Takes the files that have come since the last run, as a file stream with a checkpoint, and
ends. TARGET then holds ``postings`` (partitioned by batch and bucket of the term), ``lengths``
and ``documents`` (partitioned by batch), which ``lectern.operators.postings.opened`` reads.
"""

from __future__ import annotations

import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, started
from lectern.functions import text as X
from lectern.operators import postings as T
from lectern.session import ship

SCHEMA = "doc_id bigint, text string, lang string, source string"


def globbed(path: str) -> str:
    """The path as a pattern that fits it alone: a file stream takes single files and folders alike in this form."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def newest(batch: DataFrame) -> DataFrame:
    """One row a doc_id: of the file that was written last, by name and then text if two are as new."""
    order = F.struct("modified", "file", "text")
    return batch.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct("text", "lang", "source"), order).alias("row")).select("doc_id", "row.*")


def index_documents(spark: SparkSession, documents: str, target: str, checkpoint: str, buckets: int = 16, most_files: int = 1000) -> None:
    """Index the documents (doc_id, text, lang, source) of all files that no earlier run has taken.

    A batch replaces its own partitions, so one that is run again after a crash leaves the
    same rows; a run without new files changes nothing. A document sent again replaces its
    earlier version when the index is opened. Rows without a doc_id are left out, null texts
    have no terms. Other columns of the files are ignored.
    """
    rows = ship(spark).readStream.schema(SCHEMA).option("maxFilesPerTrigger", most_files).parquet(globbed(documents))
    rows = rows.select("doc_id", "text", "lang", "source", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file"))

    def commit(batch: DataFrame, batch_id: int) -> None:
        def write(df: DataFrame, name: str, *by: str) -> None:
            df.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(f"{target}/{name}")

        docs = newest(batch).persist()
        write(T.lengths(docs), "lengths")
        write(docs.select("doc_id", "lang", "source", X.token_count(F.coalesce("text", F.lit(""))).alias("n_tokens"), X.shorten(F.coalesce("text", F.lit("")), X.PREVIEW_LENGTH).alias("preview")), "documents")
        write(T.postings(docs, buckets), "postings", "bucket")
        docs.unpersist()
        made = T.written(spark, target).of_batch(batch_id)
        blocks = made.postings.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings")).first()
        log.info("index_documents: batch %d read %d rows of %s; wrote %d documents and %d postings in %d blocks to %s", batch_id, batch.count(), documents, made.lengths.count(), blocks["postings"], blocks["blocks"], target)

    query = rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("index_documents: batches of this run took %d rows", sum(p["numInputRows"] for p in query.recentProgress))


def main(arguments: list[str]) -> None:
    spark, given = started("index_documents", arguments, os.path.join(os.path.dirname(os.path.abspath(__file__)), "index_documents.json"), ["documents", "target", "checkpoint"])
    try:
        index_documents(spark, **given)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
