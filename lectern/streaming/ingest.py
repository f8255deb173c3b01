"""Ingestion as a stream: new documents become passages, one commit per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.vectors import hash_embedding
from lectern.operators.passages import Chunking, chunk


def ingest(batch: DataFrame, markdown: bool = False, how: Chunking = Chunking(), dimension: int = 64, embed=None) -> DataFrame:
    """Passages with vectors and deterministic ids of a batch of documents (doc_id, text)."""
    made = chunk(batch, markdown, how).withColumn("embedding", (embed or hash_embedding(dimension))(F.col("text")))
    key = F.concat_ws("/", F.col("document_id").cast("string"), F.col("ordinal").cast("string"), F.sha2("text", 256))
    return made.withColumn("chunk_id", F.sha2(key, 256))


def run(spark: SparkSession, source: str, target: str, checkpoint: str, markdown: bool = False, how: Chunking = Chunking(), trigger: dict | None = None):
    """Start a query from a folder of Parquet documents (doc_id, text) to a folder that ``passages`` reads.

    Each micro-batch replaces its own folders batch=<id>, so a batch that is run again after
    a crash leaves one set of passages. The ids of its documents are written last: they
    commit the batch, and name the documents that have no passage. A document sent twice in
    a batch counts once, with the text of the file written last (of one file, the greatest). Returns the streaming query.
    """
    schema = "doc_id bigint, text string"

    def commit(batch: DataFrame, batch_id: int) -> None:
        one = batch.groupBy("doc_id").agg(F.max_by("text", F.struct("modified", "text")).alias("text"))
        ingest(one, markdown, how).write.mode("overwrite").parquet(f"{target}/chunks/batch={batch_id}")
        batch.select(F.col("doc_id").alias("document_id")).distinct().write.mode("overwrite").parquet(f"{target}/documents/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(source).select("*", F.col("_metadata.file_modification_time").alias("modified"))
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def passages(spark: SparkSession, target: str) -> DataFrame:
    """The passages of every document as its last committed batch left them, also none.

    Batches only add folders; what a later batch replaces is left out when it is read.
    """
    last = spark.read.parquet(f"{target}/documents").groupBy("document_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{target}/chunks").join(last, ["document_id", "batch"], "left_semi").drop("batch")
