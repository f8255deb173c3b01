"""The ingestion queue as pure transitions over a table of jobs, at a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECLAIM = "15 minutes"
MOST_ATTEMPTS = 3
MOST_BATCH, LEAST_BATCH, STEPS = 128, 16, 8


def claimable(jobs: DataFrame, as_of: str, most_attempts: int | None = None) -> DataFrame:
    """Queued jobs and running ones whose lock is older than the reclaim time."""
    stale = F.col("locked_at") < F.expr(f"timestamp_ntz'{as_of}' - interval {RECLAIM}")
    found = jobs.where((F.col("state") == "queued") | ((F.col("state") == "running") & stale))
    return found if most_attempts is None else found.where(F.col("attempts") < most_attempts)


def claim(jobs: DataFrame, as_of: str, worker: str, k: int = 1) -> DataFrame:
    """The k oldest claimable jobs as the worker takes them: running, one attempt more, locked.

    One driver claims for all, so no job is in two claims of a batch.
    """
    taken = claimable(jobs, as_of).orderBy("created_at", "id").limit(k)
    return taken.withColumns({"state": F.lit("running"), "attempts": F.col("attempts") + 1, "locked_at": F.lit(as_of).cast("timestamp_ntz"), "locked_by": F.lit(worker)})


def outcome(error: Column, attempts: Column, most_attempts: int = MOST_ATTEMPTS) -> Column:
    """What a run's end makes of the job, by error class: none, permanent, transient, contract or unknown."""
    retried = F.when(attempts >= most_attempts, "failed").otherwise("requeued")
    return F.when(error == "none", "ready").when(error == "permanent", "failed").when(error == "contract", "halt").otherwise(retried)


def transition(jobs: DataFrame, error: Column, last_error: Column) -> DataFrame:
    """Running jobs (attempts) after their run: job state, document status, progress, error kept to 1000 characters."""
    end = outcome(error, F.col("attempts"))
    return jobs.withColumns({
        "outcome": end,
        "state": F.when(end == "ready", "done").when(end == "failed", "failed").otherwise("queued"),
        "status": F.when(end == "ready", "ready").when(end == "failed", "failed").otherwise("pending"),
        "progress": F.when(end == "ready", 1.0).otherwise(0.0),
        "last_error": F.when(end == "ready", None).otherwise(F.substring(last_error, 1, 1000)),
    })


def progress(done: Column, total: Column) -> Column:
    """Share of embedded passages, below one until the commit."""
    return F.when(total <= 0, 0.0).otherwise(F.greatest(F.least(done / total, F.lit(0.99)), F.lit(0.0)))


def batch_size(total: Column, configured: Column) -> Column:
    ceiling = F.least(configured, F.lit(MOST_BATCH))
    stepped = F.greatest(F.lit(LEAST_BATCH), F.ceil(total / STEPS).cast("int"))
    return F.when(total <= 0, ceiling).otherwise(F.greatest(F.lit(1), F.least(ceiling, stepped)))


def reindex_outcome(status: Column) -> Column:
    """HTTP code of a request to index again: accepted, in conflict, or not found."""
    return F.when(status.isNull(), 404).when(status.isin("ready", "failed"), 202).otherwise(409)


def replace_chunks(old: DataFrame, new: DataFrame, committed: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """All chunks after a commit: those of the ``committed`` documents are replaced whole.

    Without that table they are the documents in ``new``; a document that now has no chunk
    must be named in it, or its old ones stay.
    """
    done = (new if committed is None else committed).select(key).distinct()
    return old.join(done, key, "left_anti").unionByName(new.join(done, key, "left_semi"))


def begin(documents: DataFrame, claimed: DataFrame) -> DataFrame:
    """Documents (document_id, status, progress, error_message, chunk_count, indexed_at, ...) as a run of the claimed jobs (document_id) begins.

    Progress restarts, and what the last run left goes; the page count stays, as it is the file's.
    """
    at = documents.join(claimed.select("document_id", F.lit(True).alias("begun")).distinct(), "document_id", "left")
    fresh = {"status": F.lit("processing"), "progress": F.lit(0.0), "error_message": F.lit(None), "chunk_count": F.lit(None), "indexed_at": F.lit(None)}
    kept = [F.when(F.col("begun"), fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in documents.columns]
    return at.select(kept)


def commit(documents: DataFrame, jobs: DataFrame, chunks: DataFrame, runs: DataFrame, new: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, jobs and chunks after the ``runs`` (id of the job, document_id, page_count) with the ``new`` chunks.

    The three change together, to be published as one version: chunks are replaced whole, a
    document is ready with its number of chunks, its job done. A run whose document has
    vanished changes nothing. A chunk without a vector fails the commit.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    live = runs.join(documents.select("document_id"), "document_id", "left_semi")
    whole = new.withColumn("embedding", F.when(F.col("embedding").isNotNull(), F.col("embedding")).otherwise(F.raise_error(F.lit("every chunk must have a vector"))))
    after = replace_chunks(chunks, whole, live)
    counted = live.join(new.groupBy("document_id").agg(F.count("embedding").alias("made")), "document_id", "left")
    counted = counted.select("document_id", F.coalesce("made", F.lit(0)).alias("made"), F.col("page_count").alias("pages"), F.lit(True).alias("ran"))
    ready = {"status": F.lit("ready"), "progress": F.lit(1.0), "error_message": F.lit(None), "chunk_count": F.col("made"), "page_count": F.col("pages"), "indexed_at": now}
    docs = documents.join(counted, "document_id", "left").select([F.when(F.col("ran"), ready[c]).otherwise(F.col(c)).alias(c) if c in ready else F.col(c) for c in documents.columns])
    done = {"state": F.lit("done"), "last_error": F.lit(None), "locked_at": F.lit(None), "updated_at": now}
    ended = jobs.join(live.select("id", F.lit(True).alias("ran")), "id", "left").select([F.when(F.col("ran"), done[c]).otherwise(F.col(c)).alias(c) if c in done else F.col(c) for c in jobs.columns])
    return docs, ended, after


def delete_documents(documents: DataFrame, jobs: DataFrame, chunks: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, jobs and chunks without the asked documents (document_id), but for those in processing, which stay."""
    gone = documents.join(asked.select("document_id").distinct(), "document_id", "left_semi").where("status <> 'processing'").select("document_id")
    return tuple(t.join(gone, "document_id", "left_anti") for t in (documents, jobs, chunks))


def poll_delay(waiting: Column, elapsed_ms: Column) -> Column:
    """Milliseconds to the next look at the queue, null if nothing is in flight."""
    return F.when(~waiting, None).when(elapsed_ms >= 300_000, 10_000).otherwise(2_000)
