"""Queries over the ingestion queue. events stand for jobs: the kind of event is the state, its value the attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import jobs as J
from lectern.operators import uploads as U
from lectern.plans.registry import query
from lectern.sources.tables import table

AS_OF = "2024-01-20 12:00:00"
STATES = {"signup": "queued", "click": "running", "purchase": "done", "error": "failed", "view": "queued"}
CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END"
JOBS = f"SELECT event_id AS id, user_id AS document_id, {CASE} AS state, (event_id % 5)::INT AS attempts, CASE WHEN event_type = 'click' THEN ts + INTERVAL 5 MINUTE END AS locked_at, ts AS created_at FROM events"
CLAIMABLE = f"SELECT id, state, attempts FROM ({JOBS}) WHERE state = 'queued' OR (state = 'running' AND locked_at < TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE)"


def jobs(spark, d):
    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])[F.col("event_type")]
    locked = F.when(F.col("event_type") == "click", F.col("ts") + F.expr("interval 5 minutes"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), state.alias("state"), (F.col("event_id") % 5).cast("int").alias("attempts"), locked.alias("locked_at"), F.col("ts").alias("created_at"))


@query(CLAIMABLE)
def queue_claimable(spark, d):
    return J.claimable(jobs(spark, d), AS_OF).select("id", "state", "attempts")


@query(f"SELECT id, 'running' AS state, (attempts + 1)::INT AS attempts, 'w1' AS locked_by FROM ({JOBS}) WHERE id IN (SELECT id FROM ({CLAIMABLE})) ORDER BY created_at, id LIMIT 20")
def queue_claim(spark, d):
    return J.claim(jobs(spark, d), AS_OF, "w1", 20).select("id", "state", F.col("attempts").cast("int").alias("attempts"), "locked_by")


@query(f"SELECT id, attempts FROM ({CLAIMABLE}) WHERE attempts < 3")
def queue_claim_bounded(spark, d):
    return J.claimable(jobs(spark, d), AS_OF, 3).select("id", "attempts")


ERROR = "CASE id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'permanent' WHEN 2 THEN 'transient' WHEN 3 THEN 'contract' ELSE 'unknown' END"
OUTCOME = "CASE e WHEN 'none' THEN 'ready' WHEN 'permanent' THEN 'failed' WHEN 'contract' THEN 'halt' ELSE CASE WHEN attempts >= 3 THEN 'failed' ELSE 'requeued' END END"


def ended(spark, d):
    k = F.col("id") % 5
    error = F.when(k == 0, "none").when(k == 1, "permanent").when(k == 2, "transient").when(k == 3, "contract").otherwise("unknown")
    return jobs(spark, d).where("state = 'running'").withColumn("attempts", (F.col("id") % 7).cast("int")).withColumn("error", error)


@query(f"SELECT id, e AS error, attempts, {OUTCOME} AS outcome FROM (SELECT id, {ERROR} AS e, (id % 7)::INT AS attempts FROM ({JOBS}) WHERE state = 'running')")
def retry_decision(spark, d):
    return ended(spark, d).select("id", "error", "attempts", J.outcome(F.col("error"), F.col("attempts")).alias("outcome"))


@query(
    f"SELECT id, CASE o WHEN 'ready' THEN 'done' WHEN 'failed' THEN 'failed' ELSE 'queued' END AS state, CASE o WHEN 'ready' THEN 'ready' WHEN 'failed' THEN 'failed' ELSE 'pending' END AS status, CASE o WHEN 'ready' THEN 1.0 ELSE 0.0 END::DOUBLE AS progress, CASE o WHEN 'ready' THEN NULL ELSE 1000 END::INT AS error_length"
    f" FROM (SELECT id, {OUTCOME} AS o FROM (SELECT id, {ERROR} AS e, (id % 7)::INT AS attempts FROM ({JOBS}) WHERE state = 'running'))"
)
def queue_transition_matrix(spark, d):
    after = J.transition(ended(spark, d), F.col("error"), F.repeat(F.col("error"), 400))
    return after.select("id", "state", "status", F.col("progress").cast("double").alias("progress"), F.length("last_error").alias("error_length"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 404 WHEN 1 THEN 202 WHEN 2 THEN 202 ELSE 409 END AS code FROM orders")
def reindex_outcome(spark, d):
    k = F.col("o_orderkey") % 5
    status = F.when(k == 1, "ready").when(k == 2, "failed").when(k == 3, "processing").when(k == 4, "pending")
    return table(spark, d, "orders").select("o_orderkey", J.reindex_outcome(status).alias("code"))


@query("SELECT doc_id, 'pending' AS status, 0.0::DOUBLE AS progress, 'queued' AS state, 0 AS attempts, md5(doc_id || '/1') AS job_id FROM documents")
def enqueue_documents(spark, d):
    """One document and one job row for each upload, made from the same row."""
    return table(spark, d, "documents").select("doc_id", F.lit("pending").alias("status"), F.lit(0.0).alias("progress"), F.lit("queued").alias("state"), F.lit(0).alias("attempts"), F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("/1"))).alias("job_id"))


@query("SELECT label AS document_id, vec_id AS ordinal, 'old' AS version FROM embeddings WHERE label % 3 <> 0 UNION ALL SELECT label, vec_id, 'new' FROM embeddings WHERE label % 3 = 0 AND vec_id % 2 = 0")
def commit_chunks_replace(spark, d):
    old = table(spark, d, "embeddings").select(F.col("label").alias("document_id"), F.col("vec_id").alias("ordinal"), F.lit("old").alias("version"))
    new = table(spark, d, "embeddings").where("label % 3 = 0 and vec_id % 2 = 0").select(F.col("label").alias("document_id"), F.col("vec_id").alias("ordinal"), F.lit("new").alias("version"))
    return J.replace_chunks(old, new)


FILES = "SELECT doc_id AS document_id, CASE doc_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'ready' WHEN 2 THEN 'pending' ELSE 'processing' END AS status, (doc_id % 10 / 10.0)::DOUBLE AS progress, CASE WHEN doc_id % 4 = 0 THEN 'old failure' END AS error_message, doc_id % 7 AS chunk_count, doc_id % 3 AS page_count FROM documents"


def files(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        k.alias("document_id"), F.when(k % 4 == 0, "failed").when(k % 4 == 1, "ready").when(k % 4 == 2, "pending").otherwise("processing").alias("status"), (k % 10 / 10.0).alias("progress"),
        F.when(k % 4 == 0, "old failure").alias("error_message"), (k % 7).alias("chunk_count"), (k % 3).alias("page_count"), F.lit(None).cast("timestamp_ntz").alias("indexed_at"),
    )


def runs(spark, d):
    """Runs of every fifth document, and of as many that have vanished."""
    k = F.col("doc_id")
    return table(spark, d, "documents").where(k % 5 == 0).select((k + 7).alias("id"), F.when(k % 2 == 0, k).otherwise(-k).alias("document_id"), F.lit(9).cast("bigint").alias("page_count"))


def committed(spark, d):
    """The tables after those runs; a document has as many new chunks as the remainder of its id by three."""
    made = runs(spark, d).select("document_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ordinal")).where(F.col("ordinal") < F.abs(F.col("document_id")) % 3)
    new = made.select("document_id", F.col("ordinal").cast("long").alias("ordinal"), F.array(F.lit(1.0)).alias("embedding"))
    old = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(100).cast("long").alias("ordinal"), F.array(F.lit(0.5)).alias("embedding"))
    job = table(spark, d, "documents").select((F.col("doc_id") + 7).alias("id"), F.col("doc_id").alias("document_id"), F.lit("running").alias("state"), F.lit("slow").alias("last_error"), F.lit(AS_OF).cast("timestamp_ntz").alias("locked_at"))
    return J.commit(files(spark, d), job, old, runs(spark, d), new, AS_OF)


@query(f"SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'processing' ELSE status END AS status, CASE WHEN document_id % 3 = 0 THEN 0.0 ELSE progress END AS progress, CASE WHEN document_id % 3 <> 0 THEN error_message END AS error_message, CASE WHEN document_id % 3 <> 0 THEN chunk_count END AS chunk_count, page_count FROM ({FILES})")
def begin_processing(spark, d):
    """Every third document's run begins."""
    claimed = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("document_id"))
    return J.begin(files(spark, d), claimed).select("document_id", "status", F.round("progress", 6).alias("progress"), "error_message", "chunk_count", "page_count")


@query(
    f"SELECT document_id, CASE WHEN r THEN 'ready' ELSE status END AS status, CASE WHEN r THEN 1.0 ELSE progress END AS progress, CASE WHEN NOT r THEN error_message END AS error_message, CASE WHEN r THEN document_id % 3 ELSE chunk_count END AS chunk_count, CASE WHEN r THEN 9 ELSE page_count END AS page_count, CASE WHEN r THEN TIMESTAMP '{AS_OF}' END::VARCHAR AS indexed_at, CASE WHEN r THEN 'done' ELSE 'running' END AS state, CASE WHEN NOT r THEN 'slow' END AS last_error FROM (SELECT *, document_id % 10 = 0 AS r FROM ({FILES}))"
)
def commit_runs(spark, d):
    """Documents and their jobs after a commit; runs of vanished documents change nothing."""
    docs, ended, _ = committed(spark, d)
    shown = docs.select("document_id", "status", F.round("progress", 6).alias("progress"), "error_message", "chunk_count", "page_count", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss").alias("indexed_at"))
    return shown.join(ended.select("document_id", "state", "last_error"), "document_id")


@query("SELECT doc_id AS document_id, 100::BIGINT AS ordinal FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, o FROM documents, range(2) t(o) WHERE doc_id % 10 = 0 AND o < doc_id % 3")
def commit_chunks(spark, d):
    """Chunks after a commit: replaced whole, also where the new set is empty; none for vanished documents."""
    return committed(spark, d)[2].select("document_id", "ordinal")


@query("SELECT doc_id AS document_id, (CASE WHEN doc_id % 6 = 0 AND doc_id % 4 <> 3 THEN 0 ELSE 1 END)::BIGINT AS files, (CASE WHEN doc_id % 6 = 0 AND doc_id % 4 <> 3 THEN 0 ELSE 1 END)::BIGINT AS jobs, (CASE WHEN doc_id % 6 = 0 AND doc_id % 4 <> 3 THEN 0 ELSE 2 END)::BIGINT AS chunks FROM documents")
def delete_cascade(spark, d):
    """What is left of each document when every sixth is deleted."""
    k = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    left = J.delete_documents(files(spark, d), k, k.unionByName(k), k.where("document_id % 6 = 0"))
    out = k
    for name, t in zip(("files", "jobs", "chunks"), left, strict=True):
        out = out.join(t.groupBy("document_id").agg(F.count("*").alias(name)), "document_id", "left")
    return out.select("document_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "jobs", "chunks")])


@query("SELECT o_orderkey, CASE WHEN t <= 0 THEN 0.0 ELSE round(greatest(least(n / t, 0.99), 0.0), 6) END::DOUBLE AS progress FROM (SELECT o_orderkey, (o_orderkey % 13)::DOUBLE AS n, (o_orderkey % 11)::DOUBLE AS t FROM orders)")
def progress_clamp(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(J.progress((k % 13).cast("double"), (k % 11).cast("double")), 6).alias("progress"))


@query("SELECT o_orderkey, CASE WHEN t <= 0 THEN least(c, 128) ELSE greatest(1, least(least(c, 128), greatest(16, ceil(t / 8.0)))) END::INT AS size FROM (SELECT o_orderkey, (o_orderkey % 5000)::INT AS t, (o_orderkey % 200 + 1)::INT AS c FROM orders)")
def batch_size(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", J.batch_size((k % 5000).cast("int"), (k % 200 + 1).cast("int")).cast("int").alias("size"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN (o_orderkey * 1000) % 600000 >= 300000 THEN 10000 ELSE 2000 END AS delay FROM orders")
def poll_cadence(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", J.poll_delay(k % 3 != 0, (k * 1000) % 600000).alias("delay"))


ROWS = ", ".join(f"('{a}', {b}, {str(c).lower()})" for a, b, c in U.ERRORS)


@query(f"SELECT e.event_id, t.code, t.status, t.again FROM events e JOIN (VALUES {ROWS}) t(code, status, again) ON t.status = CASE e.event_id % 4 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 415 ELSE 500 END")
def error_taxonomy(spark, d):
    taxonomy = spark.createDataFrame(list(U.ERRORS), "code string, status int, again boolean")
    k = F.col("event_id") % 4
    seen = table(spark, d, "events").select("event_id", F.when(k == 0, 404).when(k == 1, 503).when(k == 2, 415).otherwise(500).alias("status"))
    return seen.join(taxonomy, "status").select("event_id", "code", "status", "again")


@query(
    "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'empty' WHEN doc_id % 7 = 0 THEN 'not a pdf' WHEN doc_id % 5 = 0 THEN 'encrypted' WHEN doc_id % 600 = 0 THEN 'no pages' WHEN doc_id % 600 > 500 THEN 'too many pages: ' || doc_id % 600 || ' of 500' WHEN doc_id % 40 < 20 AND doc_id % 2 = 0 THEN 'scan' WHEN doc_id % 40 < 20 THEN 'no text' END AS error FROM documents"
)
def ingest_errors(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", U.ingest_error(k % 11, k % 7 != 0, k % 5 == 0, k % 600, k % 40, k % 2 == 0).alias("error"))


POLICY = ", ".join(f"('{side}', {code})" for side, codes in U.RETRIED.items() for code in codes)


@query(f"SELECT e.event_id, count(p.side)::BIGINT AS sides FROM (SELECT event_id, (400 + event_id % 130)::INT AS status FROM events) e LEFT JOIN (VALUES {POLICY}) p(side, status) USING (status) GROUP BY e.event_id")
def retry_policy(spark, d):
    """On how many sides a status is tried again."""
    policy = spark.createDataFrame([(side, code) for side, codes in U.RETRIED.items() for code in codes], "side string, status int")
    seen = table(spark, d, "events").select("event_id", (400 + F.col("event_id") % 130).cast("int").alias("status"))
    return seen.join(policy, "status", "left").groupBy("event_id").agg(F.count("side").alias("sides"))


@query("SELECT doc_id, source FROM documents WHERE doc_id % 4 = 2")
def ready_documents(spark, d):
    """Documents that can be asked about: those whose status is ready, here the third of four in turn."""
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "ready", "failed"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").withColumn("status", status).where("status = 'ready'").select("doc_id", "source")


@query("SELECT page_id, page_id % 3 = 0 AS is_pdf FROM pages")
def pdf_magic(spark, d):
    """The parser's own test of a PDF: the mark at the start, white space aside."""
    k = F.col("page_id") % 3
    content = F.when(k == 0, F.concat(F.lit(" \n%PDF-1.7"), F.col("html"))).when(k == 1, F.concat(F.lit("x %PDF-1.7"), F.col("html"))).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", U.starts_as_pdf(content.cast("binary")).alias("is_pdf"))
