"""The jobs as registered queries: each run twice over the whole tables into a folder of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.index_documents import index_documents
from jobs.retrieval_quality import FLOORS, retrieval_quality
from lectern.operators import postings as T
from lectern.plans.retrieval import HELD, RANKS, SCORES
from lectern.plans.text import shortened, tokens
from lectern.session import shared_folder


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index holds after two runs: a row a document, and one for each of its terms."""
    place = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        index_documents(spark, f"{sf_dir}/documents.parquet", f"{place}/index", f"{place}/checkpoint")
    index = T.opened(spark, f"{place}/index")
    docs = spark.read.parquet(f"{place}/index/documents").join(index.lengths, ["doc_id", "batch"]).drop("batch")
    return docs.unionByName(index.postings.select("term", T.each_posting()), allowMissingColumns=True)


def job2_retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case after two runs, beside the summary of all."""
    place = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        retrieval_quality(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", place, "check")
    figures = spark.read.parquet(f"{place}/summary").drop("run")
    shown = [F.round(c, 6).alias(c) if c in FLOORS else F.col(c) for c in figures.columns]
    return spark.read.parquet(f"{place}/cases").drop("run").crossJoin(F.broadcast(figures.select(shown)))


INDEXED = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
s AS (SELECT doc_id, lang, source, {tokens("coalesce(text, '')")} AS n_tokens, {shortened("coalesce(text, '')", 200)} AS preview, coalesce(len(regexp_extract_all(lower(text), '[a-z0-9]+')), 0)::BIGINT AS length FROM documents),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY 1, 2)
SELECT doc_id, lang, source, n_tokens, preview, length, NULL AS term, NULL AS tf FROM s
UNION ALL BY NAME SELECT f.doc_id, length, term, tf FROM f JOIN s USING (doc_id)"""

JUDGED = SCORES + f""", h AS ({HELD}), k AS (SELECT *, CASE WHEN containing = 0 THEN 'absent' WHEN rank = 1 THEN 'first' WHEN rank <= 3 THEN 'among_three' WHEN rank <= 10 THEN 'among_ten' ELSE 'later' END AS outcome FROM ({RANKS})),
g AS (SELECT round(avg((containing > 0)::INT), 6) AS coverage, round(avg((coalesce(rank, 99) <= 1)::INT), 6) AS hit_at_1, round(avg((coalesce(rank, 99) <= 3)::INT), 6) AS hit_at_3, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM k)
SELECT k.*, g.*, coverage >= 1.0 AND hit_at_1 >= 0.75 AND hit_at_3 >= 1.0 AND mrr >= 0.8 AS reached FROM k CROSS JOIN g"""

QUERIES = {"job1_index_documents": job1_index_documents, "job2_retrieval_quality": job2_retrieval_quality}
ORACLES = {"job1_index_documents": INDEXED, "job2_retrieval_quality": JUDGED}
