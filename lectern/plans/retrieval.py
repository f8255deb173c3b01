"""Queries over vectors, passages and lexical scores. embeddings stand for chunks: label is the document, vec_id the ordinal, label % 2 the tenant."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions import vectors as V
from lectern.operators import conversation as C
from lectern.operators import ivf as I
from lectern.operators import lexical as L
from lectern.operators import paging as G
from lectern.operators import postings as T
from lectern.operators import retrieval as R
from lectern.plans.registry import query
from lectern.plans.text import shortened
from lectern.sources.tables import spread, table


def chunks(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("document_id"), F.col("vec_id").alias("ordinal"), "embedding", (F.col("label") % 2).alias("tenant"))


def own(spark, d):
    return chunks(spark, d).where("tenant = 0").drop("tenant")


def question(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("qe"))


def found(df):
    return df.select(F.col("document_id").alias("label"), F.col("ordinal").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


def retrieval_sql(floor: float, cap: int, k: int, where: str = "") -> str:
    return f"""
WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0),
c AS (SELECT vec_id, label, 1.0 - list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) AS distance FROM embeddings CROSS JOIN q
      WHERE label % 2 = 0 {where} ORDER BY distance, label, vec_id LIMIT {6 * k}),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rn FROM c)
SELECT label, vec_id, round(1.0 - distance, 6) AS similarity FROM r WHERE rn <= {cap} AND distance <= 1.0 - {floor} ORDER BY distance, label, vec_id LIMIT {k}"""


@query(retrieval_sql(0.35, 4, 8))
def retrieve_topk(spark, d):
    return found(R.retrieve(own(spark, d), question(spark, d)))


@query(retrieval_sql(0.0, 4, 8))
def retrieve_floor0(spark, d):
    return found(R.retrieve(own(spark, d), question(spark, d), R.Retrieval(floor=0.0)))


@query(retrieval_sql(0.0, 2, 20))
def per_document_cap(spark, d):
    return found(R.retrieve(own(spark, d), question(spark, d), R.Retrieval(top_k=20, floor=0.0, cap=2)))


@query(retrieval_sql(0.0, 4, 8, "AND label IN (2, 4)"))
def retrieve_scoped(spark, d):
    return found(R.retrieve(own(spark, d), question(spark, d), R.Retrieval(floor=0.0), [2, 4]))


@query(retrieval_sql(0.0, 4, 8, "AND false"))
def retrieve_scope_empty(spark, d):
    return found(R.retrieve(own(spark, d), question(spark, d), R.Retrieval(floor=0.0), []))


@query("WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0) SELECT label, vec_id, round(1.0 - list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS distance FROM embeddings CROSS JOIN q WHERE label % 2 = 0 ORDER BY 1.0 - list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), label, vec_id LIMIT 48")
def knn_candidates(spark, d):
    return R.candidates(own(spark, d), question(spark, d), 48).select(F.col("document_id").alias("label"), F.col("ordinal").alias("vec_id"), F.round("distance", 6).alias("distance"))


BATCH = """
WITH q AS (SELECT vec_id AS question_id, label % 2 AS tenant, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT question_id, vec_id, label, 1.0 - list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) AS distance FROM embeddings JOIN q ON label % 2 = tenant),
n AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, label, vec_id) AS n FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, label ORDER BY distance, vec_id) AS rn FROM n WHERE n <= 48),
b AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, label, vec_id) AS rank FROM r WHERE rn <= 4 AND distance <= 1.0 - 0.1)
SELECT question_id, rank, label, vec_id, round(1.0 - distance, 6) AS similarity FROM b WHERE rank <= 8"""


def questions(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), (F.col("label") % 2).alias("tenant"), F.col("embedding").alias("qe"))


def batch(spark, d):
    return R.retrieve_batch(chunks(spark, d), questions(spark, d), R.Retrieval(floor=0.1))


@query(BATCH)
def retrieve_batch(spark, d):
    return batch(spark, d).select("question_id", F.col("rank").cast("long").alias("rank"), F.col("document_id").alias("label"), F.col("ordinal").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query(BATCH)
def retrieve_indexed(spark, d):
    """The same from an index by cells, whose bounds tell which of them can be left out."""
    best = I.retrieve(I.build(chunks(spark, d)), questions(spark, d), R.Retrieval(floor=0.1), exact=True)
    return best.select("question_id", F.col("rank").cast("long").alias("rank"), F.col("document_id").alias("label"), F.col("ordinal").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


CITED = f"SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS index, doc_id, round(similarity, 3) AS similarity, {shortened('text', 300)} AS snippet FROM (SELECT b.*, d.doc_id, d.text FROM ({BATCH}) b JOIN documents d ON d.doc_id = b.vec_id)"


def cited(spark, d):
    passages = batch(spark, d).withColumn("similarity", F.round("similarity", 6))
    texts = table(spark, d, "documents").select("doc_id", "text", "source")
    return R.citations(passages.join(texts, F.col("doc_id") == F.col("ordinal")))


@query(CITED)
def citations(spark, d):
    return cited(spark, d).select("question_id", F.col("index").cast("long").alias("index"), "doc_id", "similarity", "snippet")


SOURCE = "'<source index=\"' || rank || '\" file=\"' || replace(source, '&', '&amp;') || '\">' || chr(10) || regexp_replace(text, '^[" + X.WS + "]+|[" + X.WS + "]+$', '', 'g') || chr(10) || '</source>'"
SOURCES = f"SELECT b.question_id, row_number() OVER (PARTITION BY b.question_id ORDER BY b.rank) AS rank, d.text, d.source FROM ({BATCH}) b JOIN documents d ON d.doc_id = b.vec_id"


@query(f"SELECT question_id, rank AS index, md5({SOURCE}) AS source FROM ({SOURCES})")
def render_source(spark, d):
    return cited(spark, d).select("question_id", F.col("index").cast("long").alias("index"), F.md5(C.render_source(F.col("index"), F.col("source"), F.col("text"))).alias("source"))


@query(f"SELECT question_id, md5('Sources:' || chr(10) || chr(10) || string_agg({SOURCE}, chr(10) || chr(10) ORDER BY rank)) AS block FROM ({SOURCES}) GROUP BY question_id")
def prompt_block(spark, d):
    return C.prompt_block(cited(spark, d).withColumnRenamed("source", "filename")).select("question_id", F.md5("block").alias("block"))


@query("SELECT d.doc_id, d.source, count(*)::BIGINT AS n FROM embeddings e JOIN documents d ON d.doc_id = e.label GROUP BY 1, 2")
def join_chunks_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return chunks(spark, d).select("document_id").join(docs, F.col("document_id") == F.col("doc_id")).groupBy("doc_id", "source").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE source = 'src3' AND doc_id IN (3, 4, 23, 43)")
def scope_narrow(spark, d):
    """Asked ids that are numbers and the tenant's own."""
    asked = spark.createDataFrame([("3",), ("4",), ("x",), ("43",), ("23",), (None,)], "id string").select(F.col("id").try_cast("bigint").alias("doc_id")).where("doc_id is not null")
    return table(spark, d, "documents").where("source = 'src3'").select("doc_id").join(asked, "doc_id", "left_semi")


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], b::DOUBLE[]), 6) AS similarity FROM (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) WHERE b IS NOT NULL")
def cosine_pairs(spark, d):
    """Each passage with the one before it."""
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    pairs = table(spark, d, "embeddings").withColumn("b", before).where("b is not null")
    return pairs.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("b")), 6).alias("similarity"))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 1 LIMIT 1) q")
def dot_scores(spark, d):
    q = table(spark, d, "embeddings").where("vec_id = 1").select(F.col("embedding").alias("qe")).limit(1)
    return table(spark, d, "embeddings").crossJoin(F.broadcast(q)).select("vec_id", F.round(V.dot(F.col("embedding"), F.col("qe")), 6).alias("score"))


@query("SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'dimension' WHEN 1 THEN 'not unit length' WHEN 2 THEN 'not finite' END AS problem FROM embeddings")
def vector_guard(spark, d):
    """Vectors spoilt in known ways."""
    k, e = F.col("vec_id") % 5, F.col("embedding").cast("array<double>")
    spoilt = F.when(k == 0, F.slice(e, 1, 63)).when(k == 1, F.transform(e, lambda x: x * 0.5)).when(k == 2, F.transform(e, lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x))).otherwise(e)
    return table(spark, d, "embeddings").select("vec_id", V.vector_problem(spoilt, 64).alias("problem"))


@query("SELECT doc_id, 64 AS dimension, 1.0::DOUBLE AS norm FROM documents")
def hash_embedding_norms(spark, d):
    rows = table(spark, d, "documents").select("doc_id", V.hash_embedding(64)(F.col("text")).alias("e"))
    return rows.select("doc_id", F.size("e").alias("dimension"), F.round(V.norm(F.col("e")), 6).alias("norm"))


@query("SELECT doc_id, ('0x' || substring(sha256(text), 1, 16))::UBIGINT::VARCHAR AS seed FROM documents")
def embedding_seed(spark, d):
    return table(spark, d, "documents").select("doc_id", V.hash_seed(F.col("text")).alias("seed"))


@query("SELECT label, list(vec_id ORDER BY vec_id)::VARCHAR AS ids FROM embeddings GROUP BY label")
def reassemble_by_index(spark, d):
    """Answers of a service that come back in any order, put back by their index."""
    got = table(spark, d, "embeddings").groupBy("label").agg(F.collect_list(F.struct(F.col("vec_id").alias("index"), "vec_id")).alias("data"))
    ids = F.transform(F.array_sort("data", lambda a, b: (a["index"] - b["index"]).cast("int")), lambda x: x["vec_id"].cast("string"))
    return got.select("label", F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")).alias("ids"))


@query(f"SELECT doc_id, lang, {shortened('text', 200)} AS preview FROM documents")
def chunk_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", X.shorten(F.col("text"), X.PREVIEW_LENGTH).alias("preview"))


@query("SELECT label, vec_id, lag(vec_id) OVER w AS previous, lead(vec_id) OVER w AS next FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)")
def neighbours(spark, d):
    return R.neighbours(chunks(spark, d).drop("embedding", "tenant")).select(F.col("document_id").alias("label"), F.col("ordinal").alias("vec_id"), "previous", "next")


@query("SELECT vec_id, true AS has_more FROM embeddings WHERE label = 3 AND vec_id > 50 ORDER BY vec_id LIMIT 10")
def chunk_page(spark, d):
    rows = table(spark, d, "embeddings").where("label = 3").select("vec_id")
    return G.by_ordinal(rows, "vec_id", 10, 50).select("vec_id", "has_more")


DF = "SELECT term, count(*)::BIGINT AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term"


@query(DF)
def bm25_df(spark, d):
    return L.document_frequency(texts(spark, d))


SCORES = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
s AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS length FROM documents),
m AS (SELECT count(*) AS n, avg(length) AS mean FROM s),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
b AS (SELECT q.item_id, f.doc_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score
      FROM q JOIN f USING (term) JOIN df USING (term) JOIN s USING (doc_id) CROSS JOIN m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM b)"""


def texts(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def cases(spark, d):
    return table(spark, d, "benchmark").select("item_id", "text")


def scored(best):
    return best.select(F.col("question_id").alias("item_id"), F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@query(SCORES + " SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 5")
def bm25_topk(spark, d):
    return scored(L.best_lexical(texts(spark, d), cases(spark, d).withColumnRenamed("item_id", "question_id"), 5))


@query(SCORES + " SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10")
def bm25_indexed(spark, d):
    """The ten best documents of every case, by an index made of all documents."""
    return scored(T.Search(T.build(texts(spark, d)), cases(spark, d).withColumnRenamed("item_id", "question_id")).best(10))


PHRASE = "trim(regexp_replace(lower(text), '[" + X.WS + "]+', ' ', 'g'))"
HELD = f"SELECT item_id, doc_id FROM (SELECT item_id, {PHRASE} AS needle FROM benchmark) JOIN (SELECT doc_id, {PHRASE} AS hay FROM documents) ON contains(hay, needle)"
RANKS = f"SELECT i.item_id, count(h.doc_id)::BIGINT AS containing, min(r.rank) AS rank FROM benchmark i LEFT JOIN h ON h.item_id = i.item_id LEFT JOIN r ON r.item_id = h.item_id AND r.doc_id = h.doc_id GROUP BY 1"


@query(HELD)
def quality_containment(spark, d):
    return L.containment(texts(spark, d), cases(spark, d))


def ranks(spark, d):
    return L.quality_ranks(texts(spark, d), cases(spark, d))


@query(SCORES + f", h AS ({HELD}) " + RANKS)
def quality_rank(spark, d):
    return ranks(spark, d).select("item_id", "containing", F.col("rank").cast("long").alias("rank"))


@query(SCORES + f", h AS ({HELD}), k AS ({RANKS}) SELECT round(avg((containing > 0)::INT), 6) AS coverage, round(avg((coalesce(rank, 99) <= 1)::INT), 6) AS hit_at_1, round(avg((coalesce(rank, 99) <= 3)::INT), 6) AS hit_at_3, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM k")
def quality_report(spark, d):
    return L.quality_report(ranks(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("coverage", "hit_at_1", "hit_at_3", "mrr")])
