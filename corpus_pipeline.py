"""Corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage judges all rows of its input: null and empty texts, repeated rows and null ids
as its operator's docstring says. Columns of the input, whatever their names, go through
unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import lang_id, packing, pu_quality, simhash
from lectern.llm.common import remove_folder, shared_folder, table
from lectern.llm.queries import held_out

#: Models are trained and pieces numbered on the way; no SQL gives these rows.
ORACLE_SQL = None


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those it rejects go, null texts and texts without a letter among them.

    Repeated rows are judged alike. Without any labelled row there is no language and all go.
    """
    models = lang_id.train(docs.where(~held_out(4, 2)).select("doc_id", "text", "lang"))
    return lang_id.keep_known(docs, models)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of those at hand, takes for good.

    Null and empty texts are scored like any other and repeated rows alike. Without labels of
    documents at hand all scores are 0.5 and all stay.
    """
    labels = table(spark, sf_dir, "labels").where(~held_out(3, 1)).select("doc_id", F.col("quality").alias("label"))
    return pu_quality.keep_good(docs, pu_quality.train(docs.where(~held_out(3, 1)), labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: fingerprints within 4 bits, or shingles of five words similar by 0.8 or more.

    The smallest doc_id stays, one row of a repeated id, and a row without an id only if no
    other of its group has one. Texts without a word are one group.
    """
    return simhash.keep_first(docs, similar_width=5, least=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", known_languages), ("quality", good_quality), ("near_dedup", near_dedup), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents; what a stage keeps is written to the shared folder and read again.

    What a stage has read is removed when it has written, but for the input of the last one,
    which the result reads.
    """
    docs, place, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{place}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
