"""Documents without text: queries on passages and sentences give the rows of the SQL for them as well."""

import hashlib

import duckdb
import pytest

from lectern.plans import ORACLES, QUERIES
from lectern.plans import text as T

TEXTS = ["", "One sentence here. Another one.", " ", "\n\n", "word " * 900, "\t　\n", None, "A line.\nThe next line."]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("blank"))
    rows = [(k, t, "en", f"src{k}", len(t or "")) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{place}/documents.parquet")
    return place


@pytest.mark.parametrize(
    "name",
    [
        "chunk_counts",
        "chunk_coverage",
        "chunk_documents",
        "chunk_min_tokens",
        "chunk_offset_invariant",
        "chunk_ordinals_dense",
        "chunk_overlap",
        "sentence_spans",
        "sql_chunk_text",
    ],
)
def test_same_rows_as_sql(spark, folder, name):
    df = QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = con.sql(ORACLES[name])
    assert sorted(map(str, df.select(*found.columns).collect())) == sorted(map(str, spark.createDataFrame(found.fetchall(), df.select(*found.columns).schema).collect()))


def test_only_blank_documents_get_a_row(spark, folder):
    """A document with a text that lost its passages is not made up for."""
    made = spark.createDataFrame([(1, 0, "One")], "document_id bigint, ordinal int, text string")
    rows = T.with_blank(made, spark, folder).collect()
    assert sorted((r.document_id, r.ordinal, r.text) for r in rows if r.ordinal is not None) == [(1, 0, "One")]
    assert sorted(r.document_id for r in rows if r.ordinal is None) == [0, 2, 3, 5, 6]


def test_sql_chunk_text_keeps_blank_lines(spark, tmp_path):
    """The digest is that of the whole text, with blank lines and line ends at its edges."""
    texts = ["\nOne.", "One.\n", "One.\n\nTwo.", "One.\n \t\nTwo.\n\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.wrong, r.digest) for r in QUERIES["sql_chunk_text"](spark, str(tmp_path)).collect()}
    assert found == {k: (0, hashlib.md5(t.encode()).hexdigest()) for k, t in enumerate(texts)}
