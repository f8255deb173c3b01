"""The two jobs: runs over growing input, replaced documents, reruns, odd rows, command lines."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs.index_documents import SCHEMA, index_documents
from jobs.retrieval_quality import retrieval_quality
from lectern.operators import postings as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def held(spark, place):
    index = T.opened(spark, place)
    terms = {(r["doc_id"], r["term"], r["tf"]) for r in index.postings.select("term", T.each_posting()).collect()}
    return terms, {(r["doc_id"], r["length"]) for r in index.lengths.collect()}


def of(rows):
    terms = {(d, t, text.lower().split().count(t)) for d, text in rows for t in (text or "").lower().split()}
    return terms, {(d, len((text or "").split())) for d, text in rows}


def test_index_grows_with_its_input(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("documents.parquet", "index", "checkpoint"))
    put = lambda rows: spark.createDataFrame([(d, t, "en", "s") for d, t in rows], SCHEMA).withColumn("n_chars", F.lit(1)).coalesce(1).write.mode("append").parquet(source)
    run = lambda: index_documents(spark, source, target, checkpoint, buckets=3)
    first = [(1, "a b b"), (2, "b c"), (3, None), (None, "lost"), (70, "a")]
    put(first)
    run()
    assert held(spark, target) == of([r for r in first if r[0] is not None])
    files = sorted(str(p) for p in (tmp_path / "index").rglob("*.parquet"))
    run()  # nothing new: no file is written
    assert sorted(str(p) for p in (tmp_path / "index").rglob("*.parquet")) == files
    put([(4, "d a"), (2, "e e b")])  # a new document, and a new version of an old one
    run()
    after = [(1, "a b b"), (2, "e e b"), (3, None), (70, "a"), (4, "d a")]
    assert held(spark, target) == of(after)
    assert files == [f for f in files if os.path.exists(f)]  # what was indexed before stays as it is
    docs = spark.read.parquet(f"{target}/documents")
    assert {(r["batch"], r["doc_id"]) for r in docs.collect()} == {(0, 1), (0, 2), (0, 3), (0, 70), (1, 4), (1, 2)}
    best = T.Search(T.opened(spark, target), spark.createDataFrame([(0, "e b")], "question_id bigint, text string")).best(2).collect()
    assert [r["doc_id"] for r in best] == [2, 1]


def test_batch_that_is_run_again_leaves_the_same_rows(spark, tmp_path):
    source, target = str(tmp_path / "documents.parquet"), str(tmp_path / "index")
    spark.createDataFrame([(k, f"word{k} shared", "en", "s") for k in range(40)], SCHEMA).repartition(4).write.parquet(source)
    index_documents(spark, source, target, str(tmp_path / "one"), most_files=2)
    rows = held(spark, target)
    index_documents(spark, source, target, str(tmp_path / "two"), most_files=2)  # a lost checkpoint: all batches come again
    assert held(spark, target) == rows == of([(k, f"word{k} shared") for k in range(40)])


def test_one_file_is_as_good_as_a_folder(spark, tmp_path):
    index_documents(spark, "/root/testdata/sf0.001/documents.parquet", str(tmp_path / "index"), str(tmp_path / "checkpoint"))
    assert T.opened(spark, str(tmp_path / "index")).lengths.count() == 200


def test_quality_of_retrieval(spark, tmp_path):
    source, cases, target = (str(tmp_path / n) for n in ("documents.parquet", "cases.parquet", "out"))
    texts = [f"common words here and passage number{k} of the set" for k in range(30)] + [None, ""]
    spark.createDataFrame([*enumerate(texts), (None, "passage number3"), (5, "a")], "doc_id bigint, text string").write.parquet(source)
    asked = [(0, "passage number3 of"), (1, "common words here"), (2, "no such passage"), (3, None), (None, "common"), (4, "And  Passage\nNUMBER7 of")]
    spark.createDataFrame(asked, "item_id bigint, text string").write.parquet(cases)
    run = lambda **how: retrieval_quality(spark, source, cases, target, **how)
    read = lambda name: sorted((tuple(r.asDict().items()) for r in spark.read.parquet(f"{target}/{name}").collect()), key=str)
    run(run="a")
    rows = {r["item_id"]: (r["containing"], r["rank"], r["outcome"]) for r in spark.read.parquet(f"{target}/cases").collect()}
    assert rows == {0: (1, 1, "first"), 1: (30, 1, "first"), 2: (0, None, "absent"), 3: (0, None, "absent"), 4: (1, 1, "first")}
    figures = spark.read.parquet(f"{target}/summary").first()
    assert figures["coverage"] == pytest.approx(0.6) and figures["hit_at_1"] == pytest.approx(0.6) and not figures["reached"]
    before = read("cases"), read("summary")
    run(run="a")
    assert (read("cases"), read("summary")) == before
    run(run="b", floors={"mrr": 0.5})
    assert {(r["run"], r["reached"]) for r in spark.read.parquet(f"{target}/summary").collect()} == {("a", False), ("b", True)}
    spark.createDataFrame([], "item_id bigint, text string").write.mode("overwrite").parquet(cases)
    run(run="b")  # a run without cases replaces its rows by none
    assert {r["run"] for r in spark.read.parquet(f"{target}/cases").collect()} == {"a"}
    assert spark.read.parquet(f"{target}/summary").where("run = 'b'").first()["coverage"] == 0


@pytest.mark.parametrize("job", ["index_documents", "retrieval_quality"])
def test_command_lines(spark, tmp_path, job):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"buckets": 2} if job == "index_documents" else {"run": "r"}))
    data, target = "/root/testdata/sf0.001", str(tmp_path / "out")
    paths = [f"{data}/documents.parquet", target, str(tmp_path / "checkpoint")] if job == "index_documents" else [f"{data}/documents.parquet", f"{data}/benchmark.parquet", target]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 --conf spark.checkpoint.dir={tmp_path}/shared pyspark-shell"}
    done = subprocess.run([sys.executable, f"{ROOT}/jobs/{job}.py", *paths, "--config", str(config)], env=env, capture_output=True, text=True, timeout=600, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"{job}:" in done.stderr and "200" in done.stderr
    if job == "index_documents":
        assert {r["bucket"] for r in spark.read.parquet(f"{target}/postings").select("bucket").distinct().collect()} == {0, 1}
    else:
        assert spark.read.parquet(f"{target}/cases").where("run = 'r'").count() == 40


def test_registered_queries_name_their_own_folders(spark):
    from jobs.queries import QUERIES

    for query in QUERIES.values():
        settings = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.shuffle.partitions")
        assert query(spark, "/root/testdata/sf0.001").count() == query(spark, "/root/testdata/sf0.001").count() > 0
        assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.shuffle.partitions")) == settings
