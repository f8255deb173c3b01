"""Retrieval from an index by cells: exact where asked, recall and pruned reads where not, odd vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import ivf
from lectern.operators import retrieval as R

CHUNKS = "document_id bigint, ordinal bigint, tenant int, embedding array<float>"
ASKED = "question_id bigint, tenant int, qe array<float>"


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    middles = [[rnd.gauss(0, 1) for _ in range(24)] for _ in range(40)]
    near = lambda m, s: [x + rnd.gauss(0, s) for x in m]
    rows = [(k % 300, k, 0 if k % 20 else 1, near(middles[k % 40], 0.5)) for k in range(3000)]
    rows += [(400, k, 0, rows[7][3]) for k in range(5000, 5100)]  # copies
    asked = [(k, 0 if k % 3 else 1, near(middles[k % 40], 0.7)) for k in range(60)]
    return spark.createDataFrame(rows, CHUNKS).repartition(3), spark.createDataFrame(asked, ASKED)


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    ivf.build(corpus[0], str(tmp_path_factory.mktemp("ivf") / "index"), cells=48)
    return ivf.opened(corpus[0].sparkSession, str(next(tmp_path_factory.getbasetemp().glob("ivf*/index"))))


def shown(df):
    return {(r["question_id"], r["rank"]): (r["document_id"], r["ordinal"], round(r["similarity"], 6)) for r in df.collect()}


@pytest.mark.parametrize("probes", [1, 6, 48])
def test_exact_search_is_that_of_all_chunks(corpus, index, probes):
    chunks, asked = corpus
    how = R.Retrieval(floor=-1.0)
    assert shown(ivf.retrieve(index, asked, how, probes, exact=True)) == shown(R.retrieve_batch(chunks, asked, how))


def test_recall_and_what_is_read(corpus, index, capsys):
    chunks, asked = corpus
    how = R.Retrieval(floor=-1.0)
    want, got = shown(R.retrieve_batch(chunks, asked, how)), shown(ivf.retrieve(index, asked, how, probes=6))
    found = {(q, d, o) for (q, _), (d, o, _) in got.items()}
    recall = sum((q, d, o) in found for (q, _), (d, o, _) in want.items()) / len(want)
    cells = ivf.order_of_cells(index, ivf.whole(asked, "qe").select("question_id", "tenant", ivf.unit(F.col("qe")).alias("qe"))).where("tenant = 0")
    share = cells.where("rank <= 6").agg(F.sum("n")).first()[0] / cells.agg(F.sum("n")).first()[0]
    with capsys.disabled():
        print(f"\ncells: recall {recall:.3f} at 8, {share:.2f} of a tenant's chunks read")
    assert recall >= 0.95 and share < 0.3


def test_one_question_reads_its_cells_only(corpus, index):
    asked = corpus[1].where("question_id = 4")
    cells = ivf.order_of_cells(index, asked.select("question_id", "tenant", ivf.unit(F.col("qe")).alias("qe"))).where("rank <= 2")
    plan = ivf.in_cells(index, cells)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "CartesianProduct" not in plan
    files = ivf.in_cells(index, cells).select(F.col("document_id")).count(), index.chunks.where("tenant = 0").count()
    assert files[0] * 5 < files[1]


def test_cells_give_only_what_can_be_among_the_nearest(corpus, index, monkeypatch):
    """Of each cell the n nearest, none further than the last one found, however chunks and questions are cut into blocks."""
    chunks, asked = corpus
    asked = R.whole(asked, "qe").select("question_id", "tenant", ivf.unit(F.col("qe")).alias("qe"))
    cells = ivf.order_of_cells(index, asked).withColumn("last", F.lit(0.9))
    every = sorted((r["question_id"], r["distance"], r["document_id"], r["ordinal"]) for r in ivf.in_cells(index, cells.drop("last")).collect())
    assert len(every) == cells.agg(F.sum("n")).first()[0]
    monkeypatch.setattr(ivf, "BLOCK", 7)
    got = sorted((r["question_id"], r["distance"], r["document_id"], r["ordinal"]) for r in ivf.in_cells(index, cells, asked, 3).collect())
    first = lambda rows: [x for q in sorted({r[0] for r in rows}) for x in [r for r in rows if r[0] == q][:3]]
    assert set(got) <= set(every) and len(got) < len(every) and max(r[1] for r in got) <= 0.9 and first(got) == first([r for r in every if r[1] <= 0.9])


def test_rare_tenants_get_more_cells(corpus, index):
    """The tenant with a twentieth of the chunks still finds all the candidates it can."""
    asked = corpus[1].where("tenant = 1")
    got = ivf.retrieve(index, asked, R.Retrieval(floor=-1.0, cap=100), probes=1).groupBy("question_id").count().collect()
    assert len(got) == 20 and {r["count"] for r in got} == {8}


def test_odd_vectors(spark):
    nan = float("nan")
    bad = [(1, 1, 0, None), (1, 2, 0, []), (1, 3, 0, [0.0, 0.0]), (1, 4, 0, [nan, 1.0]), (1, 5, 0, [None, 1.0]), (1, 6, 0, [1.0]), (1, 7, 0, [math.inf, 0.0])]
    good = [(2, k, k % 2, [1.0, k / 10]) for k in range(12)] + [(3, 1, None, [1.0, 0.0])]
    asked = spark.createDataFrame([(1, 0, [1.0, 0.2]), (2, 1, [0.0, 0.0]), (3, 1, None), (4, 7, [1.0, 1.0]), (5, 1, [-1.0, 0.0])], ASKED)
    for cells in (None, 1, 5):
        index = ivf.build(spark.createDataFrame(bad + good, CHUNKS), cells=cells)
        rows = ivf.retrieve(index, asked, R.Retrieval(floor=-1.0, cap=9), exact=True).collect()
        assert {r["question_id"] for r in rows} == {1, 5} and len(rows) == 12
        assert [r["ordinal"] for r in sorted(rows, key=lambda r: (r["question_id"], r["rank"]))][:3] == [2, 4, 0]
    empty = ivf.build(spark.createDataFrame(bad, CHUNKS).where("ordinal < 6 and ordinal > 0"))
    assert ivf.retrieve(empty, asked).collect() == []


def test_batches_search_blocks_of_chunks(spark, corpus, monkeypatch):
    """Blocks of any size give what each question finds by itself; rows without a direction take no places of candidates."""
    chunks, asked = corpus
    nan = float("nan")
    odd = spark.createDataFrame([(500 + k, k, k % 2, v) for k, v in enumerate([None, [nan] * 24, [0.0] * 24, [1.0], []] * 40)], CHUNKS)
    how = R.Retrieval(floor=-1.0, cap=100)
    alone = {}
    for q in asked.where("question_id % 10 = 4").collect():
        one = spark.createDataFrame([(q["qe"],)], "qe array<float>")
        found = R.retrieve(chunks.where(F.col("tenant") == q["tenant"]), one, how).collect()
        alone |= {(q["question_id"], k + 1): (r["document_id"], r["ordinal"], round(r["similarity"], 6)) for k, r in enumerate(found)}
    for block, tile in ((8192, 256), (7, 2)):
        monkeypatch.setattr(R, "BLOCK", block * 10)
        monkeypatch.setattr(R, "TILE", tile)
        got = shown(R.retrieve_batch(chunks.unionByName(odd), asked.where("question_id % 10 = 4"), how))
        assert got == alone and len(got) == 48
    kept = R.nearest(chunks.withColumn("more", F.lit("x")), asked, 3)
    assert kept.columns == ["question_id", "document_id", "ordinal", "tenant", "more", "distance"] and kept.count() >= 180
