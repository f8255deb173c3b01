"""Services: retries, order, contracts; readers and answerers as parts of plans."""

import pytest
from pyspark.sql import functions as F

from lectern.functions.vectors import hash_vector
from lectern.sources import services as S


class Flaky:
    dimension = 4

    def __init__(self, *statuses):
        self.left = list(statuses)

    def __call__(self, texts):
        if self.left:
            raise S.ServiceError(self.left.pop(0))
        return S.HashEmbedder(4)(texts)


def test_retries_wait_longer_and_longer():
    slept = []
    got = S.call(Flaky(429, 503, 529), ["a", "b"], sleep=slept.append, chance=lambda: 1.0)
    assert slept == [1.25, 2.5, 5.0] and got == [hash_vector("a", 4), hash_vector("b", 4)]


@pytest.mark.parametrize(("side", "status", "tries"), [("documents", 400, 0), ("documents", 529, 4), ("queries", 529, 0), ("queries", 503, 4)])
def test_what_is_not_tried_again(side, status, tries):
    slept = []
    with pytest.raises(S.ServiceError):
        S.call(Flaky(*[status] * 9), ["a"], side, slept.append, lambda: 0.0)
    assert len(slept) == tries


@pytest.mark.parametrize("items", [[], [{"index": 0, "embedding": [1.0]}] * 2, [{"index": 2, "embedding": [1.0]}, {"index": 0, "embedding": [1.0]}], [{"index": 0}, {"index": 1}]])
def test_answers_that_do_not_fit(items):
    with pytest.raises(S.ServiceError):
        S.in_order(items, 2)


@pytest.mark.parametrize("vector", [[1.0], [0.5, 0.5], [float("nan"), 1.0], [float("inf"), 0.0]])
def test_vectors_that_break_the_contract(vector):
    with pytest.raises(S.ContractError):
        S.checked([vector], 2)


@pytest.mark.parametrize(("n", "configured", "size"), [(0, 128, 128), (10, 128, 16), (200, 128, 25), (5000, 128, 128), (200, 8, 8)])
def test_batch_sizes(n, configured, size):
    assert S.batches(n, configured) == size


def test_vectors_stay_with_their_texts(spark):
    df = spark.createDataFrame([(k, f"text {k}") for k in range(300)], "id bigint, text string")
    assert all(r["embedding"] == hash_vector(r["text"], 8) for r in S.embed(df, S.HashEmbedder(8), 32).collect())


def test_answers_in_pieces(spark):
    df = spark.createDataFrame([(1, "Sources", " q ", 2), (2, "", "q", 0)], "conv_id bigint, block string, question string, n_sources int")
    got = S.answer(df, S.Scripted(["a [", "1] b"])).orderBy("seq").collect()
    assert [(r["conv_id"], r["delta"]) for r in got] == [(1, "a ["), (1, "1] b")]


def test_words_from_any_reader(spark):
    read = lambda content: [(1, 600.0, 800.0, 1, w, 54.0 + 60 * k, 104.0 + 60 * k, 100.0, 110.0, 10.0, "Serif") for k, w in enumerate(content.decode().split())]
    df = spark.createDataFrame([(5, b"some words here")], "doc_id bigint, content binary")
    assert [r["text"] for r in S.page_words(df, read).orderBy("x0").collect()] == ["some", "words", "here"]
    from lectern.operators import layout

    assert [r["text"] for r in layout.page_lines(S.page_words(df, read)).collect()] == ["some words here"]


def test_same_rows_under_any_partitioning(spark):
    from lectern.plans import QUERIES

    folder = "/root/testdata/sf0.001"
    for name in ("retrieve_batch", "history_messages", "bm25_topk", "txt_paragraphs"):
        seen = set()
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.add(tuple(sorted(map(str, QUERIES[name](spark, folder).collect()))))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(seen) == 1, name
    assert QUERIES["retrieve_topk"](spark, folder).where(F.col("similarity") < 0.35).count() == 0
