"""Ranked lexical search over an index against plain scores of all pairs; replaced documents; odd rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.operators import lexical as L
from lectern.operators import postings as T

DOCS, ASKED = "doc_id bigint, text string", "question_id bigint, text string"


def plain_scores(docs, questions):
    """{(question_id, doc_id): score} of all pairs that share a term."""
    terms = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    counts = {d: Counter(terms(t)) for d, t in docs}
    size = {d: sum(c.values()) for d, c in counts.items()}
    mean = sum(size.values()) / len(size)
    df = Counter(t for c in counts.values() for t in c)
    out = Counter()
    for q, text in questions:
        for t in set(terms(text)):
            idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
            for d, c in counts.items():
                if c[t]:
                    out[q, d] += idf * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * size[d] / mean))
    return out


def plain_best(scores, k):
    best = {}
    for (q, d), s in scores.items():
        best.setdefault(q, []).append((-round(s, 6), d))
    return {(q, r + 1): (d, -s) for q, found in best.items() for r, (s, d) in enumerate(sorted(found)[:k])}


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    docs = [(k * 3 - 60, " ".join(rnd.choices(words, weights, k=rnd.choice([1, 5, 40, 200])))) for k in range(300)]
    docs += [(2000 + k, docs[7][1]) for k in range(30)] + [(3000, None), (3001, ""), (3002, "…"), (3003, "W1 w1, W2! " * 4000)]
    questions = [(k, " ".join(rnd.choices(words, weights, k=12))) for k in range(12)] + [(20, docs[5][1]), (21, "w0 w1 w2"), (22, "nothing known"), (23, ""), (24, None), (25, docs[7][1]), (26, "w399 w0")]
    return docs, questions


@pytest.mark.parametrize("k", [1, 5, 40, 1000])
def test_best_against_all_pairs(spark, corpus, k):
    docs, questions = corpus
    index = T.build(spark.createDataFrame(docs, DOCS).repartition(6))
    rows = T.Search(index, spark.createDataFrame(questions, ASKED)).best(k).collect()
    got = {(r["question_id"], r["rank"]): (r["doc_id"], round(r["score"], 6)) for r in rows}
    assert got == {key: (d, pytest.approx(s, abs=2e-6)) for key, (d, s) in plain_best(plain_scores(docs, questions), k).items()}


def test_scores_and_ranks_of_given_pairs(spark, corpus):
    docs, questions = corpus
    scores = plain_scores(docs, questions)
    search = T.Search(T.build(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(questions, ASKED))
    rnd = random.Random(1)
    pairs = [(q, rnd.choice(docs)[0]) for q, _ in questions for _ in range(4)] + [(22, 0), (77, 0)]
    held = spark.createDataFrame(pairs, "question_id bigint, doc_id bigint")
    got = {(r["question_id"], r["doc_id"]): r["score"] for r in search.scores_of(held).collect()}
    assert got == {p: pytest.approx(scores[p]) for p in set(pairs) if scores[p] > 0}
    whole = plain_best(scores, 10**6)
    place = {(q, d): r for (q, r), (d, _) in whole.items()}
    want = {}
    for q, d in set(pairs):
        n, first = want.get(q, (0, None))
        rank = place.get((q, d))
        want[q] = (n + 1, min(x for x in (first, rank) if x is not None) if (first, rank) != (None, None) else None)
    assert {r["question_id"]: (r["containing"], r["rank"]) for r in search.ranks(held).collect()} == want


def test_few_postings_are_read(spark):
    """Common words bring no candidates: a small part of what shares a term is scored."""
    rnd = random.Random(9)
    docs = [(k, " ".join(rnd.choices(["the", "of", "and", "to", "in"], k=30) + [f"r{rnd.randint(0, 600)}" for _ in range(6)])) for k in range(2000)]
    questions = [(k, docs[k * 90][1]) for k in range(20)]
    search = T.Search(T.build(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(questions, ASKED))
    work = search.work(5).first()
    assert (work["read_first"] + work["read_leading"]) * 10 < work["all_postings"]
    assert len(search.best(5).collect()) == 100


def test_blocks_hold_what_they_say(spark, corpus):
    docs = spark.createDataFrame(corpus[0], DOCS)
    blocks = T.postings(docs, 4)
    assert [c for c in blocks.columns] == ["bucket", "term", "block", "n", "most_tf", "least_length", "ids", "tfs", "sizes"]
    for r in blocks.collect():
        assert r["n"] == len(r["ids"]) <= 1 << T.BLOCK_BITS and r["most_tf"] == max(r["tfs"]) and r["least_length"] == min(r["sizes"]) and r["ids"] == sorted(r["ids"])
        assert all(i >> T.BLOCK_BITS == r["block"] for i in r["ids"]) and 0 <= r["bucket"] < 4
    each = {(r["term"], r["doc_id"], r["tf"]) for r in blocks.select("term", T.each_posting()).collect()}
    assert each == {(t, d, n) for d, text in corpus[0] for t, n in Counter(re.findall("[a-z0-9]+", (text or "").lower())).items()}


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    search = T.Search(T.build(empty), spark.createDataFrame([(1, "w1")], ASKED))
    assert search.best(3).collect() == [] and search.ranks(spark.createDataFrame([], "question_id bigint, doc_id bigint")).collect() == []


def test_terms_of_texts_end_with_them():
    import pyarrow as pa

    texts = ["ab c1", "d", None, "", "é-xy", "z", "straße K9…q"]
    terms, owner = T.terms_of(pa.array(["cut off", *texts]).slice(1))
    assert list(zip(terms.to_pylist(), owner.tolist(), strict=True)) == [(t, k) for k, x in enumerate(texts) for t in re.findall("[a-z0-9]+", x or "")]


def test_texts_are_counted_in_slices(spark, corpus, monkeypatch):
    """A block that is cut by a slice keeps all its postings; of needed terms only these."""
    import pyarrow as pa

    monkeypatch.setattr(T, "SLICE", 300)
    docs = [(d, t and t.lower()) for d, t in corpus[0]]
    rows = pa.RecordBatch.from_arrays([pa.array([d >> T.BLOCK_BITS for d, _ in docs]), pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], names=["block", "doc_id", "text"])
    parts = list(T.sliced(rows))
    assert len(parts) > 20 and sum(p.num_rows for p in parts) == len(docs)
    every = {(t, d, n) for d, text in docs for t, n in Counter(re.findall("[a-z0-9]+", text or "")).items()}
    for needed in (None, {"w0", "w3", "w399"}):
        made = [r for p in parts for r in T.blocks_of(p, needed and pa.array(sorted(needed))).to_pylist()]
        assert {(r["term"], d, n) for r in made for d, n in zip(r["ids"], r["tfs"], strict=True)} == {x for x in every if not needed or x[0] in needed}


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_best_by_all_pairs(spark, corpus, k):
    docs, questions = [(d, t) for d, t in corpus[0] if t is not None], corpus[1]
    rows = L.best_lexical(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(questions, ASKED), k).collect()
    got = {(r["question_id"], r["rank"]): (r["doc_id"], round(r["score"], 6)) for r in rows}
    assert got == {key: (d, pytest.approx(s, abs=2e-6)) for key, (d, s) in plain_best(plain_scores(docs, questions), k).items()}


def test_phrases_by_the_index(spark):
    texts = ["The quick-brown fox\tjumps over", "a quick-brown foxes", "xthe QUICK-brown fox jumps", "… — … and é à ü", None, "", "brown"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    asked = [(0, "the quick-brown fox"), (1, "he  quick-brown\nfox"), (1, "and é à"), (2, "… — …"), (3, "brown"), (4, "a none b"), (5, None), (6, "quick-brown quick b"), (0, "The Quick-Brown fox")]
    cases = spark.createDataFrame(asked, "item_id bigint, text string")
    index = T.build(docs, needed=L.asked_terms(cases.withColumnRenamed("item_id", "question_id")))
    pairs = lambda df: sorted((r["item_id"], r["doc_id"]) for r in df.collect())
    got = pairs(L.containment_indexed(docs, cases, index))
    assert got == pairs(L.containment(docs, cases)) and (1, 2) in got and (2, 3) in got and (0, 1) not in got


def test_many_phrases(spark):
    rnd = random.Random(2)
    docs = [(k, " ".join(f"v{rnd.randint(0, 3000)}" for _ in range(60))) for k in range(50)]
    cases = [(k, f"{docs[k % 50][1][k % 200 : k % 200 + 24]}" if k % 3 else f"none v{k} such") for k in range(20_000)] + [(-1, None), (-2, "v1"), (-3, " ")]
    got = {(r["item_id"], r["doc_id"]) for r in L.containment(spark.createDataFrame(docs, DOCS), spark.createDataFrame(cases, "item_id bigint, text string")).collect()}
    form = lambda t: " ".join(t.lower().split())
    hay = {d: form(t) for d, t in docs}
    assert got == {(i, d) for i, t in cases if t is not None for d in hay if form(t) in hay[d]}
