"""Page geometry, markers in pieces, uploads, and the ingestion stream."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import jobs as J
from lectern.operators import layout as Y
from lectern.operators import uploads as U
from lectern.streaming import ingest, markers


def words(rows, page=1, doc=1, pages=1):
    out = []
    for top, size, parts in rows:
        for x, text in parts:
            out.append((doc, page, 600.0, 800.0, pages, text, float(x), float(x + 5 * len(text)), float(top), float(top + size), float(size), "Serif"))
    return out


COLUMNS = "doc_id bigint, page int, page_width double, page_height double, page_count int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string"


def two_columns(n=8):
    rows = [(40, 16, [(150, "A title that is centred and wide across it")])]
    rows += [(100 + 14 * k, 10, [(54, f"left line number {k} is quite full here"), (320, f"right line number {k} is full as well")]) for k in range(n)]
    return rows


def test_columns_are_read_in_turn():
    page = pd.DataFrame(words(two_columns()), columns=[c.split()[0] for c in COLUMNS.split(", ")])
    lines = [x[0] for x in Y.ordered(Y.rows_of(page), 600.0)]
    assert lines[0].startswith("A title")
    assert lines[1:9] == [f"left line number {k} is quite full here" for k in range(8)] and lines[9].startswith("right line number 0")


def test_few_rows_have_no_gutter():
    page = pd.DataFrame(words(two_columns(3)), columns=[c.split()[0] for c in COLUMNS.split(", ")])
    assert Y.gutter_of(Y.rows_of(page), 600.0) is None


def test_pages_to_groups(spark):
    rows = []
    for p in range(1, 5):
        head = [(30, 9, [(54, f"Journal of Things {p}")])]
        body = [(100, 13, [(54, "1. Heading")])] if p == 1 else []
        body += [(120 + 12 * k, 9.5, [(54, "plain words that fill the measure of the column quite well")]) for k in range(9)]
        body += [(120 + 12 * 9, 9.5, [(54, "and so to an end.")])]
        rows += words(head + body, p, 1, 4)
    found = Y.read_pages(spark.createDataFrame(rows, COLUMNS)).orderBy("group").collect()
    assert found[0]["text"] == "1. Heading" and found[0]["level"] == 1
    assert not any("Journal" in r["text"] for r in found)
    assert [r["level"] for r in found[1:]] == [None] * 4


def streamed(deltas, sources):
    shown, held, cited = "", "", set()
    for d in deltas:
        text, held, new = markers.scan(held + d, sources)
        shown, cited = shown + text, cited | new
    return shown, sorted(cited)


@pytest.mark.parametrize(
    ("text", "n", "out", "used"),
    [
        ("[1 [2] [,1] [1,] [1 2] [ 3 ]x", 3, "[1 [2] [,1] [1,] [1 2] [3]x", [2, 3]), ("[[1]]", 1, "[[1]]", [1]), ("[1]\n[1 ,\t2]", 2, "[1]\n[1][2]", [1, 2]),
        ("a [1] b", 2, "a [1] b", [1]), ("a [9]", 2, "a ", []), ("[0]", 2, "", []), ("x [1, 2]", 2, "x [1][2]", [1, 2]), ("x [1, 7]", 2, "x [1]", [1]),
        ("[sic] [1][1]", 1, "[sic] [1][1]", [1]), ("tail [1", 2, "tail ", []), ("[1]", 0, "", []), ("", 1, "", []),
    ],
)
def test_markers_whole_and_torn(text, n, out, used):
    for size in (1, 2, 3, 100):
        assert streamed([text[k : k + size] for k in range(0, len(text), size)], n) == (out, used)


def test_marker_stream_with_state(spark, tmp_path):
    rnd = random.Random(5)
    text = "".join(rnd.choice(["word ", "[1]", "[2, 9]", "[", "] "]) for _ in range(60))
    cut = [(1, k // 5, text[k : k + 5], 3, k + 5 >= len(text)) for k in range(0, len(text), 5)]
    schema = "conv_id bigint, seq int, delta string, n_sources int, last boolean"
    half = len(cut) // 2
    for k, part in enumerate((cut[:half], cut[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = markers.filter_stream(stream, idle=None).writeStream.format("memory").queryName("safe").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("safe").orderBy("done").collect()
    shown, used = streamed([text], 3)
    assert "".join(r["text"] for r in got) == shown and got[-1]["used"] == used
    whole = markers.filter_deltas(spark.createDataFrame(cut, schema)).first()
    assert (whole["text"], whole["used"]) == (shown, used)


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_out_of_order_over_batches(spark, tmp_path, seed):
    """Any cut into batches, any order and pieces sent twice give the whole result."""
    rnd = random.Random(seed)
    schema = "conv_id bigint, seq int, delta string, n_sources int, last boolean"
    want, rows = {}, []
    for c in range(6):
        text = "".join(rnd.choice(["word ", "[1]", "[2, 9]", "[", "] "]) for _ in range(30)) + "."
        want[c] = streamed([text], 3)
        rows += [(c, k // 4, text[k : k + 4], 3, k + 4 >= len(text)) for k in range(0, len(text), 4)]
    for c in range(3):  # the last piece comes last, as the state of a finished conversation is gone
        rows += rnd.sample([r for r in rows if r[0] == c and not r[4]], 5)
    late = [r for r in rows if r[4]]
    early = [r for r in rows if not r[4]]
    rnd.shuffle(early)
    for k, part in enumerate((early[::3], early[1::3], early[2::3], late)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    name = f"turns{seed}"
    q = markers.filter_stream(stream, idle=None).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batches = {}
    for r in spark.table(name).collect():
        batches.setdefault(r["conv_id"], []).append(r)
    for c, (text, used) in want.items():
        # rows come in no order, but each batch adds to what is shown: the texts fit together in one way
        parts = sorted(batches[c], key=lambda r: (r["done"], len(r["used"])))
        assert sum(len(r["text"]) for r in parts) == len(text) and parts[-1]["done"] and parts[-1]["used"] == used
    once = spark.createDataFrame(sorted(set(rows)), schema)
    assert {r["conv_id"]: (r["text"], r["used"]) for r in markers.filter_pieces(once).collect()} == want


def test_pieces_wait_for_those_before():
    waiting: dict = {}
    assert markers.in_turn(0, waiting, [(2, "c"), (0, "a")], False) == ([(0, "a")], 1)
    assert markers.in_turn(1, waiting, [(1, "b"), (0, "again"), (5, "f")], False) == ([(1, "b"), (2, "c")], 3)
    assert markers.in_turn(3, waiting, [], True) == ([(5, "f")], 6) and waiting == {}


def test_the_text_of_the_newer_file_counts(spark, tmp_path):
    import os

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for k, text in enumerate(("Z old.", "A new.")):
        place = tmp_path / f"{k}"
        spark.createDataFrame([(1, text)], "doc_id bigint, text string").coalesce(1).write.parquet(str(place))
        os.makedirs(source, exist_ok=True)
        part = next(place.glob("*.parquet"))
        os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
        part.rename(f"{source}/{k}.parquet")
    ingest.run(spark, source, target, str(tmp_path / "c")).awaitTermination(120)
    assert [r["text"] for r in ingest.passages(spark, target).collect()] == ["A new."]


def test_idle_conversations_are_flushed(spark, tmp_path):
    schema = "conv_id bigint, seq int, delta string, n_sources int, last boolean"
    source = tmp_path / "in"
    spark.createDataFrame([(7, 0, "see [1] and [2", 2, False)], schema).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = markers.filter_stream(stream, "1 second").writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    for k in range(40):
        if spark.table("idle").where("done").count():
            break
        spark.createDataFrame([(8, k, ".", 2, False)], schema).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(1)
    q.stop()
    got = [r.asDict() for r in spark.table("idle").where("conv_id = 7").collect()]
    assert "".join(r["text"] for r in got) == "see [1] and " and [r["done"] for r in got][-1] and got[-1]["used"] == [1]


def test_long_open_brackets_are_released():
    text = "a [" + "1, " * 20
    assert markers.scan(text, 3) == (text, "", set()) and markers.scan("a [" + "1" * 31, 3) == ("a ", "[" + "1" * 31, set())


def test_sniff_and_decode(spark):
    rows = [(1, b"%PDF-1.7", "a.txt"), (2, b"hi", "A.MD"), (3, b"\x00\x01", "a.txt"), (4, b"", "a.txt"), (5, "café au lait".encode("latin-1"), "x"), (6, "é".encode() * 5000, "x"), (7, b"text 2\x55\x04D2D", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, content binary, name string")
    got = {r["doc_id"]: r["k"] for r in df.select("doc_id", U.sniff(F.col("content"), F.col("name")).alias("k")).collect()}
    assert got == {1: "application/pdf", 2: "text/markdown", 3: None, 4: None, 5: None, 6: "text/plain", 7: "text/plain"}
    text = {r["doc_id"]: (r["text"], r["error"]) for r in U.decoded(df).collect()}
    assert text[5] == ("café au lait", None) and text[3] == (None, "binary")


def test_ingestion_is_idempotent(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "One sentence. Two sentences."), (2, "Other.\n\nText.")], "doc_id bigint, text string").write.parquet(source)
    for _ in range(2):  # the second start finds nothing new
        ingest.run(spark, source, target, str(tmp_path / "c")).awaitTermination(120)
    got = ingest.passages(spark, target)
    assert got.count() == 2 and got.select("chunk_id").distinct().count() == 2


def test_a_later_batch_replaces_a_document(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "c"))
    for rows in ([(1, "First text."), (2, "Other text.")], [(1, "Second text.")], [(2, "")], [(3, "Third."), (3, "A third.")]):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(source)
        ingest.run(spark, source, target, state).awaitTermination(120)
    got = sorted((r["document_id"], r["text"]) for r in ingest.passages(spark, target).collect())
    assert got == [(1, "Second text."), (3, "Third.")]


def test_commit_refuses_a_chunk_without_a_vector(spark):
    docs = spark.createDataFrame([(1, "processing", 0.5, None, 3, 1, None)], "document_id bigint, status string, progress double, error_message string, chunk_count bigint, page_count bigint, indexed_at timestamp_ntz")
    jobs = spark.createDataFrame([(5, 1, "running", None, None)], "id bigint, document_id bigint, state string, last_error string, locked_at timestamp_ntz")
    chunks = spark.createDataFrame([(1, 0, [1.0])], "document_id bigint, ordinal bigint, embedding array<double>")
    runs = spark.createDataFrame([(5, 1, 2)], "id bigint, document_id bigint, page_count bigint")
    with pytest.raises(Exception, match="must have a vector"):
        J.commit(docs, jobs, chunks, runs, chunks.withColumn("embedding", F.lit(None).cast("array<double>")), "2024-01-01 00:00:00")[2].collect()
    for _ in range(2):  # a job that runs twice leaves what one run leaves
        docs, jobs, chunks = J.commit(docs, jobs, chunks, runs, chunks.limit(0).unionByName(chunks.sparkSession.createDataFrame([(1, 0, [0.5]), (1, 1, [0.5])], chunks.schema)), "2024-01-01 00:00:00")
    assert sorted(r["ordinal"] for r in chunks.collect()) == [0, 1] and docs.first()["chunk_count"] == 2 and jobs.first()["state"] == "done"


def test_plans(spark):
    from lectern.plans import QUERIES

    explain = lambda n: QUERIES[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    topk, batch, page = explain("retrieve_topk"), explain("retrieve_batch"), explain("keyset_page")
    assert topk.count("TakeOrderedAndProject") == 2 and "WindowGroupLimit" in topk and "CartesianProduct" not in topk
    assert "WindowGroupLimit" in batch and "CartesianProduct" not in batch and "NestedLoop" not in batch
    assert "PushedFilters" in page and "TakeOrderedAndProject" in page


def test_tenants_stay_apart(spark):
    from lectern.plans import retrieval

    got = retrieval.batch(spark, "/root/testdata/sf0.001").where((F.col("document_id") % 2) != F.col("tenant"))
    assert got.count() == 0


def test_poll_loop_takes_what_comes(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id bigint, text string"
    spark.createDataFrame([(1, "First.")], schema).write.parquet(source)
    q = ingest.run(spark, source, target, str(tmp_path / "c"), trigger={"processingTime": "500 milliseconds"})
    try:
        for rows, wanted in (([(2, "Second.")], 2), ([(1, "Again.")], 2)):
            spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
            q.processAllAvailable()
            assert ingest.passages(spark, target).count() == wanted
    finally:
        q.stop()
    assert {r["text"] for r in ingest.passages(spark, target).collect()} == {"Again.", "Second."}


def test_vectors_do_not_leak_and_are_not_read(spark):
    from lectern.plans import QUERIES

    for name in ("chunk_summary", "chunk_page", "neighbours", "citations", "render_source", "retrieve_topk"):
        assert "embedding" not in QUERIES[name](spark, "/root/testdata/sf0.001").columns
    plan = QUERIES["chunk_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "embedding" not in plan


def test_no_nested_loop_over_documents(spark):
    from lectern.plans import QUERIES

    for name in ("quality_containment", "paragraph_breaks", "heading_levels"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_quality_floors(spark):
    """Four questions that quote a passage: none is split, and the passage is found near the top."""
    from lectern.operators import lexical as L
    from lectern.operators import passages as P

    rnd = random.Random(2)
    filler = lambda k: " ".join(rnd.choice(["the", "method", "sample", "result", "table", "study", "of", "a", "shows", "values"]) + ("." if i % 9 == 8 else "") for i in range(k))
    phrases = ["mean reciprocal rank rises with the overlap of passages", "a worker that dies is replaced after fifteen minutes", "gutters are found by counting ink in every column", "vectors of unit length make a product a cosine"]
    text = "\n\n".join(f"{filler(120)}\n\n{p.capitalize()}. {filler(60)}" for p in phrases)
    made = P.chunk(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), how=P.Chunking(96, 12, 8)).select(F.col("ordinal").cast("long").alias("doc_id"), "text")
    cases = spark.createDataFrame([(k, p) for k, p in enumerate(phrases)], "item_id bigint, text string")
    got = L.quality_report(L.quality_ranks(made, cases)).first()
    assert made.count() > 8 and got["coverage"] == 1.0 and got["hit_at_1"] >= 0.75 and got["hit_at_3"] == 1.0 and got["mrr"] >= 0.8
    none = L.quality_report(L.quality_ranks(made, spark.createDataFrame([(9, "words that no passage holds")], "item_id bigint, text string"))).first()
    assert none["coverage"] == 0.0 and none["mrr"] == 0.0


def test_sentence_boundaries():
    text = 'He met Dr. Smith, J. Doe and others, e.g. Ann. "Quite so!" They left. then came two of it? Yes. 3 more'
    from lectern.operators import passages as P

    assert [text[a:b] for a, b in P.sentences(text, 0, len(text))] == ["He met Dr. Smith, J. Doe and others, e.g. Ann.", '"Quite so!"', "They left. then came two of it?", "Yes.", "3 more"]


def test_sniff_takes_a_head_cut_through_a_character_anywhere(spark):
    # two signs are cut: one by the end of the head, and one by an end four bytes before it
    texts = ["a" * pad + "é€😀"[k] * 5000 for k in range(3) for pad in range(4)]
    mark = b"\x02\x55\x04\x44\x62\xd0 %PDF-1.7"  # the digits of the mark between two bytes, then the mark
    rows = [(k, bytearray(t.encode())) for k, t in enumerate(texts)] + [(99, bytearray(mark)), (100, bytearray(b"\xff" + b"a" * 9000))]
    df = spark.createDataFrame(rows, "id int, content binary")
    got = {r["id"]: r["k"] for r in df.select("id", U.sniff(F.col("content"), F.lit("a.txt")).alias("k")).collect()}
    assert got == {k: "text/plain" for k in range(len(texts))} | {99: "application/pdf", 100: None}
