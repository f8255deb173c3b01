"""Vector codes against plain Lloyd rounds, line dedup against plain Python; odd rows, ties, names, plans."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import heavy, line_dedup, vector_codes
from lectern.llm.vector_codes import Codebook, first_bounds, reassigned

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain_codes(rows, entries=256, rounds=4):
    """{vec_id: (code, error, label_error, sha)} by taking every distance."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    x = np.floor(np.array([r[1] for r in rows], np.float64) * 1024).astype(np.int64)
    at = [x.shape[1] * p // 4 for p in range(5)]
    books = [x[:entries, a:b].copy() for a, b in zip(at, at[1:], strict=False)]
    square = lambda p: ((x[:, None, at[p] : at[p + 1]] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(4):
            near = square(p).argmin(axis=1)
            for e in set(near.tolist()):
                books[p][e] = x[near == e, at[p] : at[p + 1]].sum(axis=0) // (near == e).sum()
    every = [square(p) for p in range(4)]
    error = sum(s.min(axis=1) for s in every)
    by_label = collections.Counter()
    for r, e in zip(rows, error.tolist(), strict=True):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    codes = zip(*[s.argmin(axis=1).tolist() for s in every], strict=True)
    return {r[0]: ("".join(f"{c:02x}" for c in code), e, by_label[r[2]], sha) for r, code, e in zip(rows, codes, error.tolist(), strict=True)}


def coded(df, **how):
    return {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.vector_codes(df, **how).collect()}


def test_bounds_never_pass_over_the_nearest():
    rng = np.random.default_rng(3)
    taken = 0
    for unit, size in ((1.0, 40), (1.0, 2000), (7.5, 2000), (1e6, 2**26)):
        x = rng.integers(-size, size, (300, 6))
        x[:100] = x[0]  # copies, and so ties
        entries = x[rng.permutation(300)[:32]].copy()
        entries[5] = entries[3]
        book = Codebook(entries, unit)
        own, square, lower = first_bounds(x, book)
        upper = book.upper(square)
        for _ in range(4):
            moved = np.where(rng.random((32, 1)) < 0.5, 0, rng.integers(-max(1, size // 50), max(2, size // 50), entries.shape))
            old, entries = entries, entries + moved
            book = Codebook(entries, unit)
            shift = book.moved(old)
            own, square, lower, n = reassigned(x, own, upper + shift[own], np.maximum(lower.astype(np.int64) - shift, 0).astype(np.uint16), book)
            upper = book.upper(square)
            every = np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)
            assert (own == every.argmin(axis=1)).all() and (square == every.min(axis=1)).all()
            assert (lower * unit <= np.sqrt(every.astype(float))).all() and (upper * unit >= np.sqrt(square.astype(float))).all()
            taken += n
    assert 0 < taken < 4 * 4 * 300 * 31 // 2  # most distances are passed over


@pytest.mark.parametrize("dim,entries", [(8, 256), (8, 16), (10, 16), (64, 32)])
def test_codes_against_plain_rounds(spark, dim, entries):
    rng = np.random.default_rng(dim)
    middles = rng.normal(size=(9, dim)).astype(np.float32)
    rows = [(k, (middles[k % 9] + rng.normal(size=dim).astype(np.float32) * np.float32(0.2)).tolist(), None if k % 7 == 0 else 1 if k % 3 else k % 5) for k in range(0, 900, 3)]
    rows += [(k, rows[4][1], 1) for k in range(1000, 1040)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert coded(df, entries=entries) == plain_codes(rows, entries)


def test_codes_of_odd_rows(spark):
    good = [(k, [0.001 * k, -0.5, 0.25, 1.0], k % 2) for k in range(20)]
    bad = [(100, None, 1), (101, [float("nan"), 1.0, 1.0, 1.0], 1), (102, [float("inf"), 0.0, 0.0, 0.0], None), (103, [None, 1.0, 2.0, 3.0], 1), (104, [1.0, 2.0], 1), (105, [], 1)]
    df = spark.createDataFrame(good + bad, VECTORS).withColumns({"code": F.lit("clash"), "x": F.lit(1), "Own": F.lit(2), "rows": F.lit(3), "part": F.lit(None).cast("int")})
    assert coded(df) == plain_codes(good)
    assert coded(df.limit(0)) == {} and coded(df.where("vec_id >= 100 and vec_id < 104")) == {}
    twice = vector_codes.vector_codes(spark.createDataFrame([*good, good[3], (None, good[3][1], None)], VECTORS)).collect()
    assert len(twice) == 22 and len({r["code"] for r in twice if r["vec_id"] in (3, None)}) == 1
    huge = vector_codes.vector_codes(spark.createDataFrame([(1, [3e38, -3e38, 0.0, 1.0], 1), (2, [-3e38, 3e38, 0.0, 1.0], 1), *good], VECTORS)).collect()
    assert len(huge) == 20 + 2 and all(r["error"] >= 0 for r in huge)


def plain_lines(rows, least_chars=40, least_docs=5):
    table = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    key = lambda line: line.strip(line_dedup.BLANKS).translate(table)
    held = collections.defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars and doc_id is not None:
                held[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < least_docs or max(held[key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_against_plain_python(spark):
    license_, wide = "Licensed under the terms of the Public Example License", "é" * 39 + "日"
    rng = np.random.default_rng(5)
    rows = [(None, None), (1, None), (2, ""), (3, "\n\n"), (None, f"x\n{license_}"), (4, "\r\n" + "short\n" * 9)]
    rows += [(k, f"own line {k}\n \t{license_.upper()}\x0b\n{wide}\nend{k}\n{license_}") for k in range(10, 30)]
    rows += [(30, f"{license_} "), (31, license_[:39]), (10, "another text of document ten"), rows[8]]
    rows += [(k, "\n".join(f"line number {v} is long enough to be counted as one" for v in rng.integers(0, 60, 12))) for k in range(40, 70)]
    rows += [(70, "\n".join([license_] * 300 + ["z"] * 5)), (71, "y" * 100_000 + "\n" + wide), (72, "\n".join(f"row {v}\n{license_}" for v in range(40_000)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"line": F.lit("clash"), "H1": F.lit(1), "keep": F.lit(2), "n_lines": F.lit(None).cast("int"), "of": F.lit(0)})
    bitmaps = line_dedup.keep_bitmaps(df)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.with_kept_text(df, bitmaps).collect()), key=str)
    assert got == plain_lines(rows)
    assert all(r["n_dropped"] > 0 for r in bitmaps.collect())
    empty = df.limit(0)
    assert line_dedup.with_kept_text(empty, line_dedup.keep_bitmaps(empty)).collect() == []


def test_bitmaps_are_read_back(spark):
    rows = [(300, [0, 1, 2, 299]), (10, [0]), (10, list(range(10))), (70_000, [69_999, 5, 6]), (255, [254])]
    df = spark.createDataFrame([(n, sorted(d)) for n, d in rows], "n int, dropped array<int>")
    keep = df.select("n", "dropped", line_dedup.packed(line_dedup.borders_of(F.col("dropped")), F.col("n")).alias("keep"))
    for r in keep.select("n", "dropped", F.length("keep").alias("size"), line_dedup.unpacked(F.col("keep")).alias("edges")).collect():
        edges = r["edges"]
        assert [x for a, b in zip(edges[::2], edges[1::2], strict=True) for x in range(a, b)] == r["dropped"]
        assert r["size"] == 1 + len(edges) * (1 if r["n"] < 256 else 2 if r["n"] < 65536 else 4)


def test_plan_of_first_occurrences_and_no_python(spark):
    docs = spark.createDataFrame([(k, "a line that is long enough to be one of those counted here") for k in range(9)], "doc_id bigint, text string")
    plan = line_dedup.repeated_lines(line_dedup.long_lines(docs, 40))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(") == 1 and plan.count("hashpartitioning(") == 1
    whole = line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan + whole for word in ("Python", "Pandas", "ArrowEval", "MapInArrow", "Cartesian", "NestedLoop"))


def test_facts_of_heavy_and_light_keys(spark):
    rows = spark.createDataFrame([(k, None if k % 10 == 0 else "hot" if k % 3 else f"k{k}") for k in range(3000)], "id bigint, key string")
    facts = heavy.stored(rows.groupBy("key").agg(F.count("*").alias("n")))
    for most in (heavy.MOST_HEAVY, 4):
        old, heavy.MOST_HEAVY = heavy.MOST_HEAVY, most
        got = {r["id"]: r["n"] for r in heavy.with_facts(rows, facts, ["key"], "n", ["id"]).collect()}
        heavy.MOST_HEAVY = old
        want = collections.Counter(r["key"] for r in rows.collect())
        assert got == {r["id"]: want[r["key"]] for r in rows.collect()}
