"""Quality rules with repetition found by a suffix array of each text's words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import column_of, records, slices, tidied

SYMBOLS = "#*$%&|<>"
GAPS = " \t\n\v\f\r"
WINDOW = 5
NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")
SCHEMA = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in NUMBERS)])


def suffix_ranks(tokens: np.ndarray, ends: np.ndarray, group: np.ndarray, longest: int | None = None) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... tokens, until all differ.

    With ``longest`` (a power of two) at most that many tokens are compared.

    ``ends`` holds for each position the end of its text; ``group`` orders texts before
    tokens, so suffixes of different texts never tie. A rank is the number of smaller
    suffixes, and only tied suffixes are sorted again at the next length.
    """
    n = len(tokens)
    key = group.astype(np.int64) * (int(tokens.max()) + 1 if n else 1) + tokens
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, length = [rank], 1
    tied = order[~new | ~np.append(new[1:], True)]
    while len(tied) and length != longest:
        ahead = tied + length
        inside = ahead < ends[tied]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        first = rank[tied]
        order = np.lexsort((second, first))
        tied, first, second = tied[order], first[order], second[order]
        heads = np.concatenate([[True], first[1:] != first[:-1]])
        new = heads | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(tied))
        rank = rank.copy()
        rank[tied] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(heads, at, 0))
        levels.append(rank)
        length *= 2
        tied = tied[~new | ~np.append(new[1:], True)]
    return levels


def longest_repeats(tokens: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
    """At each position the length of the longest run of tokens from there that the text has elsewhere too.

    The longest common prefixes of neighbours in the suffix array are built up from the
    ranks of all lengths; the larger of a suffix's two is the bound of the widest interval
    it is in.
    """
    n = len(tokens)
    if n < 2:
        return np.zeros(n, np.int64)
    levels = suffix_ranks(tokens, ends, group)
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        x, y = a + common, b + common
        ok = (x < ends[a]) & (y < ends[b])
        ok[ok] = rank[x[ok]] == rank[y[ok]]
        common[ok] += 1 << k
    out = np.zeros(n, np.int64)
    out[a] = common
    out[b] = np.maximum(out[b], common)
    return out


def union_sizes(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    turns = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(turns)[:n] > 0


def measure(texts: list, least_repeat: int) -> np.ndarray:
    """The NUMBERS of each text, in rows."""
    out = np.zeros((len(texts), len(NUMBERS)), np.int64)
    ids: dict[bytes, int] = {}
    streams = []
    for i, t in enumerate(texts):
        t = t or ""
        words = t.encode("utf-8", "surrogatepass").split()
        streams.append(np.array([ids.setdefault(w, len(ids)) for w in words], np.int64))
        out[i, 0] = len(words)
        out[i, 1] = len(t) - sum(map(t.count, GAPS))
        out[i, 2] = sum(map(t.count, SYMBOLS))
        lines = t.split("\n")
        if len(set(lines)) < len(lines):
            full = [x for x in lines if x.strip(GAPS)]
            out[i, 3] = len(full) - len(set(full))
    sizes = out[:, 0]
    tokens = np.concatenate(streams) if streams else np.empty(0, np.int64)
    n = len(tokens)
    if n:
        owner = np.repeat(np.arange(len(texts)), sizes)
        ends = np.repeat(np.cumsum(sizes), sizes)
        reach = longest_repeats(tokens, ends, owner)
        windows = np.flatnonzero(reach >= WINDOW)
        out[:, 4] = np.bincount(owner, weights=union_sizes(windows, np.full(len(windows), WINDOW), n), minlength=len(texts))
        long = np.flatnonzero(reach >= least_repeat)
        out[:, 5] = np.bincount(owner, weights=union_sizes(long, reach[long], n), minlength=len(texts))
        np.maximum.at(out[:, 6], owner, reach)
    return out


def repetition_rules(docs: DataFrame, least_repeat: int = 10, most_covered: float = 0.2, most_repeat: int = 50) -> DataFrame:
    """Base counts and the verdict on each row of ``docs`` (doc_id, text).

    Returns doc_id, the NUMBERS, base_failed and kept. Words are runs without ASCII white
    space; a null or empty text has none and fails the base. A text that passes the base is
    kept if its repeated runs of at least ``least_repeat`` words cover no more than the
    share ``most_covered`` of its words and none is longer than ``most_repeat`` words.
    Repeated rows and null ids are judged like any other; an empty table gives an empty
    result; other columns are ignored, whatever their names. No shuffle; a worker holds one
    slice of about a million bytes, or one text.
    """

    @tidied
    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, "text", 1_000_000):
                yield records([column_of(rows, "doc_id"), *measure(texts, least_repeat).T], SCHEMA)

    found = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, ", ".join(f"{f.name} bigint" for f in SCHEMA))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = (F.col("n_covered") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= most_repeat)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
