"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import column_of, durable, records, slices, tidied, unit_hash
from lectern.llm.lang_id import grams, mix, symbols

BITS = 20
ORDERS = (3, 4, 5, 6)
TALLY = pa.schema([("bucket", pa.int32()), ("with_1", pa.int64()), ("with_0", pa.int64())])
ROWS = pa.schema([("label", pa.int32()), ("found", pa.list_(pa.int32()))])
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def buckets(texts: list):
    """For each order the text and the hash bucket of every n-gram that ends on a counted symbol.

    Letters are in lower case and whatever is between words is one space.
    """
    s, counts, owner = symbols(texts)
    g = grams(s)
    of = owner[counts]
    for n in ORDERS:
        key = g & np.uint64((1 << 16 * n) - 1) if n < 4 else g.copy()
        if n > 4:
            key = mix(key)
            for k in range(4, n):
                key[k:] = mix(key[k:] + s[:-k].astype(np.uint64) + np.uint64(n))
        yield of, (mix(key[counts] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)


def presence(texts: list, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, feature), each once. ``table`` maps buckets to features, others to -1."""
    found = []
    for of, bucket in buckets(texts):
        if table is not None:
            bucket = table[bucket]
            known = bucket >= 0
            of, bucket = of[known], bucket[known].astype(np.int64)
        found.append(np.unique(of << BITS | bucket))
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class ToxicityModel:
    table: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list) -> np.ndarray:
        of, feature = presence(texts, self.table)
        margin = np.bincount(of, weights=self.weights[feature], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(of: np.ndarray, feature: np.ndarray, y: np.ndarray, ratio: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 2.0) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features scaled by their ratios; weights and bias.

    ``decay`` is the strength of the squared penalty on the scaled weights, over all rows.
    """
    n, size = len(y), len(ratio)
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    w, b = np.zeros(size), float(np.log(base / (1 - base)))
    if not n or y.min() == y.max():
        return w, b
    m1, m2 = np.zeros(size + 1), np.zeros(size + 1)
    x = ratio[feature]
    for t in range(1, steps + 1):
        f = np.bincount(of, weights=x * w[feature], minlength=n) + b
        e = (1 / (1 + np.exp(-np.clip(f, -30, 30))) - y) / n
        g = np.append(np.bincount(feature, weights=x * e[of], minlength=size) + decay * w / n, e.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w * ratio, float(b)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, most_features: int = 1 << 12, least_texts: int = 3) -> ToxicityModel:
    """Learn from ``labels`` (doc_id, label) and the texts of ``docs`` (doc_id, text).

    Takes at most ``most_rows`` labels, chosen by a hash of the id, with their whole texts;
    the ``most_features`` n-grams that tell the classes apart best, of those in at least
    ``least_texts`` texts; in folds of rows that may be learned from, four times as many
    found fewer toxic texts. These bounds fix the size of what is broadcast and of what
    reaches the driver. Rows with nulls teach nothing; a label given twice counts once;
    without labels or texts all scores are equal. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null and label is not null").dropDuplicates(["doc_id"]).orderBy(unit_hash(F.col("doc_id"), "toxicity"), "doc_id").limit(most_rows)
    chosen = spark.createDataFrame([(r["doc_id"], int(r["label"])) for r in chosen.collect()], "doc_id bigint, label int")
    rows = docs.where("text is not null").selectExpr("cast(doc_id as bigint) as doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    rows = durable(rows.repartition(max(1, most_rows // 1000)))  # about a thousand texts a task
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)

    @tidied
    def tally(batches):
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for part, texts in slices(batch, "text", 500_000):
                y = column_of(part, "label").to_numpy()
                of, bucket = presence(texts)
                for v in (0, 1):
                    counts[v] += np.bincount(bucket[y[of] == v], minlength=1 << BITS)
        some = np.flatnonzero(counts.any(axis=0))
        yield records([some.astype(np.int32), counts[1][some], counts[0][some]], TALLY)

    smooth = lambda c, n: (c + F.lit(1.0)) / (F.lit(float(n)) + 2.0)
    seen = rows.mapInArrow(tally, "bucket int, with_1 bigint, with_0 bigint").groupBy("bucket").agg(F.sum("with_1").alias("with_1"), F.sum("with_0").alias("with_0"))
    seen = seen.where(F.col("with_1") + F.col("with_0") >= least_texts).withColumn("ratio", F.log(smooth(F.col("with_1"), n1) / smooth(F.col("with_0"), n0)))
    apart = F.abs("ratio") * F.sqrt(F.col("with_1") / F.lit(max(1, n1)) + F.col("with_0") / F.lit(max(1, n0)))
    # At most 2 ** BITS rows, brought to one task, so that the driver gets one list of the best and not one from each task.
    best = seen.withColumn("apart", F.round(apart, 9)).repartition(1).orderBy(F.desc("apart"), "bucket").limit(most_features).select("bucket", "ratio").toPandas().sort_values("bucket")
    table = np.full(1 << BITS, -1, np.int32)
    table[best["bucket"].to_numpy()] = np.arange(len(best))
    shared = spark.sparkContext.broadcast(table)

    @tidied
    def find(batches):
        for batch in batches:
            for part, texts in slices(batch, "text", 500_000):
                of, feature = presence(texts, shared.value)
                cut = np.searchsorted(of, np.arange(len(texts) + 1))
                yield records([column_of(part, "label"), [feature[a:b].astype(np.int32) for a, b in zip(cut, cut[1:])]], ROWS)

    got = rows.mapInArrow(find, "label int, found array<int>").toArrow()
    found = got.column("found").combine_chunks()
    sizes = np.diff(found.offsets.to_numpy())
    of = np.repeat(np.arange(len(sizes)), sizes)
    w, b = fit(of, found.values.to_numpy().astype(np.int64), got.column("label").to_numpy().astype(np.float64), best["ratio"].to_numpy())
    return ToxicityModel(table, w, b)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text), from the whole text alone.

    A null or empty text has no n-gram and the score of the bias; repeated rows and null
    ids are scored like any other; an empty table gives an empty result; other columns are
    ignored, whatever their names. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, "text", 500_000):
                yield records([column_of(rows, "doc_id"), shared.value.score(texts)], SCORES)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
