"""Quality classifier from trusted positives and unlabelled text (non-negative PU learning)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import column_of, keep_rows, records, slices, tidied, unit_hash

FEATURES = ("log_words", "word_length", "upper", "digits", "symbols", "marks", "distinct_words", "repeated_next", "capital_words", "symbol_words", "bare_words", "repeated_lines", "line_words", "top_word", "longest_same", "longest_symbols", "longest_capitals", "longest_table")
FOUND = pa.schema([("kind", pa.int32()), ("values", pa.list_(pa.float32()))])
TALLY = pa.schema([("cell", pa.int32()), ("n", pa.int64())])
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
UPPER, DIGIT, SYMBOL, MARK, BLANK, LETTER = 1, 2, 3, 4, 5, 6


def _kinds() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp)
        table[cp] = BLANK if c.isspace() else UPPER if c.isupper() else LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK if c in ".,;:!?'\"()-" else SYMBOL
    return table


KINDS = _kinds()


def longest_runs(flags: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The longest run of set flags in each of n texts."""
    at = np.arange(len(flags))
    begins = flags.copy()
    begins[1:] &= ~flags[:-1] | (owner[1:] != owner[:-1])
    since = at - np.maximum.accumulate(np.where(begins, at, 0)) + 1
    out = np.zeros(n, np.int64)
    np.maximum.at(out, owner[flags], since[flags])
    return out


def features(texts: list) -> np.ndarray:
    """FEATURES of each text, in rows; an empty text has zeros."""
    n = len(texts)
    out = np.zeros((n, len(FEATURES)), np.float32)
    clean = [t or "" for t in texts]
    chars = np.array([len(t) for t in clean])
    cp = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(cp < 1 << 16, KINDS[np.minimum(cp, 0xFFFF)], SYMBOL).astype(np.int64)
    by = np.bincount(np.repeat(np.arange(n), chars) * 8 + kind, minlength=8 * n).reshape(n, 8)
    letters = np.maximum(1, by[:, UPPER] + by[:, LETTER])
    solid = np.maximum(1, chars - by[:, BLANK])
    out[:, 2] = by[:, UPPER] / letters
    for k, v in ((3, DIGIT), (4, SYMBOL), (5, MARK)):
        out[:, k] = by[:, v] / solid
    ids: dict[str, int] = {}
    streams, kinds = [], []
    for i, t in enumerate(clean):
        words = t.split()
        streams.append(np.array([ids.setdefault(w, len(ids)) for w in words], np.int64))
        lines = [x for x in t.split("\n") if x.strip()]
        out[i, 11] = 1 - len(set(lines)) / len(lines) if lines else 0
        out[i, 12] = np.log1p(len(words) / len(lines)) if lines else 0
    for w in ids:
        capital = len(w) > 1 and w.isupper()
        tail = w[-1]
        kinds.append(capital + 2 * (tail in "#*$%&|<>!~^=+_@/\\") + 4 * (not any(c.isalpha() for c in w)))
    kinds = np.array(kinds, np.int64)
    sizes = np.array([len(s) for s in streams])
    words = np.maximum(1, sizes)
    out[:, 0] = np.log1p(sizes)
    out[:, 1] = solid * (sizes > 0) / words
    tokens = np.concatenate(streams) if streams else np.empty(0, np.int64)
    if len(tokens):
        owner = np.repeat(np.arange(n), sizes)
        pairs, counts = np.unique(owner * len(ids) + tokens, return_counts=True)
        of = pairs // len(ids)
        out[:, 6] = np.bincount(of, minlength=n) / words
        top = np.zeros(n, np.int64)
        np.maximum.at(top, of, counts)
        out[:, 13] = top / words
        same = (tokens[1:] == tokens[:-1]) & (owner[1:] == owner[:-1])
        out[:, 7] = np.bincount(owner[1:][same], minlength=n) / words
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        bare = (kinds[tokens] & 4) > 0
        table = bare | np.concatenate([[False], bare[:-1]]) & ~first
        for k, flags in ((14, np.concatenate([[False], same])), (15, (kinds[tokens] & 2) > 0), (16, (kinds[tokens] & 1) > 0), (17, table)):
            out[:, k] = np.log1p(longest_runs(flags, owner, n))
        for k, bit in ((8, 1), (9, 2), (10, 4)):
            out[:, k] = np.bincount(owner, weights=(kinds[tokens] & bit) > 0, minlength=n) / words
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class QualityModel:
    """An additive model over binned features, its class prior and its calibration."""

    edges: list
    weights: np.ndarray
    bias: float
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of the weight table for each text and feature."""
        wide = self.weights.shape[1]
        return np.array([np.searchsorted(e, x[:, j], side="right") + wide * j for j, e in enumerate(self.edges)]).T.reshape(len(x), len(self.edges))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.weights.ravel()[self.cells(x)].sum(axis=1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(x) + self.shift)


def prior_cuts(positive: np.ndarray, least_share: float = 0.8) -> np.ndarray:
    """Rising cuts of a score, all of which leave ``least_share`` of the positives or more."""
    return np.quantile(positive, np.linspace(0, 1 - least_share, 25))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, cuts: np.ndarray) -> float:
    """The share of positives among the unlabelled.

    ``positive`` holds scores, ``unlabelled`` how many texts lie below, between and above the
    cuts. Where a score is typical of positives, the unlabelled are positives nearly alone:
    the ratio of the two tails is the prior or more at every cut, so the least ratio is
    taken, over cuts that leave most of the positives, where it is least noisy.
    """
    p = np.array([(positive >= c).mean() for c in cuts])
    u = unlabelled[::-1].cumsum()[::-1][1:] / max(1, unlabelled.sum())
    return float(np.clip((u / p).min(), 0.02, 0.98))


def calibrated(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of margins that minimise the unbiased risk, by Newton steps.

    With the logistic loss that risk is prior * E_P[-f] + E_U[log(1 + e^f)], convex in the
    two numbers; its least value makes the mean score of the unlabelled the prior.
    """
    a, b = 1.0, 0.0
    for _ in range(200):
        s = sigmoid(a * unlabelled + b)
        v = s * (1 - s)
        g = np.array([(s * unlabelled).mean() - prior * positive.mean(), s.mean() - prior])
        cross = (v * unlabelled).mean()
        step = np.clip(np.linalg.solve(np.array([[(v * unlabelled**2).mean() + 1e-4, cross], [cross, v.mean() + 1e-4]]), g), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def fit_risk(model: QualityModel, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> None:
    """Minimise the non-negative unbiased risk with the logistic loss, by full-batch Adam.

    Risk: prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]). Where the second
    term falls below zero, the step undoes that instead, as the method has it.
    """
    cp, cu = model.cells(positive), model.cells(unlabelled)
    size = model.weights.size
    w, b = model.weights.ravel().copy(), 0.0
    m1, m2 = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        fp, fu = w[cp].sum(axis=1) + b, w[cu].sum(axis=1) + b
        gap = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gu, gp = sigmoid(fu) / len(fu), prior * sigmoid(fp) / len(fp)
        if gap >= 0:
            gp = -prior * sigmoid(-fp) / len(fp) - gp
        else:
            gu = -gu
        g = np.bincount(cp.ravel(), weights=np.repeat(gp, cp.shape[1]), minlength=size) + np.bincount(cu.ravel(), weights=np.repeat(gu, cu.shape[1]), minlength=size)
        g = np.append(g + decay * w, gp.sum() + gu.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    model.weights, model.bias = w.reshape(model.weights.shape), float(b)


def cell_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Edges at quantiles of all values and of those above zero, as many features are zero in most texts."""
    some = x[x > 0]
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])
    return np.unique(np.concatenate([edges, np.quantile(some, np.linspace(0, 1, bins // 2 + 1)[:-1])]) if len(some) else edges)


def fit_model(positive: np.ndarray, unlabelled: np.ndarray, bins: int = 12, tally=None) -> QualityModel:
    """A model from features of trusted positives and unlabelled text; without either, a flat one.

    No negative is asked for. The prior is read off margins of two models, each on the half
    of the texts that it had not seen: ``tally`` (of models and rising cuts) counts for each
    model the margins of the whole corpus between the cuts, those of its own half are taken
    off; without it the other half of ``unlabelled`` serves. Two more models of the halves,
    fitted with that prior, give the margins that slope and shift of the score come from.
    """
    both = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, len(FEATURES)), np.float32)
    edges = [cell_edges(both[:, j], bins) for j in range(len(FEATURES))]
    wide = max(len(e) for e in edges) + 1
    flat = lambda: QualityModel(edges, np.zeros((len(FEATURES), wide)), 0.0, 0.5)
    model = flat()
    if not len(positive) or not len(unlabelled):
        return model
    if len(positive) > 1 and len(unlabelled) > 1:

        def halves(prior: float, steps: int) -> tuple[list, list, list]:
            made = [flat(), flat()]
            for k, m in enumerate(made):
                fit_risk(m, positive[k::2], unlabelled[k::2], prior, steps=steps)
            return made, *([m.margin(x[1 - k :: 2]) for k, m in enumerate(made)] for x in (positive, unlabelled))

        made, p, u = halves(0.5, 150)
        cuts = prior_cuts(np.concatenate(p))
        count = lambda f: np.bincount(np.searchsorted(cuts, f, side="right"), minlength=len(cuts) + 1)
        if tally is None:
            n = count(np.concatenate(u))
        else:
            n = tally(made, cuts) - sum(count(m.margin(unlabelled[k::2])) for k, m in enumerate(made))
        model.prior = class_prior(np.concatenate(p), n, cuts)
        _, p, u = halves(model.prior, 400)
        model.slope, model.shift = calibrated(np.concatenate(p), np.concatenate(u), model.prior)
    fit_risk(model, positive, unlabelled, model.prior)
    return model


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 9000, most_unlabelled: int = 9000) -> QualityModel:
    """Learn from ``labels`` (doc_id, label) and the texts of ``docs`` (doc_id, text).

    The caller leaves out what must not be learned from. Only rows with label 1 count, as
    trusted positives: at most ``most_labelled``, and about ``most_unlabelled`` texts of any
    kind, chosen by a hash of the id, whole texts each; these bounds fix the size of what
    reaches the driver and of what is broadcast. The class prior is of the whole corpus: all
    texts but those of the fits are scored once, and numbers of margins between the cuts are
    summed up. Rows with nulls teach nothing; a label given twice counts once; without
    labels or texts all scores are 0.5. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    order = unit_hash(F.col("doc_id"), "quality")
    chosen = labels.where("doc_id is not null and label = 1").select("doc_id").dropDuplicates(["doc_id"]).orderBy(order, "doc_id").limit(most_labelled)
    ids = {r["doc_id"] for r in chosen.collect()}
    shared = spark.sparkContext.broadcast(ids)
    rows = docs.where("doc_id is not null and text is not null").selectExpr("cast(doc_id as bigint) as doc_id", "text")
    share = min(1.0, most_unlabelled / max(1, rows.count()))
    picked = spark.createDataFrame([(i,) for i in sorted(ids)], "doc_id bigint").withColumn("labelled", F.lit(True))
    whole = rows.select("text")
    rows = rows.join(F.broadcast(picked), "doc_id", "left")  # at most ``most_labelled`` ids
    rows = rows.withColumn("free", unit_hash(F.col("doc_id"), "unlabelled") < share).where("labelled or free")

    @tidied
    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text", 1_000_000):
                x = features(texts)
                kinds, values = [], []
                for i, doc_id, free in zip(range(len(x)), column_of(part, "doc_id").to_pylist(), column_of(part, "free").to_pylist(), strict=True):
                    if doc_id in shared.value:
                        kinds.append(1)
                        values.append(x[i])
                    if free:
                        kinds.append(-1)
                        values.append(x[i])
                yield records([kinds, values], FOUND)

    got = rows.select("doc_id", "text", "free").mapInArrow(run, "kind int, values array<float>").toArrow()
    kind = got.column("kind").to_numpy()
    x = np.array(got.column("values").to_pylist(), np.float32).reshape(len(kind), len(FEATURES))
    order = np.lexsort((*x.T, kind))  # the same model whatever order the rows came in
    kind, x = kind[order], x[order]

    def tally(models: list, cuts: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((models, cuts))

        @tidied
        def count(batches):
            models, cuts = shared.value
            n = np.zeros(len(cuts) + 1, np.int64)
            for batch in batches:
                for _, texts in slices(batch, "text", 1_000_000):
                    x = features(texts)
                    for m in models:
                        n += np.bincount(np.searchsorted(cuts, m.margin(x), side="right"), minlength=len(n))
            yield records([np.arange(len(n)), n], TALLY)

        found = whole.mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
        n = np.zeros(len(cuts) + 1, np.int64)
        for r in found.collect():
            n[r["cell"]] = r["n"]
        return n

    return fit_model(x[kind == 1], x[kind == -1], tally=tally if share < 1 else None)  # else the sample is the corpus


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text), from the whole text alone.

    Null and empty texts have zero features and a score like any other; repeated rows and
    null ids too. An empty table gives an empty result; other columns are ignored, whatever
    their names. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, "text", 1_000_000):
                yield records([column_of(rows, "doc_id"), shared.value.score(features(texts))], SCORES)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` or more.

    Null and empty texts are scored like any other; repeated rows are judged alike; columns
    may have any names; an empty table gives an empty result. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda texts: shared.value.score(features(texts)) >= least)
