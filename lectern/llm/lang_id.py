"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import column_of, durable, keep_rows, records, slices, tidied, unit_hash

ORDER = 4
GROUP = 16
SPACE, START = 0x20, 0x02
COUNTS = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])
ENTROPIES = pa.schema([("lang", pa.string()), ("e", pa.float64()), ("n", pa.int64())])
SCORES = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("n_symbols", pa.int64()), ("rejected", pa.bool_())])


def _symbol(c: str) -> int:
    """The symbol of a character: letters in lower case, marks and joiners as they are, everything else a space."""
    if c.isalpha():
        low = c.lower()
        return ord(low) if len(low) == 1 else ord(c)
    return ord(c) if category(c)[0] == "M" or c in "\u200c\u200d" else SPACE


@lru_cache(1)
def symbol_table() -> tuple[np.ndarray, np.ndarray]:
    """For each UTF-16 unit its symbol, and whether that is of a letter. Units of pairs are themselves."""
    table = np.array([cp if 0xD800 <= cp < 0xE000 else _symbol(chr(cp)) for cp in range(1 << 16)])
    table[table > 0xFFFF] = SPACE
    table[START] = START
    letters = np.array([chr(s).isalpha() or 0xD800 <= s < 0xDC00 for s in range(1 << 16)])
    return table.astype(np.uint16), letters


def symbols(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in turn, which of them count, and the text each belongs to.

    A symbol is a UTF-16 unit, so a letter beyond the first plane is two, and none is lost.
    Every text follows ORDER - 1 start symbols and one space, and ends with a space; runs
    of spaces are one. The start symbols and the space after them only serve as context.
    """
    gap = chr(START) * (ORDER - 1) + " "
    clean = [(t or "").replace(chr(START), " ") for t in texts]
    joined = gap + (" " + gap).join(clean) + " "
    units = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
    s = symbol_table()[0][units]
    lengths = np.array([len(t) for t in clean])
    high = np.flatnonzero((units[:-1] & 0xFC00 == 0xD800) & (units[1:] & 0xFC00 == 0xDC00))
    alone = (units & 0xF800) == 0xD800
    if high.size:
        alone[high] = alone[high + 1] = False
        codes = 0x10000 + ((units[high].astype(np.int64) & 0x3FF) << 10 | units[high + 1] & 0x3FF)
        kinds, which = np.unique(codes, return_inverse=True)
        made = np.array([_symbol(chr(c)) for c in kinds.tolist()])[which]
        s[high] = np.where(made == SPACE, SPACE, 0xD800 + (made - 0x10000 >> 10))
        s[high + 1] = np.where(made == SPACE, SPACE, 0xDC00 + (made & 0x3FF))
        lengths = np.array([len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in clean])
    s[alone] = SPACE
    lengths = lengths + len(gap) + 1
    owner = np.repeat(np.arange(len(clean)), lengths)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != SPACE) | (s[:-1] != SPACE)
    counts = keep & (s != START)
    counts[np.concatenate([[0], np.cumsum(lengths)[:-1]]) + len(gap) - 1] = False
    return s[keep], counts[keep], owner[keep]


def grams(s: np.ndarray) -> np.ndarray:
    """At each position the last ORDER symbols, packed in 64 bits, the position's own lowest."""
    w = s.astype(np.uint64)
    out = w.copy()
    for k in range(1, ORDER):
        out[k:] |= w[:-k] << np.uint64(16 * k)
    return out


def mix(key: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = key ^ (key >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class HashArray:
    """Rows of values under sorted 64-bit hashes; a directory of leading bits gives the place."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mix(keys)
        order = np.argsort(h)
        self.hashes, self.values = h[order], values[order]
        self.bits = max(1, int(len(h)).bit_length())
        heads = self.hashes >> np.uint64(64 - self.bits)
        self.first = np.searchsorted(heads, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if absent."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.hashes):
            return out
        h = mix(keys)
        head = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        while len(todo):
            hit = self.hashes[at] == h
            out[todo[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            todo, at, end, h = todo[more], at[more] + 1, end[more], h[more]
        return out


def low(key: np.ndarray, k: int) -> np.ndarray:
    """The last k symbols of a gram."""
    return key & np.uint64((1 << 16 * k) - 1) if k < 4 else key


@dataclass
class OneLanguage:
    """Kneser-Ney counts of one language: by order, the grams, their counts and contexts."""

    grams: list = field(default_factory=list)
    counts: list = field(default_factory=list)
    contexts: list = field(default_factory=list)
    weights: list = field(default_factory=list)
    totals: list = field(default_factory=list)
    discounts: list = field(default_factory=list)

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray) -> OneLanguage:
        """Counts at the highest order; below, in how many contexts a gram was seen."""
        self = cls()
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(np.float64)
        for k in range(ORDER, 0, -1):
            context, start = np.unique(keys >> np.uint64(16), return_index=True)
            total = np.add.reduceat(n, start)
            kinds = np.diff(np.append(start, len(n)))
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            self.grams.insert(0, keys)
            self.counts.insert(0, n)
            self.contexts.insert(0, context)
            self.totals.insert(0, total)
            self.weights.insert(0, d * kinds / total)
            self.discounts.insert(0, d)
            if k > 1:
                keys, n = np.unique(low(keys, k - 1), return_counts=True)
                n = n.astype(np.float64)
        return self

    def weight(self, k: int, context: np.ndarray) -> np.ndarray:
        """The share that order k leaves to the order below, all of it in unseen contexts."""
        at = np.minimum(np.searchsorted(self.contexts[k - 1], context), len(self.contexts[k - 1]) - 1)
        return np.where(self.contexts[k - 1][at] == context, self.weights[k - 1][at], 1.0)

    def probability(self, k: int, keys: np.ndarray, kinds: int) -> np.ndarray:
        if not k:
            return np.full(len(keys), 1.0 / kinds)
        at = np.minimum(np.searchsorted(self.grams[k - 1], keys), len(self.grams[k - 1]) - 1)
        seen = self.grams[k - 1][at] == keys
        context = keys >> np.uint64(16)
        c = np.minimum(np.searchsorted(self.contexts[k - 1], context), len(self.contexts[k - 1]) - 1)
        part = np.where(seen, (self.counts[k - 1][at] - self.discounts[k - 1]) / self.totals[k - 1][c], 0.0)
        return part + self.weight(k, context) * self.probability(k - 1, low(keys, k - 1), kinds)


class LanguageModels:
    """All languages: by order the log-probabilities of every gram that any has seen, in sorted hash arrays.

    Languages stand side by side in tables of ``GROUP`` at most, so that a gram of one takes
    no room in the tables of hundreds of others.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        models = [OneLanguage.of(*counts[name]) for name in self.langs]
        self.kinds = len(np.unique(np.concatenate([m.grams[0] for m in models]))) + 1 if models else 1
        self.groups = [self._tables(models[k : k + GROUP]) for k in range(0, len(models), GROUP)]
        self.calibration: dict[str, tuple[float, float]] = {}

    def _tables(self, models: list[OneLanguage]) -> tuple[list, list]:
        seen, left = [], []
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([m.grams[k - 1] for m in models]))
            p = np.array([m.probability(k, keys, self.kinds) for m in models]).T
            seen.append(HashArray(keys, np.log(p).astype(np.float32)))
            context = np.unique(keys >> np.uint64(16))
            w = np.array([m.weight(k, context) for m in models]).T
            left.append(HashArray(context, np.log(w).astype(np.float32)))
        return seen, left

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        return np.concatenate([self._of_group(g, keys, ORDER) for g in self.groups], axis=1)

    def _of_group(self, group: tuple[list, list], keys: np.ndarray, k: int) -> np.ndarray:
        seen, left = group
        if not k:
            return np.full((len(keys), seen[0].values.shape[1]), -np.log(self.kinds), np.float32)
        at = seen[k - 1].find(keys)
        out = seen[k - 1].values[np.maximum(at, 0)]
        if (miss := np.flatnonzero(at < 0)).size:
            below = self._of_group(group, low(keys[miss], k - 1), k - 1)
            c = left[k - 1].find(keys[miss] >> np.uint64(16))
            below[c >= 0] += left[k - 1].values[c[c >= 0]]
            out[miss] = below
        return out

    def entropies(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy by text and language, and the number of symbols that count.

        A text without a letter has none.
        """
        if not texts:
            return np.zeros((0, len(self.langs))), np.zeros(0, np.int64)
        s, counts, owner = symbols(texts)
        g = grams(s)[counts]
        of = owner[counts]
        n = np.bincount(of, minlength=len(texts))
        letters = np.bincount(of, weights=symbol_table()[1][s[counts]], minlength=len(texts))
        out = np.zeros((len(texts), len(self.langs)))
        if len(g) and self.langs:
            logs = self.log_probabilities(g)
            start = np.concatenate([[0], np.cumsum(n)[:-1]])
            some = n > 0
            out[some] = -np.add.reduceat(logs, start[some], axis=0, dtype=np.float64) / n[some, None]
        return out, np.where(letters > 0, n, 0)

    def excess(self, lang: str, entropy: float, n: int) -> float:
        """How far a text is above its language's usual cross-entropy, by what its length allows.

        All symbols are in the cross-entropy; beyond 400 its spread is that of the texts'
        kinds and no longer falls with the length.
        """
        mean = self.calibration.get(lang, (0.0, 0.0))[0]
        return (entropy - mean) * min(n, 400) ** 0.5

    def judge(self, texts: list) -> list[tuple[str, float, float, int, bool]]:
        """For each text: language, score, cross-entropy, symbols, whether it is rejected.

        The score is the language's share among all by the odds that 60 symbols give at the
        whole text's cross-entropies (all, if fewer), as the symbols of a text are not independent.
        """
        entropy, n = self.entropies(texts)
        out = []
        for e, k in zip(entropy, n.tolist(), strict=True):
            if not k or not self.langs:
                out.append(("und", 0.0, 0.0, k, True))
                continue
            best = int(np.argmin(e))
            name = self.langs[best]
            odds = np.exp(-(e - e[best]) * min(k, 60))
            limit = self.calibration.get(name, (0.0, np.inf))[1]
            out.append((name, float(1 / odds.sum()), float(e[best]), k, bool(self.excess(name, e[best], k) > limit)))
        return out


def train(labelled: DataFrame, most_rows: int = 3000, most_texts: int = 48_000, quantile: float = 0.99, slack: float = 3.0, least_limit: float = 12.0) -> LanguageModels:
    """Models of the languages in ``labelled`` (doc_id, text, lang).

    Learns from about ``most_rows`` whole texts a language, chosen by a hash of the id, and
    from fewer of each if there are so many languages that it would be more than
    ``most_texts`` together; so the model has a bounded size whatever the table's. All grams
    of these texts count. Rejection is calibrated on the same texts, each half judged by
    models of the other half: the limit is ``slack`` times the given quantile of their
    excess, ``least_limit`` at least, so that names or codes in a text reject none. Rows
    with null ids, texts or languages teach nothing; repeated rows count as often as they
    are there; without any row there is no language and all is ``und``. Other columns are
    ignored, whatever their names.
    """
    known = labelled.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = durable(known.groupBy("lang").count().select("lang", F.col("count").alias("n_texts")))
    n_languages = sizes.count()
    each = max(1, min(most_rows, most_texts // max(1, n_languages)))
    chosen = unit_hash(F.col("doc_id"), "language") < F.lit(float(each)) / F.col("n_texts")
    known = known.join(F.broadcast(sizes) if n_languages <= 100_000 else sizes, "lang").where(chosen)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    sample = durable(known.select("lang", half.alias("part"), "text"))

    @tidied
    def count(batches):
        found: dict[tuple, list] = {}
        for batch in batches:
            for rows, texts in slices(batch, "text", 1_000_000):
                kinds = list(zip(column_of(rows, "lang").to_pylist(), column_of(rows, "part").to_pylist(), strict=True))
                s, counts, owner = symbols(texts)
                g, of = grams(s)[counts], owner[counts]
                for kind in set(kinds):
                    mine = np.array([k == kind for k in kinds])
                    found.setdefault(kind, []).append(np.unique(g[mine[of]], return_counts=True))
        for (name, part), parts in found.items():
            keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([p[1] for p in parts]))
            yield records([[name] * len(keys), [part] * len(keys), keys.view(np.int64), n.astype(np.int64)], COUNTS)

    counted = sample.mapInArrow(count, "lang string, part int, gram bigint, n bigint").groupBy("lang", "part", "gram").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    models = _of_counts(got)
    if models.langs:
        halves = sample.sparkSession.sparkContext.broadcast([_of_counts(got[got["part"] != k]) for k in (0, 1)])

        @tidied
        def unseen(batches):
            for batch in batches:
                for rows, texts in slices(batch, "text", 1_000_000):
                    names, parts = column_of(rows, "lang").to_pylist(), np.array(column_of(rows, "part").to_pylist())
                    for k, m in enumerate(halves.value):
                        mine = [i for i in np.flatnonzero(parts == k) if names[i] in m.langs]
                        e, n = m.entropies([texts[i] for i in mine])
                        yield records([[names[i] for i in mine], [float(x[m.langs.index(names[i])]) for x, i in zip(e, mine, strict=True)], n], ENTROPIES)

        seen = sample.mapInArrow(unseen, "lang string, e double, n bigint").where("n > 0").toPandas()
        for name, part in seen.groupby("lang"):
            models.calibration[name] = (float(np.average(part["e"], weights=part["n"])), np.inf)
            excess = [models.excess(name, e, n) for e, n in zip(part["e"], part["n"], strict=True)]
            models.calibration[name] = (models.calibration[name][0], max(least_limit, slack * float(np.quantile(excess, quantile))))
    return models


def _of_counts(counted) -> LanguageModels:
    summed = counted.groupby(["lang", "gram"], sort=True, as_index=False)["n"].sum()
    return LanguageModels({str(name): (part["gram"].to_numpy().view(np.uint64), part["n"].to_numpy()) for name, part in summed.groupby("lang")})


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """The language of each row of ``docs`` (doc_id, text), from the whole text alone.

    Returns doc_id, lang_pred, score, cross_entropy (nats a symbol), n_symbols, rejected.
    A null text or one without a letter is ``und`` with score 0 and rejected; else
    lang_pred is a learned language even where the text is rejected as unlike all of them.
    Repeated rows and null ids are judged like any other; an empty table gives an empty
    result; other columns are ignored, whatever their names. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @tidied
    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, "text", 1_000_000):
                yield records([column_of(rows, "doc_id"), *map(list, zip(*shared.value.judge(texts), strict=True))], SCORES)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, cross_entropy double, n_symbols bigint, rejected boolean")


def keep_known(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected as unlike every learned language.

    Null texts and texts without a letter go; repeated rows are judged alike; columns may
    have any names; an empty table gives an empty result. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return keep_rows(docs, lambda texts: [not j[4] for j in shared.value.judge(texts)])
