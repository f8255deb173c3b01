"""Product codes of vectors: integer codebooks by Lloyd's rounds, with Elkan's bounds kept between them."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import column_of, records, remove_folder, shared_folder, ship, tidied
from lectern.llm.heavy import stored, with_facts

SCALE = 1024
#: Rows that are compared with a codebook at a time.
BLOCK = 2048
#: The largest stored bound; one that would be larger is held there, which a lower bound may be.
TOP = 65535


def cuts(dim: int, parts: int) -> list[int]:
    """Where the parts begin and the last one ends; equal ones if ``parts`` divides ``dim``."""
    return [dim * p // parts for p in range(parts + 1)]


class Codebook:
    """The entries of one part with what the bounds need: their distances from each other, rounded down to units."""

    def __init__(self, entries: np.ndarray, unit: float):
        self.entries, self.unit = entries.astype(np.int64), unit
        self.between = self.lower(squares(self.entries, self.entries))
        np.fill_diagonal(self.between, 0)

    def lower(self, square: np.ndarray) -> np.ndarray:
        """Distances in units, never more than they are."""
        return np.minimum(np.sqrt(square.astype(np.float64)) * (1 - 1e-12) / self.unit, TOP).astype(np.uint16)

    def upper(self, square: np.ndarray) -> np.ndarray:
        """Distances in units, never less than they are."""
        return np.ceil(np.sqrt(square.astype(np.float64)) * (1 + 1e-12) / self.unit).astype(np.int64)

    def moved(self, old: np.ndarray) -> np.ndarray:
        """How far each entry is from where it was, in units, never less."""
        return self.upper(((self.entries - old) ** 2).sum(axis=1))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all of b, as exact integers."""
    if float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))) ** 2 * 4 * max(a.shape[1], 1) < 2**52:
        x, y = a.astype(np.float64), b.astype(np.float64)  # whole numbers that doubles hold exactly
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((a - e) ** 2).sum(axis=1) for e in b], axis=1)


def first_bounds(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, its squared distance, lower bounds) of rows that have no bounds yet: every distance is taken."""
    square = squares(x, book.entries)
    own = square.argmin(axis=1)
    return own, square[np.arange(len(x)), own], book.lower(square)


def reassigned(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest entry, its squared distance, lower bounds, distances taken) from the bounds of the rows.

    An entry is passed over only if a bound says that it is strictly further than the row's
    own one: its lower bound is above the upper bound, or it is further from the own entry
    than twice the upper bound. What may be as near is compared as integers, ties to the
    smaller index. Upper bounds are made exact first where any entry would not be passed over.
    """
    rows = np.arange(len(x))

    def near(u: np.ndarray, at: np.ndarray) -> np.ndarray:
        open_ = (lower[at] <= u[:, None]) & (book.between[own[at]] <= 2 * u[:, None])
        open_[np.arange(len(at)), own[at]] = False
        return open_

    doubtful = rows[near(upper, rows).any(axis=1)]
    square = ((x - book.entries[own]) ** 2).sum(axis=1)
    exact = book.upper(square[doubtful])
    at, entry = np.nonzero(near(exact, doubtful))
    r = doubtful[at]
    d = ((x[r] - book.entries[entry]) ** 2).sum(axis=1)
    lower[r, entry] = book.lower(d)
    lower[rows, own] = book.lower(square)
    # the nearest of each row among its own entry and those compared
    order = np.lexsort((np.concatenate([own[doubtful], entry]), np.concatenate([square[doubtful], d]), np.concatenate([doubtful, r])))
    who = np.concatenate([doubtful, r])[order]
    first = order[np.r_[True, who[1:] != who[:-1]]] if len(who) else order
    new = own.copy()
    new[doubtful] = np.concatenate([own[doubtful], entry])[first]
    square[doubtful] = np.concatenate([square[doubtful], d])[first]
    return new, square, lower, len(r)


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, x): rows whose vectors are whole, each component as floor(1024 * component).

    Components are held to such a size that a squared distance of two vectors is under 2^61.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = embeddings.where(F.size("embedding") > 0).where(finite)
    most = F.sqrt(2.0**61 / F.size("embedding")) / 2
    floors = F.transform("embedding", lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, most), -most)).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", floors.alias("x"))


def assigned(state: DataFrame, books: list[Codebook], old: list[np.ndarray] | None, at: list[int], last: bool) -> DataFrame:
    """A round over the rows, each judged where it lies; no shuffle. Without ``old`` there are no bounds yet.

    ``state`` has x and, after the first round, own (an entry a part), upper (a bound a
    part) and lower (a bound an entry and part, as bytes). Returns them anew, or after the
    ``last`` round vec_id, label, code and error.
    """
    parts, k = len(books), len(books[0].entries)
    moved = None if old is None else [b.moved(o) for b, o in zip(books, old, strict=True)]
    kind = dict(state.dtypes)["label"]
    keep = f"vec_id bigint, label {kind}, "
    schema = keep + ("code string, error bigint" if last else "x array<bigint>, own array<int>, upper array<bigint>, lower binary")
    of = {"vec_id": pa.int64(), "code": pa.string(), "error": pa.int64(), "x": pa.list_(pa.int64()), "own": pa.list_(pa.int32()), "upper": pa.list_(pa.int64()), "lower": pa.binary()}
    names = ["code", "error"] if last else ["x", "own", "upper", "lower"]

    def whole(batch, name, n):
        return column_of(batch, name).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)

    @tidied
    def run(batches):
        for batch in (b.slice(s, BLOCK) for b in batches for s in range(0, b.num_rows, BLOCK)):
            n = batch.num_rows
            x = whole(batch, "x", n)
            own, square = np.empty((n, parts), np.int32), np.empty((n, parts), np.int64)
            bounds, upper = np.empty((n, parts, k), np.uint16), np.empty((n, parts), np.int64)
            if moved is not None:
                was, high = whole(batch, "own", n), whole(batch, "upper", n)
                packed = column_of(batch, "lower")
                bounds[:] = np.frombuffer(b"".join(packed.to_pylist()), np.uint16).reshape(n, parts, k)
            for p, book in enumerate(books):
                mine = x[:, at[p] : at[p + 1]]
                if moved is None:
                    own[:, p], square[:, p], bounds[:, p] = first_bounds(mine, book)
                else:
                    shifted = np.maximum(bounds[:, p].astype(np.int64) - moved[p], 0).astype(np.uint16)
                    own[:, p], square[:, p], bounds[:, p], _ = reassigned(mine, was[:, p].astype(np.int64), high[:, p] + moved[p][was[:, p]], shifted, book)
                upper[:, p] = book.upper(square[:, p])
            if last:
                made = [["".join(f"{e:02x}" for e in row) for row in own.tolist()], square.sum(axis=1)]
            else:
                lists = lambda a, t: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel(), t))
                made = [column_of(batch, "x"), lists(own, pa.int32()), lists(upper, pa.int64()), [row.tobytes() for row in bounds]]
            schema_ = pa.schema([("vec_id", pa.int64()), ("label", column_of(batch, "label").type), *[(c, of[c]) for c in names]])
            yield records([column_of(batch, "vec_id"), column_of(batch, "label"), *made], schema_)

    return state.mapInArrow(run, schema)


def averaged(state: DataFrame, books: list[Codebook], at: list[int]) -> list[np.ndarray]:
    """The floors of the means of each entry's parts; unused entries stay.

    Each task sums its rows to one row an entry and part; these meet by key, and only the
    sums, ``parts`` times the entries, come to the driver.
    """
    parts = len(books)
    widest = max(b - a for a, b in zip(at, at[1:], strict=False))
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("place", pa.int32()), ("total", pa.int64())])
    k = len(books[0].entries)

    @tidied
    def run(batches):
        total, count = np.zeros((parts, k, widest), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = column_of(batch, "x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = column_of(batch, "own").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for p in range(parts):
                    np.add.at(total[p, :, : at[p + 1] - at[p]], own[:, p], x[:, at[p] : at[p + 1]])
                    count[p] += np.bincount(own[:, p], minlength=k)
        part, entry = np.nonzero(count)
        place = np.tile(np.arange(widest), len(part))
        yield records([np.repeat(part, widest), np.repeat(entry, widest), np.repeat(count[part, entry], widest), place, total[part, entry].ravel()], schema)

    sums = state.select("x", "own").mapInArrow(run, "part int, entry int, n bigint, place int, total bigint")
    fresh = [b.entries.copy() for b in books]
    for row in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        if row["place"] < at[row["part"] + 1] - at[row["part"]]:
            fresh[row["part"]][row["entry"], row["place"]] = row["total"] // row["n"]
    return fresh


def vector_codes(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row of embeddings (vec_id, embedding, label) with a whole vector.

    Components become floor(1024 * component); vectors are cut into ``parts`` consecutive
    parts. Each part's codebook begins as that part of the ``entries`` rows with the
    smallest vec_id (all rows, if there are fewer), and in each round every part goes to its
    nearest entry (squared Euclidean distance in integers, ties to the smaller index) and
    each entry to the floor of the mean of its parts; an unused entry stays. At the end
    parts are assigned once more. ``code`` has two hex digits a part, ``error`` is the sum
    of the squared distances, ``label_error`` its sum over the rows of a label.

    Rounds are Elkan's: a row keeps an upper bound a part and a lower bound an entry and
    part, in whole units of a distance, in a table of the shared folder that the next round
    reads; the bounds are shifted by how far entries have moved. Nothing is shuffled but
    sums of entries. A table is removed when the next one stands.

    Rows with a null or empty vector, or one that holds a null or non-finite component, take
    no part. All vectors are as long as that of the smallest vec_id; others take no part either. If
    ``parts`` doesn't divide this length, parts differ by one. Repeated vec_ids are rows
    each, the one with the smaller vector first; rows without an id come last. Null labels
    are one label. A component of over 2^19 / sqrt(length) in size counts as about that
    much; a sum of errors that a long can't hold is null.
    An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = ship(embeddings.sparkSession)
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part")
    rows = integers(embeddings)
    first = rows.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(1).collect()
    dim = len(first[0]["x"]) if first else 0
    rows, at = rows.where(F.size("x") == dim), cuts(dim, parts)
    start = [r["x"] for r in rows.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()]
    start = np.array(start or [[0] * dim], np.int64)
    largest = rows.agg(F.coalesce(F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))), F.lit(0))).first()[0]
    unit = max(1.0, 2 * largest * max(dim, 1) ** 0.5 / (TOP - 1))
    place, state, books, old = f"{shared_folder(spark)}/vector-codes-{uuid.uuid4().hex}", rows, [Codebook(start[:, a:b], unit) for a, b in zip(at, at[1:], strict=False)], None
    for k in range(rounds):
        state = stored(assigned(state, books, old, at, last=False), f"{place}/{k}")
        if k:
            remove_folder(spark, f"{place}/{k - 1}")
        old = [b.entries for b in books]
        books = [Codebook(e, unit) for e in averaged(state, books, at)]
    done = stored(assigned(state, books, old, at, last=True), f"{place}/done")
    remove_folder(spark, f"{place}/{rounds - 1}")
    text = ",".join(str(v) for b in books for v in b.entries.ravel().tolist()) if first else ""
    facts = stored(done.groupBy("label").agg(F.count("*").alias("rows"), F.try_sum("error").alias("label_error")), f"{place}/labels")
    if facts.isEmpty():
        coded = done.select("vec_id", "code", "error", F.col("error").alias("label_error"))
    else:
        coded = with_facts(done, facts, ["label"], "rows", ["vec_id", "code"])
    return coded.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
