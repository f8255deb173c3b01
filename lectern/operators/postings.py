"""An index of terms for ranked lexical search: blocks of postings with what bounds their scores.

A search of an index never scores all documents that share a term. A floor under the k-th best
score is found on each question's rarest terms; terms whose bounds together stay under it bring
no new candidates, so the long lists of common words are looked up only for the few documents
that remain. Postings are dealt once, by groups of documents and of questions, and scored where
they then lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.lexical import K1, B, asked_terms
from lectern.sources.tables import stored

#: A block holds the documents whose ids are equal but for so many last bits.
BLOCK_BITS = 9
#: Terms that are sent to all texts.
MOST_BROADCAST = 100_000
#: Bytes of texts that are counted at once; about so many documents and questions are scored against each other in a group.
SLICE, GROUP, ASKED = 4_000_000, 4096, 512
#: Which bytes of a lower-case text belong to a term, as ``text.TERM`` has it.
IN_TERM = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
COUNTED = pa.schema([("term", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("most_tf", pa.int64()), ("least_length", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("ids", "tfs", "sizes"))])
SCORED = "question_id bigint, doc_id bigint, score double"
#: Scores are told apart by six digits; what is passed over stays further than this below them.
SLACK = 1e-5


@dataclass(frozen=True)
class Index:
    """``postings`` (bucket, term, block, n, most_tf, least_length, ids, tfs, sizes), ``lengths`` (doc_id, length)."""

    postings: DataFrame
    lengths: DataFrame

    def of_batch(self, batch_id: int) -> Index:
        """What one batch has written, of an index whose tables have a column ``batch``."""
        return Index(self.postings.where(F.col("batch") == batch_id), self.lengths.where(F.col("batch") == batch_id))


def block_of(doc_id: Column) -> Column:
    return F.shiftright(doc_id, BLOCK_BITS)


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, length): terms of docs (doc_id, text); a null text has none."""

    def run(batches):
        for batch in batches:
            for part in sliced(batch):
                owner = terms_of(part.column("text"))[1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.bincount(owner, minlength=len(part)).astype(np.int64))], names=["doc_id", "length"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(run, "doc_id bigint, length bigint")


def sliced(batch: pa.RecordBatch):
    """The rows in slices of about ``SLICE`` bytes of text, or one row if that is larger."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of lower-case texts, in order, and which text each is of."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    inside = IN_TERM[data]
    begins = offsets[:-1] - offsets[0]
    cut = np.zeros(len(data) + 1, bool)  # where a text begins, so that no term reaches over
    cut[begins] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    kept = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(data[inside]))
    return kept, np.searchsorted(begins, starts, "right") - 1


def blocks_of(part: pa.RecordBatch, needed: pa.Array | None) -> pa.RecordBatch:
    """The postings of some documents (block, doc_id, text), by block and term; only of the needed terms, if these are given."""
    terms, owner = terms_of(part.column("text"))
    block, ids = (part.column(c).to_numpy() for c in ("block", "doc_id"))
    length = np.bincount(owner, minlength=len(part)).astype(np.int64)
    coded = terms.dictionary_encode()
    names, code = coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64)
    if needed is not None:
        asked = pc.is_in(names, value_set=needed).to_numpy(zero_copy_only=False)[code]
        owner, code = owner[asked], code[asked]
    key, tf = np.unique(owner * max(1, len(names)) + code, return_counts=True)
    owner, code = np.divmod(key, max(1, len(names)))
    order = np.lexsort((ids[owner], code, block[owner]))
    owner, code, tf = owner[order], code[order], tf[order].astype(np.int64)
    at = block[owner]
    start = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (code[1:] != code[:-1])])) if len(at) else np.zeros(0, np.int64)
    cut = pa.array(np.append(start, len(at)).astype(np.int32))
    most, least = (f.reduceat(x, start) if len(at) else start for f, x in ((np.maximum, tf), (np.minimum, length[owner])))
    lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (ids[owner], tf, length[owner])]
    return pa.RecordBatch.from_arrays([names.take(pa.array(code[start])), pa.array(at[start]), pa.array(np.diff(cut.to_numpy()).astype(np.int64)), pa.array(most), pa.array(least), *lists], schema=COUNTED)


def counted(docs: DataFrame, needed: DataFrame | None = None) -> DataFrame:
    """(term, block, n, most_tf, least_length, ids, tfs, sizes) of docs (doc_id, text), one row an id.

    Texts are shuffled once, by block, and all is counted where they then lie, some of them at a
    time, so a block can be two rows for a term where its texts are large.
    """
    # a number of partitions of its own, as texts are small for what is made of them
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).withColumn("block", block_of(F.col("doc_id")))
    few = [r["term"] for r in needed.select("term").distinct().limit(MOST_BROADCAST + 1).collect()] if needed is not None else []
    asked = pa.array(few, pa.string()) if needed is not None and len(few) <= MOST_BROADCAST else None

    def run(batches):
        for batch in batches:
            for part in sliced(batch):
                yield blocks_of(part, asked)

    return rows.repartition(partitions, "block").sortWithinPartitions("block").mapInArrow(run, "term string, block bigint, n bigint, most_tf bigint, least_length bigint, ids array<bigint>, tfs array<bigint>, sizes array<bigint>")


def postings(docs: DataFrame, buckets: int = 16, needed: DataFrame | None = None) -> DataFrame:
    """(bucket, term, block, n, most_tf, least_length, ids, tfs, sizes) of docs (doc_id, text), one row an id.

    The arrays have the ids, in order, of the documents of one block that hold the term, how
    often they do and their lengths, so no row grows with the corpus. Rows come sorted by term,
    those of a bucket in as many partitions as there are for it, so that a common term lies in
    all of these. Given ``needed`` (a column ``term``) only these terms are indexed, if they are
    few enough to be sent to all texts: for questions that are put once.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = counted(docs, needed)
    blocks = blocks.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), *blocks.columns)
    salts = max(1, partitions // buckets)
    return blocks.repartition(buckets * salts, "bucket", F.pmod(F.xxhash64("block"), F.lit(salts))).sortWithinPartitions("bucket", "term", "block")


def in_blocks(each: DataFrame) -> DataFrame:
    """The blocks of single postings (bucket, term, block, doc_id, tf, length)."""
    entries = F.sort_array(F.collect_list(F.struct("doc_id", "tf", "length")))
    blocks = each.groupBy("block", "term").agg(F.first("bucket").alias("bucket"), F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("length").alias("least_length"), entries.alias("e"))
    return blocks.select("bucket", "term", "block", "n", "most_tf", "least_length", F.col("e.doc_id").alias("ids"), F.col("e.tf").alias("tfs"), F.col("e.length").alias("sizes"))


def each_posting() -> F.Column:
    """A block as rows (doc_id, tf, length), to be selected."""
    return F.inline(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("tfs").alias("tf"), F.col("sizes").alias("length")))


def build(docs: DataFrame, place: str | None = None, buckets: int = 16, needed: DataFrame | None = None) -> Index:
    """An index of docs (doc_id, text), written to a folder and read from there."""
    kept = stored(postings(docs, buckets, needed), place and f"{place}/postings", ["bucket"])
    return Index(kept, stored(lengths(docs.where("doc_id is not null")), place and f"{place}/lengths"))


def replaced(index: Index) -> Index:
    """The index of the last version of each document, from one whose tables have a column ``batch``.

    Only if some document is in more than one batch are its old entries taken out, and the
    blocks made anew from the rest.
    """
    last = index.lengths.groupBy("doc_id").agg(F.max_by("length", "batch").alias("length"), F.max("batch").alias("batch"), F.count("*").alias("versions"))
    if last.where("versions > 1").isEmpty():
        return Index(index.postings, index.lengths)
    old = index.lengths.join(last.select("doc_id", "batch"), ["doc_id", "batch"], "left_anti").select("doc_id", "batch")
    each = index.postings.select("bucket", "term", "block", "batch", each_posting()).join(old, ["doc_id", "batch"], "left_anti")
    return Index(in_blocks(each), last.select("doc_id", "length", "batch"))


def saturated(tf: Column, length: Column, mean: float) -> Column:
    """What a term's count in a document of this length makes of its weight: grows with the count, falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def scored(found: pa.Table, weights: pa.Table, mean: float, k: int | None) -> pa.Table:
    """(question_id, doc_id, score) of the postings of some documents for some questions, as ``Search.reaching`` has them."""
    questions, row = np.unique(weights.column("question_id").to_numpy(), return_inverse=True)
    names = weights.column("term").combine_chunks().unique()
    code = pc.index_in(found.column("term"), value_set=names).to_numpy()
    order = np.argsort(code, kind="stable")
    lists = [found.column(c).take(pa.array(order)).combine_chunks() for c in ("ids", "tfs", "sizes")]
    ids, tfs, sizes = (x.flatten().to_numpy() for x in lists)
    docs, at = np.unique(ids, return_inverse=True)
    part = tfs * (K1 + 1) / (tfs + K1 * (1 - B + B * sizes / mean))
    n = np.bincount(np.repeat(code[order], pc.list_value_length(lists[0]).to_numpy()), minlength=len(names))
    upto = np.concatenate([[0], np.cumsum(n)])
    term, idf = pc.index_in(weights.column("term"), value_set=names).to_numpy(), weights.column("idf").to_numpy()
    leads = weights.column("leads").to_numpy()
    total = np.zeros((len(questions), len(docs)))
    for q, t, w in zip(row[leads], term[leads], idf[leads], strict=True):
        mine = slice(upto[t], upto[t + 1])
        total[q, at[mine]] += w * part[mine]
    floor, rest = (np.zeros(len(questions)) for _ in range(2))
    floor[row], rest[row] = weights.column("floor").to_numpy(), weights.column("rest").to_numpy()
    left = [np.flatnonzero((t > 0) & (t + r >= f)) for t, r, f in zip(total, rest, floor, strict=True)]
    of_term = np.zeros(len(docs))
    others = np.flatnonzero(~leads & (np.array([len(x) for x in left], np.int64)[row] > 0))
    for i in others[np.argsort(term[others], kind="stable")]:
        mine = slice(upto[term[i]], upto[term[i] + 1])
        of_term[at[mine]] = part[mine]
        total[row[i], left[row[i]]] += idf[i] * of_term[left[row[i]]]
        of_term[at[mine]] = 0
    kept = [likely(docs[x], t[x], f, k) for x, t, f in zip(left, total, floor, strict=True)]
    ids, scores = (np.concatenate([np.zeros(0, kind), *(x[i] for x in kept)]) for i, kind in ((0, np.int64), (1, np.float64)))
    return pa.table({"question_id": np.repeat(questions, [len(x[0]) for x in kept]), "doc_id": ids, "score": scores})


def likely(docs: np.ndarray, scores: np.ndarray, floor: float, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The documents that reach the floor, or that can be among the k best: of equal scores those with the smaller ids."""
    kept = scores >= floor
    docs, scores = docs[kept], scores[kept]
    if k is None or not len(docs):
        return docs, scores
    order = np.lexsort((docs, -scores))
    docs, scores = docs[order], scores[order]
    place = np.arange(len(docs)) - np.searchsorted(-scores, -scores)
    kept = (place < k) & (scores >= scores[min(k, len(scores)) - 1] - SLACK)
    return docs[kept], scores[kept]


class Search:
    """Questions (question_id, text) put to an index. Ties in score, at six digits, go to the smaller doc_id."""

    def __init__(self, index: Index, questions: DataFrame):
        n, mean = index.lengths.agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(1.0))).first()
        self.n, self.mean = n, mean or 1.0
        asked = asked_terms(questions)
        # bounds need no arrays of postings
        places = asked.select("term").distinct()
        self.postings = index.postings
        blocks = index.postings.select("term", "n", "most_tf", "least_length").join(places, "term", "left_semi")
        top = saturated(F.col("most_tf"), F.col("least_length"), self.mean)
        stats = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max(top).alias("top"))
        idf = F.log(1.0 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = asked.join(stats, "term").select("question_id", "term", "df", idf.alias("idf"), (idf * F.col("top")).alias("bound"))
        self.weights = stored(weights)

    def _entries(self, weights: DataFrame, found: DataFrame | None = None) -> DataFrame:
        """(question_id, doc_id, part) of all postings of some questions' terms."""
        every = (found if found is not None else self.postings).join(weights.select("question_id", "term", "idf"), "term")
        each = every.select("question_id", "term", "idf", each_posting())
        return each.select("question_id", "doc_id", (F.col("idf") * saturated(F.col("tf"), F.col("length"), self.mean)).alias("part"))

    def rare(self, k: int) -> DataFrame:
        """The weights of each question's rarest terms, as many as hold some ``k`` documents."""
        before = F.sum("df").over(Window.partitionBy("question_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
        return self.weights.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 4 * k)

    def floors(self, k: int) -> DataFrame:
        """(question_id, floor): k documents have at least this score.

        Of the documents that hold a question's rarest terms the best by these alone are
        scored by all terms; the k-th of them is a floor under the k-th of all.
        """
        part = self._entries(self.rare(k)).groupBy("question_id", "doc_id").agg(F.sum("part").alias("part"))
        first = lambda score: F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(score)))
        likely = part.withColumn("n", first("part")).where(F.col("n") <= 2 * k)
        scored = self.scores_of(stored(likely.select("question_id", "doc_id")))
        return scored.withColumn("n", first("score")).where(F.col("n") <= k).where(F.col("n") == k).select("question_id", F.col("score").alias("floor"))

    def split(self, floors: DataFrame, how: str = "left") -> DataFrame:
        """The weights with their question's floor (none: 0) and whether the term brings candidates.

        Terms are taken from the smallest bound up; those whose sum of bounds stays under the
        floor bring none, as a document with no other term can't reach it.
        """
        at = self.weights.join(floors, "question_id", how).withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
        upto = F.sum("bound").over(Window.partitionBy("question_id").orderBy("bound", "term"))
        return at.withColumn("upto", upto).withColumn("leads", F.col("upto") >= F.col("floor"))

    def reaching(self, floors: DataFrame, how: str = "left", k: int | None = None) -> DataFrame:
        """(question_id, doc_id, score) of every document whose score is at least its question's floor, and of some below.

        Questions without a floor have all their documents, or with ``how`` "inner" none. Given
        ``k``, of each group of documents only those that can be among the k best.
        Postings of the questions' terms are dealt once, by hashes of their blocks, to groups of
        about ``GROUP`` documents and ``ASKED`` questions. There candidates come from the
        leading terms; the others are looked up for those that can still reach the floor.
        """
        weights = self.split(floors, how)
        rest = F.coalesce(F.max(F.when(~F.col("leads"), F.col("upto"))).over(Window.partitionBy("question_id")), F.lit(0.0))
        weights = stored(weights.select("question_id", "term", "idf", "floor", "leads", rest.alias("rest")))
        questions = weights.select("question_id").distinct().count()
        groups, parts = 1 + self.n // GROUP, 1 + questions // ASKED
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        # a number of partitions of its own, as postings are small for what is made of them
        partitions = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        part = weights.withColumn("q", dealt("question_id", parts))
        found = self.postings.select("term", "block", "ids", "tfs", "sizes").join(stored(part.select("term", "q").distinct()), "term").select(dealt("block", groups).alias("d"), "q", "term", "ids", "tfs", "sizes")
        every = part.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        mean = self.mean

        def score(a: pa.Table, b: pa.Table) -> pa.Table:
            return scored(a, b, mean, k)

        left, right = (df.repartition(partitions, "d", "q").groupBy("d", "q") for df in (found, every))
        return left.cogroup(right).applyInArrow(score, SCORED)

    def _looked_up(self, pairs: DataFrame, weights: DataFrame) -> DataFrame:
        """(question_id, doc_id, part) of these pairs (question_id, doc_id) for these terms."""
        asked = stored(pairs.join(weights.select("question_id", "term", "idf"), "question_id").select("question_id", "doc_id", "term", "idf", block_of(F.col("doc_id")).alias("block")))
        found = asked.join(self.postings.select("term", "block", "ids", "tfs", "sizes"), ["term", "block"])
        at = found.withColumn("at", F.array_position("ids", F.col("doc_id")).cast("int")).where("at > 0")
        part = F.col("idf") * saturated(F.element_at("tfs", F.col("at")), F.element_at("sizes", F.col("at")), self.mean)
        return at.select("question_id", "doc_id", part.alias("part"))

    def scores_of(self, pairs: DataFrame) -> DataFrame:
        """(question_id, doc_id, score) of the pairs (question_id, doc_id) that share a term."""
        return self._looked_up(pairs.select("question_id", "doc_id").distinct(), self.weights).groupBy("question_id", "doc_id").agg(F.sum("part").alias("score"))

    def best(self, k: int) -> DataFrame:
        """(question_id, doc_id, score, rank) of the k best documents of every question."""
        order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
        return self.reaching(self.floors(k), k=k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def best_of_all(self, k: int) -> DataFrame:
        """``best`` by the scores of all pairs that share a term, without a floor."""
        order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
        none = self.weights.select("question_id", F.lit(0.0).alias("floor")).limit(0)
        return self.reaching(none, k=k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def ranks(self, held: DataFrame) -> DataFrame:
        """(question_id, containing, rank) of held (question_id, doc_id): how many documents, and the rank of the first of them.

        Only documents that score at least as much as the best one held are looked for. The
        rank is null where none of those held shares a term.
        """
        own = stored(held.select("question_id", "doc_id").distinct())
        many = own.groupBy("question_id").agg(F.count("*").alias("containing"))
        minus = (-F.round("score", 6)).alias("minus")
        best = stored(self.scores_of(own).groupBy("question_id").agg(F.min(F.struct(minus, "doc_id")).alias("best"), F.max("score").alias("floor")))
        near = self.reaching(best.select("question_id", "floor"), "inner").join(best, "question_id").where(F.struct(minus, "doc_id") <= F.col("best"))
        return many.join(near.groupBy("question_id").agg(F.count("*").alias("rank")), "question_id", "left")

    def work(self, k: int) -> DataFrame:
        """(all_postings, read_first, read_leading): how many postings share a term with a question, and how many ``best`` scores for floors and candidates."""
        size = lambda w, name: w.agg(F.coalesce(F.sum("df"), F.lit(0)).alias(name))
        one = F.broadcast(size(self.rare(k), "read_first")).crossJoin(F.broadcast(size(self.split(self.floors(k)).where("leads"), "read_leading")))
        return size(self.weights, "all_postings").crossJoin(one)


POSTINGS = "term string, block bigint, n bigint, most_tf bigint, least_length bigint, ids array<bigint>, tfs array<bigint>, sizes array<bigint>, batch bigint, bucket int"


def written(spark: SparkSession, place: str) -> Index:
    """All that was written to a folder in batches."""
    return Index(spark.read.schema(POSTINGS).parquet(f"{place}/postings"), spark.read.schema("doc_id bigint, length bigint, batch bigint").parquet(f"{place}/lengths"))


def opened(spark: SparkSession, place: str) -> Index:
    """The index that was written to a folder in batches, each document as its last batch left it."""
    return replaced(written(spark, place))
