"""Lexical scoring, phrase containment and retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X

K1, B = 1.5, 0.75


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of docs (doc_id, text)."""
    return docs.select("doc_id", F.explode(X.terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame) -> DataFrame:
    return term_counts(docs).groupBy("term").agg(F.count("*").alias("df"))


def asked_terms(questions: DataFrame) -> DataFrame:
    """(question_id, term), each of a question's terms once."""
    return questions.select("question_id", F.explode(F.array_distinct(X.terms(F.col("text")))).alias("term"))


def weighted(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(doc_id, term, part): what each of the needed terms (a column ``term``) adds to the score of docs (doc_id, text).

    Tokens of other terms go before the one shuffle, by document; all that is counted of a
    document is then counted where it lies, and so are the scores of ``bm25``. How many
    documents hold a term is counted on the same shuffle, which Spark runs once, as both
    sides ask for the same columns.
    """
    sized = docs.select("doc_id", X.terms(F.col("text")).alias("terms")).withColumn("length", F.size("terms"))
    tokens = sized.select("doc_id", "length", F.explode("terms").alias("term")).join(needed.select("term").distinct(), "term", "left_semi").repartition("doc_id")
    counts = tokens.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = counts.groupBy("term").agg(F.count(F.when((F.col("tf") > 0) & (F.col("length") > 0), 1)).alias("df"))
    total = sized.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return counts.join(df, "term").crossJoin(F.broadcast(total)).select("doc_id", "term", part.alias("part"))


def bm25(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, doc_id, score) of every pair that shares a term.

    A question counts each of its terms once. Only counts of the questions' terms are
    joined, so the work follows the postings of those terms, not all pairs.
    """
    asked = asked_terms(questions)
    return weighted(docs, asked).join(asked, "term").groupBy("question_id", "doc_id").agg(F.sum("part").alias("score"))


def best_lexical(docs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The k best documents of every question, by the scores of all pairs, from counts of the questions' terms alone.

    Texts without a value have no length and do not count in the mean.
    """
    from lectern.operators.postings import Index, Search, counted, lengths  # which needs this module
    from lectern.sources.tables import stored

    sized = lengths(docs.where("text is not null")).unionByName(docs.where("text is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("length")))
    return Search(Index(stored(counted(docs, asked_terms(questions))), sized), questions).best_of_all(k)


def containment(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(item_id, doc_id) where the document holds the phrase, both in lower case with single spaces.

    Normal forms are made once on each side. The inner words of a phrase are whole words of
    every text that holds it, so its longest inner word is a key: words of texts are joined to
    keys, however many these are, and only phrases whose key a text has are looked for in it. Phrases of one or two words
    have no inner word; they are looked for in every text, row by row.
    """
    words = F.split("needle", " ")
    inner = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct(-F.length(w), w.alias("w")))
    p = phrases.select("item_id", X.phrase(F.col("text")).alias("needle")).withColumn("key", F.try_element_at(F.array_sort(inner), F.lit(1))["w"])
    hay = X.phrase(F.col("text"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split(hay, " "))).alias("key"))
    likely = words.join(p, "key").select("doc_id", "item_id", "needle")
    found = docs.select("doc_id", "text").join(likely, "doc_id").where(F.contains(hay, "needle")).select("item_id", "doc_id")
    few = p.where("key is null and needle is not null")
    if few.isEmpty():
        return found
    short = few.agg(F.collect_list(F.struct("item_id", "needle")).alias("short")).scalar()
    every = docs.select("doc_id", hay.alias("hay"), F.explode(short).alias("short")).where(F.contains("hay", "short.needle"))
    return found.unionByName(every.select("short.item_id", "doc_id"))


def containment_indexed(docs: DataFrame, phrases: DataFrame, index) -> DataFrame:
    """``containment`` by an index of docs that has all terms of the phrases.

    The terms of a phrase's inner words are whole terms of every text that holds it, so only
    documents with the rarest of them are looked at. Phrases without one go to ``containment``.
    """
    from lectern.operators.postings import each_posting  # which needs this module
    from lectern.sources.tables import stored

    p = phrases.select("item_id", X.phrase(F.col("text")).alias("needle")).where("needle is not null")
    words = F.split("needle", " ")
    inner = F.array_distinct(X.terms(F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), " ")))
    each = stored(p.select("needle", inner.alias("terms")).distinct())
    terms = each.select("needle", F.explode("terms").alias("term"))
    df = index.postings.select("term", "n").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    rarest = terms.join(df, "term", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "term"))["term"].alias("term"))
    keys = stored(p.join(rarest, "needle").select("item_id", "needle", "term"))
    likely = stored(index.postings.join(keys, "term").select("item_id", "needle", each_posting()).select("doc_id", "item_id", "needle"))
    found = docs.select("doc_id", "text").join(likely, "doc_id").where(F.contains(X.phrase(F.col("text")), "needle")).select("item_id", "doc_id")
    rest = phrases.join(each.where("size(terms) = 0"), X.phrase(F.col("text")) == F.col("needle"), "left_semi")
    return found if rest.isEmpty() else found.unionByName(containment(docs, rest))


def quality_ranks(docs: DataFrame, cases: DataFrame) -> DataFrame:
    """For each case (item_id, text): how many of docs (doc_id, text) hold it and the first rank of one, by an index made of docs."""
    from lectern.operators.postings import Search, build  # which needs this module

    asked = cases.select(F.col("item_id").alias("question_id"), "text")
    index = build(docs, needed=asked_terms(asked))
    held = containment_indexed(docs, cases.where("text is not null"), index).withColumnRenamed("item_id", "question_id")
    found = Search(index, asked).ranks(held).withColumnRenamed("question_id", "item_id")
    return cases.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("containing", F.lit(0)).alias("containing"), "rank")


def quality_report(ranks: DataFrame) -> DataFrame:
    """coverage, hit@1, hit@3 and mean reciprocal rank; zeros without a case."""
    share = lambda c: F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0))
    return ranks.agg(
        share(F.col("containing") > 0).alias("coverage"),
        share(F.col("rank") <= 1).alias("hit_at_1"),
        share(F.col("rank") <= 3).alias("hit_at_3"),
        F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
    )
