"""The inverted index as tables: postings, vocabulary, documents, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.session import cut

#: A word is common if it is in at least one of so many documents. There are at most that many times a document's mean
#: number of different words of them, whatever the number of documents; in practice far fewer.
COMMON = 10_000


def term_frequencies(docs: DataFrame, text: str = "text", key: str = "doc_id", stop_words: tuple[str, ...] = (), lemmas: DataFrame | None = None) -> DataFrame:
    """(doc_id, lemma, tf): significant tokens counted; lemmas(form, lemma) replaces forms it knows.

    Texts are dealt by key, once; words are counted where they lie then, and so is whatever is grouped by doc_id later.
    """
    words = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).repartition("doc_id").select("doc_id", F.explode(T.tokens("text")).alias("form")).filter(T.is_significant(F.col("form"), stop_words))
    if lemmas is not None:
        words = words.groupBy("doc_id", "form").agg(F.count("*").alias("n")).join(lemmas, "form", "left")
        return words.groupBy("doc_id", F.coalesce("lemma", "form").alias("lemma")).agg(F.sum("n").alias("tf"))
    return words.groupBy("doc_id", F.col("form").alias("lemma")).agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(lemma, df): in how many documents a lemma is."""
    return tf.groupBy("lemma").agg(F.count("*").alias("df"))


def with_df(tf: DataFrame, documents: DataFrame, count: Column | None = None) -> DataFrame:
    """tf(lemma, ...) with df and the number of documents, from the one row of documents(documents). df is the number of a
    lemma's rows, or the given aggregate of them.

    Most rows have one of the common words: these are broadcast, so such rows stay where they are, and a word of every
    document is no hot key. The rare words' rows are shuffled to their frequencies and need no sorting there.
    """
    df = (document_frequencies(tf) if count is None else tf.groupBy("lemma").agg(count.alias("df"))).crossJoin(F.broadcast(documents))
    often = F.col("df") * COMMON >= F.col("documents")
    common = F.broadcast(df.filter(often))
    rest = tf.join(F.broadcast(df.filter(often).select("lemma")), "lemma", "left_anti")
    return tf.join(common, "lemma").unionByName(rest.join(df.filter(~often).hint("shuffle_hash"), "lemma"))


def build(docs: DataFrame, text: str = "text", key: str = "doc_id", wanted: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(postings, documents): (lemma, doc_id, tf, df, idf, weight) with weight = tf * log10(N / df), and
    (doc_id, term_count, norm) with the Euclidean norm of each document's weights.

    Every document counts in N, with or without terms; those without have norm 0. The count of documents is
    a one-row side, joined without a key. Frequencies are written once and read by all that follows.

    wanted(lemma, ...), a few beside the index's: postings are those of its lemmas only, found without moving any; norms
    are of all lemmas.
    """
    tf = cut(term_frequencies(docs, text, key, **options))
    total = docs.agg(F.count("*").alias("documents"))
    idf = T.inverse_frequency(F.col("documents"), F.col("df"))
    weighed = lambda rows: rows.select("lemma", "doc_id", "tf", "df", idf.alias("idf"), (F.col("tf") * idf).alias("weight"))
    postings = weighed(with_df(tf, total))
    sizes = postings.groupBy("doc_id").agg(F.sum("tf").alias("term_count"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    documents = docs.select(F.col(key).alias("doc_id")).join(sizes, "doc_id", "left").select("doc_id", F.coalesce("term_count", F.lit(0)).alias("term_count"), F.coalesce("norm", F.lit(0.0)).alias("norm"))
    if wanted is not None:
        few = document_frequencies(tf.join(F.broadcast(wanted.select("lemma").distinct()), "lemma", "left_semi")).crossJoin(F.broadcast(total))
        postings = weighed(tf.join(F.broadcast(few), "lemma"))
    return postings, documents


def tf_norms(tf: DataFrame) -> DataFrame:
    """(doc_id, norm) of plain frequencies."""
    return tf.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))


def top_terms(postings: DataFrame, limit: int = 20) -> DataFrame:
    """Most frequent lemmas: total frequency, documents, largest weight."""
    found = postings.groupBy("lemma").agg(F.sum("tf").alias("tf_total"), F.count("*").alias("df"), F.max("weight").alias("max_weight"))
    return found.orderBy(F.desc("tf_total"), "lemma").limit(limit)


def form_vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(form, freq) over all documents."""
    return docs.select(F.explode(T.tokens(text)).alias("form")).filter(F.length("form") >= 2).groupBy("form").agg(F.count("*").alias("freq"))


def summary(docs: DataFrame, tf: DataFrame, host: str = "source") -> DataFrame:
    """One row of collection figures."""
    own = docs.agg(F.count("*").alias("documents"), F.countDistinct(host).alias("hosts"), F.round(F.avg(F.length("text")), 1).alias("mean_chars"), F.sum(F.length("text")).alias("chars"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("empty"))
    terms = tf.agg(F.countDistinct("lemma").alias("lemmas"), F.count("*").alias("postings"), F.sum("tf").alias("tokens"))
    return own.crossJoin(terms)


def size(docs: DataFrame) -> Column:
    """The number of documents, as a scalar subquery: nothing runs while a plan is made."""
    return docs.agg(F.count("*")).scalar()


def popular_queries(log: DataFrame, limit: int = 10) -> DataFrame:
    """log(id, raw_query, results_count): queries that found something, by how often; later ones first on ties."""
    found = log.filter("results_count > 0").groupBy(F.lower("raw_query").alias("query"))
    return found.agg(F.count("*").alias("n"), F.max("results_count").alias("found"), F.max("id").alias("last_id"), F.max_by("raw_query", "id").alias("raw_query")).orderBy(F.desc("n"), F.desc("last_id")).limit(limit)


def host_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """Documents and characters by host."""
    return docs.groupBy(host).agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))
