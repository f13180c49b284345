"""Reports: how profiles overlap, sizes of documents, frequent words, leftovers of normalization, who wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T


def profile_overlap(documents: DataFrame, languages: DataFrame, least: float = 0.0) -> DataFrame:
    """Profiles (owner, feature, n, weight) of documents and languages -> (owner, lang, found, missing, share, coverage): how
    many of a document's features a language has with at least that weight, and their weight in the document, added
    as counts, so that no order rounds. Pairs without a
    common feature are left out. Languages' profiles are few and bounded; documents' are read once, and met where they are made."""
    theirs = languages.filter(F.col("weight") >= least).select(F.col("owner").alias("lang"), "feature", F.lit(True).alias("_met"))
    every = documents.select("owner", "feature", "n", "weight").crossJoin(F.broadcast(theirs.select("lang").distinct()))
    met = every.join(F.broadcast(theirs), ["lang", "feature"], "left")
    hit = lambda c: F.when(F.col("_met"), c)
    sums = met.groupBy("owner", "lang").agg(F.count("*").alias("_n"), F.count("_met").alias("found"), F.sum(hit(F.col("n"))).alias("_uses"), F.max(hit(F.col("n") / F.col("weight"))).alias("_all")).filter("found > 0")
    return sums.select("owner", "lang", "found", (F.col("_n") - F.col("found")).alias("missing"), (F.col("found") / F.col("_n")).alias("share"), (F.col("_uses") / F.round("_all")).alias("coverage"))


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, paragraphs, sentences, words, chars) of each document; null texts have none."""
    blocks = T.let(F.coalesce(F.col(text), F.lit("")), T.blocks)
    sentences = F.aggregate(F.transform(blocks, lambda b: F.size(T.simple_sentences(b))), F.lit(0), lambda a, n: a + n)
    count = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    return docs.select(key, count(F.size(blocks)).alias("paragraphs"), count(sentences).alias("sentences"), count(F.size(T.tokens(F.coalesce(text, F.lit(""))))).alias("words"), count(F.length(text)).alias("chars"))


def frequent_words(words: DataFrame, by: str, least: int = 2, limit: int = 1500) -> DataFrame:
    """words(by, word) -> (by, word, n, rank): each group's `limit` most frequent words, ties by the word."""
    counts = words.groupBy(by, "word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "word")))
    return ranked.filter(F.col("rank") <= limit)


def leftover_share(text: Column | str) -> Column:
    """Share of tokens between white space that still hold a digit or a sign which should have been read out; no token: 0."""
    parts = F.filter(F.split(F.col(text) if isinstance(text, str) else text, r"\s+"), lambda p: p != "")
    return T.let(parts, lambda p: F.coalesce(F.try_divide(F.size(F.filter(p, lambda t: t.rlike(r"[0-9%&§€$+=<>#@]"))), F.size(p)), F.lit(0.0)))


def head_to_head(scores: DataFrame, first: str, second: str, margin: float, *by: str) -> DataFrame:
    """Wins, losses and ties of the first score; a difference of at most margin is a tie. Rows with a null score don't count."""
    gap = F.col(first) - F.col(second)
    return scores.groupBy(*by).agg(F.count_if(gap > margin).alias("wins"), F.count_if(gap < -margin).alias("losses"), F.count_if(F.abs(gap) <= margin).alias("ties"))
