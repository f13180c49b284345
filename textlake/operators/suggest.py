"""Help with queries: completion, spelling, synonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import udfs


def autocomplete(prefixes: DataFrame, history: DataFrame, vocabulary: DataFrame, limit: int = 8) -> DataFrame:
    """prefixes(prefix) -> (prefix, rank, suggestion): past queries first, by use, then forms by frequency.

    history(query, n) and vocabulary(form, freq). A suggestion in both counts as a query. Both sides meet on
    the prefix's first two characters, so no pair of different beginnings is compared.
    """
    start = lambda c: F.substring(c, F.lit(1), F.lit(2))
    offers = history.select(F.col("query").alias("suggestion"), F.lit(0).alias("kind"), F.col("n").cast("long").alias("weight")).unionByName(vocabulary.select(F.col("form").alias("suggestion"), F.lit(1).alias("kind"), F.col("freq").cast("long").alias("weight")))
    asked = prefixes.filter(F.length("prefix") >= 2).distinct().withColumn("start", start(F.col("prefix")))
    met = offers.withColumn("start", start(F.col("suggestion"))).join(asked, "start").filter(F.startswith("suggestion", "prefix"))
    best = met.groupBy("prefix", "suggestion").agg(F.min_by(F.struct("kind", "weight"), F.struct("kind", -F.col("weight"))).alias("own")).select("prefix", "suggestion", "own.kind", "own.weight")
    order = Window.partitionBy("prefix").orderBy("kind", F.desc("weight"), "suggestion")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("prefix", "rank", "suggestion", "kind", "weight")


def unknown_words(words: DataFrame, forms: DataFrame, lemmas: DataFrame) -> DataFrame:
    """words(word) that are neither a form nor a lemma."""
    return words.distinct().join(forms, F.col("word") == F.col("form"), "left_anti").join(lemmas, F.col("word") == F.col("lemma"), "left_anti")


def _deleted(word, edits: int):
    """The word and every string left by deleting up to `edits` (1 or 2) of its characters."""
    drop = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    once = drop(word)
    return F.array_distinct(F.concat(F.array(word), once, F.flatten(F.transform(once, lambda w: F.when(F.length(w) > 0, drop(w)).otherwise(F.array().cast("array<string>")))))) if edits > 1 else F.array_distinct(F.concat(F.array(word), once))


def corrections(words: DataFrame, vocabulary: DataFrame, most: int = 2, short: int = 5, least: int = 4) -> DataFrame:
    """words(word) -> (word, correction, distance, freq): the nearest form of vocabulary(form, freq).

    The distance counts a swap of neighbours as one edit (optimal string alignment). Words of fewer than
    `least` letters have no correction; words of up to `short` letters take one edit and keep their first
    letter, longer ones up to `most`. Nearest first, then most frequent, then by name. Two strings within k
    edits, swaps included, share a string left by at most k deletions of each, so the sides meet by
    equality on those instead of all against all. Words are a query's: few.
    """
    first = lambda c: F.substring(c, F.lit(1), F.lit(1))
    size = F.length("word")
    asked = words.filter(size >= least).distinct().withColumn("key", F.explode(_deleted(F.col("word"), most)))
    offers = vocabulary.filter(F.length("form").between(1, 40)).withColumn("key", F.explode(_deleted(F.col("form"), most)))
    met = asked.join(offers, "key").filter((size > short) | (first("word") == first("form"))).select("word", "form", "freq").distinct()
    allowed = F.when(size <= short, 1).otherwise(most)
    near = met.filter(F.abs(size - F.length("form")) <= allowed).withColumn("distance", udfs.osa("word", "form"))
    order = Window.partitionBy("word").orderBy("distance", F.desc("freq"), "form")
    best = near.filter((F.col("distance") <= allowed) & (F.col("distance") > 0)).withColumn("n", F.row_number().over(order))
    return best.filter("n = 1").select("word", F.col("form").alias("correction"), "distance", "freq")


def thesaurus(groups: DataFrame) -> DataFrame:
    """groups(words array) -> (lemma, synonym), each word with the others of its groups."""
    g = groups.select("words")
    return g.select("words", F.explode("words").alias("lemma")).select("lemma", F.explode("words").alias("synonym")).filter("lemma <> synonym").distinct()
