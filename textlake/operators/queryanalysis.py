"""How queries are understood: tokens, stop words, lemmas, what is unknown, corrected, and meant as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import suggest

INFO = "form string, lemma string, pos string, score double"


def word_info(words: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """words(word) -> (word, lemma, pos) of the best reading in known(form, lemma, pos, score), of equal ones the first by
    lemma and part of speech; a word without one is its own lemma, its part of speech null."""
    asked = words.select("word").distinct()
    if known is None:
        return asked.select("word", F.col("word").alias("lemma"), F.lit(None).cast("string").alias("pos"))
    best = known.groupBy("form").agg(F.min(F.struct((-F.col("score")).alias("order"), "lemma", "pos")).alias("x"))
    return asked.join(best, F.col("word") == F.col("form"), "left").select("word", F.coalesce("x.lemma", "word").alias("lemma"), "x.pos")


def _by_query(rows: DataFrame, name: str, value: Column) -> DataFrame:
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos_", value.alias("v")))).alias(name)).select("query_id", F.transform(name, lambda x: x["v"]).alias(name))


def analyze(queries: DataFrame, lemmas: DataFrame, vocabulary: DataFrame, stop: DataFrame, synonyms: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """queries(query_id, text) -> (query_id, text, tokens, stop_words, morphology, lemmas, unknown, corrections, synonyms,
    corrected, expansions).

    lemmas(lemma) are those of the index, vocabulary(form, freq) its forms, stop(word), synonyms(lemma, synonym), known as in
    word_info(). Words that are no stop words and significant have a place in morphology (word, lemma, pos, in_index);
    lemmas are each once, in order; those not in the index are unknown. corrections map unknown words, synonyms map lemmas
    to those in the index; expansions are both, by lemma. In `corrected` every correction is put in. Null texts have
    empty lists.
    """
    rows = queries.select("query_id", "text", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    each = rows.select("query_id", F.posexplode("tokens").alias("pos_", "word"))
    gone = stop.select(F.lower("word").alias("word")).distinct().withColumn("_stop", F.lit(True))
    each = each.join(gone, "word", "left").withColumn("_stop", F.coalesce("_stop", F.lit(False)))
    stops = _by_query(each.filter("_stop"), "stop_words", F.col("word"))
    meant = each.filter(~F.col("_stop") & T.is_significant(F.col("word")))
    info = word_info(meant, known).join(lemmas.select("lemma").distinct().withColumn("in_index", F.lit(True)), "lemma", "left")
    meant = meant.join(info.withColumn("in_index", F.coalesce("in_index", F.lit(False))), "word")
    morphology = _by_query(meant, "morphology", F.struct("word", "lemma", "pos", "in_index"))
    fixed = suggest.corrections(meant.filter("NOT in_index").select("word"), vocabulary).select("word", "correction").filter("word <> correction")
    corrected = meant.filter("NOT in_index").select("query_id", "word", "lemma").distinct().join(fixed, "word")
    right = word_info(corrected.select(F.col("correction").alias("word")), known).select(F.col("word").alias("correction"), F.col("lemma").alias("_right"))
    corrected = corrected.join(right, "correction")
    pairs = corrected.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("word", "correction"))).alias("fixes"))
    inside = synonyms.join(lemmas.select(F.col("lemma").alias("synonym")).distinct(), "synonym")
    others = meant.select("query_id", "lemma").distinct().join(inside, "lemma").select("query_id", "lemma", "synonym")
    also = others.groupBy("query_id", "lemma").agg(F.array_sort(F.collect_set("synonym")).alias("s")).groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lemma", "s")))).alias("synonyms"))
    more = others.union(corrected.select("query_id", "lemma", F.col("_right").alias("synonym")))
    wide = more.groupBy("query_id", "lemma").agg(F.array_sort(F.collect_set("synonym")).alias("s")).groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lemma", "s")))).alias("expansions"))
    out = rows
    for part in (stops, morphology, pairs, also, wide):
        out = out.join(part, "query_id", "left")
    none = F.array().cast("array<string>")
    forms = F.coalesce("morphology", F.array().cast("array<struct<word string, lemma string, pos string, in_index boolean>>"))
    fixes = F.coalesce("fixes", F.array().cast("array<struct<word string, correction string>>"))
    table = "map<string, array<string>>"
    return out.select(
        "query_id", "text", "tokens", F.coalesce("stop_words", none).alias("stop_words"), forms.alias("morphology"),
        F.array_distinct(F.transform(forms, lambda m: m["lemma"])).alias("lemmas"), F.transform(F.filter(forms, lambda m: ~m["in_index"]), lambda m: m["word"]).alias("unknown"),
        F.map_from_entries(fixes).alias("corrections"), F.coalesce("synonyms", F.create_map().cast(table)).alias("synonyms"),
        F.aggregate(fixes, F.col("text"), lambda t, f: F.replace(t, f["word"], f["correction"])).alias("corrected"), F.coalesce("expansions", F.create_map().cast(table)).alias("expansions"),
    )


def logged(log: DataFrame, analysed: DataFrame, counts: DataFrame) -> DataFrame:
    """The log (raw_query, normalized, results_count) with a row more for every analysed query: its text, its lemmas, and
    how many results counts(query_id, n) gives it, 0 without a row there."""
    new = analysed.join(counts, "query_id", "left").select(F.col("text").alias("raw_query"), F.array_join("lemmas", " ").alias("normalized"), F.coalesce("n", F.lit(0)).cast("long").alias("results_count"))
    return log.select("raw_query", "normalized", "results_count").unionAll(new)
