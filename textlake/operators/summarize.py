"""Extractive summaries: layout, term weights, sentence weights, selection, keywords."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import index
from textlake.session import cut


def sentence_rows(docs: DataFrame, sentences: Column, key: str = "doc_id") -> DataFrame:
    """(doc_id, idx, text, start, start_in_par, par, doc_len, par_len): sentences of each line, with offsets.

    `sentences` maps the column `par_text` to an array of strings; a paragraph is a line. Offsets count
    sentence characters with one separator between neighbours.
    """
    lines = docs.select(F.col(key).alias("doc_id"), F.posexplode(T.blocks("text")).alias("par", "par_text"))
    rows = lines.select("doc_id", "par", F.posexplode(sentences).alias("at", "text"))
    w = Window.partitionBy("doc_id").orderBy("par", "at")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("doc_id", "par").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("text") + 1
    out = rows.select("doc_id", "par", "text", (F.row_number().over(w) - 1).alias("idx"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias("start"), F.coalesce(F.sum(size).over(inside), F.lit(0)).alias("start_in_par"), F.sum(size).over(Window.partitionBy("doc_id")).alias("doc_len"), F.sum(size).over(Window.partitionBy("doc_id", "par")).alias("par_len"))
    return out


def term_weights(tf: DataFrame, documents: Column) -> DataFrame:
    """tf(doc_id, lemma, tf) -> with weight = (1 + tf / largest tf) / 2 * ln(documents / df)."""
    return _weighted(tf, documents).filter("doc_id is not null").select("doc_id", "lemma", "tf", "df", "weight")


def _weighted(terms: DataFrame, documents: Column, **options) -> DataFrame:
    """terms(doc_id, lemma, tf, ...), written once, with df and weight."""
    made = cut(terms.withColumn("most", F.max("tf").over(Window.partitionBy("doc_id"))))
    rows = index.with_df(made, made.sparkSession.range(1).select(documents.alias("documents")), **options)
    return rows.withColumn("weight", 0.5 * (1 + F.col("tf") / F.col("most")) * F.log(F.col("documents") / F.col("df")))


def weigh_sentences(sentences: DataFrame, documents: Column, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """sentence_scores() with the term_weights() of the sentences' own words.

    A document's words stand together, so tf is summed beside them and their weights need no join of words to words; a
    document's sums come back as one row.
    """
    words = sentences.select("doc_id", "idx", F.explode(T.tokens("text")).alias("lemma")).filter(T.is_significant(F.col("lemma"), stop_words)).groupBy("doc_id", "idx", "lemma").agg(F.count("*").alias("n"))
    same = Window.partitionBy("doc_id", "lemma")
    terms = words.withColumns({"tf": F.sum("n").over(same), "first": (F.col("idx") == F.min("idx").over(same)).cast("int")})
    rows = _weighted(terms, documents, count=F.sum("first"))
    sums = rows.groupBy("doc_id", "idx").agg(F.sum(F.col("n") * F.col("weight")).alias("score"))
    own = sums.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "score"))).alias("_scores"))
    return _placed(sentences.join(own.hint("shuffle_hash"), "doc_id", "left").withColumn("score", F.try_element_at("_scores", F.col("idx"))))


def sentence_scores(sentences: DataFrame, weights: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, idx, score, pos_doc, pos_par, weight, rank): the sum of its terms' weights, times how early the
    sentence is in the document and in its paragraph; ranks from 1 by falling weight, then place."""
    words = sentences.select("doc_id", "idx", F.explode(T.tokens("text")).alias("lemma")).filter(T.is_significant(F.col("lemma"), stop_words)).groupBy("doc_id", "idx", "lemma").agg(F.count("*").alias("n"))
    sums = words.join(weights, ["doc_id", "lemma"]).groupBy("doc_id", "idx").agg(F.sum(F.col("n") * F.col("weight")).alias("score"))
    return _placed(sentences.join(sums, ["doc_id", "idx"], "left"))


def _placed(scored: DataFrame) -> DataFrame:
    rows = scored.na.fill(0.0, ["score"])
    d, p = 1 - F.col("start") / F.col("doc_len"), 1 - F.col("start_in_par") / F.col("par_len")
    full = rows.withColumns({"pos_doc": d, "pos_par": p}).withColumn("weight", F.col("score") * F.col("pos_doc") * F.col("pos_par"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "idx"))
    return full.withColumn("rank", rank).select("doc_id", "idx", "text", "score", "pos_doc", "pos_par", "weight", "rank")


def select(scores: DataFrame, count: int = 10, method: str = "extraction") -> DataFrame:
    """(doc_id, idx, text, method): the chosen sentences; weights tie at nine digits. Methods: extraction, score, position, lead, random (by hash)."""
    order = {"extraction": [F.desc(F.round("weight", 9)), "idx"], "score": [F.desc("score"), "idx"], "position": [F.desc(F.col("pos_doc") * F.col("pos_par")), "idx"], "lead": ["idx"], "random": [F.xxhash64("doc_id", "idx"), "idx"]}[method]
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return scores.withColumn("n", n).filter(F.col("n") <= count).select("doc_id", "idx", "text", F.lit(method).alias("method"))


def summaries(chosen: DataFrame) -> DataFrame:
    """(doc_id, sentences, chars, summary): chosen sentences in the order of the text."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"])
    return chosen.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("text")).alias("chars"), F.array_join(in_order, " ").alias("summary"))


def oracle_selection(sentences: DataFrame, references: DataFrame, count: int = 10) -> DataFrame:
    """(doc_id, step, idx): sentences taken one by one, each the one that adds most reference words (ties: the first).

    sentences(doc_id, idx, words), references(doc_id, words); greedy within a document, one group each.
    """

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        left: dict[str, int] = {}
        for w in pdf["reference"].iloc[0]:
            left[w] = left.get(w, 0) + 1
        rows, out = pdf.sort_values("idx"), []
        pool = {int(r.idx): list(r.words) for r in rows.itertuples()}
        while pool and len(out) < count:
            gains = {i: _gain(w, left) for i, w in pool.items()}
            best = max(gains, key=lambda i: (gains[i], -i))
            if not gains[best]:
                break
            for w in pool.pop(best):
                if left.get(w, 0):
                    left[w] -= 1
            out.append((int(pdf["doc_id"].iloc[0]), len(out) + 1, best))
        return pd.DataFrame(out, columns=["doc_id", "step", "idx"])

    both = sentences.join(references.select("doc_id", F.col("words").alias("reference")), "doc_id")
    return both.groupBy("doc_id").applyInPandas(greedy, "doc_id long, step int, idx int")


def _gain(words: list[str], left: dict[str, int]) -> int:
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    return sum(min(n, left.get(w, 0)) for w, n in seen.items())


def keywords(weights: DataFrame, top: int = 10) -> DataFrame:
    """(doc_id, rank, lemma, weight): heads by tf times weight; a lemma that contains a heavier chosen one, or is
    contained in it, is passed over, and its place goes to the next (compounds of one head)."""
    value = weights.select("doc_id", F.struct((-F.col("tf") * F.col("weight")).alias("order"), "lemma").alias("x")).filter("x.order < 0 AND length(x.lemma) > 2")
    sorted_ = value.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # a document's vocabulary
    free = lambda acc, x: ~F.exists(acc, lambda h: h["lemma"].contains(x["lemma"]) | x["lemma"].contains(h["lemma"]))
    take = lambda acc, x: F.when(F.size(acc) >= top, acc).when(free(acc, x), F.array_append(acc, x)).otherwise(acc)
    chosen = F.aggregate("xs", F.array().cast("array<struct<order double, lemma string>>"), take)
    each = sorted_.select("doc_id", F.posexplode(chosen).alias("rank", "x"))
    return each.select("doc_id", (F.col("rank") + 1).alias("rank"), "x.lemma", (-F.col("x.order")).alias("weight"))


def phrases(tokens: DataFrame, least: int = 2) -> DataFrame:
    """tokens(doc_id, pos, word) -> (doc_id, phrase, freq): neighbouring pairs that repeat in a document."""
    after = F.lead("word").over(Window.partitionBy("doc_id").orderBy("pos"))
    pairs = tokens.withColumn("after", after).filter("after is not null")
    return pairs.groupBy("doc_id", F.concat_ws(" ", "word", "after").alias("phrase")).agg(F.count("*").alias("freq")).filter(F.col("freq") >= least)


def group_means(scores: DataFrame, *values: str) -> DataFrame:
    """Means over all, each language, each domain and both together; null values don't count."""
    return scores.cube("language", "domain").agg(F.count("*").alias("documents"), *[F.avg(v).alias(v) for v in values])
