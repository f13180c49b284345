"""Spoken commands with slots: templates, what was said against them by edit similarity, what fills the slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T

#: Leading words that may be passed over, and what each costs; the least score, and that of commands of up to SHORT letters.
SKIPS, SKIP_COST, LEAST, SHORT, SHORT_LEAST = 2, 0.04, 0.75, 5, 0.8
SLOT = r"\{([\p{L}\p{N}_]+)\}"


def parsed(templates: DataFrame, longest: int = 80) -> DataFrame:
    """templates(operation, text, slot: a name or null) -> with shape (its words, comparable, without the slot), slotted and
    error: why a template cannot be used, or null. A slot stands once, at the end, under the operation's name for it."""
    raw = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    found = F.regexp_extract_all(raw, F.lit(SLOT), F.lit(1))
    rest = F.regexp_replace(raw, SLOT, " ")
    shape = T.phrase(rest)
    marker = F.concat(F.lit("{"), "slot", F.lit("}"))
    error = (
        F.when(raw == "", "empty").when(F.length(raw) > longest, "too long").when(rest.rlike(r"[{}]"), "stray braces").when(shape == "", "no words")
        .when(F.col("slot").isNull() & (F.size(found) > 0), "no slot here").when(F.col("slot").isNotNull() & ((F.size(found) != 1) | (F.get(found, F.lit(0)) != F.col("slot")) | ~raw.endswith(marker)), "slot not at the end")
    )
    return templates.withColumns({"shape": shape, "slotted": F.col("slot").isNotNull(), "error": error})


def _words(text: Column, fillers: list[str]) -> Column:
    """(word, raw) of a phrase: comparable, and as heard."""
    heard = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    each = F.transform(heard, lambda w: F.struct(T.phrase(w).alias("word"), w.alias("raw")))
    return F.filter(each, lambda x: (x["word"] != "") & ~x["word"].contains(" ") & ~x["word"].isin(*fillers, "\0"))


def _heads(phrases: DataFrame, longest: int, slot_words: int, fillers: list[str]) -> DataFrame:
    """(phrase_id, variant, skipped, head, whole, said, rest): beginnings of a phrase that a command could be. All its words
    (whole), or as many as leave a slot of 1 to `slot_words`; with and without fillers and words passed over."""
    both = F.array(_words(F.col("text"), fillers), _words(F.col("text"), []))
    kept = F.filter(both, lambda x, i: (F.size(x) > 0) & ((i == 0) | (F.size(x) != F.size(F.get(both, F.lit(0))))))
    rows = phrases.select("phrase_id", F.posexplode(kept).alias("variant", "ws"))
    rows = rows.select("phrase_id", "variant", F.posexplode(F.transform(F.sequence(F.lit(0), F.least(F.lit(SKIPS), F.size("ws") - 1)), lambda k: F.slice("ws", k + 1, F.size("ws")))).alias("skipped", "ws"))
    n = F.size("ws")
    low, high = F.greatest(n - slot_words, F.lit(1)), F.least(n - 1, F.lit(longest))
    heads = F.concat(F.array(n), F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")))
    each = rows.select("phrase_id", "variant", "skipped", "ws", F.posexplode(heads).alias("at", "head"))
    said = F.array_join(F.transform(F.slice("ws", F.lit(1), F.col("head")), lambda x: x["word"]), " ")
    return each.select("phrase_id", "variant", "skipped", "head", (F.col("at") == 0).alias("whole"), said.alias("said"), F.slice("ws", F.col("head") + 1, n - F.col("head")).alias("rest"))


def candidates(phrases: DataFrame, templates: DataFrame, fillers: list[str] = ()) -> DataFrame:
    """phrases(phrase_id, text), templates(operation, place, number, shape, slotted, slot_words, mode) -> the best template
    of each operation for each phrase: (phrase_id, mode, operation, place, shape, score, skipped, slot, raw).

    A slotted template is held against a beginning of as many words, or one more or less, as it has; the rest, of 1 to
    slot_words words, is the slot. Of equal scores the template of more words is better, then the first in the order of
    variants (without fillers first), templates and words passed over. What is not similar by LEAST is left out.
    Beginnings and shapes meet by their lengths, of which only near ones can be similar, in a join of equal numbers.
    """
    sizes = templates.agg(F.max(F.size(F.split("shape", " "))).alias("words"), F.max(F.coalesce("slot_words", F.lit(0))).alias("slot")).first()
    heads = _heads(phrases, (sizes["words"] or 0) + 1, sizes["slot"] or 0, list(fillers))
    long = F.length("said")
    near = heads.withColumn("_size", F.explode(F.sequence(F.ceil(long * F.lit(LEAST)).cast("int"), F.floor(long / F.lit(LEAST)).cast("int"))))
    shapes = templates.select("operation", "place", "number", "mode", "shape", "slotted", "slot_words", F.size(F.split("shape", " ")).alias("n"), F.length("shape").alias("_size"))
    fits = F.when(F.col("slotted"), ~F.col("whole") & (F.abs(F.col("head") - F.col("n")) <= 1) & (F.size("rest") <= F.col("slot_words"))).otherwise(F.col("whole"))
    met = near.join(shapes, "_size").filter(fits).withColumn("like", T.similarity("said", "shape")).filter(F.col("like") >= LEAST)
    score = F.col("like") - SKIP_COST * F.col("skipped")
    # of one template and beginning the best number of words, the least of equals, before what is passed over counts
    order = Window.partitionBy("phrase_id", "operation").orderBy(F.desc("_key"), F.desc("n"), "variant", "number", "skipped", F.desc("like"), "head")
    best = met.withColumn("score", score).withColumn("_key", F.round("score", 6)).withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    slot = lambda c: F.when(F.col("slotted"), F.array_join(F.transform("rest", lambda x: x[c]), " "))
    return best.select("phrase_id", "mode", "operation", "place", "shape", "n", F.col("_key").alias("score"), "skipped", slot("word").alias("slot"), slot("raw").alias("raw"))


def match(phrases: DataFrame, templates: DataFrame, mode: str, fillers: list[str] = ()) -> DataFrame:
    """(phrase_id, operation, score, skipped, slot, raw): the operation of `mode` that a phrase calls, if any.

    It is the first, by score, words and place, whose score is enough for its template. A phrase that is nearer to an
    operation of another mode calls none: what ends a dictation does not begin one.
    """
    found = candidates(phrases, templates, fillers)
    enough = F.col("score") >= F.when(F.length("shape") <= SHORT, SHORT_LEAST).otherwise(LEAST)
    order = Window.partitionBy("phrase_id").orderBy(F.desc("score"), F.desc("n"), "place")
    own = found.filter((F.col("mode") == mode) & enough).withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    rivals = found.filter(F.col("mode") != mode).groupBy("phrase_id").agg(F.max("score").alias("_rival"))
    kept = own.join(rivals, "phrase_id", "left").filter(F.col("_rival").isNull() | (F.col("_rival") <= F.col("score")))
    return kept.select("phrase_id", "operation", "score", "skipped", "slot", "raw")
