"""Spoken phrases against command templates, by edit similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T

SKIP_COST = 0.04


def match(phrases: DataFrame, templates: DataFrame, skips: int = 2, threshold: float = 0.75, short: float = 0.8) -> DataFrame:
    """phrases(phrase_id, text), templates(operation, text) -> (phrase_id, operation, score): the best operation.

    Up to `skips` leading words of the phrase may be passed over, each at a small cost. A template of up to
    five letters needs a higher score. Templates are a fixed list of commands: they are the broadcast side.
    Best score first, then more template words, then the name; phrases that reach no threshold are left out.
    """
    normal = phrases.select("phrase_id", F.split(T.phrase("text"), " ").alias("words"))
    tails = normal.select("phrase_id", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(skips), F.size("words") - 1)), lambda k: F.struct(k.alias("skipped"), F.array_join(F.slice("words", k + 1, F.size("words")), " ").alias("said")))).alias("t")).select("phrase_id", "t.*")
    shapes = templates.select("operation", T.phrase("text").alias("shape")).distinct()
    near = tails.join(F.broadcast(shapes), F.abs(F.length("said") - F.length("shape")) <= F.greatest(F.length("said"), F.length("shape")) * (1 - threshold))
    scored = near.withColumn("score", F.round(T.similarity("said", "shape") - SKIP_COST * F.col("skipped"), 6))
    good = scored.filter(F.col("score") >= F.when(F.length("shape") <= 5, short).otherwise(threshold))
    order = Window.partitionBy("phrase_id").orderBy(F.desc("score"), F.desc(F.size(F.split("shape", " "))), "operation")
    return good.withColumn("n", F.row_number().over(order)).filter("n = 1").select("phrase_id", "operation", "score")


def trial_tally(trials: DataFrame) -> DataFrame:
    """trials(language, kind, condition, errors, words, exact, reacted, seconds, audio) -> rates by kind and
    condition, for each language and all together (language null)."""
    rate = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    made = trials.groupingSets([["language", "kind", "condition"], ["kind", "condition"]], "language", "kind", "condition").agg(F.count("*").alias("trials"), rate("errors", "words").alias("wer"), F.avg(F.col("exact").cast("double")).alias("exact"), F.avg(F.col("reacted").cast("double")).alias("reaction"), rate("seconds", "audio").alias("rtf"))
    return made
