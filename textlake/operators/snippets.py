"""What a hit list shows of a document: the stretch with most of the query's words, and those words marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T

#: A token, or what stands between two.
PIECES = rf"{T.TOKEN}|[^\p{{L}}\p{{N}}]+"


def _pieces(text: Column | str) -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(PIECES), F.lit(0))


def _plain(piece: Column) -> Column:
    return F.translate(F.lower(piece), "ё", "е")


def best_stretch(docs: DataFrame, lemmas: Column, length: int = 300) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, hits, snippet): the stretch of `length` characters that holds most of `lemmas`, an
    array of each row. Stretches start a third of their length before a hit; the first of the best counts. Without a hit
    it is the text's beginning. White space is squeezed, cuts go to word borders near by, and dots show where text is
    left out. A null text has a null snippet; ids are unique.

    Tokens of the whole text are rows, so how often a stretch is hit is one count over a range of places.
    """
    texts = docs.select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), lemmas.alias("lemmas"))
    pieces = texts.select("doc_id", "lemmas", F.posexplode(_pieces("text")).alias("pos", "piece"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    hits = placed.filter(F.array_contains("lemmas", _plain(F.col("piece")))).select("doc_id", "at")
    third = length // 3
    around = F.count("*").over(Window.partitionBy("doc_id").orderBy("at").rangeBetween(-third, length - third - 1))
    early = F.count_if(F.col("at") < length).over(Window.partitionBy("doc_id"))
    counted = hits.select("doc_id", F.greatest(F.col("at") - third, F.lit(0)).alias("start"), F.when(F.col("at") <= third, early).otherwise(around).alias("n"))
    best = counted.groupBy("doc_id").agg(F.max("n").alias("hits"), F.min_by("start", F.struct(-F.col("n"), "start")).alias("start"))
    rows = texts.join(best, "doc_id", "left").select("doc_id", "text", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("start", F.lit(0)).cast("int").alias("start"))
    space = F.expr("locate(' ', text, start + 1)")
    rows = rows.withColumn("start", F.when((F.col("start") > 0) & (space > 0) & (space <= F.col("start") + 30), space).otherwise(F.col("start")))
    cut = F.substring("text", F.col("start") + 1, F.lit(length))
    rows = rows.withColumn("cut", cut).withColumn("more", F.col("start") + length < F.length("text"))
    last = F.length("cut") - F.locate(" ", F.reverse("cut"))
    whole = F.when(F.col("more") & (F.col("hits") > 0) & F.col("cut").contains(" ") & (last > 0.6 * length), F.substring("cut", F.lit(1), last)).otherwise(F.col("cut"))
    shown = F.concat(F.when(F.col("start") > 0, "…").otherwise(""), whole, F.when(F.col("more"), "…").otherwise(""))
    return rows.select("doc_id", "hits", shown.alias("snippet"))


def escaped(text: Column) -> Column:
    """Text as markup shows it."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def highlight(text: Column | str, lemmas: Column) -> Column:
    """Markup of a text in which the words of `lemmas` are marked."""
    marked = lambda p: F.when(F.array_contains(lemmas, _plain(p)), F.concat(F.lit("<mark>"), escaped(p), F.lit("</mark>"))).otherwise(escaped(p))
    return F.array_join(F.transform(_pieces(text), marked), "")


def matched(text: Column | str, lemmas: Column) -> Column:
    """Those of `lemmas` that a text has, in the order of their first places."""
    return F.array_distinct(F.filter(T.tokens(text), lambda t: F.array_contains(lemmas, t)))
