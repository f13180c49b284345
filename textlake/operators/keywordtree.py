"""Keyword trees: nouns that stand out, the phrases and compounds that belong to them, phrases within phrases.

Words are rows (doc_id, part, pos, surface, adjacent, initial): `part` is a sentence or heading, `adjacent` says that
nothing but space stands between a word and the one before. Analysis adds term, counted, noun and adjective, and for
languages with cases genitive, person, abbreviation, lemma and `agrees`, what an adjective must share with its noun.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions.stems import german

WORD = r"\p{L}+(?:[-‐'’]\p{L}+)*"
# Endings of adjectives; prefixes that make a verb's noun and not a compound.
ENDINGS = ("en", "er", "es", "em", "e")
PREFIXES = ("ver", "be", "ent", "er", "zer", "ge", "miss", "emp", "un", "ur")


def words(parts: DataFrame, text: str = "text") -> DataFrame:
    """parts(doc_id, part, text, heading) -> one row a word. Numbers and marks are no words, but part what stands beside them."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"{WORD}|[^\s\p{{L}}]+"), F.lit(0))
    flat = parts.select("doc_id", "part", "heading", pieces.alias("ps")).select("doc_id", "part", "heading", "ps", F.posexplode("ps").alias("pos", "surface"))
    rows = flat.withColumn("adjacent", (F.col("pos") > 0) & F.get("ps", F.col("pos") - 1).rlike(rf"^{WORD}$")).drop("ps").filter(F.col("surface").rlike(rf"^{WORD}$"))
    first = rows.groupBy("doc_id", "part").agg(F.min("pos").alias("_first"))
    return rows.join(first, ["doc_id", "part"]).withColumn("initial", F.col("pos") == F.col("_first")).drop("_first")


def german_words(rows: DataFrame, stop: DataFrame | None = None, stem: Callable[[Column], Column] = german) -> DataFrame:
    """Adds term, counted, adjective, noun_term and noun: terms are stems, of a name with an s the name's without, where
    the document has that too; noun terms stand with a capital within sentences as often as without, at least; adjectives
    are small words with their endings.

    stop(word): words and stems that don't count.
    """
    script = F.col("surface").rlike(r"^[A-Za-zÄÖÜäöüßÀ-ÖØ-öø-ÿ'’‐-]+$")
    each = rows.select("surface").distinct().withColumn("term", stem(F.col("surface")))
    each = each.withColumn("counted", script & (F.length("surface") > 1) & (F.length("term") > 1))
    if stop is not None:
        gone = stop.select(F.lower("word").alias("_stop"), F.lit(True).alias("_gone")).distinct()
        for word in (F.lower("surface"), F.col("term")):
            each = each.join(gone, word == F.col("_stop"), "left").withColumn("counted", F.col("counted") & F.col("_gone").isNull()).drop("_stop", "_gone")
    large = F.col("surface").rlike(r"^\p{Lu}")
    small = ~large & (F.length("surface") > 4) & F.lower("surface").rlike(f"(?:{'|'.join(ENDINGS)})$")
    met = rows.join(each, "surface").withColumn("adjective", small)
    bare = met.filter("counted").select(F.col("doc_id").alias("_doc"), F.col("surface").alias("_bare"), F.col("term").alias("_term")).distinct()
    name = F.when(F.col("counted") & F.col("surface").rlike(r"^\p{Lu}.{2,}s$"), F.expr("substring(surface, 1, length(surface) - 1)"))
    met = met.withColumn("_name", name).join(bare, (F.col("doc_id") == F.col("_doc")) & (F.col("_name") == F.col("_bare")), "left")
    met = met.withColumn("term", F.coalesce("_term", "term")).drop("_doc", "_bare", "_term", "_name")
    inside = F.col("counted") & ~F.col("initial") & ~F.col("heading")
    sums = met.groupBy("doc_id", "term").agg(F.count_if(inside & large).alias("_large"), F.count_if(inside & ~large).alias("_small"))
    nouns = sums.select("doc_id", "term", ((F.col("_large") > 0) & (F.col("_large") >= F.col("_small"))).alias("noun_term"))
    return met.join(nouns, ["doc_id", "term"]).withColumn("noun", F.col("counted") & large & F.col("noun_term"))


def terms(rows: DataFrame) -> DataFrame:
    """(doc_id, term, shown, noun_term, tf, idf) of counted words. Shown is the commonest form (of equals the shorter, then
    the first), of a noun one with a capital if there is any, of others in small letters. idf is the logarithm of documents
    over documents with the term."""
    forms = rows.filter("counted").groupBy("doc_id", "term", "noun_term", "surface").agg(F.count("*").alias("n"))
    place = F.struct((F.col("surface").rlike(r"^\p{Lu}") != F.col("noun_term")).alias("other"), (-F.col("n")).alias("n"), F.length("surface").alias("size"), "surface")
    best = forms.groupBy("doc_id", "term", "noun_term").agg(F.min(place).alias("top"), F.sum("n").alias("tf"))
    shown = F.when(F.col("noun_term"), F.col("top.surface")).otherwise(F.lower("top.surface"))
    spread = best.groupBy("term").agg(F.count("*").alias("df"))
    total = rows.select("doc_id").distinct().agg(F.count("*").alias("documents"))  # one row
    return best.join(spread, "term").join(F.broadcast(total)).select("doc_id", "term", shown.alias("shown"), "noun_term", "tf", F.ln(F.col("documents") / F.col("df")).alias("idf"))


def contains_compound(term: Column, head: Column) -> Column:
    """Is the term a compound that begins or ends with the head, of four letters or more? What stands before a head at the
    end, without s and hyphens, has three letters at least and is no prefix."""
    rest = F.regexp_replace(F.substring(term, F.lit(1), F.length(term) - F.length(head)), "[s-]+$", "")
    ends = term.endswith(head) & (F.length(rest) >= 3) & ~rest.isin(*PREFIXES)
    return (F.length(head) >= 4) & (term != head) & (term.startswith(head) | term.contains(F.concat(F.lit("-"), head)) | ends)


def derived(term: Column, head: Column) -> Column:
    """Do they share all but one of the head's letters at the start, four at least?"""
    need = F.greatest(F.lit(4), F.length(head) - 1)
    return (F.length(head) >= 4) & (term != head) & (F.length(term) >= need) & (F.substring(term, F.lit(1), need) == F.substring(head, F.lit(1), need))


RELATED = {"de": contains_compound, "ru": derived}


def heads(found: DataFrame, top: int = 10, compounds: bool = True) -> DataFrame:
    """(doc_id, rank, term, shown, tf, weight): noun terms by tf times idf. Where compounds are one word, one that contains
    a chosen head gives its place to the next."""
    weight = F.col("tf") * F.col("idf")
    nouns = found.filter(F.col("noun_term") & (weight > 0)).select("doc_id", F.struct((-weight).alias("order"), "term", "shown", "tf").alias("x"))
    sorted_ = nouns.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # a document's vocabulary
    kind = "array<struct<order double, term string, shown string, tf bigint>>"
    free = lambda acc, x: ~F.exists(acc, lambda h: contains_compound(x["term"], h["term"])) if compounds else F.lit(True)
    chosen = F.aggregate("xs", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) < top) & free(acc, x), F.array_append(acc, x)).otherwise(acc))
    each = sorted_.select("doc_id", F.posexplode(chosen).alias("rank", "x"))
    return each.select("doc_id", (F.col("rank") + 1).alias("rank"), "x.term", "x.shown", "x.tf", (-F.col("x.order")).alias("weight"))


def german_phrases(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, terms, form, n): adjectives right before nouns, as after a definite article."""
    w = Window.partitionBy("doc_id", "part").orderBy("pos")
    before = F.lag(F.struct("surface", "term", "counted", "adjective")).over(w)
    pairs = rows.withColumn("before", before).filter(F.col("adjacent") & F.col("noun") & F.col("before.counted") & F.col("before.adjective"))
    low = F.lower("before.surface")
    base = F.when(low.rlike("^.{3,}(?:en|er|es|em)$"), F.concat(F.expr("substring(lower(before.surface), 1, length(before.surface) - 2)"), F.lit("e"))).otherwise(low)
    met = pairs.join(found.select("doc_id", "term", "shown"), ["doc_id", "term"])
    return met.groupBy("doc_id", F.array("before.term", "term").alias("terms"), F.concat_ws(" ", base, "shown").alias("form")).agg(F.count("*").alias("n"))


def cased_phrases(rows: DataFrame) -> DataFrame:
    """(doc_id, terms, form, n) for languages with cases: up to two adjectives that agree before a noun; a noun and one or
    two nouns in the genitive, or an adjective and a noun in the genitive that agree; two or three names in a row.

    Columns besides those of words(): term, counted, noun, adjective, genitive, person, abbreviation, lemma (a noun's
    dictionary form) and agrees (array: an adjective agrees with a noun that shares one of its elements).
    """
    fields = ("surface", "term", "counted", "noun", "adjective", "genitive", "person", "abbreviation", "lemma", "agrees", "adjacent", "initial")
    w = Window.partitionBy("doc_id", "part").orderBy("pos")
    one = F.struct(*fields)
    near = rows.select("doc_id", "part", "pos", one.alias("x"), *(F.lag(one, k).over(w).alias(f"b{k}") for k in (1, 2)), *(F.lead(one, k).over(w).alias(f"a{k}") for k in (1, 2)))
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    fits = lambda a, n: yes(c(f"{a}.counted") & c(f"{a}.adjective") & F.arrays_overlap(c(f"{a}.agrees"), c(f"{n}.agrees")))
    gen = lambda n: yes(c(f"{n}.adjacent") & c(f"{n}.counted") & c(f"{n}.noun") & c(f"{n}.genitive"))
    person = lambda n: yes(c(f"{n}.counted") & c(f"{n}.person"))
    noun, low = yes(c("x.counted") & c("x.noun")), lambda n: F.lower(c(f"{n}.surface"))
    is_person, inside = noun & person("x"), yes(c("x.adjacent")) & person("b1")
    second, third = person("a1") & yes(c("a1.adjacent")), person("a2") & yes(c("a2.adjacent"))
    plain = noun & ~(is_person & (inside | second))
    one_adj = plain & yes(c("x.adjacent")) & fits("b1", "x")
    two_adj = one_adj & yes(c("b1.adjacent")) & fits("b2", "x")
    heads = plain & ~yes(c("x.abbreviation")) & ~person("x")
    then = heads & ~gen("a1") & yes(c("a1.adjacent")) & yes(c("a1.counted") & c("a1.adjective")) & gen("a2") & fits("a1", "a2")
    cases = [
        (is_person & ~inside & second, ["x", "a1", "a2"], third, [c("x.lemma"), c("a1.lemma"), c("a2.lemma")]),
        (is_person & ~inside & second, ["x", "a1"], ~third, [c("x.lemma"), c("a1.lemma")]),
        (one_adj, ["b1", "x"], F.lit(True), [c("b1.lemma"), c("x.lemma")]),
        (two_adj, ["b2", "b1", "x"], F.lit(True), [c("b2.lemma"), c("b1.lemma"), c("x.lemma")]),
        (heads & gen("a1"), ["x", "a1"], F.lit(True), [c("x.lemma"), low("a1")]),
        (heads & gen("a1"), ["x", "a1", "a2"], gen("a2"), [c("x.lemma"), low("a1"), low("a2")]),
        (then, ["x", "a1", "a2"], F.lit(True), [c("x.lemma"), low("a1"), low("a2")]),
    ]
    found = F.array(*(F.when(a & b, F.struct(F.array(*(c(f"{n}.term") for n in names)).alias("terms"), F.concat_ws(" ", *form).alias("form"))) for a, names, b, form in cases))
    each = near.select("doc_id", F.inline(F.filter(found, lambda p: p.isNotNull())))
    return each.groupBy("doc_id", "terms", "form").agg(F.count("*").alias("n"))


def _nested(phrases: list[dict]) -> list[dict]:
    """Each phrase under the last one, in the order of the tree so far, whose terms are fewer and all its own."""
    order = sorted(phrases, key=lambda p: (len(p["terms"]), -p["weight"], p["text"]))
    children: dict[int, list[int]] = {-1: []}
    out = []
    for i, phrase in enumerate(order):
        parent, stack = -1, children[-1][::-1]
        while stack:
            node = stack.pop()
            own = order[node]
            if own["kind"] != "compound" and len(own["terms"]) < len(phrase["terms"]) and set(own["terms"]) <= set(phrase["terms"]):
                parent = node
            stack += children[node][::-1]
        children[i] = []
        children[parent].append(i)
        out.append({c: phrase[c] for c in ("text", "kind", "freq", "weight")} | {"parent": order[parent]["text"] if parent >= 0 else None})
    return out


def _nest(column: pd.Series) -> pd.Series:
    return pd.Series([_nested([dict(p) for p in phrases]) for phrases in column], dtype=object)


def tree(found: DataFrame, tops: DataFrame, phrases: DataFrame, language: str = "de", children: int = 4, least: int = 2, loose: int = 5) -> DataFrame:
    """(doc_id, head, parent, text, kind, freq, weight): a document's heads (head and parent null), under each up to
    `children` phrases and compounds (head, and the phrase they stand under, if any), and up to `loose` phrases of no head
    (kind `loose`).

    phrases(doc_id, terms, form, n); a phrase counts from `least` times, weighs as much as that times the mean idf of
    its terms, and belongs to the heaviest head that is one of its terms or related to one. A document without nouns has
    no rows but loose ones.
    """
    idf = found.select("doc_id", "term", "idf")
    forms = phrases.groupBy("doc_id", "terms").agg(F.sum("n").alias("freq"), F.min(F.struct((-F.col("n")).alias("n"), "form")).alias("top")).filter(F.col("freq") >= least)
    weighed = forms.select("doc_id", "terms", "freq", F.col("top.form").alias("text"), F.posexplode("terms").alias("_at", "term")).join(idf, ["doc_id", "term"], "left")
    means = weighed.groupBy("doc_id", "terms", "freq", "text").agg((F.sum(F.coalesce("idf", F.lit(0.0))) / F.count("*")).alias("mean")).filter("mean > 0")
    made = means.select("doc_id", "terms", "text", F.lit("phrase").alias("kind"), "freq", (F.col("freq") * F.col("mean")).alias("weight"))
    related = RELATED[language]
    hs = tops.select("doc_id", F.col("term").alias("_head"), F.col("weight").alias("_weight"), F.col("shown").alias("head"))
    if language == "de":
        weight = F.col("tf") * F.col("idf")
        rest = found.filter(F.col("noun_term") & (F.col("tf") >= least) & (weight > 0)).join(tops.select("doc_id", "term"), ["doc_id", "term"], "left_anti")
        parts = rest.join(hs, "doc_id").filter(related(F.col("term"), F.col("_head"))).select("doc_id", F.array("term").alias("terms"), F.col("shown").alias("text"), F.lit("compound").alias("kind"), F.col("tf").alias("freq"), weight.alias("weight"))
        made = made.union(parts.distinct())
    # a document has few heads, so a join on it multiplies its phrases by as many at most
    met = made.join(hs, "doc_id", "left").withColumn("fits", F.exists("terms", lambda t: (t == F.col("_head")) | related(t, F.col("_head"))))
    best = met.groupBy("doc_id", "terms", "text", "kind", "freq", "weight").agg(F.max(F.when(F.col("fits"), F.struct("_weight", "head"))).alias("best")).withColumn("head", F.col("best.head")).drop("best")
    order = Window.partitionBy("doc_id", "head").orderBy(F.desc("weight"), "text")
    ranked = best.withColumn("_rank", F.row_number().over(order))
    free = ranked.filter(F.col("head").isNull() & (F.col("_rank") <= loose)).select("doc_id", "head", F.lit(None).cast("string").alias("parent"), "text", F.lit("loose").alias("kind"), "freq", "weight")
    kept = ranked.filter(F.col("head").isNotNull() & (F.col("_rank") <= children)).groupBy("doc_id", "head").agg(F.collect_list(F.struct("terms", "text", "kind", "freq", "weight")).alias("ps"))
    placed = F.pandas_udf(_nest, "array<struct<parent string, text string, kind string, freq long, weight double>>")("ps")
    kids = kept.select("doc_id", "head", F.inline(placed))
    none = F.lit(None).cast("string")
    top = tops.select("doc_id", none.alias("head"), none.alias("parent"), F.col("shown").alias("text"), F.lit("word").alias("kind"), F.col("tf").alias("freq"), "weight")
    return top.union(kids).union(free)
