"""A bilingual lexicon: reading, overlays, lookup, phrases, word-by-word translation; lemmas by suffix rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T

COLUMNS = ("en", "pos", "de", "gender", "plural", "extra", "domain")
#: What separates the ranks of one file's lines from the next file's.
FILE_STEP = 100_000
#: Parts of speech that a lookup may fall back to, best first.
FALLBACK = {"noun": ["noun", "name", "verb"], "verb": ["verb", "noun"], "adj": ["adj", "adv", "verb"], "adv": ["adv", "adj"]}


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines(file_no, line_no, value) -> entries with rank; `#` lines and lines of fewer than three columns are none."""
    parts = F.split("value", "\t")
    cut = lines.filter(~F.startswith(F.ltrim("value"), F.lit("#"))).withColumn("p", parts).filter(F.size("p") >= 3)
    return cut.select(*[F.coalesce(F.trim(F.get("p", F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(COLUMNS)], (F.col("file_no") * FILE_STEP + F.col("line_no")).alias("rank"))


def overlay(seed: DataFrame, user: DataFrame) -> DataFrame:
    """User entries replace all seed entries of their (en, pos, domain); their rank goes before."""
    keys = ["en", "pos", "domain"]
    kept = seed.join(user.select(*keys).distinct(), keys, "left_anti")
    return kept.withColumn("source", F.lit("seed")).unionByName(user.withColumns({"source": F.lit("user"), "rank": F.col("rank") - 1_000_000_000}))


def lookup(words: DataFrame, lexicon: DataFrame, domain: str = "") -> DataFrame:
    """words(word_id, en, pos) -> the best entry of each: the own part of speech first, then its fallbacks; the
    domain's entries before general ones; then rank. Words without an entry are left out. Of the entries of one
    word only the best meets the words that are asked for, however many there are."""
    tries = F.coalesce(*[F.when(F.col("pos") == k, F.array(*map(F.lit, v))) for k, v in FALLBACK.items()], F.array("pos"))
    asked = words.select("word_id", F.lower("en").alias("_en"), F.posexplode(tries).alias("step", "_pos"))
    own = F.struct(F.when(F.col("domain") == domain, 0).otherwise(1), "rank")
    entries = lexicon.filter(F.col("domain").isin("", domain)).groupBy(F.lower("en").alias("_en"), F.col("pos").alias("_pos")).agg(F.min_by(F.struct("en", "pos", "de"), own).alias("e"))
    best = Window.partitionBy("word_id").orderBy("step")
    return asked.join(entries, ["_en", "_pos"]).withColumn("n", F.row_number().over(best)).filter("n = 1").select("word_id", "e.en", "e.pos", "e.de", "step")


def browse(lexicon: DataFrame, query: str = "", pos: str | None = None, source: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Entries whose English contains the query: equal ones first, then those that start with it; one page, with total."""
    rows = lexicon
    if query:
        rows = rows.filter(F.lower("en").contains(query.lower()))
    if pos:
        rows = rows.filter(F.col("pos") == pos)
    if source:
        rows = rows.filter(F.col("source") == source)
    total = rows.agg(F.count("*").alias("total"))
    kind = F.when(F.lower("en") == query.lower(), 0).when(F.startswith(F.lower("en"), F.lit(query.lower())), 1).otherwise(2)
    return rows.crossJoin(F.broadcast(total)).orderBy(kind, F.lower("en"), "rank").offset(offset).limit(limit)


def longest_phrases(tokens: DataFrame, phrases: DataFrame, longest: int = 4) -> DataFrame:
    """tokens(doc_id, pos, word), phrases(phrase) -> (doc_id, pos, size, phrase): at every place the longest phrase.

    Runs of two to `longest` words are built by lead() and joined with the phrases by equality.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    runs = tokens.select("doc_id", "pos", F.array("word", *[F.lead("word", i).over(w) for i in range(1, longest)]).alias("ws"))
    each = runs.select("doc_id", "pos", F.explode(F.transform(F.sequence(F.lit(2), F.lit(longest)), lambda n: F.struct(n.alias("size"), F.when(F.get("ws", n - 1).isNotNull(), F.array_join(F.slice("ws", 1, n), " ")).alias("phrase")))).alias("r"))
    met = each.select("doc_id", "pos", "r.*").filter("phrase is not null").join(phrases.distinct(), "phrase")
    return met.groupBy("doc_id", "pos").agg(F.max_by(F.struct("size", "phrase"), "size").alias("m")).select("doc_id", "pos", "m.size", "m.phrase")


def translate_words(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """tokens(doc_id, pos, word) -> (doc_id, translation): each word's first entry, unknown words unchanged."""
    first = lexicon.groupBy(F.lower("en").alias("word")).agg(F.min_by("de", "rank").alias("de"))
    rows = tokens.join(first, "word", "left").select("doc_id", F.struct("pos", F.coalesce("de", "word").alias("w")).alias("s"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["w"]), " ").alias("translation"))


def unknown_words(old: DataFrame, new: DataFrame) -> DataFrame:
    """Accumulated unknown words: both sides (en, pos, count, texts, example, last_seen), summed; the first example stays."""
    rows = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    return rows.groupBy("en", "pos").agg(F.sum("count").alias("count"), F.sum("texts").alias("texts"), F.min_by("example", F.when(F.col("example") != "", F.col("age")).otherwise(9)).alias("example"), F.max("last_seen").alias("last_seen"))


def suffix_rules(examples: DataFrame, longest: int = 4, least: int = 2) -> DataFrame:
    """examples(form, tag, lemma) -> (suffix, tag, strip, add, n): the commonest change of each ending."""
    same = T.common_prefix("form", "lemma")
    change = examples.select("tag", "form", (F.length("form") - same).alias("strip"), F.substring("lemma", same + 1, F.length("lemma")).alias("add"))
    ends = change.select("tag", "strip", "add", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("form"))), lambda n: F.substring("form", -n, n))).alias("suffix"))
    counted = ends.groupBy("suffix", "tag", "strip", "add").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    best = Window.partitionBy("suffix", "tag").orderBy(F.desc("n"), "strip", "add")
    return counted.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")


def lemmatize(words: DataFrame, rules: DataFrame, longest: int = 4) -> DataFrame:
    """words(form, tag) -> (form, tag, lemma) by the rule of the longest known ending; without one, the form."""
    ends = words.distinct().select("form", "tag", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("form"))), lambda n: F.substring("form", -n, n))).alias("suffix"))
    met = ends.join(rules, ["suffix", "tag"]).filter(F.col("strip") <= F.length("form"))
    best = met.groupBy("form", "tag").agg(F.max_by(F.struct("strip", "add"), F.length("suffix")).alias("r"))
    made = F.concat(F.substring("form", F.lit(1), F.length("form") - F.col("r.strip")), F.col("r.add"))
    return words.join(best, ["form", "tag"], "left").select("form", "tag", F.coalesce(made, "form").alias("lemma"))


def counts(lexicon: DataFrame) -> DataFrame:
    """(pos, domain, entries, words, meanings): by part of speech and domain, by part of speech, and of all."""
    sets = lexicon.groupingSets([["pos", "domain"], ["pos"], []], "pos", "domain")
    return sets.agg(F.count("*").alias("entries"), F.count_distinct("en").alias("words"), F.count_distinct("de").alias("meanings"))
