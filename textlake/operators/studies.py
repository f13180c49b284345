"""Studies over whole collections: search configurations, mixtures of languages, lengths, spoken numbers, finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.functions import udfs
from textlake.operators import langprofiles, metrics, search
from textlake.session import cut


def compare_searches(vectors: DataFrame, postings: DataFrame, documents: DataFrame, qrels: DataFrame, configurations: dict[str, search.Modifiers], limit: int = 20) -> DataFrame:
    """(configuration, queries, precision, recall, ap, ndcg, bpref): means over all judged queries of each configuration."""
    ranked = search.search_all(vectors, postings, documents, configurations, limit)
    found = cut(ranked.select("configuration", "query_id", F.col("rank").alias("pos"), "doc_id"))  # few rows, read once a configuration
    out = None
    for name in configurations:
        own = metrics.retrieval(found.filter(F.col("configuration") == name).drop("configuration"), qrels)
        means = own.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in ("precision", "recall", "ap", "ndcg", "bpref")]).select(F.lit(name).alias("configuration"), "*")
        out = means if out is None else out.unionByName(means)
    return out


def numbered(rows: DataFrame, key: str, name: str = "i") -> DataFrame:
    """With name: 1, 2, ... in order of a unique key. Only keys are sorted, and each range of them numbers its own rows from
    where the ranges before it end, so no task sees the whole table."""
    keys = rows.select(F.col(key).alias("_key")).repartitionByRange("_key").withColumn("_part", F.spark_partition_id())
    sizes = keys.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_key").alias("_least"))
    starts = sizes.select("_least", F.coalesce(F.sum("_n").over(Window.orderBy("_least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.coalesce(F.lead("_least").over(Window.orderBy("_least")), F.lit(None)).alias("_next"))
    placed = keys.drop("_part").join(F.broadcast(starts), (F.col("_key") >= F.col("_least")) & (F.col("_next").isNull() | (F.col("_key") < F.col("_next"))))
    own = F.row_number().over(Window.partitionBy("_least").orderBy("_key"))
    return rows.join(placed.select("_key", (F.col("_before") + own).alias(name)), F.col(key) == F.col("_key")).drop("_key")


def mixture_study(docs: DataFrame, first: str, second: str, languages: DataFrame, size: int = 400, steps: int = 20) -> DataFrame:
    """(ratio, pairs, share): how often texts mixed from pairs of the i-th documents of two languages, `ratio` of the
    second, are taken for the second, by letter shares."""
    texts = lambda lang, name: numbered(docs.filter(F.col("lang") == lang).select("doc_id", F.col("text").alias(name)), "doc_id")
    pairs = texts(first, "a").join(texts(second, "b"), "i").select("i", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    mixed = pairs.select(F.concat_ws("/", "i", "step").alias("owner"), langprofiles.mixed(F.col("a"), F.col("b"), F.col("step") / steps, size).alias("text"))
    own = langprofiles.profiles(langprofiles.features(mixed, "alphabet"), None)
    told = langprofiles.classify(langprofiles.share_distance(own, languages))
    step = F.split("owner", "/")[1].cast("int")
    return told.groupBy((step / steps).alias("ratio")).agg(F.count("*").alias("pairs"), F.avg((F.col("predicted") == second).cast("double")).alias("share"))


def word_windows(docs: DataFrame, length: int, count: int = 5) -> DataFrame:
    """(doc_id, window, text): up to `count` runs of whole words, each of about `length` characters, one after the other;
    a last one under half that length is dropped."""
    words = docs.select("doc_id", F.posexplode(F.split(T.letters("text"), " ")).alias("pos", "word")).filter("word <> ''")
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("window", F.floor(F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)) / length))
    rows = placed.filter(F.col("window") < count).groupBy("doc_id", "window").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("text"))
    return rows.filter(F.length("text") >= length / 2)


def number_table(docs: DataFrame, limit: int = 1000) -> DataFrame:
    """(words, number): German number words from 0 up to `limit`, made by rule."""
    return docs.sparkSession.range(limit).select(udfs.cardinal("id").alias("words"), F.col("id").alias("number"))


def spoken_numbers(phrases: DataFrame, numbers: DataFrame, threshold: float = 0.75) -> DataFrame:
    """phrases(phrase_id, text) -> (phrase_id, number, score): digits as they are, words by equality, else the most similar
    number word above threshold of the same first letter (ties: the smaller number). numbers is a table made by rule.
    Phrases that say the same are compared with it once."""
    said = phrases.select("phrase_id", F.replace(F.lower(F.trim("text")), F.lit(" ")).alias("said"))
    digits = said.filter(F.col("said").rlike(r"^\d{1,9}$")).select("phrase_id", F.col("said").cast("long").alias("number"), F.lit(1.0).alias("score"))
    rest = said.filter(~F.col("said").rlike(r"^\d{1,9}$"))
    start = lambda c: F.substring(c, F.lit(1), F.lit(1))
    met = rest.select("said").distinct().join(F.broadcast(numbers), start("said") == start("words")).withColumn("score", T.similarity("said", "words")).filter(F.col("score") >= threshold)
    best = met.groupBy("said").agg(F.min_by(F.struct("number", "score"), F.struct(-F.col("score"), "number")).alias("b"))
    return digits.unionByName(rest.join(best, "said").select("phrase_id", "b.number", "b.score"))


def find_word(paragraphs: DataFrame, stem: str, current: int) -> DataFrame:
    """paragraphs(doc_id, par, text) -> (doc_id, n, pars, forms, nearest): where words that start with stem stand; nearest is
    the first paragraph at or after the current one, else the first of all."""
    hits = paragraphs.select("doc_id", "par", F.explode(T.tokens("text")).alias("form")).filter(F.startswith("form", F.lit(stem)))
    found = hits.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("par")).alias("pars"), F.array_sort(F.collect_set("form")).alias("forms"), F.min(F.when(F.col("par") >= current, F.col("par"))).alias("_after"), F.min("par").alias("_first"))
    return found.select("doc_id", "n", "pars", "forms", F.coalesce("_after", "_first").alias("nearest"))


def by_thirds(values: DataFrame, value: str, *ties: str) -> DataFrame:
    """With third: 1 to 3, counted over the whole table by rank in even parts, without one task seeing all rows:
    ranks come from counts of equal values, which are few."""
    counts = values.groupBy(value).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy())
    placed = counts.withColumns({"_before": before, "_total": total})
    return values.join(placed, value).withColumn("third", (F.floor(3 * F.col("_before") / F.col("_total")) + 1).cast("int")).drop("_n", "_before", "_total")


def expiring(pledges: DataFrame, now: Column) -> DataFrame:
    """pledges(id, due_at, redeemed_at) -> with state: redeemed, expired or open at `now`."""
    state = F.when(F.col("redeemed_at").isNotNull() & (F.col("redeemed_at") <= F.col("due_at")), "redeemed").when(F.col("due_at") <= now, "expired").otherwise("open")
    return pledges.withColumn("state", state)


def copied_share(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, hypothesis, reference arrays of words) -> (pair_id, copied, shared): share of the hypothesis' word pairs
    that the reference has, and of its distinct words."""
    two = lambda c: T.word_ngrams(c, 2)
    mine = two("hypothesis")
    copied = F.try_divide(F.size(F.filter(mine, lambda g: F.array_contains(two("reference"), g))), F.size(mine))
    shared = F.try_divide(F.size(F.array_intersect("hypothesis", "reference")), F.size(F.array_distinct("hypothesis")))
    return pairs.select("pair_id", F.coalesce(copied, F.lit(0.0)).alias("copied"), F.coalesce(shared, F.lit(0.0)).alias("shared"))


def detect_domain(docs: DataFrame, markers: dict[str, list[str]], default: str) -> DataFrame:
    """(doc_id, domain): the domain whose marker words occur most often; a tie or none gives the default."""
    words = docs.select("doc_id", T.tokens("text").alias("ws"))
    counts = [F.struct(_hits("ws", m).alias("n"), F.lit(d).alias("d")) for d, m in sorted(markers.items())]
    ranked = words.withColumn("c", F.sort_array(F.array(*counts), asc=False))
    one, two = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    tie = (one["n"] == 0) | (two.isNotNull() & (one["n"] == two["n"]))
    return ranked.select("doc_id", F.when(tie, default).otherwise(one["d"]).alias("domain"))


def _hits(words: str, markers: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*markers)))


def contained_words(words: DataFrame, least: int = 5) -> DataFrame:
    """words(word) -> (word, head): words that end with another one of at least `least` letters, the longest such.

    Every ending of a word is a row, joined by equality: no pair of unrelated words meets.
    """
    ends = words.distinct().select("word", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("word") - least + 1)), lambda i: F.substring("word", i, F.length("word")))).alias("head"))
    met = ends.filter(F.length("head") >= least).join(words.distinct().select(F.col("word").alias("head")), "head")
    return met.groupBy("word").agg(F.max_by("head", F.length("head")).alias("head"))


def spelled(word: Column | str) -> Column:
    """An acronym read letter by letter."""
    w = F.col(word) if isinstance(word, str) else word
    return F.array_join(F.filter(F.split(F.upper(w), ""), lambda c: c != ""), "-")
