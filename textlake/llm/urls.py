"""URL filters: rules, and naive Bayes over hosts split into words by unigram Viterbi."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.shared import Scratch

#: Words that mark unwanted hosts and paths: the weak labels from which naive Bayes starts. A parameter of fit().
SEEDS = ("adult", "ads", "bet", "bets", "casino", "cheap", "dating", "escort", "farm", "gambling", "jackpot", "loan", "loans", "lottery", "nude", "payday", "pharmacy", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "track", "tracker", "viagra", "win", "xxx")
LONGEST_WORD = 24
#: Runs that a host or path falls into: letters a-z, digits, other letters.
PARTS = r"[a-z]+|[0-9]+|[\p{L}&&[^a-z]]+"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://`, A-Z lower-cased in the host; both empty for null or no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of `rules`, pairs of verdict and `host/path`, that fits; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def best_split(name: str, counts: dict[tuple[int, int], int], total: int) -> list[str]:
    """The words of a concatenated name: the split of highest unigram probability, by Viterbi.

    counts: (start, length) -> how often that substring is a word. A substring that is none costs as a word
    met once and three more a letter. Ties: fewer words, then the longer last word.
    """
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    once = math.log(total)
    for end in range(1, len(name) + 1):
        tried = []
        for at in range(max(0, end - LONGEST_WORD), end):
            n = counts.get((at, end - at))
            cost = once - math.log(n) if n else once + 3 * (end - at)
            tried.append((best[at][0] + cost, best[at][1] + 1, at))
        best.append(min(tried))
    words, end = [], len(name)
    while end:
        words.append(name[best[end][2] : end])
        end = best[end][2]
    return words[::-1]


def _split(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = {(h["at"], h["size"]): h["n"] for h in hits or [] if h["n"] is not None}
                out.append(["0"] if "0" <= name[0] <= "9" else best_split(name, known, total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["part", "words"])

    return run


def segmented(parts: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """parts(part, distinct) -> (part, words). words(w, n) is a vocabulary of any size with its counts.

    Every substring of a part meets the vocabulary in a join, and the few that are words come back to it, so
    no task holds the vocabulary. A run of digits becomes the one word "0".
    """
    size = F.length("part")
    starts = parts.filter(~F.col("part").rlike("^[0-9]")).select("part", F.explode(F.sequence(F.lit(0), size - 1)).alias("at"))
    pieces = starts.select("part", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), size - F.col("at")))).alias("size"))
    hits = pieces.withColumn("w", F.expr("substring(part, at + 1, size)")).join(words, "w")
    known = hits.groupBy("part").agg(F.collect_list(F.struct("at", "size", "n")).alias("hits"))
    return parts.join(known, "part", "left").select("part", "hits").mapInArrow(_split(total), "part string, words array<string>")


@dataclass(frozen=True)
class Model:
    """words(w, n): counts for the segmentation, `total` of them; odds(token, odds): log-odds of block; the prior's."""

    words: DataFrame
    total: int
    odds: DataFrame
    prior: float


def _units(pages: DataFrame, url: str) -> DataFrame:
    """(host, path, n): every different pair, and how many pages have it."""
    host, path = split_url(F.col(url))
    return pages.select(host.alias("host"), path.alias("path")).groupBy("host", "path").agg(F.count("*").alias("n"))


def _parts(units: DataFrame) -> DataFrame:
    """units, a row for each run of the host and of the path; mark is a slash for those of the path."""
    of = lambda text, mark: F.transform(F.regexp_extract_all(text, F.lit(PARTS), F.lit(0)), lambda p: F.struct(F.lit(mark).alias("mark"), p.alias("part")))
    return units.select("*", F.inline(F.concat(of(F.col("host"), ""), of(F.lower("path"), "/"))))


def _tokens(parts: DataFrame, words: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """(mark, part, tokens) of every different part: its words, those of a path with a slash before them."""
    split = scratch.cut(segmented(parts.select("part").distinct(), words, total))
    named = F.transform("words", lambda w: F.concat("mark", w))
    return parts.select("mark", "part").distinct().join(split, "part").select("mark", "part", "words", named.alias("tokens"))


def _scores(parts: DataFrame, tokens: DataFrame, odds: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, path, score): sums of the odds of a unit's tokens. A token without odds adds nothing.

    Odds are summed for each different part first: what meets the many pages is one number a part, from a
    written table, so that Spark can split the join where a part, such as a common domain, has very many.
    """
    each = tokens.select("mark", "part", F.explode("tokens").alias("token")).join(odds, "token", "left")
    summed = scratch.cut(each.groupBy("mark", "part").agg(F.sum(F.coalesce("odds", F.lit(0.0))).alias("odds")))
    return parts.join(summed, ["mark", "part"]).groupBy("host", "path").agg(F.sum("odds").alias("score"))


def _learn(units: DataFrame, parts: DataFrame, tokens: DataFrame, bad: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """Log-odds of every token, add-one, and the prior's, where bad(host, path) are the unwanted units."""
    marked = parts.join(bad.withColumn("bad", F.lit(True)), ["host", "path"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    counted = marked.groupBy("mark", "part").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("g"))
    each = tokens.select("mark", "part", F.explode("tokens").alias("token")).join(counted, ["mark", "part"])
    counts = scratch.cut(each.groupBy("token").agg(F.sum("b").alias("b"), F.sum("g").alias("g")))
    t = counts.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("g"), F.lit(0)).alias("g"), F.count("*").alias("n")).first()
    odds = counts.select("token", (F.log((F.col("b") + 1) / (t["b"] + t["n"] + 1)) - F.log((F.col("g") + 1) / (t["g"] + t["n"] + 1))).alias("odds"))
    p = units.join(bad.withColumn("bad", F.lit(True)), ["host", "path"], "left").agg(F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    return odds, math.log((p["b"] + 1) / (p["all"] - p["b"] + 1))


def fit(pages: DataFrame, url: str = "url", html: str = "html", seeds: tuple[str, ...] = SEEDS, rounds: int = 1) -> Model:
    """Learn from all pages: counts of all words of their texts, and of all tokens of their urls, in Spark tables.

    Pages with a seed among the words of their host or path start as unwanted. Naive Bayes learns from that,
    then `rounds` times again from pages that have a seed or that it finds unwanted itself, so that words
    that come along with seeds count where no seed is. Nothing is capped; the driver sees totals only.
    """
    scratch = Scratch(pages.sparkSession)
    text = F.lower(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(script|style).*?</\1>|<[^>]*>", " "))
    word = F.explode(F.expr(f"regexp_extract_all(t, '[a-z]{{1,{LONGEST_WORD}}}', 0)")).alias("w")
    met = pages.select(text.alias("t")).select(word).groupBy("w").agg(F.count("*").alias("n"))
    known = pages.sparkSession.createDataFrame([(s, 2) for s in seeds], "w string, n long")
    words = scratch.cut(met.union(known).groupBy("w").agg(F.max("n").alias("n")))  # a seed counts as met twice at least
    total = (words.agg(F.sum("n").alias("n")).first()["n"] or 0) + 1
    units = scratch.cut(_units(pages, url))
    parts = scratch.cut(_parts(units))
    tokens = scratch.cut(_tokens(parts, words, total, scratch))
    seeded = tokens.filter(F.arrays_overlap("words", F.array(*map(F.lit, seeds)))).select("mark", "part")
    first = scratch.cut(parts.join(seeded, ["mark", "part"], "left_semi").select("host", "path").distinct())
    odds, prior = _learn(units, parts, tokens, first, scratch)
    for _ in range(rounds):
        own = _scores(parts, tokens, odds, scratch).filter(F.col("score") + prior > 0).select("host", "path")
        odds, prior = _learn(units, parts, tokens, scratch.cut(first.union(own).distinct()), scratch)
    return Model(words, total, odds, prior)


def judge(pages: DataFrame, model: Model, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """Append host, path, rule, verdict (allow or block) and block_odds, the log-odds of naive Bayes.

    A fitting rule decides; else block where the odds are positive. An url without tokens has the prior's
    odds; a token that was not learned adds nothing. Each different pair of host and path is scored once,
    then joined to its pages. Null urls and those without `://` have an empty host and path. Urls of any
    length are read whole; repeated rows get equal verdicts, no rows give no rows. Columns of the appended
    names are replaced, others pass, whatever their names.
    """
    scratch = Scratch(pages.sparkSession)
    made = ("host", "path", "rule", "verdict", "block_odds")
    host, path = split_url(F.col(url))
    rows = pages.select(F.struct(*[c for c in pages.columns if c.lower() not in made]).alias("row"), host.alias("host"), path.alias("path"))
    parts = scratch.cut(_parts(_units(pages, url)))
    scores = _scores(parts, _tokens(parts, model.words, model.total, scratch), model.odds, scratch)
    met = rows.join(scores, ["host", "path"], "left").withColumn("block_odds", F.coalesce("score", F.lit(0.0)) + model.prior)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("block_odds") > 0, "block").otherwise("allow")
    return met.select("row.*", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "block_odds")
