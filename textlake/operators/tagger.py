"""Sequence tagging by an averaged perceptron that Spark trains in shards, mixing their weights after every pass."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Weights = dict[str, dict[str, float]]


@dataclass(frozen=True)
class Tagger:
    """Classes in order (the first wins ties), and weights by feature and class."""

    classes: list[str]
    weights: Weights


def word_features(words: list[str], i: int, one: str, two: str) -> list[str]:
    """What is seen of word i, given the two tags before it."""
    w = words[i]
    around = {f"at{d}": words[i + d].lower() if 0 <= i + d < len(words) else "<>" for d in (-2, -1, 1, 2)}
    low = w.lower()
    shape = "".join("X" if c.isupper() else "x" if c.islower() else "d" if c.isdigit() else c for c in w[:1] + w[-1:])
    seen = {"word": low, "start": low[:1], "end2": low[-2:], "end3": low[-3:], "shape": shape, "tag1": one, "tag2": two, "tags": f"{one} {two}", "tagword": f"{one} {low}", **around, "before": f"{around['at-1']} {low}", "after": f"{low} {around['at1']}"}
    return ["bias", *[f"{k}={v}" for k, v in seen.items()]]


def _best(weights: Weights, classes: list[str], seen: list[str]) -> str:
    total = dict.fromkeys(classes, 0.0)
    for feature in seen:
        for tag, weight in weights.get(feature, {}).items():
            total[tag] += weight
    return max(classes, key=total.__getitem__)


def certain_words(sentences: DataFrame, least: int = 20, share: float = 0.97) -> DataFrame:
    """sentences(words, tags) -> (word, tag): words seen at least that often, nearly always with one tag."""
    pairs = sentences.select(F.explode(F.arrays_zip("words", "tags")).alias("x")).groupBy(F.col("x.words").alias("word"), F.col("x.tags").alias("tag")).agg(F.count("*").alias("n"))
    best = pairs.groupBy("word").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("tag", F.struct("n", "tag")).alias("tag"))
    return best.filter((F.col("n") >= least) & (F.col("most") >= share * F.col("n"))).select("word", "tag")


def _shard(shared: Broadcast[Weights], classes: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One pass over a shard; yields how its averaged weights differ from the start's, with the words it saw."""
        start, own = shared.value, defaultdict(dict)
        sums: dict[tuple[str, str], float] = defaultdict(float)
        at = 0
        for batch in batches:
            for words, tags in zip(batch["words"], batch["tags"], strict=True):
                one = two = "<>"
                for i, gold in enumerate(tags):
                    seen = word_features(words, i, one, two)
                    total = dict.fromkeys(classes, 0.0)
                    for feature in seen:
                        for table in (start.get(feature), own.get(feature)):
                            for tag, weight in (table or {}).items():
                                total[tag] += weight
                    told = max(classes, key=total.__getitem__)
                    if told != gold:
                        for feature in seen:
                            for tag, step in ((gold, 1.0), (told, -1.0)):
                                own[feature][tag] = own[feature].get(tag, 0.0) + step
                                sums[feature, tag] += step * at
                    at += 1
                    one, two = told, one
        rows = [(f, t, w - sums[f, t] / at, at) for f, table in own.items() for t, w in table.items()]
        if rows:
            yield pd.DataFrame(rows, columns=["feature", "tag", "weight", "n"])

    return run


def train(sentences: DataFrame, key: str, shards: int = 8, passes: int = 4, most: int = 20_000) -> Tagger:
    """sentences(key, words, tags) -> a tagger.

    It learns from the `most` sentences of smallest key hash, so weights that reach the driver and go out again are bounded
    whatever the corpus; none is cut. Every pass deals them to shards by the key's hash; each shard goes on from the common
    weights, and the weights become the shards' mean by words seen.
    """
    good = sentences.filter((F.size("words") > 0) & (F.size("words") == F.size("tags"))).select(key, "words", "tags").orderBy(F.xxhash64(key), F.xxhash64("words")).limit(most)
    dealt = good.repartition(shards, F.xxhash64(key)).sortWithinPartitions(F.xxhash64(key), "words").select("words", "tags")
    facts = good.select(F.explode("tags").alias("tag")).groupBy("tag").count().orderBy("tag").collect()
    classes, total = [r["tag"] for r in facts], sum(r["count"] for r in facts)
    weights: Weights = {}
    for _ in range(passes if classes else 0):
        changes = dealt.mapInPandas(_shard(sentences.sparkSession.sparkContext.broadcast(weights), classes), "feature string, tag string, weight double, n long")
        mixed = changes.groupBy("feature", "tag").agg((F.sum(F.col("weight") * F.col("n")) / total).alias("weight")).filter("weight <> 0")
        merged: Weights = defaultdict(dict, {f: dict(t) for f, t in weights.items()})
        for r in mixed.toLocalIterator():
            merged[r["feature"]][r["tag"]] = merged[r["feature"]].get(r["tag"], 0.0) + r["weight"]
        weights = dict(merged)
    return Tagger(classes, weights)


def with_certain(sentences: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """With sure: at the place of each word that known(word, tag) has, its tag. Different words are joined, each once a
    sentence, so no table of words has to fit anywhere. The key is unique."""
    words = sentences.select(key, F.explode(F.array_distinct("words")).alias("word"))
    met = words.join(known, "word").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "tag"))).alias("_sure"))
    return sentences.join(met, key, "left").withColumn("sure", F.transform("words", lambda w: F.try_element_at("_sure", w))).drop("_sure")


def tag(sentences: DataFrame, model: Tagger, name: str = "told") -> DataFrame:
    """Append the tags of `words`, decided from left to right; null words have null tags. Rows stay where they are. Tags in
    a column `sure` (with_certain) stand as they are."""
    shared = sentences.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<string>")
    def run(column: pd.Series, sure: pd.Series) -> pd.Series:
        m, out = shared.value, []
        for words, fixed in zip(column, sure, strict=True):
            if words is None:
                out.append(None)
                continue
            tags: list[str] = []
            for i, w in enumerate(words):
                one, two = tags[-1] if i else "<>", tags[-2] if i > 1 else "<>"
                own = fixed[i] if fixed is not None else None
                tags.append(own or _best(m.weights, m.classes, word_features(words, i, one, two)))
            out.append(tags)
        return pd.Series(out, dtype=object)

    sure = F.col("sure") if "sure" in sentences.columns else F.lit(None).cast("array<string>")
    return sentences.withColumn(name, run("words", sure))


def accuracy(tagged: DataFrame, gold: str = "tags", told: str = "told") -> DataFrame:
    """(gold, told, n): how often each tag was told as each."""
    return tagged.select(F.explode(F.arrays_zip(F.col(gold).alias("gold"), F.col(told).alias("told"))).alias("x")).groupBy("x.gold", "x.told").agg(F.count("*").alias("n"))
