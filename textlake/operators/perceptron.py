"""Averaged perceptrons of any structure, trained in shards by Spark, their weights mixed after every pass."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Weights = dict[str, dict[str, float]]


def best(weights: Weights, classes: list[str], seen: list[str]) -> str:
    """The class of the highest score; the first of `classes` wins ties."""
    total = dict.fromkeys(classes, 0.0)
    for feature in seen:
        for name, weight in weights.get(feature, {}).items():
            if name in total:
                total[name] += weight
    return max(classes, key=total.__getitem__)


class Learner:
    """What one shard adds to common weights: they are read through it, and its own steps are averaged."""

    def __init__(self, start: Weights):
        self.start, self.own = start, defaultdict(dict)
        self.sums: dict[tuple[str, str], float] = defaultdict(float)
        self.at = 0

    def scores(self, classes: list[str], seen: list[str]) -> dict[str, float]:
        total = dict.fromkeys(classes, 0.0)
        for feature in seen:
            for table in (self.start.get(feature), self.own.get(feature)):
                for name, weight in (table or {}).items():
                    if name in total:
                        total[name] += weight
        return total

    def learn(self, right: str, told: str, seen: list[str]) -> None:
        """One decision: its features move towards the right class if another was told."""
        if right != told:
            for feature in seen:
                for name, step in ((right, 1.0), (told, -1.0)):
                    self.own[feature][name] = self.own[feature].get(name, 0.0) + step
                    self.sums[feature, name] += step * self.at
        self.at += 1

    def changes(self) -> pd.DataFrame:
        """How far the averaged weights lie from the common ones, with the decisions made."""
        rows = [(f, c, w - self.sums[f, c] / self.at, self.at) for f, table in self.own.items() for c, w in table.items()]
        return pd.DataFrame(rows, columns=["feature", "class", "weight", "n"])


def train(examples: DataFrame, key: str, visit: Callable[[dict, Learner], None], shards: int = 8, passes: int = 4) -> Weights:
    """examples -> weights. visit(row, learner) makes the decisions of one example.

    The caller bounds `examples`: weights reach the driver and go out again at every pass. A pass deals the examples to
    shards by the key's hash, in an order of its own; weights become the shards' mean by decisions made.
    """
    spark: SparkSession = examples.sparkSession
    weights: Weights = {}
    for number in range(passes):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            learner = Learner(shared.value)
            for batch in batches:
                for row in batch.to_dict("records"):
                    visit(row, learner)
            if learner.own:
                yield learner.changes()

        dealt = examples.repartition(shards, F.xxhash64(key)).sortWithinPartitions(F.xxhash64(key, F.lit(number)))
        changes = dealt.mapInPandas(run, "feature string, class string, weight double, n long")
        rows = changes.groupBy("feature", "class").agg(F.sum(F.col("weight") * F.col("n")).alias("weight"), F.sum("n").alias("n")).filter("weight <> 0").toPandas()
        if rows.empty:
            break
        total = rows["n"].max()
        merged: Weights = defaultdict(dict, {f: dict(t) for f, t in weights.items()})
        for feature, name, weight in zip(rows["feature"], rows["class"], rows["weight"] / total, strict=True):
            merged[feature][name] = merged[feature].get(name, 0.0) + weight
        weights = dict(merged)
    return weights
