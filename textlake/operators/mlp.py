"""Language identification by a small neural network over n-gram shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import langprofiles

SIZES = (150, 300, 600)


@dataclass(frozen=True)
class Network:
    """Features in order, languages in order, and the two layers."""

    features: list[str]
    languages: list[str]
    layers: tuple[np.ndarray, ...]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        z = np.tanh(x @ w + b) @ v + c
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def select_features(profiles: DataFrame, limit: int = 400) -> DataFrame:
    """profiles(owner, feature, rank) -> (feature, place): best ranks of all languages in turn, the first mention counts."""
    order = Window.orderBy("rank", "owner", "feature")
    first = profiles.filter(F.col("rank") < limit).groupBy("feature").agg(F.min(F.struct("rank", "owner")).alias("s")).select("feature", "s.rank", "s.owner")
    return first.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < limit).select("feature", "place")


def shares(normal: list[str], features: list[str]) -> np.ndarray:
    """Share of each feature among the running n-grams (1 to 3) of each text."""
    codes, places = np.array([_code(f) for f in features], dtype=np.int64), np.arange(len(features))
    order = np.argsort(codes, kind="stable")
    codes, places = codes[order], places[order]
    out = np.zeros((len(normal), len(features)))
    for row, text in enumerate(normal):
        own = langprofiles.running_codes(text)
        if len(own) and len(codes):
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            out[row, places] = np.bincount(at[codes[at] == own], minlength=len(codes))
        out[row] /= max(1, len(own))
    return out


def pieces(text: str) -> list[str]:
    """text.fragments() of all SIZES: windows of characters that overlap by about a third."""
    out = []
    for size in SIZES:
        out += [text[i : i + size] for i in range(0, len(text) - size + 1, int(size * 0.65))] if len(text) > size else [text] * bool(text)
    return out


def _code(gram: str) -> int:
    """A gram of one to three characters as langprofiles.running_codes() has it; others are never met."""
    shift = langprofiles.RUNNING_BITS
    return sum(ord(c) << shift * (2 - i) for i, c in enumerate(gram)) if 0 < len(gram) <= 3 else -1


def _least(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(owner, t) -> (owner, f): of each owner the task's `most` fragments of smallest xxhash64, then text; repeats count."""

    def cut(rows: list[tuple[int, str]]) -> list[tuple[int, str]]:
        return sorted(rows, key=lambda r: (r[0], r[1].encode()))[:most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[int, str]]] = {}
        bound: dict[str, int] = {}
        for batch in batches:
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine, top = held.setdefault(owner, []), bound.get(owner, 1 << 63)
                for f in pieces(text):
                    h = xxhash.xxh64_intdigest(f, 42)
                    h -= (h >> 63) << 64
                    if h <= top:
                        mine.append((h, f))
                if len(mine) > 4 * most:
                    held[owner] = cut(mine)
                    bound[owner] = held[owner][-1][0]
        rows = [(owner, f) for owner, mine in held.items() for _, f in cut(mine)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["owner", "f"])

    return run


def train(fragments: list[str], gold: list[str], features: list[str], hidden: int = 32, epochs: int = 20, rate: float = 0.01, decay: float = 1e-4, seed: int = 17) -> Network:
    """Fit with Adam and weight decay. One language needs no fit and gets all the probability."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(gold))
    x = np.sqrt(shares(fragments, features))
    y = np.eye(len(languages))[[languages.index(g) for g in gold]] if gold else np.zeros((0, 0))
    w = [rng.normal(0, (1 / max(1, len(features))) ** 0.5, (len(features), hidden)) * 4, np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, max(1, len(languages)))), np.zeros(max(1, len(languages)))]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs if len(languages) > 1 else 0):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            h = np.tanh(x[at] @ w[0] + w[1])
            d = (Network([], [], tuple(w)).probabilities(x[at]) - y[at]) / len(at)
            e = d @ w[2].T * (1 - h * h)
            step += 1
            for i, g in enumerate((x[at].T @ e + decay * w[0], e.sum(0), h.T @ d + decay * w[2], d.sum(0))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(features, languages, tuple(w))


def fit(docs: DataFrame, most: int = 600, limit: int = 400) -> Network:
    """docs(owner, text), owner the language: features from all of them; of the fragments of all whole texts the `most` of
    smallest hash of each language are learnt from. Tasks keep their own least ones, so few fragments are shuffled; what
    reaches the driver is bounded by both numbers."""
    features = [r["feature"] for r in select_features(langprofiles.profiles(langprofiles.features(docs, "running"), limit), limit).orderBy("place").collect()]
    n = F.row_number().over(Window.partitionBy("owner").orderBy(F.xxhash64("f"), "f"))
    texts = docs.filter("owner is not null and text is not null").select(F.col("owner").cast("string").alias("owner"), T.letters("text").alias("t"))
    every = texts.mapInArrow(_least(most), "owner string, f string")
    rows = every.withColumn("n", n).filter(F.col("n") <= most).select("owner", "f").orderBy("owner", "f").toPandas()
    return train(rows["f"].tolist(), rows["owner"].tolist(), features)


def distances(docs: DataFrame, network: Network) -> DataFrame:
    """docs(owner, text) -> (owner, lang, distance): one less each language's probability; 1 for texts without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for pdf in batches:
            p = own.probabilities(np.sqrt(shares(pdf["t"].tolist(), own.features))) if len(pdf) else np.zeros((0, len(own.languages)))
            p[(pdf["t"] == "").to_numpy()] = 0
            yield pd.DataFrame({"owner": np.repeat(pdf["owner"].to_numpy(), len(own.languages)), "lang": own.languages * len(pdf), "distance": 1 - p.ravel()})

    rows = docs.select(F.col("owner").cast("long").alias("owner"), F.coalesce(T.letters("text"), F.lit("")).alias("t"))
    return rows.mapInPandas(run, "owner long, lang string, distance double")
