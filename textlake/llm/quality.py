"""Quality classifier: averaged embeddings of hashed words and character n-grams under a softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.shared import SHORT, add_columns

#: Distinct words whose scores a worker remembers before it starts afresh.
REMEMBER = 200_000
#: What stands for a word that repeats the one before it.
AGAIN = b"\0again"


@dataclass(frozen=True)
class Model:
    """Vectors of feature buckets and the softmax layer over their average."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    shortest: int
    longest: int

    def scores(self) -> np.ndarray:
        """What each bucket adds to the log-odds of class 1 over class 0."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0])


def features(words: list[bytes], buckets: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place of its word): each word itself, and the n-grams of its bytes in angle brackets."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, count=len(words))
    framed = [b"<" + w + b">" for w in words]
    data = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, framed), np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    left[np.repeat(np.fromiter((w == AGAIN for w in words), bool, count=len(words)), sizes)] = 0
    ids, owners = [own % np.uint64(buckets)], [np.arange(len(words))]
    h = np.zeros(len(data), np.uint64)
    for n in range(1, longest + 1):
        h = h[: len(data) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + data[n - 1 :]
        if n >= shortest and len(h):
            at = np.flatnonzero(left[: len(h)] >= n)
            mixed = (h[at] ^ (h[at] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            ids.append((mixed >> np.uint64(33)) % np.uint64(buckets))
            owners.append(owner[at])
    return np.concatenate(ids).astype(np.int32), np.concatenate(owners)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, a word that repeats the one before replaced by a mark."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return [AGAIN if w == p else w for w, p in zip(words, [b"", *words[:-1]], strict=True)] if words else words


def train(texts: list, labels: list, buckets: int = 1 << 16, width: int = 10, epochs: int = 4, rate: float = 0.5, batch: int = 32, shortest: int = 3, longest: int = 4, seed: int = 7) -> Model:
    """Fit by numpy stochastic gradient descent; no rows or one class only give a model that says so with 0.5 or that class."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    weights, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    docs = []
    for text in texts:
        counted: dict[bytes, int] = {}
        for w in words_of(text):
            counted[w] = counted.get(w, 0) + 1
        ids, owner = features(list(counted), buckets, shortest, longest)
        share = np.bincount(ids, np.fromiter(counted.values(), float, count=len(counted))[owner], buckets) if counted else np.zeros(buckets)
        flat = np.flatnonzero(share)
        docs.append((flat.astype(np.int32), (share[flat] / max(1.0, share.sum())).astype(np.float32)))
    gold, steps = np.array(labels, np.int64), max(1, epochs * ((len(docs) + batch - 1) // batch))
    if len(gold):
        counts = np.bincount(gold, minlength=2)[:2] + 1.0
        bias = np.log(counts / counts.sum()).astype(np.float32)
        weights = rng.normal(0, 0.1, (width, 2)).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), batch):
            now = rate * (1 - step / steps) * width
            step += 1
            pick = [docs[i] for i in order[at : at + batch]]
            rows = np.concatenate([np.full(len(d[0]), i) for i, d in enumerate(pick)])
            ids, share = np.concatenate([d[0] for d in pick]), np.concatenate([d[1] for d in pick])
            taken = vectors[ids] * share[:, None]
            hidden = np.stack([np.bincount(rows, taken[:, k], len(pick)) for k in range(width)], 1) if len(ids) else np.zeros((len(pick), width))
            z = hidden @ weights + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), gold[order[at : at + batch]]] -= 1
            back = (p @ weights.T)[rows] * share[:, None]
            weights -= (now / len(pick) * hidden.T @ p).astype(np.float32)
            bias -= (now / len(pick) / width * p.sum(0)).astype(np.float32)
            for k in range(width if len(ids) else 0):
                vectors[:, k] -= now * np.bincount(ids, back[:, k], buckets).astype(np.float32)
    return Model(vectors, weights, bias, shortest, longest)


class Scorer(dict):
    """word -> what it adds, and as the imaginary part how many features it has; computed once a worker and model."""

    def __init__(self, model: Model):
        self.adds, self.model = model.scores().astype(np.float64), model
        self.bias = float(model.bias[1] - model.bias[0])

    def learn(self, words: set[bytes]) -> None:
        if len(self) > REMEMBER:
            self.clear()
        new = [w for w in words if w not in self]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids, owner = features(part, len(self.adds), self.model.shortest, self.model.longest)
            adds, count = np.bincount(owner, self.adds[ids], len(part)), np.bincount(owner, minlength=len(part))
            self.update(zip(part, (adds + 1j * count).tolist(), strict=True))

    def scores(self, texts: list) -> list[float]:
        lists = [words_of(t) for t in texts]
        distinct: set[bytes] = set()
        distinct.update(*lists)
        self.learn(distinct)
        sums = np.array([sum(map(self.__getitem__, x), 0j) for x in lists], complex)
        odds = self.bias + np.divide(sums.real, sums.imag, out=np.zeros(len(sums)), where=sums.imag > 0)
        for w in distinct:
            if len(w) > SHORT:
                del self[w]
        return (1 / (1 + np.exp(-np.clip(odds, -50, 50)))).tolist()


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", learn_from=None, most: int = 6_000, longest: int = 100_000) -> DataFrame:
    """(text, label): at most `most` labelled documents, those of smallest hash of the key; a document with
    several labels takes the largest, one whose id repeats is a row for each different text. Only their keys, a
    bounded number, are broadcast. Texts of more than `longest` characters are not learned from, which bounds
    the sample in bytes too; all are scored."""
    rows = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    if learn_from is not None:
        rows = rows.filter(learn_from)
    ids = rows.groupBy(key).agg(F.max(label).alias("_label")).orderBy(F.xxhash64(key), key).limit(most)
    found = docs.select(key, text).join(F.broadcast(ids), key)
    found = found.filter(F.coalesce(F.length(text), F.lit(0)) <= longest)
    return found.select(F.col(key).alias("_key"), F.col(text).alias("text"), F.col("_label").cast("int").alias("label")).distinct().select("text", "label")


def fit(rows: DataFrame, **options) -> Model:
    """A model of training_rows; its rows are bounded, so the driver may hold them."""
    found = rows.withColumn("_order", F.xxhash64("text")).toPandas().sort_values(["_order", "label"])
    return train(found["text"].tolist(), found["label"].clip(0, 1).tolist(), **options)


_scorers: dict[str, Scorer] = {}


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Append the probability of class 1. Null and empty texts get the prior's; texts are scored whole.

    A column of that name is replaced, others pass; no rows give no rows, repeated rows get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mark = xxhash.xxh64_hexdigest(model.vectors.tobytes() + model.weights.tobytes() + model.bias.tobytes())

    def make(texts: list) -> dict[str, pa.Array]:
        if mark not in _scorers:
            _scorers.clear()
            _scorers[mark] = Scorer(shared.value)
        own = _scorers[mark]
        return {name: pa.array(own.scores(texts), pa.float64())}

    return add_columns(docs, text, make, f"{name} double")
