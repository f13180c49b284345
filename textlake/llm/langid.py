"""Language identification: mixtures of languages by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.shared import add_columns, pieces, small_batches

SPACE = 32


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Code point -> its lower case if that is one code point, letters and marks; anything else -> a space."""
    table = np.full(0x110000, SPACE, np.uint32)
    for c in (*range(0x40000), *range(0xE0000, 0xE0200)):  # no other plane has letters or marks
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LM":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _grams(texts: list, buckets: int, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every letter n-gram (a run of non-letters is one space, and one stands around each text), and its text."""
    sizes = np.array([len(t or "") + 2 for t in texts], np.int64)
    joined = " " + "  ".join(t or "" for t in texts) + " "
    points = _fold()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    start = np.cumsum(sizes) - sizes
    blank = points == SPACE
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[start] = True
    points, owner, blank = points[keep], owner[keep], blank[keep]
    if len(points) < n:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    size = len(points) - n + 1
    h = np.zeros(size, np.uint64)
    for t in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[t : t + size]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    whole = (owner[: size] == owner[n - 1 :]) & ~(blank[:size] & blank[1 : size + 1]) & ~blank[1 : size + 1]
    return (h[whole] >> np.uint64(40)).astype(np.int64) % buckets, owner[:size][whole]


@dataclass(frozen=True)
class Model:
    """log[b, l]: log-likelihood of bucket b in language l; languages rise."""

    languages: list[str]
    log: np.ndarray


def fit(docs: DataFrame, learn_from: Column, text: str = "text", lang: str = "lang", buckets: int = 1 << 16, smooth: float = 0.5) -> Model:
    """Count every n-gram of every document of the training part in Spark: tasks count into buckets, sums meet by key.

    What reaches the driver is at most `buckets` rows a language. No labelled rows give a model of no language.
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(learn_from & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, F.col(text).cast("string").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in pieces(batches, "_text"):
            langs, texts = np.array(part.column(0).to_pylist(), object), part.column(1).to_pylist()
            for one in sorted(set(langs)):
                found = _grams([t for t, x in zip(texts, langs, strict=True) if x == one], buckets)[0]
                sums[one] = sums.get(one, 0) + np.bincount(found, minlength=buckets)
        for one, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])

    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.full((buckets, len(languages)), smooth)
    for i, one in enumerate(languages):
        own = found[found["lang"] == one]
        counts[own["bucket"].to_numpy(), i] += own["n"].to_numpy()
    return Model(languages, np.log(counts / counts.sum(0)).astype(np.float32))


def mixtures(texts: list, model: Model, run: int = 16, rounds: int = 12, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(shares[text, language], has a letter[text]).

    A text is a sequence of runs of n-grams, each run in one language; a run's likelihood is the product of
    its n-grams'. Languages enter a text's set one by one, the best first; expectation-maximisation fits
    the shares of a set, and a language stays only if the log-likelihood rises by more than
    penalty * log(runs) (+ penalty). Sets whose best possible rise is below that are not tried.
    """
    many, size = len(texts), len(model.languages)
    shares = np.zeros((many, size))
    grams, owner = _grams(texts, len(model.log))
    lettered = np.bincount(owner, minlength=many) > 0
    if not len(grams) or not size:
        return shares, lettered
    count = np.bincount(owner, minlength=many)
    start = np.cumsum(count) - count
    segment = (np.arange(len(grams)) - start[owner]) // run
    new = np.ones(len(grams), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])
    cut = np.flatnonzero(new)
    ll = np.add.reduceat(model.log[grams], cut, axis=0).astype(np.float64)
    doc = owner[cut]
    total = np.stack([np.bincount(doc, ll[:, k], many) for k in range(size)], 1)
    runs = np.bincount(doc, minlength=many)
    best = total.argmax(1)
    likelihood = total.max(1)
    shares[np.arange(many), best] = 1.0
    chosen = np.zeros((many, size), bool)
    chosen[np.arange(many), best] = True
    need = penalty * (1 + np.log(np.maximum(runs, 1)))
    for _ in range(size - 1):
        rise = np.bincount(doc, ll.max(1), many) - likelihood  # no mixture can be likelier than each run's best language
        live = np.flatnonzero(lettered & (rise > need) & (chosen.sum(1) < size))
        if not len(live):
            break
        at = np.full(many, -1)
        at[live] = np.arange(len(live))
        mine = at[doc] >= 0
        sub, own = ll[mine], at[doc[mine]]
        top = sub.max(1, keepdims=True)
        like = np.exp(np.maximum(sub - top, -700))
        base = np.bincount(own, top[:, 0], len(live))
        n = np.bincount(own, minlength=len(live))[:, None]
        gain, pick, fitted = np.full(len(live), -np.inf), np.zeros(len(live), np.int64), shares[live].copy()
        for k in range(size):
            can = ~chosen[live, k]
            pi = (chosen[live] | (np.arange(size) == k)).astype(float)
            pi /= pi.sum(1, keepdims=True)
            for _ in range(rounds):
                part = like * pi[own]
                part /= part.sum(1, keepdims=True)
                pi = np.stack([np.bincount(own, part[:, j], len(live)) for j in range(size)], 1) / n
            now = np.bincount(own, np.log((like * pi[own]).sum(1)), len(live)) + base - likelihood[live]
            better = can & (now > gain)
            gain[better], pick[better], fitted[better] = now[better], k, pi[better]
        taken = gain > need[live]
        rows = live[taken]
        chosen[rows, pick[taken]] = True
        shares[rows] = fitted[taken]
        likelihood[rows] += gain[taken]
        stop = live[~taken]
        need[stop] = np.inf
        if not taken.any():
            break
    return shares, lettered


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append lang_pred, score and languages.

    lang_pred is the language of the largest share (ties: the first by name), score that share, and
    languages the chosen set, largest share first, joined by commas. A null text, one without letters and a
    model of no language give `und`, score 0 and an empty set. Texts are read whole. Columns of those names
    are replaced, others pass; no rows give no rows, repeated rows get equal answers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list) -> dict[str, pa.Array]:
        own = shared.value
        shares, lettered = mixtures(texts, own)
        pred, score, sets = [], [], []
        for row, known, t in zip(shares, lettered, texts, strict=True):
            if not known or not own.languages or not any(map(str.isalpha, t)):
                pred.append("und"), score.append(0.0), sets.append("")
                continue
            order = [i for i in np.argsort(-row, kind="stable") if row[i] > 0]
            pred.append(own.languages[order[0]]), score.append(min(1.0, float(row[order[0]])))
            sets.append(",".join(own.languages[i] for i in order))
        return {"lang_pred": pa.array(pred), "score": pa.array(score), "languages": pa.array(sets)}

    return add_columns(docs, text, make, "lang_pred string, score double, languages string", budget=min(2_000_000, 8_000_000 // max(1, len(model.languages))))
