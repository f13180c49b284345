"""Approximate nearest neighbours over learned partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.shared import Scratch, small_batches

#: Rows of a partition that one task compares at once; a larger partition is dealt to more tasks.
BLOCK = 20_000


@dataclass(frozen=True)
class Model:
    """A two-layer classifier from a vector to its partition."""

    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        scale = np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum(x / np.where(scale > 0, scale, 1) @ self.first + self.first_bias, 0) @ self.second + self.second_bias


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row, itself left out."""
    k = min(k, len(x) - 1)
    square, out = (x**2).sum(1), np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        d = square[None] - 2 * x[at : at + 1024] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12, slack: float = 0.1) -> np.ndarray:
    """A part for each node: few edges between parts, none larger than its even share by more than slack.

    Starts from nearest random centres under the size bound, then moves nodes, those that gain most edges
    first, to the part most of their neighbours (both ways) are in, as long as it has room.
    """
    n = len(graph)
    room = int(np.ceil(n / parts * (1 + slack) - 1e-9))
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(5):
        near = np.argsort((centres**2).sum(1)[None] - 2 * x @ centres.T, axis=1)
        part, used = np.full(n, -1), np.zeros(parts, int)
        for rank in range(parts):
            for i in np.flatnonzero(part < 0):
                p = near[i, rank]
                if used[p] < room:
                    part[i], used[p] = p, used[p] + 1
        centres = np.stack([x[part == p].mean(0) if (part == p).any() else centres[p] for p in range(parts)])
    source = np.repeat(np.arange(n), graph.shape[1])
    target = graph.ravel()
    for _ in range(rounds):
        votes = np.bincount(np.concatenate([source * parts + part[target], target * parts + part[source]]), minlength=n * parts).reshape(n, parts)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved, used = 0, np.bincount(part, minlength=parts)
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if used[best[i]] < room:
                used[part[i]] -= 1
                used[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def train(x: np.ndarray, parts: int, k: int = 10, hidden: int = 128, epochs: int = 30, seed: int = 5) -> Model:
    """Partition the neighbour graph of x, then fit the classifier to each row's own and neighbours' parts (numpy, Adam)."""
    rng = np.random.default_rng(seed)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(size > 0, size, 1)
    parts = max(1, min(parts, len(x)))
    w = [rng.normal(0, (2 / max(1, x.shape[1])) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (2 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    if len(x) > 1 and parts > 1:
        graph = neighbour_graph(x, k)
        part = balanced_parts(graph, x, parts, rng)
        want = np.zeros((len(x), parts))
        np.add.at(want, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 0.5 / max(1, graph.shape[1]))
        want[np.arange(len(x)), part] += 0.5
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                a, t = x[at], want[at]
                h = np.maximum(a @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                d = (p - t) / len(at)
                e = d @ w[2].T * (h > 0)
                step += 1
                for i, g in enumerate((a.T @ e, e.sum(0), h.T @ d, d.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(*w)


def usable(vector: Column) -> Column:
    """True for vectors of finite components, not all zero."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda c: c != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 0))


def probes_needed(model: Model, x: np.ndarray, recall: float, k: int = 10) -> int:
    """The fewest probed parts that find `recall` of the k nearest among rows x that the model has not seen.

    Fewer rows than the table has lie farther apart, so the answer errs on the side of more parts.
    """
    parts = len(model.second_bias)
    if len(x) < 2 or parts < 2:
        return parts
    order = np.argsort(-model.logits(x), axis=1, kind="stable")
    graph = neighbour_graph(x, k)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None].repeat(len(x), 0), axis=1)
    at = rank[np.arange(len(x))[:, None], order[graph, 0]]  # which probe of a row reaches the part of its neighbour
    found = np.cumsum(np.bincount(at.ravel(), minlength=parts)) / at.size
    return int(np.searchsorted(found, recall - 1e-12)) + 1


def _top(q: np.ndarray, names: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, exact distance) arrays: each query's k best rows of x, ids rising, ties to smaller ids; a
    repeated id counts once, by its nearest row."""
    square, out = (x**2).sum(1), []
    repeats = bool((ids[1:] == ids[:-1]).any())
    for at in range(0, len(q), 64):
        rough = square - 2 * (q[at : at + 64] @ x.T) + (q[at : at + 64] ** 2).sum(1)[:, None]
        for a, name, row in zip(q[at : at + 64], names[at : at + 64], rough, strict=True):
            row[ids == name] = np.inf
            last = np.partition(row, k - 1)[k - 1] if len(row) > k and not repeats else np.inf
            pick = np.flatnonzero((row <= last + 1e-9 * (1 + square.max() + a @ a)) & (ids != name))
            exact = np.sqrt(((x[pick] - a) ** 2).sum(1))
            top = np.lexsort((ids[pick], exact))
            if repeats:
                top = top[np.sort(np.unique(ids[pick][top], return_index=True)[1])]
            top = top[:k]
            out.append((np.full(len(top), name), ids[pick][top], exact[top]))
    return out


FOUND = "query_id long, vec_id long, score double"


def _nearest(k: int):
    """Over rows (part, block, asks, id, vector) sorted so: the rows of a block, at most BLOCK or so, are held,
    the queries that follow them stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids = None, [], []
        for batch in batches:
            part, block, asks, names = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            new = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
            out = []
            for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
                if (part[a], block[a]) != now:
                    now, held, ids = (part[a], block[a]), [], []
                vectors = _matrix(batch.column(4).slice(a, b - a))
                if not asks[a]:
                    held.append(vectors)
                    ids.append(names[a:b])
                elif held:
                    held, ids = [np.concatenate(held)], [np.concatenate(ids)]
                    out += _top(vectors, names[a:b], held[0], ids[0], k)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, sample: int = 8_192, parts: int | None = None, probes: float | None = None, recall: float = 0.95, tune: int = 4_096, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by Euclidean distance, as far as found.

    queries is a condition that picks the rows to search for. The index is learned on the `sample` rows of
    smallest key hash: their neighbour graph is cut into balanced parts and a small classifier trained on
    them; then every row enters the classifier's best part, and a query looks into its most probable parts,
    whose rows are compared exactly. How many is found out on the next `tune` rows by key hash (of a small
    table, on a quarter of it), which the classifier has not seen: the fewest that reach `recall` there, so vectors with clusters need few parts
    and vectors without structure many. probes, a share of the parts, overrules it.

    Vectors null, empty, zero or with null or non-finite components take no part. Vectors of another length
    than the commonest are compared with all of their own length. Rows that repeat a key are candidates that
    count once, by the nearest; as queries they ask once, with the least vector. No rows give no rows; other
    columns are not looked at, whatever their names.

    parts defaults to a sixth of the root of the number of rows, a power of two from 8 to 1,024. A part
    larger than `block` rows, such as one with many copies of a vector, is dealt to several tasks, each of
    which sees all its queries, a batch at a time. The sample, the model and the parts' sizes reach the
    driver; all are bounded by the parameters.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    good = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    good = good.filter(usable(F.col("vector")) & F.col("id").isNotNull())
    sizes = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = sizes["d"]
    if parts is None:
        parts = int(np.clip(2 ** round(np.log2(max(1, sizes["count"]) ** 0.5 / 6)), 8, 1_024))
    same = good.filter(F.size("vector") == width)
    picked = same.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample + tune)  # ids first: vectors of the picked alone travel
    rows = same.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("vector").alias("vector")).withColumn("order", F.xxhash64("id")).toPandas().sort_values(["order", "id"])
    chosen = np.stack(rows["vector"].to_numpy())
    seen = min(sample, max(1, len(chosen) * 3 // 4))
    model = train(chosen[:seen], parts)
    shared, parts = spark.sparkContext.broadcast(model), len(model.second_bias)
    reach = probes_needed(model, chosen[seen:], recall, k) if probes is None else int(np.ceil(parts * probes))
    reach = max(1, min(parts, reach))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, asks = batch.column(1), batch.column(2).to_pylist()
            sizes = np.diff(column.offsets.to_numpy())
            near = [[-int(d)] for d in sizes]
            at = np.flatnonzero(sizes == width)
            order = np.argsort(-shared.value.logits(_matrix(column.take(pa.array(at)))), axis=1, kind="stable")[:, :reach] if len(at) else []
            for i, o in zip(at, order, strict=True):
                near[i] = o.tolist() if asks[i] else o[:1].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=["id", "vector", "asks", "near"])

    placed = scratch.cut(good.mapInArrow(place, "id long, vector array<double>, asks boolean, near array<int>"))
    first = F.get("near", F.lit(0))
    counts = {r["p"]: r["n"] for r in placed.groupBy(first.alias("p")).agg(F.count("*").alias("n")).collect()}
    blocks = F.create_map(*[F.lit(x) for p, n in counts.items() for x in (p, max(1, -(-n // block)))])
    pick = lambda p: F.coalesce(F.element_at(blocks, p), F.lit(1))
    rows = placed.select(first.alias("part"), F.pmod(F.xxhash64("id"), pick(first).cast("long")).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "vector")
    asked = placed.filter("asks").groupBy("id").agg(F.min(F.struct("vector", "near")).alias("least")).select("id", "least.vector", F.explode("least.near").alias("part"))
    dealt = asked.select("part", F.explode(F.sequence(F.lit(0), pick(F.col("part")) - 1)).alias("block"), F.lit(1).alias("asks"), "id", "vector")
    met = rows.union(dealt).repartition("part", "block").sortWithinPartitions("part", "block", "asks", "id")
    found = met.mapInArrow(_nearest(k), FOUND).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
