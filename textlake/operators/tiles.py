"""Cosines of sources with all documents, tile by tile: a task holds the postings of some documents, sources pass by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of a task, in the order of block and kind: documents of a block first (0), then sources (1).
ROWS = "block int, kind int, id long, norm double, lemmas array<long>, weights array<double>"
FOUND = "source_id long, doc_id long, score double"
#: Documents' columns of scores are looked through by so many at a time.
RUN = 64
#: Scores that rounding makes equal lie no farther apart; less than the least is rounded to none.
NEAR, LEAST = 1e-9, 1e-12
#: Scores held at once, of so many sources at most; lists of fewer postings are added up together.
CELLS, MOST_SOURCES, SHORT = 1 << 20, 128, 256


class Block:
    """Postings of some documents, by lemma: places of documents, and weights by their norms."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, sizes: np.ndarray, lemmas: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.n = ids[order], len(ids)
        at = np.empty(len(ids), np.int32)
        at[order] = np.arange(len(ids), dtype=np.int32)
        by = np.argsort(lemmas, kind="stable")
        sorted_lemmas = lemmas[by]
        first = np.flatnonzero(np.concatenate(([True], sorted_lemmas[1:] != sorted_lemmas[:-1]))) if len(lemmas) else np.zeros(0, np.int64)
        self.keys, self.first = sorted_lemmas[first], np.append(first, len(lemmas))
        self.docs = np.repeat(at, sizes)[by]
        self.values = (weights / np.repeat(norms, sizes))[by]
        self.width = -(-self.n // RUN) * RUN
        self.dense: dict[int, np.ndarray] = {}

    def _column(self, a: int, b: int) -> np.ndarray:
        """Values of a lemma that many documents have, one for every document."""
        if a not in self.dense:
            column = np.zeros(self.width)
            column[self.docs[a:b]] = self.values[a:b]
            self.dense[a] = column
        return self.dense[a]

    def nearest(self, ids: np.ndarray, sizes: np.ndarray, lemmas: np.ndarray, weights: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sources, documents, scores): the `limit` best documents of every source, itself left out; equal scores by id."""
        place = np.searchsorted(self.keys, lemmas)
        place[place == len(self.keys)] = 0
        known = np.flatnonzero(self.keys[place] == lemmas) if len(self.keys) else np.zeros(0, np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        own = np.sqrt(np.add.reduceat(weights * weights, bounds[:-1]))
        share, source = (weights / np.repeat(own, sizes))[known], np.repeat(np.arange(len(ids)), sizes)[known]
        starts, ends = self.first[place[known]], self.first[place[known] + 1]
        left, right = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        step = max(1, min(MOST_SOURCES, CELLS // self.width))
        out = []
        for low in range(0, len(ids), step):
            high = min(low + step, len(ids))
            some = slice(*np.searchsorted(source, [low, high]))
            scores = self._scores(source[some] - low, starts[some], ends[some], share[some], high - low)
            for k in np.flatnonzero(right[low:high] > left[low:high]).tolist():
                scores[k, left[low + k] : right[low + k]] = 0.0
            least = np.full(high - low, LEAST)
            if self.width // RUN > limit:  # so many runs as documents are wanted hold something of at least this score
                tops = scores.reshape(high - low, -1, RUN).max(axis=2)
                least = np.maximum(least, np.partition(tops, -limit, axis=1)[:, -limit] - NEAR)
            row, at = np.nonzero(scores >= least[:, None])
            told = scores[row, at]
            order = np.lexsort((at, -np.round(told, 10), row))
            row, at, told = row[order], at[order], told[order]
            best = np.arange(len(row)) - np.searchsorted(row, row, "left") < limit
            out.append((ids[low + row[best]], self.ids[at[best]], told[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _scores(self, source: np.ndarray, starts: np.ndarray, ends: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
        """Scores of all documents of the block for n sources: short lists of postings together, long ones each by itself."""
        sizes = ends - starts
        short, long = np.flatnonzero(sizes < SHORT), np.flatnonzero(sizes >= SHORT)
        few = sizes[short]
        at = np.repeat(starts[short] - (np.cumsum(few) - few), few) + np.arange(few.sum())
        cells = np.repeat(source[short] * self.width, few) + self.docs[at]
        scores = np.bincount(cells, weights=self.values[at] * np.repeat(share[short], few), minlength=n * self.width)
        scores = scores.astype(float, copy=False).reshape(n, self.width)  # without cells it counts whole numbers
        for k, a, b, q in zip(source[long].tolist(), starts[long].tolist(), ends[long].tolist(), share[long].tolist(), strict=True):
            if (b - a) * 4 > self.n:
                scores[k] += self._column(a, b) * q
            else:
                scores[k, self.docs[a:b]] += self.values[a:b] * q
        return scores


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lemmas, weights = batch.column("lemmas"), batch.column("weights")
    sizes = lemmas.value_lengths().to_numpy(zero_copy_only=False)
    numpy = lambda c: c.to_numpy(zero_copy_only=False)
    return numpy(batch.column("id")), numpy(batch.column("norm")), sizes, numpy(lemmas.flatten()), numpy(weights.flatten())


def nearest(limit: int):
    """ROWS -> FOUND, for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, block, current = [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = batch.column("block").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                number, kind = divmod(int(marks[a]), 2)
                if number != current:
                    parts, block, current = [], None, number
                own = _lists(batch.slice(a, b - a))
                if kind == 0:
                    parts.append(own)
                    continue
                if block is None and parts:
                    block = Block(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                    parts = []
                if block is None:
                    continue
                ids, _, sizes, lemmas, weights = own
                found = block.nearest(ids, sizes, lemmas, weights, limit)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["source_id", "doc_id", "score"])

    return run
