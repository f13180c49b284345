"""Byte-level BPE: exact merges found by backtracking over longest vocabulary matches."""

from __future__ import annotations

import base64
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textlake.llm.shared import SHORT, add_columns, fresh

#: Distinct pieces whose encodings a worker remembers before it starts afresh.
REMEMBER = 200_000


def merges(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The plain definition: merge the adjacent pair of lowest rank, leftmost first, until none is in the vocabulary."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class ByteBPE:
    """Encoder and decoder for one file of ranks.

    A sequence of tokens is what the merges give exactly if every two neighbours are compatible: merging
    just their bytes gives the two back. So the encoder walks left to right with the longest match at each
    place (pyahocorasick over bytes mapped to Latin-1), falls back to shorter matches where a neighbour is
    incompatible, and marks places from which nothing fits; each place is marked once, which keeps the work
    linear. Compatibility of a pair is computed once and remembered, as are whole pieces.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.matcher = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.matcher.add_word(token.decode("latin-1"), (rank, len(token)))
        self.matcher.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def compatible(self, left: int, right: int) -> bool:
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > 4 * REMEMBER:
                self.fits.clear()
            found = self.fits[left, right] = merges(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text = data.decode("latin-1")
        at: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, found in self.matcher.iter(text):  # by rising end, so each list ends with the longest match
            at[end + 1 - found[1]].append(found)
        size, place = len(text), 0
        open_ = bytearray(b"\1") * (size + 1)
        path: list[tuple[int, int]] = []  # (token, which match of its place)
        which = len(at[0]) - 1
        while place < size:
            choice = at[place]
            while which >= 0:
                token, length = choice[which]
                if open_[place + length] and (not path or self.compatible(path[-1][0], token)):
                    break
                which -= 1
            if which >= 0:
                path.append((token, which))
                place += length
                which = len(at[place]) - 1 if place < size else 0
            else:
                open_[place] = 0
                if not path:
                    raise ValueError("the vocabulary lacks single bytes")
                token, which = path.pop()
                place -= len(self.bytes_of[token])
                which -= 1
        return [token for token, _ in path]

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= REMEMBER:
                    known.clear()
                ids = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= SHORT:
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> ByteBPE:
    """One coder a worker process and vocabulary."""
    return ByteBPE(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Append token_ids array<int> and n_tokens long; with decoded, also the bytes that the ids decode to.

    Every match of pattern is encoded by itself, special tokens are ordinary text, and ids are those of the
    plain merges. Null texts count as empty: no ids; a text of any length is encoded whole. Columns named
    token_ids, n_tokens or decoded are replaced, others pass; no rows give no rows, repeated rows stay. The
    rank file must be readable on every executor.
    """

    def make(texts: list) -> dict[str, pa.Array]:
        own = coder(path, pattern)
        lists = [own.encode(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.empty(int(sizes.sum()), dtype=np.int32)
        place = 0
        for ids in lists:
            flat[place : place + len(ids)] = ids
            place += len(ids)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        made = {"token_ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "n_tokens": pa.array(sizes)}
        if decoded:
            made["decoded"] = pa.array([own.decode(ids) for ids in lists], pa.binary())
        return made

    return add_columns(docs, text, make, "token_ids array<int>, n_tokens long" + ", decoded binary" * decoded)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """Append the bytes that an array of ids decodes to, as `decoded`; null ids decode to null."""
    from pyspark.sql import functions as F

    def make(lists: list) -> dict[str, pa.Array]:
        own = coder(path, pattern)
        return {"decoded": pa.array([None if x is None else own.decode([int(i) for i in x.split()]) for x in lists], pa.binary())}

    own = fresh(docs.columns, "_ids")
    joined = docs.withColumn(own, F.array_join(F.col(ids).cast("array<string>"), " "))
    return add_columns(joined, own, make, "decoded binary").drop(own)
