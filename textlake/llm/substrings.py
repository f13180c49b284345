"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.shared import add_columns, pieces, small_batches

#: Odd multipliers of the two rolling hashes, modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Words whose windows a task hashes at once; a longer document makes a chunk of its own.
CHUNK = 2_000_000
#: Words of the corpus for each bucket: what one task judges, whatever the size of the input.
BUCKET = 1_500_000
LAST = 2**63 - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    """Any bits of the result depend on all bits of h."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolling(words: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """Rabin-Karp hashes of all windows of `width` word hashes: sums of word times base^-place, rolled on by
    differences of running sums and brought to the window's start by base^place, all modulo 2^64."""
    size = len(words) - width + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    powers = lambda b: np.cumprod(np.append(np.uint64(1), np.full(len(words) - 1, b, np.uint64)), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(pow(base, -1, 1 << 64)), dtype=np.uint64)])
    return _mixed((sums[width:] - sums[:-width]) * powers(base)[:size])


def _pack(rising: np.ndarray) -> bytes:
    """Rising 32-bit numbers as gaps, byte plane by byte plane, so that the shuffle's codec squeezes the zeros."""
    gaps = np.diff(rising, prepend=0).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _later(hashes: np.ndarray, order: np.ndarray, bucket: np.ndarray | None = None) -> np.ndarray:
    """True where a hash (in its bucket) also occurs at a smaller order (a tuple of equal orders counts as one place)."""
    by = np.argsort(hashes, kind="stable") if bucket is None else np.lexsort((bucket, hashes))
    same = np.zeros(len(by), bool)
    same[1:] = hashes[by[1:]] == hashes[by[:-1]]
    if bucket is not None:
        same[1:] &= bucket[by[1:]] == bucket[by[:-1]]
    starts = np.flatnonzero(~same)
    least = np.minimum.reduceat(order[by], starts) if len(starts) else order[:0]
    out = np.zeros(len(by), bool)
    out[by] = order[by] > np.repeat(least, np.diff(np.append(starts, len(by))))
    return out


def _chunk_rows(docs: list[tuple[int, int, np.ndarray]], chunk: int, width: int, buckets: int) -> Iterator[tuple]:
    """Rows (chunk, bucket, hashes, places, gone, doc_ids, starts, crcs) of one chunk's documents."""
    docs = sorted(docs, key=lambda d: d[:2])
    docs = [d for i, d in enumerate(docs) if not i or d[:2] != docs[i - 1][:2]]  # a repeated row adds nothing
    sizes = np.array([len(d[2]) for d in docs], np.int64)
    starts = np.cumsum(sizes) - sizes
    ids, crcs = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int64)
    words = np.concatenate([d[2] for d in docs])
    h = rolling(words, width)
    left = np.repeat(starts + sizes, sizes)[: len(h)] - np.arange(len(h))
    place = np.flatnonzero(left >= width)
    h = h[place]
    bucket = rolling(_mixed(words), width, BASES[1])[place] % np.uint64(buckets)
    order = place if len(np.unique(ids)) == len(ids) else _dense(ids, starts, sizes, place)
    gone = _later(h, order, bucket)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
    table = lambda part: (np.diff(ids[part], prepend=0).astype("<i8").tobytes(), _pack(starts[part]))
    yield chunk, chunk % buckets, None, None, None, *table(slice(None)), crcs.astype("<i8").tobytes()
    for b in range(buckets):
        own = by[cuts[b] : cuts[b + 1]]
        if len(own):
            first, later = own[~gone[own]], own[gone[own]]
            seen = np.unique(np.searchsorted(starts, place[first], side="right") - 1)  # the documents that these windows start in
            yield chunk, b, h[first].astype("<u8").tobytes(), _pack(place[first]), _pack(place[later]), *table(seen), None


def _dense(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """An order of places by (doc_id, start in the document), where documents share an id."""
    doc = np.repeat(np.arange(len(ids)), sizes)[place]
    at = place - starts[doc]
    return np.unique(np.stack([ids[doc], at], 1), axis=0, return_inverse=True)[1].ravel()


def _hashed(width: int, buckets: int, chunk_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, used, made, part = [], 0, 0, TaskContext.get().partitionId()
        digest = xxhash.xxh64_intdigest

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(_chunk_rows(docs, part << 32 | made, width, buckets))
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)

        for batch in pieces(batches, "_text"):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                words = data.split()
                if len(words) >= width:
                    docs.append((key, zlib.crc32(data), np.fromiter(map(digest, words), np.uint64, count=len(words))))
                    used += len(words)
                if used >= chunk_words:
                    yield from flush()
                    docs, used, made = [], 0, made + 1
        if docs:
            yield from flush()

    return run


NAMES = ["chunk", "bucket", "hashes", "places", "gone", "doc_ids", "starts", "crcs"]
SCHEMA = "chunk long, bucket int, hashes binary, places binary, gone binary, doc_ids binary, starts binary, crcs binary"


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket of hashes -> per chunk the places of windows that also start earlier; tables pass through."""
    tables, rows = pdf[pdf.hashes.isna()], pdf[pdf.hashes.notna()]
    out = [(c, None, d, s, k) for c, d, s, k in zip(tables.chunk, tables.doc_ids, tables.starts, tables.crcs, strict=True)]
    hashes, ids, starts, owner, places = [], [], [], [], []
    for i, r in enumerate(rows.itertuples()):
        own = _unpack(r.places)
        at = _unpack(r.starts)
        doc = np.searchsorted(at, own, side="right") - 1
        hashes.append(np.frombuffer(r.hashes, "<u8"))
        ids.append(np.cumsum(np.frombuffer(r.doc_ids, "<i8"))[doc])
        starts.append(own - at[doc])
        owner.append(np.full(len(own), i, np.int32))
        places.append(own)
    if hashes:
        h, owner = np.concatenate(hashes), np.concatenate(owner)
        by = np.argsort(h, kind="stable")
        same = h[by[1:]] == h[by[:-1]]
        twice = by[np.append(same, False) | np.append(False, same)]  # entries whose hash other chunks have too
        ids, starts, places = (np.concatenate(x) for x in (ids, starts, places))
        rank = np.unique(np.stack([ids[twice], starts[twice]], 1), axis=0, return_inverse=True)[1].ravel() if len(twice) else twice
        later = np.sort(twice[_later(h[twice], rank)])  # entries stand row by row
        cuts = np.searchsorted(owner[later], np.arange(len(rows) + 1))
        for i, r in enumerate(rows.itertuples()):
            found = np.sort(np.concatenate([places[later[cuts[i] : cuts[i + 1]]], _unpack(r.gone)]))
            if len(found):
                out.append((r.chunk, _pack(found), None, None, None))
    return pd.DataFrame(out, columns=["chunk", "found", "doc_ids", "starts", "crcs"])


def _merge(width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One chunk's windows -> (key, crc, begins, ends) of its documents' maximal intervals."""
        table = pdf[pdf.found.isna()].iloc[0]
        found = [_unpack(x) for x in pdf.found.dropna()]
        if not found:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("_key", "_crc", "begins", "ends")})
        ids, at, crcs = np.cumsum(np.frombuffer(table.doc_ids, "<i8")), _unpack(table.starts), np.frombuffer(table.crcs, "<i8")
        place = np.sort(np.concatenate(found))
        doc = np.searchsorted(at, place, side="right") - 1
        new = np.ones(len(place), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + width)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        begins, ends, owner = place[first] - at[doc[first]], place[last] + width - at[doc[last]], doc[first]
        cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        to = np.append(cut[1:], len(owner))
        return pd.DataFrame({"_key": ids[owner[cut]], "_crc": crcs[owner[cut]], "begins": [begins[a:b] for a, b in zip(cut, to, strict=True)], "ends": [ends[a:b] for a, b in zip(cut, to, strict=True)]})

    return run


def repeated_intervals(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 20, chunk_words: int = CHUNK, bucket_words: int = BUCKET) -> DataFrame:
    """(_key, _crc, begins, ends): per document with any, the maximal intervals of words to remove.

    A window of `width` words goes if the same words also start earlier: in a document of smaller key, or
    earlier in the same one. A task hashes a chunk of documents and keeps for the shuffle only the first
    window of each hash, so a passage that a third of all documents hold reaches the judging task once a
    chunk; the rest of its windows are already known to go and travel as places. A second hash of other base
    deals the windows into buckets, one for every `bucket_words` words of the corpus (six bytes of text count
    as a word), each judged by one task; what is found returns to its chunk and is merged there. Windows are
    taken as equal if bucket and 64-bit hash are: the more windows, the more bits decide, so that chance
    equals stay unlikely at any size. A null key counts as the largest long. Rows that share a key: equal
    texts are one document, different texts are told apart by a checksum, and windows at equal (key, start)
    don't count as earlier.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * bucket_words)))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("_key"), F.col(text).cast("string").alias("_text"))
    hashed = rows.mapInArrow(_hashed(width, buckets, chunk_words), SCHEMA)
    found = hashed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_judge, "chunk long, found binary, doc_ids binary, starts binary, crcs binary")
    merged = found.groupBy("chunk").applyInPandas(_merge(width), "_key long, _crc long, begins array<long>, ends array<long>")
    return merged.dropDuplicates(["_key", "_crc"])


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 20, chunk_words: int = CHUNK) -> DataFrame:
    """Documents without the words that repeated windows cover.

    Appends n_words, n_removed (long), begins, ends (the removed intervals of word places) and kept (the
    other words, joined by one space); columns of those names are replaced, others pass, whatever their
    names. Words are runs of anything but ASCII white space, unchanged. Null texts have no words; a null key
    counts as the largest. One row per input row; no rows give no rows.
    """
    spans = repeated_intervals(docs, text, key, width, chunk_words).withColumnsRenamed({"_key": "span_key", "_crc": "span_crc"})
    made = ("n_words", "n_removed", "begins", "ends", "kept")
    others = [c for c in docs.columns if c.lower() not in made]
    own = [F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("own_key"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("own_crc")]
    kept = text.lower() in [c.lower() for c in others]  # then the text travels in its row only
    keyed = docs.select(F.struct(*others).alias("row"), *([] if kept else [F.col(text).alias("body")]), *own)
    met = keyed.join(spans, (F.col("own_key") == F.col("span_key")) & (F.col("own_crc") == F.col("span_crc")), "left")
    coded = F.concat_ws(" ", F.array_join(F.col("begins").cast("array<string>"), ","), F.array_join(F.col("ends").cast("array<string>"), ","))
    body = (F.col("row")[text] if kept else F.col("body")).cast("string")
    packed = met.select("row", "begins", "ends", F.concat(coded, F.lit("\n"), F.coalesce(body, F.lit(""))).alias("both"))

    def make(texts: list) -> dict[str, pa.Array]:
        words_, removed, kept = [], [], []
        for both in texts:
            head, _, body = both.partition("\n")
            words = body.encode("utf-8", "surrogatepass").split()
            words_.append(len(words))
            if head:
                begins, ends = ([int(x) for x in part.split(",")] for part in head.split(" "))
                at, left = 0, []
                for a, b in zip(begins, ends, strict=True):
                    left += words[at:a]
                    at = b
                words = left + words[at:]
            removed.append(words_[-1] - len(words))
            kept.append(b" ".join(words))
        return {"n_words": pa.array(words_, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}

    done = add_columns(packed, "both", make, "n_words long, n_removed long, kept string")
    return done.select("row.*", "n_words", "n_removed", "begins", "ends", "kept")
