"""Near-duplicates by the exact Jaccard similarity of word shingles: SimHash fingerprints and MinHash bands find candidates,
sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.components import components
from textlake.llm.shared import Scratch, add_columns
from textlake.llm.simhash import SEED, fingerprint, first_of_each, links

#: 20 bands of 4 minima: a pair of similarity 0.8 shares none with probability 3e-5, one of 0.9 with 2e-9.
BANDS, ROWS = 20, 4


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of word shingles, ascending; a text of fewer words is one shingle, an empty one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    runs = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)] * bool(words)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), dtype="<u8"))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**64, (n, 1), dtype=np.uint64), rng.integers(0, 2**64, (n, 1), dtype=np.uint64) | np.uint64(1)


def band_hashes(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """One signed hash for each band of `rows` minima; none for no hashes."""
    mask, factor = _constants(bands * rows)
    least = np.full(bands * rows, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096] ^ mask) * factor).min(axis=1))
    each = least.astype("<u8").reshape(bands, rows)
    made = np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(each)], dtype=np.uint64)
    return made.view(np.int64).tolist() if len(hashes) else []


def spanning(nodes: list[int], sets: list[np.ndarray], similar: float, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of nodes whose sets' Jaccard similarity is at least `similar`, as many as connect all that such pairs connect.

    label: nodes of equal labels are connected already.
    """
    n, sizes = len(nodes), np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    first = np.concatenate([[0], np.cumsum(sizes)])
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    found, left = [], label.max()
    for i in range(n):
        if not left:
            break
        shared = np.zeros(n, dtype=np.int64)
        for k in range(first[i], first[i + 1], 256):  # a slice at a time: a common shingle has up to n owners
            shared += np.bincount(np.concatenate([owner[start[x] : start[x + 1]] for x in ids[k : min(k + 256, first[i + 1])]]), minlength=n)
        alike = np.flatnonzero(shared >= similar * (sizes[i] + sizes - shared) - 1e-9)
        for other, at in zip(*np.unique(label[alike], return_index=True), strict=True):
            if other != label[i]:
                found.append((nodes[i], nodes[alike[at]]))
                label[label == other] = label[i]
                left -= 1
    return found


def _within(groups: DataFrame, similar: float) -> DataFrame:
    """(group, node, root, hashes), the rows of a group side by side -> (u, v) of spanning()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            found = []
            ends, values = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            for k, (group, node, root) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                if group != last:
                    found += _linked(rows, similar)
                    last, rows = group, []
                rows.append((node, root, values[ends[k] : ends[k + 1]]))
            yield _pairs(found)
        yield _pairs(_linked(rows, similar))

    return groups.repartition("group").sortWithinPartitions("group").select("group", "node", "root", "hashes").mapInArrow(run, "u long, v long")


def _linked(rows: list[tuple], similar: float) -> list[tuple[int, int]]:
    if len(rows) < 2:
        return []
    nodes, roots, sets = zip(*rows, strict=True)
    return spanning(list(nodes), list(sets), similar, np.array(roots))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _stars(met: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(u, v): rows of a bucket against its least node, each pair once, kept if the sets are similar.

    A join of narrow pairs with the sets: a node that is the least of many buckets is a hot key on the side
    of the pairs only, which Spark splits.
    """
    least = met.groupBy("bucket").agg(F.min("node").alias("u"))
    pairs = met.join(least, "bucket").filter("node <> u").select("u", F.col("node").alias("v")).distinct()
    one, two = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_set")) for c in "uv")
    both = pairs.join(one, "u").join(two, "v")
    shared = F.size(F.array_intersect("u_set", "v_set"))
    return both.filter(shared >= similar * (F.size("u_set") + F.size("v_set") - shared) - 1e-9).select("u", "v")


def _blocks(met: DataFrame, most: int) -> DataFrame:
    """(group, node, root) of met(bucket, node, root): a bucket of at most `most` nodes is one group; a larger
    one is dealt into blocks, and every two of its blocks, and each by itself, are one."""
    sizes = met.groupBy("bucket").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    dealt = met.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "node", "root")


def _alike(made: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, bucket) of made(node, fp, hashes): those whose fingerprints op4's links connect share a bucket; empty sets have none."""
    some = made.filter(F.size("hashes") > 0).select("node", "fp").distinct()
    fps = scratch.cut(some.select("fp").distinct())
    roots = components(links(fps), scratch).select(F.col("node").alias("fp"), "root")
    return some.join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("bucket")).distinct()


def _classes(docs: DataFrame, text: str, key: str, shingle: int, similar: float, most: int) -> DataFrame:
    """(_key, _hash, _root): every row's key, the hash of its text and the name of its component."""

    def make(texts: list) -> dict[str, pa.Array]:
        every = [shingle_hashes(t, shingle) for t in texts]
        names = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in every], dtype=np.uint64).view(np.int64)
        sets = [np.unique(h.astype(np.uint32)).view(np.int32) for h in every]
        return {"node": pa.array(names, pa.int64()), "fp": pa.array(map(fingerprint, texts), pa.int64()), "bands": pa.array(map(band_hashes, every), pa.list_(pa.int64())), "hashes": pa.array(sets, pa.list_(pa.int32()))}

    scratch = Scratch(docs.sparkSession)
    hashed = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    made = scratch.cut(add_columns(hashed, "_text", make, "node long, fp long, bands array<long>, hashes array<int>").drop("_text"))
    banded = made.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("bucket"))
    banded = banded.union(_alike(made, scratch))
    several = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    met = scratch.cut(banded.join(several, "bucket"))
    sets = scratch.cut(made.select("node", "hashes").join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")))
    stars = scratch.cut(_stars(met, sets, similar))
    rooted = met.join(components(stars, scratch), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    # only buckets whose nodes are not all connected yet can add anything
    torn = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket")
    rest = _blocks(rooted.join(torn, "bucket"), most).join(sets, "node")
    roots = components(stars.union(_within(rest, similar)), scratch)
    return made.select("_key", "_hash", "node").join(roots, "node", "left").select("_key", "_hash", F.coalesce("root", "node").alias("_root"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, similar: float = 0.8, most: int = 2_000) -> DataFrame:
    """One document of each group that chains of pairs with a Jaccard similarity of at least `similar` connect.

    Equal sets are grouped first. Texts whose SimHash fingerprints are linked, as simhash.links() has it, meet in a bucket, and
    so do sets that share a MinHash band: of the pairs of similarity 0.8 fingerprints see few. First all of a bucket are
    compared with its least set, which connects most families; then, in buckets that are not connected
    whole, every pair is compared in tasks of at most about 2 * `most` sets, and only pairs that connect
    something new leave. Sets hold 32 bits a shingle. Null and empty texts are one group. The document of
    the least key (nulls last), then of the least text hash stays. All columns pass, whatever their names;
    repeated rows are one document, no rows give no rows.
    """
    return first_of_each(docs, _classes(docs, text, key, shingle, similar, most), text, key)
