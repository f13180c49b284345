"""SimHash near-duplicates: fingerprints, a grid range join over segment popcounts, components."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.components import components
from textlake.llm.shared import Scratch, add_columns

SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of word shingles, as a signed long: a bit is set if it is in over half the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    runs = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(r, SEED) for r in runs), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """Append the fingerprint of `text` as a long. Null and empty texts have fingerprint zero."""

    def make(texts: list) -> dict[str, pa.Array]:
        return {name: pa.array([fingerprint(t, shingle) for t in texts], pa.int64())}

    return add_columns(docs, text, make, f"{name} long")


#: Two-bit segments of a fingerprint, and how likely two random ones have equal bit counts.
SEGMENTS, ALIKE = 32, 3 / 8
#: The lower bit of every segment.
LOWER = 0x5555555555555555


def counts_code(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each as 00, 01 or 11 in its segment's place.

    In this code the number of differing bits is the Manhattan distance of the counts.
    """
    low, high = fp.bitwiseAND(LOWER), F.shiftrightunsigned(fp, 1).bitwiseAND(LOWER)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def group_masks(groups: int, whole: int) -> list[int]:
    """Signed masks: every choice of `whole` of `groups` groups of neighbouring segments."""
    cuts = [SEGMENTS * i // groups for i in range(groups + 1)]
    each = [sum(3 << (2 * k) for k in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(each, whole)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def grid_groups(rows: int, max_bits: int) -> int:
    """Groups for that many fingerprints: the fewest with which a random one meets at most one other by chance."""
    for groups in range(max_bits + 2, SEGMENTS):
        if rows * comb(groups, max_bits) * ALIKE ** (SEGMENTS // groups * (groups - max_bits)) <= 1:
            return groups
    return SEGMENTS


def links(fps: DataFrame, max_bits: int = 2, groups: int | None = None) -> DataFrame:
    """fps(fp long, distinct) -> (u, v): every pair u < v that differs in at most max_bits bits.

    A fingerprint becomes the bit counts of its 32 two-bit segments: a point whose Manhattan distance to
    another is at most the number of differing bits. The axes are cut into groups; points within max_bits
    of each other are equal in all but max_bits groups, so each choice of that many groups is a grid of
    cells of width one, and each close pair shares a cell of one of them. An equi-join of the cells finds
    it; the Manhattan distance and then the bits are compared. More fingerprints get more groups
    (grid_groups), hence smaller cells: what meets by chance grows as their number, not as its square.
    """
    if not 0 <= max_bits <= 8:
        raise ValueError("max_bits must be 0 to 8")
    groups = groups or grid_groups(fps.count(), max_bits)
    coded = fps.select("fp", counts_code(F.col("fp")).alias("counts"))
    cells = F.array(*[F.struct(F.lit(i).alias("grid"), F.col("counts").bitwiseAND(m).alias("cell")) for i, m in enumerate(group_masks(groups, groups - max_bits))])
    u = coded.select("fp", "counts", F.inline(cells))
    v = u.withColumnsRenamed({"fp": "v", "counts": "to"})
    bound = F.bit_count(F.col("counts").bitwiseXOR(F.col("to"))) <= max_bits
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= max_bits
    met = u.join(v, ["grid", "cell"]).filter((F.col("fp") < F.col("v")) & bound & near)
    return met.select(F.col("fp").alias("u"), "v").distinct()


def _classes(docs: DataFrame, text: str, key: str, shingle: int, max_bits: int) -> DataFrame:
    """(_key, _hash, fp, _root, component_id): of each row the key, a hash of its text, its fingerprint, the
    fingerprint that names its component, and the component's smallest key."""
    scratch = Scratch(docs.sparkSession)
    hashed = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    fps = scratch.cut(with_fingerprints(hashed, "_text", shingle).select("_key", "_hash", "fp"))
    groups = scratch.cut(fps.groupBy("fp").agg(F.min("_key").alias("least")))
    roots = components(links(groups.select("fp"), max_bits), scratch)
    rooted = groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("_root"))
    ids = rooted.groupBy("_root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(ids, "_root").select("fp", "_root", "component_id"), "fp")


def first_of_each(docs: DataFrame, classes: DataFrame, text: str, key: str) -> DataFrame:
    """One row of docs for each _root of classes(_key, _hash, _root): least key, nulls last, then least text hash."""
    order = F.struct(F.col("_key").isNull().alias("none"), "_key", "_hash")
    keep = classes.groupBy("_root").agg(F.min(order).alias("least")).select("_root", F.col("least._key").alias("keep"), F.col("least._hash").alias("hash"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("own"), F.xxhash64(text).alias("own_hash"))
    met = rows.join(keep, F.col("own").eqNullSafe(F.col("keep")) & (F.col("own_hash") == F.col("hash")))
    first = F.row_number().over(Window.partitionBy("_root").orderBy("hash"))
    return met.withColumn("rank", first).filter("rank = 1").select("row.*")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(key, fp, component_id): documents, their fingerprints and the smallest key that chains of links reach.

    One row per input row. Equal fingerprints are grouped first, so a group of exact copies of any size
    costs one row in the join. Null keys are kept; they never become a component's id unless all are null.
    Null and empty texts share fingerprint zero and link like any other. Repeated rows give repeated rows,
    no rows give no rows; other columns are not looked at, whatever their names.
    """
    return _classes(docs, text, key, shingle, max_bits).select(F.col("_key").alias(key), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One document of each component: the one of the least key (nulls last), then of the least text hash.

    A component is told by its root fingerprint, not by a key: keys may be null or repeat across components.
    All columns pass, whatever their names.
    """
    return first_of_each(docs, _classes(docs, text, key, shingle, max_bits), text, key)
