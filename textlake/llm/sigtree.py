"""Jaccard join of word shingles by signature trees: no pair that is similar enough is missed.

Sets meet where they could be similar: two sets that are, differ in so few shingles that of a fixed number of parts,
into which shingles are dealt by their hash, at least one is the same in both. What meets is put into a tree whose
nodes hold the bits of all shingles below them and the least and greatest size. Two nodes are compared by the most
that sets below them can share; only pairs that could be similar are followed down to sets, which decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.components import components
from textlake.llm.shared import SHORT, Scratch, add_columns, pieces, small_batches

SEED = 42
#: Children of a tree's node.
FAN = 8
#: Sizes grow by this factor from a class to the next.
GROWTH = 1.3
#: Shingles up to which a part is thin.
THIN = 1
#: Sets, and shingles of sets, that are compared in a task at a time.
SETS, SHINGLES = 2_000, 2_000_000
#: Nodes up to which their list is broadcast.
FEW = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = 4, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Distinct 64-bit hashes of word shingles, ascending; a text of fewer words is one shingle, one without words has none.

    A shingle's hash is mixed from those of its words. known: word hashes of earlier texts, of words up to SHORT bytes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    known = {} if known is None else known
    if len(known) > 1_000_000:
        known.clear()
    hashes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w, SEED)
            if len(w) <= SHORT:
                known[w] = h
        hashes[i] = h
    span = min(size, len(words))
    out = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        out = _mix(out * _MIX[0] + hashes[k : len(words) - span + 1 + k])
    return np.unique(out)


def size_class(n: int) -> int:
    """Class of a set's size: class c holds the sizes above GROWTH**(c-1) up to GROWTH**c."""
    c = 0
    while n > int(GROWTH**c):
        c += 1
    return c


def most_different(n: int, similar: int) -> int:
    """Most shingles that only one of two sets has whose sizes are n at most, if they are `similar` per cent alike.

    Of the union u at least similar * u / 100 is shared, so sizes sum to u + shared <= 2 n, and u <= 200 n / (100 + similar).
    """
    return (200 * n // (100 + similar)) * (100 - similar) // 100


@lru_cache(maxsize=None)
def parts_of(c: int, similar: int) -> tuple[int, int]:
    """(parts, spare) of class c: parts are `spare` + 1 more than the shingles that only one of two similar sets may have.

    So two similar sets have more than `spare` parts in common. Parts of up to THIN shingles say little; spare is chosen so
    that few sets of the class have more such parts than that (their number is about normal).
    """
    top = int(GROWTH**c)
    differ = most_different(top, similar)
    if not differ:
        return 0, 0
    spare, low = 0, max(similar * top / GROWTH / 100, 1)
    for _ in range(20):
        parts = differ + 1 + spare
        rate = low / parts
        thin = sum(rate**k * math.exp(-rate) / math.factorial(k) for k in range(THIN + 1))
        wanted = math.ceil(parts * thin + 2 * math.sqrt(parts * thin * (1 - thin)))
        if wanted <= spare or wanted > 2 * differ:
            break
        spare = wanted
    return differ + 1 + spare, spare


def part_keys(hashes: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, class, whether the set is of a lower class) of parts of a set, for its own size class and, if a similar set
    may be in it, for the next one.

    Two similar sets meet in the class of the larger. They have more than `spare` equal parts there; if either of them has
    at most `spare` thin parts, one of the equal parts is not thin. So a set with few thin parts needs no key of those, and
    one with many has keys of all. Equal sets are one already: a class in which similar sets are equal has no keys.
    """
    n = len(hashes)
    keys, classes, lower = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int8)]
    c = size_class(n)
    for k in (c, c + 1) if n else ():
        if k > c and similar * (int(GROWTH**c) + 1) > 100 * n:
            break
        parts, spare = parts_of(k, similar)
        if not parts:
            continue
        part = ((_mix(hashes ^ _MIX[1]) >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part, _mix(hashes + _MIX[2]))
        thin = np.bincount(part, minlength=parts) <= THIN
        every = _mix(_mix(sums + np.arange(parts, dtype=np.uint64)) + np.uint64(k))
        keys.append(every[~thin] if thin.sum() <= spare else every)
        classes.append(np.full(len(keys[-1]), k, np.int32))
        lower.append(np.full(len(keys[-1]), k > c, np.int8))
    return np.concatenate(keys), np.concatenate(classes), np.concatenate(lower)


class Tree:
    """Sets under nodes of FAN children each; level 0 is the sets, in the order of their least hashes.

    Of a node: `bits` of all shingles below it, `low` and `high` size, and `spare`, the most that one set below it
    has more shingles than bits. Two sets below nodes a and b share at most
    min(high a, high b, common bits + min(spare a, spare b)) shingles.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: int(sets[i][0]))
        self.sets = [sets[i] for i in self.order]
        sizes = np.array([len(s) for s in self.sets], np.int64)
        width = 1 << int(np.clip(np.ceil(np.log2(4 * np.median(sizes))), 9, 16))
        bits = np.zeros((len(sets), width // 64), np.uint64)
        for i, s in enumerate(self.sets):
            at = s & np.uint64(width - 1)
            np.bitwise_or.at(bits[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.levels = [(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(1))]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, spare = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, similar: int) -> np.ndarray:
        """Whether sets below nodes i and j could be similar, by their bits and sizes."""
        bits, low, high, spare = self.levels[level]
        common = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64) + np.minimum(spare[i], spare[j])
        share = np.minimum(common, np.minimum(high[i], high[j]))
        return (100 + similar) * share >= similar * (low[i] + low[j])


def linked(nodes: list[int], sets: list[np.ndarray], similar: int, roots: list[int] | None = None, counts: dict | None = None) -> list[tuple[int, int]]:
    """Pairs of nodes that are similar, as many as connect all that such pairs connect.

    The tree is joined with itself: pairs of nodes of a level, then of their children, depth first, many at a time.
    Pairs whose sets are all connected already add nothing. roots: nodes of equal roots are connected.
    """
    if len(nodes) < 2:
        return []
    tree, found = Tree(sets), []
    label = np.unique(np.array(roots if roots is not None else range(len(nodes)))[tree.order], return_inverse=True)[1]
    left = label.max()
    top = len(tree.levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack and left:
        level, i, j = stack.pop()
        if level:
            span = FAN**level
            at = np.arange(0, len(nodes), span)
            low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            torn = (low[i] != low[j]) | (low[i] != high[i]) | (low[j] != high[j])
        else:
            torn = label[i] != label[j]
        i, j = i[torn], j[torn]
        keep = (i == j) | tree.possible(level, i, j, similar)
        i, j = i[keep], j[keep]
        if level:
            size = len(tree.levels[level - 1][0])
            a = (i[:, None, None] * FAN + np.arange(FAN)[:, None] + np.zeros((1, FAN), np.int64)).ravel()
            b = (j[:, None, None] * FAN + np.arange(FAN) + np.zeros((FAN, 1), np.int64)).ravel()
            inside = (a < size) & (b < size) & ((a < b) | ((a == b) & (level > 1)))
            a, b = a[inside], b[inside]
            for k in range(0, len(a), 4096):
                stack.append((level - 1, a[k : k + 4096], b[k : k + 4096]))
            continue
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if label[x] == label[y]:
                continue
            one, two = tree.sets[x], tree.sets[y]
            if counts is not None:
                counts["sets"] = counts.get("sets", 0) + 1
            both = len(one) + len(two)
            share = both - len(np.union1d(one, two))
            if 100 * share >= similar * (both - share):
                found.append((nodes[tree.order[x]], nodes[tree.order[y]]))
                label[label == label[y]] = label[x]
                left -= 1
    return found


def _joined(rows: DataFrame, similar: int) -> DataFrame:
    """rows(group, node, root, hashes) -> (u, v) of linked() within every group; a node counts once in a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}

        def out() -> pa.RecordBatch:
            found = linked(list(held), [s for _, s in held.values()], similar, [r for r, _ in held.values()])
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            ends, values = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy().view(np.uint64)
            for k, (group, node, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if group != last:
                    yield out()
                    last, held = group, {}
                if node not in held:
                    held[node] = root, values[ends[k] : ends[k + 1]].copy()
        yield out()

    dealt = rows.select("group", "node", "root", "hashes").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "u long, v long")


def _name(hashes: np.ndarray) -> int:
    """A signed hash of a set: equal sets are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _keys(rows: DataFrame, size: int, similar: int) -> DataFrame:
    """(bucket, node, class, lower): the keys of every different set, once a task at least, so that copies hardly repeat
    them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        seen: set[int] = set()
        for part in pieces(batches, "text"):
            found = [(*part_keys(np.empty(0, np.uint64), similar), np.empty(0, np.int64))]
            for text in part.column(0).to_pylist():
                hashes = shingles(text, size, known)
                node = _name(hashes)
                if node in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                keys = part_keys(hashes, similar)
                found.append((*keys, np.full(len(keys[0]), node, np.int64)))
            key, kind, lower, node = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(kind), pa.array(lower)], names=["bucket", "node", "class", "lower"])

    return rows.select("text").mapInArrow(run, "bucket long, node long, class int, lower tinyint")


def _met(keys: DataFrame) -> DataFrame:
    """(bucket, node, class) of buckets with several nodes, one of them of the class itself: a stream of sorted rows, each
    compared with those beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, left, own = np.empty((3, 0), np.int64), False, False  # the last row, whether it has left, and its bucket's first
        for batch in batches:
            lower = batch.column(3).to_numpy()
            rows = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:3]])], 1)
            first = np.r_[np.full(rest.shape[1], 0 if own else 1), lower] == 0
            new = np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(0)][: rows.shape[1]]
            rows, first = rows[:, new], first[new]
            if not rows.shape[1]:
                continue
            same = rows[0, 1:] == rows[0, :-1]
            starts = np.r_[True, ~same]
            valid = first[starts][np.cumsum(starts) - 1]  # nodes of the class itself come first
            several = (np.r_[False, same] | np.r_[same, False]) & valid
            if rest.shape[1]:
                several[0] &= not left
            left = bool(same[-1]) if len(same) else left and bool(rest.shape[1])
            rest, own = rows[:, -1:], bool(valid[-1])
            yield pa.RecordBatch.from_arrays([pa.array(rows[0][several]), pa.array(rows[1][several]), pa.array(rows[2][several].astype(np.int32))], names=["bucket", "node", "class"])

    ordered = keys.repartition("bucket").sortWithinPartitions("bucket", "lower", "node")
    return ordered.mapInArrow(run, "bucket long, node long, class int")


def _families(met: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, class, root): nodes that buckets of a class connect, whether they are similar or not.

    Classes stay apart: short texts share parts with many others, and would join the families of all longer ones.
    """
    members = met.select("bucket", "node", "class", F.xxhash64("node", "class").alias("member"))
    least = members.groupBy("bucket").agg(F.min("member").alias("u"))
    edges = members.join(least, "bucket").filter("u <> member").select("u", F.col("member").alias("v")).distinct()
    names = met.select("node", "class").distinct().withColumn("member", F.xxhash64("node", "class"))
    return names.join(components(edges, scratch).withColumnRenamed("node", "member"), "member").select("node", "class", "root")


def _chosen(made: DataFrame, families: DataFrame) -> DataFrame:
    """(node, class, _one, n, family, small) of every node that met another: one of its keys, and whether its family is
    small enough for one task."""
    one = made.join(families.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("_key").alias("_one"), F.first("n").alias("n"))
    nodes = families.withColumnRenamed("root", "family").join(one, "node")
    sizes = nodes.groupBy("family").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    return nodes.join(sizes, "family").select("node", "class", "_one", "n", "family", ((F.col("k") <= SETS) & (F.col("s") <= SHINGLES)).alias("small"))


def _sets(rows: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """(node, family, hashes): sets hashed again from one text of each node, so that no other text's set ever moves.

    Which rows those are is broadcast if they are FEW, else joined. A key may stand on several rows, so a text counts
    only if its set is the node's, and a node may come more than once.
    """
    side = F.broadcast(chosen) if chosen.count() <= FEW else chosen
    texts = rows.join(side, F.col("_key").eqNullSafe(F.col("_one"))).select("node", "family", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for part in pieces(batches, "text"):
            found = [(node, family, hashes.view(np.int64)) for node, family, text in zip(*(c.to_pylist() for c in part.columns), strict=True) if _name(hashes := shingles(text, size, known)) == node]
            kinds = pa.int64(), pa.int64(), pa.list_(pa.int64())
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["node", "family", "hashes"])

    return texts.mapInArrow(make, "node long, family long, hashes array<long>")


def _blocks(count: str, shingle: str) -> Column:
    return F.greatest(F.ceil(F.col(count) / SETS), F.ceil(F.col(shingle) / SHINGLES), F.lit(1).cast("long"))


def _best(rooted: DataFrame) -> DataFrame:
    """(group, node, root, blocks): one node of each root in a bucket, in the bucket where it meets most others, which
    is dealt into blocks."""
    apart = rooted.groupBy("bucket", "root").agg(F.min(F.struct("node", "n")).alias("x")).select("bucket", "root", "x.node", "x.n")
    several = apart.groupBy("bucket").agg(F.count("*").alias("others")).filter("others > 1")
    best = apart.join(several, "bucket").groupBy("node").agg(F.max(F.struct("others", "bucket")).alias("x"), F.first("root").alias("root"), F.first("n").alias("n"))
    best = best.select("node", "root", "n", "x.bucket")
    blocks = best.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("s")).filter("k > 1").select("bucket", _blocks("k", "s").alias("blocks"))
    group = F.xxhash64("bucket", F.pmod(F.xxhash64("node"), F.col("blocks")))
    return best.join(blocks, "bucket").select(group.alias("group"), "node", "root", "blocks")


def _torn(rooted: DataFrame) -> DataFrame:
    """(group, node, root): every two nodes of a bucket that are not connected share a group.

    Buckets of the same nodes are one. The nodes of a bucket's largest root need no comparison with one another, so
    its blocks meet the blocks of the other nodes only, and those meet each other.
    """
    roots = rooted.groupBy("bucket", "root").agg(F.count("*").alias("k"), F.sum("n").alias("s"), F.bit_xor(F.xxhash64("node")).alias("x"))
    every = roots.groupBy("bucket").agg(
        F.count("*").alias("roots"), F.sum("k").alias("k"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"), F.max(F.struct("k", "s", "root")).alias("main")
    ).filter("roots > 1")
    once = every.groupBy("k", "s", "x").agg(F.min_by("main", "bucket").alias("main"), F.min("bucket").alias("bucket"))
    small = (F.col("k") <= SETS) & (F.col("s") <= SHINGLES)
    rest = once.withColumn("ok", F.col("k") - F.col("main.k")).withColumn("os", F.col("s") - F.col("main.s")).withColumn("mk", F.col("main.k")).withColumn("ms", F.col("main.s"))
    sizes = rest.select("bucket", F.col("main.root").alias("main"), small.alias("small"), _blocks("ok", "os").alias("others"), _blocks("mk", "ms").alias("mains"))
    dealt = rooted.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("root") == F.col("main"), F.col("mains")).otherwise(F.col("others"))))
    groups = F.expr("""CASE WHEN small THEN array(xxhash64(bucket, 's'))
      WHEN root = main THEN transform(sequence(0L, others - 1), i -> xxhash64(bucket, 'm', i, own))
      ELSE concat(transform(sequence(0L, others - 1), i -> xxhash64(bucket, 'o', least(i, own), greatest(i, own))),
                  transform(sequence(0L, mains - 1), i -> xxhash64(bucket, 'm', own, i))) END""")
    return dealt.select(F.explode(groups).alias("group"), "node", "root")


def _of_large(met: DataFrame, sets: DataFrame, similar: int, scratch: Scratch) -> DataFrame:
    """(u, v) of families too large for a task, bucket by bucket: met(bucket, node, n), sets(node, hashes).

    First each node in its largest bucket; then whatever buckets are not connected whole.
    """
    met, spark = scratch.cut(met), met.sparkSession
    links, roots = spark.createDataFrame([], "u long, v long"), spark.createDataFrame([], "node long, root long")

    def rooted() -> DataFrame:
        return met.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))

    for _ in range(3):  # a round leaves about one root of SETS; whatever is still apart then is compared below
        best = scratch.cut(_best(rooted()))
        found = scratch.cut(_joined(best.join(sets, "node"), similar))
        if found.isEmpty():
            break
        links = scratch.cut(links.union(found))
        roots = scratch.cut(components(links, scratch))
        if best.filter("blocks > 1").isEmpty():
            break
    return scratch.cut(links.union(_joined(_torn(rooted()).join(sets, "node"), similar)))


def join(docs: DataFrame, similar: int = 85, size: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) of every row: the number of its different shingles of `size` words, and the
    least key that links reach, its own included. Two rows link if 100 * shared >= similar * (shingles of either).

    Equal sets are one node. Nodes meet in buckets of part_keys(); what buckets of a size class connect is a family,
    whose signature tree is joined with itself in one task, so that a set moves once or twice. A family of more than SETS sets or SHINGLES
    shingles is compared bucket by bucket, in blocks of that size: first each node in its largest bucket, then whatever
    buckets are not connected whole. Links leave a task only if they connect something new.

    Null and empty texts have no shingles and link with nothing. A null key is no component's name unless all keys of
    a component are null. Equal rows stay rows. Other columns don't matter. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))

    def make(texts: list) -> dict[str, pa.Array]:
        sets = [shingles(t, size) for t in texts]
        return {"node": pa.array([_name(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64())}

    made = scratch.cut(add_columns(rows, "text", make, "node long, n long").drop("text"))
    met = scratch.cut(_met(_keys(rows, size, similar)))
    chosen = scratch.cut(_chosen(made, _families(met, scratch)))
    small, large = (chosen.filter(c) for c in ("small", "NOT small"))
    links = scratch.cut(_joined(_sets(rows, small, size).select(F.col("family").alias("group"), "node", F.col("node").alias("root"), "hashes"), similar))
    if not large.isEmpty():
        sets = scratch.cut(_sets(rows, large, size).groupBy("node").agg(F.first("hashes").alias("hashes")))
        links = links.union(_of_large(met.join(large.select("node", "class", "n"), ["node", "class"]).select("bucket", "node", "n"), sets, similar, scratch))
    named = made.join(components(links, scratch), "node", "left").select("_key", "n", F.coalesce("root", "node").alias("root"))
    least = named.filter("n > 0").groupBy("root").agg(F.min("_key").alias("least"))
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("_key"))
    return named.join(least, "root", "left").select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
