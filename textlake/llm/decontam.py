"""Benchmark decontamination by spaced seeds, in DataFrame functions only."""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.shared import Scratch

#: Masks over word positions; 1: the word counts, 0: it may differ. Each run of 13 words with up to two
#: substitutions holds a place where one fits; masks_for() gives others for items that are too short for that.
MASKS = ("11111", "11001011")
#: Rows of benchmark seeds, and words of items (eight bytes each), up to which both are broadcast; beyond
#: either Spark shuffles both sides.
BROADCAST_SEEDS, BROADCAST_WORDS = 200_000, 2_000_000
#: Words of a document that are laid over an item at a time.
BLOCK = 256


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def covers(masks: tuple[str, ...], size: int, changes: int) -> bool:
    """Does a mask fit somewhere in `size` words, whichever `changes` of them differ?"""
    placed = [{at + i for i, c in enumerate(m) if c == "1"} for m in masks for at in range(size - len(m) + 1)]
    return all(any(p.isdisjoint(gone) for p in placed) for gone in combinations(range(size), changes))


def masks_for(size: int, similar: float = 0.8, masks: tuple[str, ...] = MASKS) -> tuple[str, ...]:
    """Masks one of which fits in `size` words in every way in which at least `similar` of them agree.

    `masks` if they do; else the longest run of words that always stays whole, or for runs of two words
    (five words, one changed) two masks of three words where those do.
    """
    changes = size - max(ceil(size * similar - 1e-9), 1)
    run = "1" * -(-(size - changes) // (changes + 1))
    tried = [masks, (run,)] if len(run) > 2 or not changes else [masks, ("111", "1101")]
    small = comb(size, changes) <= 100_000
    return next((m for m in tried if small and covers(m, size, changes)), (run,))


def _seeds(hashes: Column, mask: str, number: int) -> Column:
    """Hash of the words that the mask keeps, at every position where it fits."""
    kept = [i for i, c in enumerate(mask) if c == "1"]
    starts = F.sequence(F.lit(0), F.size(hashes) - len(mask))
    found = F.transform(starts, lambda i: F.xxhash64(F.lit(number), *[F.get(hashes, i + k) for k in kept]))
    return F.when(F.size(hashes) >= len(mask), found).otherwise(F.array().cast("array<bigint>"))


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seeded(rows: DataFrame, text: str, masks: tuple[str, ...], *keep: str, sizes: dict[str, list[int]] | None = None, window: int = 0) -> DataFrame:
    """One narrow row per seed: keep, the word where it starts, its hash. sizes: the sizes of texts, at most
    `window`, that a mask is for; all if not given."""
    hashed = rows.select(*keep, _hashes(F.col(text)).alias("hashes"))
    h = F.col("hashes")
    meant = lambda m: F.least(F.size(h), F.lit(window)).isin(sizes[m]) if sizes else F.lit(True)
    seeds = [F.when(meant(m), _seeds(h, m, i)).otherwise(F.array().cast("array<bigint>")) if sizes else _seeds(h, m, i) for i, m in enumerate(masks)]
    # seeds of a mask follow those of the masks before it; before[i]: how many those are
    before = [F.lit(0)]
    for m in masks:
        before.append(before[-1] + F.when(meant(m), F.greatest(F.size(h) - len(m) + 1, F.lit(0))).otherwise(0))
    every = hashed.select(*keep, F.array(*before[:-1]).alias("before"), F.concat(*seeds).alias("seeds"))
    # outer: else Spark infers a filter on the seeds and pushes it below, where it computes them once more per element
    placed = every.select(*keep, "before", F.posexplode_outer("seeds").alias("place", "seed"))
    at = F.col("place")
    for i in range(1, len(masks)):
        at = F.when(F.col("place") >= F.col("before")[i], F.col("place") - F.col("before")[i]).otherwise(at)
    return placed.select(*keep, at.alias("at"), "seed")


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = 13, similar: float = 0.8, masks: tuple[str, ...] = MASKS, shortest: int = 5) -> DataFrame:
    """(key, item_key, matched, window, place): benchmark items that a document holds, one row per pair.

    Seeds of both sides meet in an equi-join, as narrow rows, which leaves the blocks of documents that have any and
    how far each item is shifted there; the words around such a block are laid over the item without gaps, and the pair
    counts if some `window` words in a row (an item with fewer: all of it) agree in at least `similar` of their places.
    matched is the largest number of such agreements, place the word of the document where its window starts (the first
    of the best). The masks follow from the sizes of the items (masks_for), so that every such window has a seed. Items
    of so few words that a seed is all of them need no laying over. Items of fewer than `shortest` words take no part,
    nor do null texts; null keys are keys. Repeated rows of a key count once, different texts of a key as one.
    If both tables call their key alike, the item's column gets `item_` before its name. Other columns are
    not looked at, whatever their names; an empty table gives no rows. Documents of any length are searched
    whole: no row holds more than a text's hashes, and what a shift needs is a block of BLOCK words.
    """
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_key).alias("_item"), F.col(item_text).alias("_text"))
    items = items.withColumn("_n", F.size(words(F.col("_text")))).filter(F.col("_n") >= max(shortest, 1))
    known = items.select("_item", _hashes(F.col("_text")).alias("_words"))
    sizes: dict[str, list[int]] = {}
    for (size,) in known.select(F.least(F.size("_words"), F.lit(window))).distinct().collect():
        for mask in masks_for(size, similar, masks):
            sizes.setdefault(mask, []).append(size)
    told = [n for m, ns in sizes.items() for n in ns if n < window and m == "1" * n and masks_for(n, similar, masks) == (m,)]
    masks = tuple(sorted(sizes, key=lambda m: (-len(m), m))) or masks
    seeds = _seeded(items, "_text", masks, "_item", "_n", sizes=sizes, window=window).withColumnsRenamed({"at": "_at"})
    n_words = known.agg(F.sum(F.size("_words") + 1).alias("n")).first()["n"] or 0
    if n_words <= BROADCAST_WORDS and seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        known, seeds = F.broadcast(known), F.broadcast(seeds)
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    whole = F.col("_n").isin(told)
    where = F.when(~whole, F.floor(F.col("at") / BLOCK)).cast("int").alias("block"), F.when(~whole, F.col("at") - F.col("_at")).alias("shift")
    met = _seeded(rows, "_text", masks, "_key").join(seeds, "seed").groupBy("_key", "_item", "_n", *where).agg(F.min("at").cast("long").alias("place"))
    met = Scratch(docs.sparkSession).cut(met)  # texts are searched once, for both kinds of items
    found = met.filter("block IS NULL").groupBy("_key", "_item").agg(F.max("_n").alias("matched"), F.max("_n").alias("window"), F.min("place").alias("place"))
    hits = met.filter("block IS NOT NULL").select("_key", "_item", "shift", "block").distinct()
    keys = hits.select(F.col("_key").alias("_of")).distinct()
    h = F.col("hashes")
    start = lambda b: F.greatest(b * BLOCK - window, F.lit(0))
    numbers = F.sequence(F.lit(0), F.floor(F.size(h) / BLOCK).cast("int"))
    cut = F.transform(numbers, lambda b: F.struct(b.alias("_block"), start(b).alias("from"), F.slice(h, start(b) + 1, F.lit(BLOCK + 2 * window)).alias("ws")))
    again = rows.join(keys, F.col("_key").eqNullSafe(F.col("_of")), "left_semi").select(F.col("_key").alias("_of"), _hashes(F.col("_text")).alias("hashes"))
    blocks = again.select("_of", F.inline(cut))
    known = known.withColumnRenamed("_item", "_known")
    each = hits.join(blocks, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("block") == F.col("_block"))).join(known, F.col("_item").eqNullSafe(F.col("_known")))
    size = F.size("_words")
    low = F.greatest(F.col("shift"), F.col("from"))
    length = F.greatest(F.least(F.col("shift") + size, F.col("from") + F.size("ws")) - low, F.lit(0))
    agree = F.zip_with(F.slice("ws", low - F.col("from") + 1, length), F.slice("_words", low - F.col("shift") + 1, length), lambda a, b: (a == b).cast("int"))
    laid = each.filter(length >= F.least(F.lit(window), size)).select("_key", "_item", low.alias("low"), agree.alias("agree"), F.least(F.lit(window), size).alias("window"))
    sums = F.transform(F.sequence(F.lit(1), F.size("agree") - F.col("window") + 1), lambda s: F.aggregate(F.slice("agree", s, F.col("window")), F.lit(0), lambda x, y: x + y))
    summed = laid.select("_key", "_item", "low", "window", sums.alias("sums"))
    best = summed.select("_key", "_item", "window", F.array_max("sums").alias("matched"), (F.col("low") + F.array_position("sums", F.array_max("sums")) - 1).cast("long").alias("place"))
    # the condition stands after the grouping: pushed below, it would compute the sums anew for every place
    every = best.groupBy("_key", "_item").agg(F.max("matched").alias("matched"), F.max("window").alias("window"), F.min_by("place", F.struct(-F.col("matched"), "place")).alias("place"))
    top = every.filter(F.col("matched") >= F.ceil(F.col("window") * F.lit(similar) - F.lit(1e-9))).select("_key", "_item", "matched", "window", "place").union(found)
    item = item_key if item_key.lower() != key.lower() else f"item_{item_key}"
    return top.select(F.col("_key").alias(key), F.col("_item").alias(item), F.col("matched").cast("long"), F.col("window").cast("long"), "place")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no benchmark item. A document is its key and text: keys may be null or repeat.

    All columns pass, whatever their names; null and empty texts stay, and without items everything does.
    """
    named = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(key, text).alias("doc"), F.col(text).alias("body"))
    bad = overlaps(named, benchmark, "body", "doc", **options).select(F.col("doc").alias("bad")).distinct()
    return named.join(bad, F.col("doc") == F.col("bad"), "left_anti").select("row.*")
