"""Source divergence: how far the term shares of a language's sources lie apart, and which terms set a source apart.

A share is a whole number of billionths, so every sum is exact. The distance of two sources is a sum over all kept
terms, most of which a large source has and a small one has not. Terms that many sources have are summed in dense
tiles, sources by terms. A source without a term has the share of no occurrence, `least`: of the other terms, two sums
over what each source alone holds, and a correction for the few pairs that share such a term, give the same total.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.shared import Scratch, pieces, small_batches

#: Words of UTF-8 bytes once A-Z are lower-cased: ASCII letters and everything beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
ADDED = 5
#: A term is heavy if a quarter of its language's sources, or more than LIGHT of them, have it.
QUARTER, LIGHT = 4, 128
#: Sources on a side of a tile, terms of a tile.
SIDE, TERMS = 128, 512
PAIR = "lang string, a string, b string, value long"


def counted(docs: DataFrame, text: str, lang: str, source: str, held: int = 400_000) -> DataFrame:
    """(lang, source, term, n, docs) over all documents, and a row of a null term for every group.

    A task counts up to `held` terms before it hands them on, so that a hot group leaves it as few rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def handed(groups: dict) -> pa.RecordBatch:
        flat = [(*g, None, 0, 0) for g in groups] + [(*g, term, *x) for g, terms in groups.items() for term, x in terms.items()]
        columns = list(zip(*flat, strict=True)) or [[]] * 5
        terms = pa.array(list(columns[2]), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.string()), pa.array(list(columns[1]), pa.string()), terms, *(pa.array(list(columns[i]), pa.int64()) for i in (3, 4))], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        size = 0
        for part in pieces(batches, "text"):
            for one, two, body in zip(*(c.to_pylist() for c in part.columns), strict=True):
                own = groups.setdefault((one, two), {})
                size -= len(own)
                for term, k in Counter(TERM.findall(body.encode().lower())).items():
                    seen = own.get(term)
                    if seen is None:
                        own[term] = [k, 1]
                    else:
                        seen[0] += k
                        seen[1] += 1
                size += len(own)
                if size > held:
                    yield handed(groups)
                    groups, size = {}, 0
        yield handed(groups)

    # tasks have counted already: no second counting before the shuffle
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str) -> Column:
    """1 + floor(1,000,000,000 * (n + ADDED) / total) of two long columns, null where the total is 0: a long division by
    three digits of base 1,000, whose products stay in 64 bits up to a total of 9e15."""
    out, left = f"(({n}) + {ADDED}) div nullif({total}, 0)", f"(({n}) + {ADDED}) % nullif({total}, 0)"
    for _ in range(3):
        out, left = f"({out}) * 1000 + (({left}) * 1000) div nullif({total}, 0)", f"(({left}) * 1000) % nullif({total}, 0)"
    return F.expr(f"1 + {out}")


class Terms:
    """Written tables: `groups` (lang, source, total, least, sources, all_total, heavy, light: a row for each source of
    a language) and `kept` (lang, source, term, n, all_n, heavy: kept terms with an occurrence in the source)."""

    def __init__(self, docs: DataFrame, fewest: int, text: str, lang: str, source: str):
        scratch = Scratch(docs.sparkSession)
        counts = scratch.cut(counted(docs, text, lang, source))
        terms = counts.filter("term IS NOT NULL")
        spread = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.count("*").alias("spread"), F.sum("n").alias("all_n"))
        found = scratch.cut(terms.join(spread.filter(F.col("docs") >= fewest).drop("docs"), ["lang", "term"]).select("lang", "source", "term", "n", "all_n", "spread"))
        names = counts.filter("term IS NULL").select("lang", "source")
        sources = names.groupBy("lang").agg(F.count("*").alias("sources"))
        heavy = f"spread * {QUARTER} >= sources OR spread > {LIGHT}"
        kept = found.join(sources, "lang").withColumn("heavy", F.expr(heavy)).drop("sources", "spread")
        once = found.groupBy("lang", "term").agg(F.first("spread").alias("spread"), F.first("all_n").alias("all_n")).join(sources, "lang")
        weight = F.expr(heavy)
        langs = sources.join(once.groupBy("lang").agg(F.sum("all_n").alias("all_n"), F.count_if(weight).alias("heavy"), F.count_if(~weight).alias("light")), "lang", "left").na.fill(0)
        own = found.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        groups = names.join(own, ["lang", "source"], "left").na.fill(0, ["n"]).join(langs, "lang")
        five = f"{ADDED} * (heavy + light)"
        groups = groups.withColumn("total", F.expr(f"n + {five}")).withColumn("all_total", F.expr(f"all_n + {five}"))
        groups = groups.select("lang", "source", "total", "all_total", "sources", "heavy", "light").withColumn("least", share("0L", "total"))
        self.groups = scratch.cut(groups)
        both = kept.join(self.groups.select("lang", "source", "total", "all_total", "least"), ["lang", "source"])
        self.kept = scratch.cut(both.withColumn("p", share("n", "total")).withColumn("q", share("all_n", "all_total")).select("lang", "source", "term", "p", "q", "least", "heavy"))


def _tiled(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """Rows of a source, once for each tile it takes part in: (i, j) of the halves, i <= j."""
    dealt = rows.join(tiles, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("tiles")))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def _sides(names: list, halves: list, i: int, j: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each place of `names` with those it makes a pair with: every pair of the tile once."""
    halves = np.array(halves)
    for a in range(len(names)):
        if halves[a] == i:
            later = np.flatnonzero(halves == j)
            yield a, later[later > a] if i == j else later


def _made(key: str, found: list[tuple[str, str, int]]) -> pa.Table:
    columns = list(zip(*((min(a, b), max(a, b), v) for a, b, v in found), strict=True)) or [[]] * 3
    return pa.table({"lang": pa.array([key] * len(found), pa.string()), "a": pa.array(list(columns[0]), pa.string()), "b": pa.array(list(columns[1]), pa.string()), "value": pa.array(list(columns[2]), pa.int64())})


def dense(terms: Terms) -> DataFrame:
    """(lang, a, b, value): over the heavy terms, what a distance is beyond that of two sources without the term; a
    part for each block of terms.

    A tile has the shares of two times SIDE sources and TERMS terms at most, up to the evenness of a hash.
    """
    each = terms.groups.select("lang", F.ceil(F.col("sources") / SIDE).alias("tiles"), F.ceil(F.col("heavy") / TERMS).alias("blocks")).filter("blocks > 0").distinct()
    frame = terms.groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("least").alias("p"), "least")
    shares = terms.kept.filter("heavy").select("lang", "source", "term", "p", "least")
    blocks = F.expr("CASE WHEN term IS NULL THEN sequence(0L, blocks - 1) ELSE array(pmod(xxhash64(term), blocks)) END")
    rows = _tiled(frame.union(shares), each).withColumn("block", F.explode(blocks)).select("lang", "i", "j", "block", "source", "own", "term", "p", "least")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, i, j, _ = (k.as_py() for k in key)
        source, own, term, p, lowest = (table.column(c).to_pylist() for c in ("source", "own", "term", "p", "least"))
        place, words = {}, {}
        for s, o, t, x in zip(source, own, term, lowest, strict=True):
            if t is None:
                place[s] = (len(place), o, x)
            else:
                words.setdefault(t, len(words))
        least = np.array([x for _, _, x in place.values()], np.int64)
        grid = np.repeat(least[:, None], len(words), 1)
        for s, t, x in zip(source, term, p, strict=True):
            if t is not None:
                grid[place[s][0], words[t]] = x
        names = list(place)
        found = []
        for a, others in _sides(names, [o for _, o, _ in place.values()], i, j):
            sums = np.abs(grid[others] - grid[a]).sum(1) - len(words) * np.abs(least[others] - least[a])
            found += [(names[a], names[b], int(v)) for b, v in zip(others, sums, strict=True)]
        return _made(lang, found)

    return rows.groupBy("lang", "i", "j", "block").applyInArrow(run, PAIR)


def alone(terms: Terms) -> DataFrame:
    """(lang, a, b, value): distances as if no source had a heavy term, and no two shared a light one; every pair is here.

    A source brings its shares of light terms as a histogram: there are few different counts.
    """
    each = terms.groups.select("lang", F.ceil(F.col("sources") / SIDE).alias("tiles")).distinct()
    bars = terms.kept.filter("NOT heavy").groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    hist = bars.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("bars"))
    rows = _tiled(terms.groups.select("lang", "source", "least", (F.col("heavy") + F.col("light")).alias("kept")).join(hist, ["lang", "source"], "left"), each).select("lang", "i", "j", "source", "own", "least", "kept", "bars")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, i, j = (k.as_py() for k in key)
        names, own, kept, bars = (table.column(c).to_pylist() for c in ("source", "own", "kept", "bars"))
        least = np.array([x or 0 for x in table.column("least").to_pylist()], np.int64)
        over = np.zeros((len(names), len(names)), np.int64)  # of a source's own terms, against any other's least share
        for a, bar in enumerate(bars):
            if bar:
                p, n = (np.array([b[c] for b in bar], np.int64) for c in ("p", "n"))
                over[a] = ((np.abs(p[:, None] - least) - np.abs(least[a] - least)) * n[:, None]).sum(0)
        found = []
        for a, others in _sides(names, own, i, j):
            sums = kept[a] * np.abs(least[others] - least[a]) + over[a, others] + over[others, a]
            found += [(names[a], names[b], int(v)) for b, v in zip(others, sums, strict=True)]
        return _made(lang, found)

    return rows.groupBy("lang", "i", "j").applyInArrow(run, PAIR)


def shared(terms: Terms, held: int = 500_000) -> DataFrame:
    """(lang, a, b, value): what alone() has too much for light terms that both sources have, summed within a task.

    The sources of a light term are at most LIGHT, so its posting list is short, and its pairs never leave the task.
    """
    lists = terms.kept.filter("NOT heavy").groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "least")).alias("list")).select("lang", "list")

    def handed(sums: dict) -> pa.RecordBatch:
        columns = list(zip(*((*k, v) for k, v in sums.items()), strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "a", "b", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for lang, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = sorted((x["source"], x["p"], x["least"]) for x in listed)
                for (a, p, o), (b, q, r) in combinations(rows, 2):
                    more = abs(p - q) - abs(p - r) - abs(o - q) + abs(o - r)
                    sums[lang, a, b] = sums.get((lang, a, b), 0) + more
                if len(sums) > held:
                    yield handed(sums)
                    sums = {}
        yield handed(sums)

    return lists.mapInArrow(run, PAIR)


def pairs(terms: Terms) -> DataFrame:
    """(lang, source, item, value): the distance of every two sources of a language, in both directions."""
    sums = dense(terms).union(alone(terms)).union(shared(terms)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", "value", both.alias("x")).select("lang", "x.source", "x.item", "value")


def audit(docs: DataFrame, fewest: int = 30, most: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language all others by distance (part `pair`), and
    up to `most` terms whose share is above the language's (part `term`), largest first, then by item.

    A language keeps the terms in at least `fewest` of its documents; without kept terms all distances are 0. Null
    text, language and source are empty texts; equal rows are documents of their own; other columns don't matter.
    No rows give no rows. All values are whole numbers of billionths, added without rounding.
    """
    terms = Terms(docs, fewest, text, lang, source)
    above = terms.kept.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    apart = pairs(terms).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return apart.union(top)
