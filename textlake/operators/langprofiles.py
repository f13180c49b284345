"""Language identification by profiles: n-gram ranks, letter shares, voting, and studies of accuracy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T

LIMIT = 300
#: n-grams go up to five characters of 12 bits each in one number, first character first: numbers order as names do.
LONGEST, BITS = 5, 12
#: Those across words have at most three characters, of any plane.
RUNNING_BITS = 21
#: Texts of one owner are taken apart together up to so many characters; so many different n-grams leave a task's memory.
TOGETHER, HELD = 1 << 20, 4_000_000


def features(docs: DataFrame, method: str, text: str = "text") -> DataFrame:
    """docs(owner, text) -> (owner, feature, n) by method: ngram, alphabet or running.

    n-grams are added up within a task before they are shuffled; letters are counted in the row they stand in,
    one row a different letter.
    """
    normal = T.letters(text)
    if method != "alphabet":
        kind = docs.schema["owner"].dataType.simpleString()
        made = docs.select("owner", normal.alias("normal")).mapInArrow(_word_grams if method == "ngram" else _running_grams, f"owner {kind}, feature string, uses long")
    else:
        once = lambda t: F.filter(F.array_distinct(F.split(t, "")), lambda c: c != "")
        uses = lambda t: F.transform(once(t), lambda c: F.struct(c.alias("feature"), (F.length(t) - F.length(F.replace(t, c, F.lit("")))).cast("long").alias("uses")))
        made = docs.select("owner", F.inline(T.let(F.replace(normal, F.lit(" "), F.lit("")), uses)))
    return made.groupBy("owner", "feature").agg(F.sum("uses").alias("n"))


def profiles(counts: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """(owner, feature, n, rank, weight): ranks from 0 by falling count, then name; a weight is the share of all
    features, also of those the limit cuts off.

    With a limit, ranks past it are dropped before the shuffle and totals join the few rows that stay: an
    owner may have any number of features."""
    w = Window.partitionBy("owner")
    place = F.row_number().over(w.orderBy(F.desc("n"), "feature"))
    if limit is None:
        return counts.withColumns({"rank": place - 1, "weight": F.col("n") / F.sum("n").over(w)})
    totals = counts.groupBy("owner").agg(F.sum("n").alias("total"))
    top = counts.withColumn("place", place).filter(F.col("place") <= limit).join(totals, "owner")
    return top.select("owner", "feature", "n", (F.col("place") - 1).alias("rank"), (F.col("n") / F.col("total")).alias("weight"))


def _codes(normal: str) -> np.ndarray:
    """text.padded_ngrams() of a text whose characters are all below 1 << BITS, as numbers."""
    points = np.frombuffer(f"_{normal.replace(' ', f'_{chr(0)}_')}_".encode("utf-32-le"), "<u4").astype(np.int64)
    inside, code = points != 0, points << BITS * (LONGEST - 1)
    out = [code[inside & (points != ord("_"))]]
    for n in range(2, LONGEST + 1):
        code = code[:-1] | points[n - 1 :] << BITS * (LONGEST - n)
        inside = inside[:-1] & (points[n - 1 :] != 0)
        out.append(code[inside])
    return np.concatenate(out)


def _names(codes: np.ndarray) -> list[str]:
    shifts = np.arange(LONGEST - 1, -1, -1) * BITS
    return ((codes[:, None] >> shifts) & ((1 << BITS) - 1)).astype("<u4").view(f"<U{LONGEST}").ravel().tolist()


def _plain(normal: str) -> list[str]:
    """The same as names, for texts of any characters."""
    words = [f"_{w}_" for w in normal.split(" ") if w]
    return [w[i : i + n] for w in words for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1) if n > 1 or w[i] != "_"]


def _small(normal: str) -> bool:
    return normal.isascii() or ord(max(normal)) < 1 << BITS


def _counted(texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], Counter]:
    """n-grams of texts with their counts: as numbers, ascending, where the text allows it, else as names."""
    small = " ".join(t for t in texts if t and _small(t))
    codes = np.unique(_codes(small), return_counts=True) if small else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return codes, Counter(g for t in texts if not _small(t) for g in _plain(t))


def _most(texts: list[str], limit: int) -> tuple[int, list[str], list[int]]:
    """How many n-grams texts have, and the `limit` most frequent ones with their counts: by falling count, then name."""
    (codes, n), others = _counted(texts)
    if others:
        others.update(dict(zip(_names(codes), n.tolist(), strict=True)))
        top = sorted(others.items(), key=lambda x: (-x[1], x[0]))[:limit]
        return others.total(), [g for g, _ in top], [c for _, c in top]
    top = np.argsort(-n, kind="stable")[:limit]
    return int(n.sum()), _names(codes[top]), n[top].tolist()


def running_codes(normal: str) -> np.ndarray:
    """text.running_ngrams() of a normal text, as numbers: up to three characters of RUNNING_BITS bits."""
    points = np.frombuffer(f" {normal} ".encode("utf-32-le"), "<u4").astype(np.int64)
    if not normal:
        return points[:0]
    one = points << 2 * RUNNING_BITS
    two = one[:-1] | points[1:] << RUNNING_BITS
    return np.concatenate([one[points != ord(" ")], two, two[:-1] | points[2:]])


def _running_names(codes: np.ndarray) -> list[str]:
    shifts = np.arange(2, -1, -1) * RUNNING_BITS
    return ((codes[:, None] >> shifts) & ((1 << RUNNING_BITS) - 1)).astype("<u4").view("<U3").ravel().tolist()


def _running_counted(texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], Counter]:
    return np.unique(np.concatenate([running_codes(t) for t in texts]), return_counts=True), Counter()


def _word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _added_up(batches, _counted, _names)


def _running_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _added_up(batches, _running_counted, _running_names)


def _added_up(batches: Iterator[pa.RecordBatch], count: Callable, named: Callable) -> Iterator[pa.RecordBatch]:
    """(owner, normal) -> (owner, feature, uses), added up within a task as far as HELD different ones allow."""
    held: dict = {}
    size, kind = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        for owner, (codes, n) in held.items():
            for at in range(0, len(codes), 100_000):
                names = named(codes[at : at + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array([owner] * len(names), kind), pa.array(names), pa.array(n[at : at + 100_000])], names=["owner", "feature", "uses"])
        held.clear()

    for batch in batches:
        kind = batch.column(0).type
        waiting: dict = {}
        for owner, normal in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if normal:
                parts = waiting.setdefault(owner, [(0, [])])
                if parts[-1][0] > TOGETHER:
                    parts.append((0, []))
                parts[-1][1].append(normal)
                parts[-1] = parts[-1][0] + len(normal), parts[-1][1]
        for owner, parts in waiting.items():
            for _, texts in parts:
                (codes, n), others = count(texts)
                if owner in held:
                    both, at = np.unique(np.concatenate([held[owner][0], codes]), return_inverse=True)
                    codes, n = both, np.bincount(at, np.concatenate([held[owner][1], n]), len(both)).astype(np.int64)
                    size -= len(held[owner][0])
                held[owner] = codes, n
                size += len(codes)
                if others:
                    yield pa.RecordBatch.from_arrays([pa.array([owner] * len(others), kind), pa.array(list(others)), pa.array(list(others.values()), pa.int64())], names=["owner", "feature", "uses"])
                if size > HELD:
                    yield from flush()
                    size = 0
    yield from flush()


def own_profiles(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """profiles(features(docs, "ngram"), limit) for very many owners of few texts each, such as documents: texts are dealt
    by owner once, n-grams are counted where an owner's texts stand side by side, and nothing else is shuffled."""
    rows = docs.select("owner", T.letters("text").alias("normal")).filter("owner is not null").repartition("owner").sortWithinPartitions("owner")
    kind = rows.schema["owner"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, texts, made, own = None, [], [], None

        def flush() -> pa.RecordBatch:
            ends = pa.array(np.cumsum([0, *(len(m[2]) for m in made)]), pa.int32())
            values = [pa.array([x for m in made for x in m[i]], t) for i, t in ((2, pa.string()), (3, pa.int64()))]
            out = [pa.array([m[0] for m in made], own), pa.array([m[1] for m in made], pa.int64()), *(pa.ListArray.from_arrays(ends, v) for v in values)]
            made.clear()
            return pa.RecordBatch.from_arrays(out, names=["owner", "total", "features", "uses"])

        for batch in batches:
            own = batch.column(0).type
            for owner, normal in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if owner != last:
                    if texts:
                        made.append((last, *_most(texts, limit)))
                    last, texts = owner, []
                if normal:
                    texts.append(normal)
                if len(made) >= 1000:
                    yield flush()
        if texts:
            made.append((last, *_most(texts, limit)))
        if made:
            yield flush()

    tops = rows.mapInArrow(run, f"owner {kind}, total long, features array<string>, uses array<long>")
    each = tops.select("owner", "total", "uses", F.posexplode("features").alias("rank", "feature")).withColumn("n", F.get("uses", "rank"))
    return each.select("owner", "feature", "n", "rank", (F.col("n") / F.col("total")).alias("weight"))


def rank_distance(docs: DataFrame, languages: DataFrame, penalty_least: int = LIMIT) -> DataFrame:
    """(owner, lang, distance) of every document and language: mean rank difference over the document's features,
    in units of the penalty, which a feature unknown to the language costs. Both are profiles; languages are few, and
    their profiles bounded. Costs are added as whole numbers, so equal distances tie in any order.
    """
    size = languages.groupBy("owner").agg(F.greatest(F.count("*"), F.lit(penalty_least)).alias("penalty"))
    langs = F.broadcast(size.withColumnRenamed("owner", "lang"))
    own = languages.select(F.col("owner").alias("lang"), "feature", F.col("rank").alias("lang_rank"))
    rows = docs.select("owner", "feature", "rank").crossJoin(langs).join(F.broadcast(own), ["lang", "feature"], "left")
    cost = F.sum(F.coalesce(F.abs(F.col("rank") - F.col("lang_rank")), F.col("penalty")))
    return rows.groupBy("owner", "lang", "penalty").agg((cost / (F.count("*") * F.col("penalty"))).alias("distance")).drop("penalty")


def share_distance(docs: DataFrame, languages: DataFrame) -> DataFrame:
    """(owner, lang, distance): half the sum of differences of shares over the union of features, at most 1.

    Rewritten over the common features only, so no outer join is needed: the sum over the union is both
    sides' totals less twice the smaller shares of what they share. Languages are few, and so are their letters.
    """
    left = docs.groupBy("owner").agg(F.sum("weight").alias("mine"))
    right = languages.groupBy("owner").agg(F.sum("weight").alias("theirs")).withColumnRenamed("owner", "lang")
    own = languages.select(F.col("owner").alias("lang"), "feature", F.col("weight").alias("lang_weight"))
    common = docs.join(F.broadcast(own), "feature").groupBy("owner", "lang").agg(F.sum(F.least("weight", "lang_weight")).alias("common"))
    rows = left.crossJoin(F.broadcast(right)).join(common, ["owner", "lang"], "left")
    return rows.select("owner", "lang", F.least(F.lit(1.0), (F.col("mine") + F.col("theirs") - 2 * F.coalesce("common", F.lit(0.0))) / 2).alias("distance"))


def classify(distances: DataFrame) -> DataFrame:
    """(owner, predicted, distance, confidence): nearest language (ties: by name); confidence is how much nearer
    than the second it is, from 0 to 1."""
    best = distances.groupBy("owner").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "lang"))), 1, 2).alias("two"))
    one, two = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    second = two["distance"]
    confidence = F.when(second > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (second - one["distance"]) / second))).otherwise(0.0)
    return best.select("owner", one["lang"].alias("predicted"), one["distance"].alias("distance"), confidence.alias("confidence"))


def consensus(votes: DataFrame) -> DataFrame:
    """votes(owner, method, predicted, confidence) -> (owner, predicted, agreement): most votes, then the highest
    confidence, then by name; agreement is the share of methods that voted so."""
    each = votes.groupBy("owner", "predicted").agg(F.count("*").alias("n"), F.max("confidence").alias("c"))
    w = Window.partitionBy("owner")
    ranked = each.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), F.desc("c"), "predicted")), "agreement": F.col("n") / F.sum("n").over(w)})
    return ranked.filter("r = 1").select("owner", "predicted", "agreement")


def confusion(verdicts: DataFrame, *by: str) -> DataFrame:
    """(by..., gold, predicted, n)"""
    return verdicts.groupBy(*by, "gold", "predicted").agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame, *by: str) -> DataFrame:
    """confusion -> (by..., lang, precision, recall, f1); zero where there is nothing to divide by."""
    hit = F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)
    gold = matrix.groupBy(*by, F.col("gold").alias("lang")).agg(F.sum("n").alias("golds"), F.sum(hit).alias("hits"))
    told = matrix.groupBy(*by, F.col("predicted").alias("lang")).agg(F.sum("n").alias("told"))
    rows = gold.join(told, [*by, "lang"], "full").select(*by, "lang", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("golds", "hits", "told")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("hits"), F.col("told")), ratio(F.col("hits"), F.col("golds"))
    return rows.select(*by, "lang", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def stable_from(rows: DataFrame, x: str, y: str, target: float, *by: str) -> DataFrame:
    """The smallest x from which on y never falls below target, per `by`; none where there is no such x."""
    after = Window.partitionBy(*by).orderBy(x).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("least", F.min(y).over(after)).filter(F.col("least") >= target).groupBy(*by).agg(F.min(x).alias("stable_from"))


def mixed(first: Column, second: Column, ratio: Column, size: int) -> Column:
    """A text of about `size` characters: the share `ratio` of the second, the rest of the first."""
    n = F.bround(ratio * size).cast("int")
    return F.trim(F.concat_ws(" ", F.substring(first, F.lit(1), F.lit(size) - n), F.substring(second, F.lit(1), n)))
