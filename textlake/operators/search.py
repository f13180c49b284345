"""Vector-space retrieval: many queries in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.operators import tiles
from textlake.session import cut

LEAST_RANK = 1e-9


@dataclass(frozen=True)
class Modifiers:
    """What may change a search: squared weights, idf left out, a bonus for short documents, all words required,
    a banned host, a range of dates as YYYYMMDD keys (empty: unbounded)."""

    square: bool = False
    flat_idf: bool = False
    short_bonus: bool = False
    strict: bool = False
    ban_host: str | None = None
    date_from: str = ""
    date_to: str = ""


def query_vectors(queries: DataFrame, synonyms: DataFrame | None = None, vocabulary: DataFrame | None = None, expansion: float = 0.5, stop_words: tuple[str, ...] = (), stop_weight: float = 0.0) -> DataFrame:
    """queries(query_id, lemma) -> (query_id, lemma, weight, typed).

    Typed lemmas weigh 1, typed stop-words stop_weight (0 drops them). Synonyms (lemma, synonym) that the
    vocabulary has add `expansion`, but never change a typed lemma.
    """
    base = F.when(F.col("lemma").isin(*stop_words), F.lit(stop_weight)).otherwise(1.0) if stop_words else F.lit(1.0)
    typed = queries.select("query_id", "lemma").distinct().select("query_id", "lemma", base.alias("weight"), F.lit(True).alias("typed")).filter("weight > 0")
    if synonyms is None:
        return typed
    more = typed.join(synonyms, "lemma").select("query_id", F.col("synonym").alias("lemma")).distinct()
    if vocabulary is not None:
        more = more.join(vocabulary.select("lemma"), "lemma", "left_semi").select("query_id", "lemma")
    more = more.join(typed, ["query_id", "lemma"], "left_anti")
    return typed.unionByName(more.select("query_id", "lemma", F.lit(expansion).alias("weight"), F.lit(False).alias("typed")))


def _met(vectors: DataFrame, postings: DataFrame, *columns: str) -> DataFrame:
    """Postings of the queries' lemmas beside the queries: p and q. These postings are dealt by document before they meet the
    queries, which are broadcast, so whatever is grouped by query and document is whole where it is made."""
    words = vectors.select("lemma").distinct()
    dealt = postings.join(F.broadcast(words), "lemma", "left_semi").select("doc_id", "lemma", *columns).repartition("doc_id")
    return dealt.alias("p").join(F.broadcast(vectors).alias("q"), "lemma")


def search_all(vectors: DataFrame, postings: DataFrame, documents: DataFrame, configurations: dict[str, Modifiers], limit: int = 10) -> DataFrame:
    """(configuration, query_id, rank, doc_id, score, matched): search() by each configuration; postings are read and meet
    the queries once for all of them."""
    weights = {}
    for m in configurations.values():
        weight: Column = F.col("tf").cast("double") if m.flat_idf else F.col("p.weight")
        weights[_product(m)] = F.col("q.weight") * (weight * weight if m.square else weight)
    hits = _met(vectors, postings, "tf", "weight")
    sums = hits.groupBy("query_id", "doc_id").agg(*[F.sum(w).alias(name) for name, w in weights.items()], F.count_if("typed").alias("typed_hits"), F.sort_array(F.collect_set("lemma")).alias("matched"))
    lengths = vectors.groupBy("query_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("query_norm"), F.count_if("typed").alias("required"))
    rows = sums.join(F.broadcast(lengths), "query_id").join(documents.filter("norm > 0").hint("shuffle_hash"), "doc_id")
    scores = [F.struct(F.lit(name).alias("configuration"), F.when(_kept(m), F.round(_score(m), 10)).alias("score")) for name, m in configurations.items()]
    scored = rows.select("query_id", "doc_id", "matched", F.inline(F.array(*scores))).filter(F.col("score") > LEAST_RANK)
    order = Window.partitionBy("query_id", "configuration").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("configuration", "query_id", "rank", "doc_id", "score", "matched")


def _product(m: Modifiers) -> str:
    return f"product{'_flat' if m.flat_idf else ''}{'_square' if m.square else ''}"


def _score(m: Modifiers) -> Column:
    score = F.col(_product(m)) / (F.col("query_norm") * F.col("norm"))
    return score / F.log10(F.greatest(F.col("term_count"), F.lit(10))) if m.short_bonus else score


def _kept(m: Modifiers) -> Column:
    kept = F.lit(True)
    if m.strict:
        kept &= F.col("typed_hits") == F.col("required")
    if m.ban_host is not None:
        kept &= F.col("host") != m.ban_host
    if m.date_from:
        kept &= F.col("date") >= m.date_from
    if m.date_to:
        kept &= F.col("date") <= m.date_to
    return kept


def search(vectors: DataFrame, postings: DataFrame, documents: DataFrame, modifiers: Modifiers = Modifiers(), limit: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score, matched): the `limit` best documents of every query, by cosine.

    documents holds doc_id and norm, and host, date (a date key) and term_count where a modifier needs
    them. Postings meet the queries' lemmas first, so only matching rows are summed; documents join the sums.
    The norm stays that of unsquared, idf-weighted vectors whatever the modifiers, so a score may exceed 1.
    Scores are rounded to ten digits, so equal documents tie however their sums ran; ties go to the smaller doc_id.
    """
    return search_all(vectors, postings, documents, {"": modifiers}, limit).drop("configuration")


def explain(vectors: DataFrame, postings: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, doc_id, terms): each pair's largest contributions, as (value, lemma), largest first. Only these are
    kept while rows pass, in the order in which they are sorted."""
    each = _met(vectors, postings, "weight").select("query_id", "doc_id", F.struct((F.col("q.weight") * F.col("p.weight")).alias("value"), "lemma").alias("term"))
    n = F.row_number().over(Window.partitionBy("doc_id", "query_id").orderBy(F.desc("term.value"), F.desc("term.lemma")))
    first = each.withColumn("n", n).filter(F.col("n") <= top).groupBy("doc_id", "query_id").agg(*[F.max(F.when(F.col("n") == k, F.col("term"))).alias(f"t{k}") for k in range(1, top + 1)])
    return first.select("query_id", "doc_id", F.array_compact(F.array(*[f"t{k}" for k in range(1, top + 1)])).alias("terms"))


def rocchio(vectors: DataFrame, postings: DataFrame, documents: DataFrame, marks: DataFrame, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15, top: int = 40) -> DataFrame:
    """marks(query_id, doc_id, mark +-1) -> the queries' vectors moved to liked documents and away from others.

    The sum of alpha times the query, beta times the mean normalized liked document and minus gamma times
    the mean of the others; only positive weights stay, the `top` largest of a query (ties: by lemma).
    """
    sizes = marks.groupBy("query_id", "mark").agg(F.count("*").alias("marked"))
    unit = marks.join(sizes, ["query_id", "mark"]).join(documents.filter("norm > 0"), "doc_id").join(postings, "doc_id")
    share = F.when(F.col("mark") > 0, F.lit(beta)).otherwise(F.lit(-gamma)) * F.col("weight") / F.col("norm") / F.col("marked")
    moved = vectors.select("query_id", "lemma", (alpha * F.col("weight")).alias("part")).unionByName(unit.select("query_id", "lemma", share.alias("part")))
    summed = moved.groupBy("query_id", "lemma").agg(F.sum("part").alias("weight")).filter("weight > 1e-6")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("weight", 10)), "lemma")
    return summed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "lemma", "weight")


#: Postings that a task holds at once, and so many at least, if there are tasks enough.
TILE, LEAST_TILE = 6_000_000, 250_000


def similar(postings: DataFrame, documents: DataFrame, sources: DataFrame | None = None, terms: int = 25, limit: int = 10) -> DataFrame:
    """(doc_id, rank, other_id, score): documents(doc_id) nearest to each of sources(doc_id), or to every document, over its
    `terms` heaviest lemmas. Ids are whole numbers; rows without one are near to none.

    The cosine uses the source's norm over those lemmas only. All pairs that share a lemma are compared: documents are dealt
    into blocks of some TILE postings, sources, which bring at most `terms` lemmas each, pass by every block, and a task
    lets go of no more than a block's `limit` best documents of a source. A lemma's 64-bit hash stands for it.
    """
    spark = postings.sparkSession
    by_doc = postings.filter("doc_id is not null and weight > 0").groupBy("doc_id").agg(F.collect_list(F.struct("weight", "lemma")).alias("all"))
    heavy = F.slice(F.array_sort(F.transform("all", lambda x: F.struct((-F.round(x["weight"], 10)).alias("order"), x["lemma"].alias("lemma"), x["weight"].alias("weight")))), 1, terms)
    norm = F.sqrt(F.aggregate("all", F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"]))
    hashes, weights = (lambda c: F.transform(c, lambda x: F.xxhash64(x["lemma"]))), (lambda c: F.transform(c, lambda x: x["weight"]))
    made = by_doc.select(F.col("doc_id").cast("long").alias("id"), norm.alias("norm"), hashes("all").alias("lemmas"), weights("all").alias("weights"), heavy.alias("own"))
    vectors = cut(made.select("id", "norm", "lemmas", "weights", hashes("own").alias("own_lemmas"), weights("own").alias("own_weights")))
    held = vectors.agg(F.sum(F.size("lemmas"))).first()[0] or 0
    blocks = max(1, -(-held // TILE), min(2 * spark.sparkContext.defaultParallelism, held // LEAST_TILE))

    rows = documents.select(F.col("doc_id").cast("long").alias("id"))
    whole = vectors.join(rows.hint("shuffle_hash"), "id").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "norm", "lemmas", "weights")
    asked = vectors if sources is None else vectors.join(sources.select(F.col("doc_id").cast("long").alias("id")), "id", "left_semi")
    passing = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "norm", F.col("own_lemmas").alias("lemmas"), F.col("own_weights").alias("weights"))
    dealt = whole.unionByName(passing).repartitionById(blocks, "block").sortWithinPartitions("block", "kind")
    found = dealt.mapInArrow(tiles.nearest(limit), tiles.FOUND).withColumn("score", F.round("score", 10)).filter("score > 0")
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(F.col("source_id").alias("doc_id"), "rank", F.col("doc_id").alias("other_id"), "score")
