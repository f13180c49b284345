"""Quality metrics: ranked retrieval, n-gram overlap, word errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.functions import udfs


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """ranked(query_id, pos, doc_id) with rel of qrels(query_id, doc_id, rel), null where not judged."""
    return ranked.join(qrels.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"], "left")


def retrieval(ranked: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row per judged query: precision, recall, f1, p_at_k (divided by k even if fewer came back),
    r_precision, ap (divided by all relevant), ndcg (gain 2^rel - 1), bpref. Zero where undefined.

    bpref without a judged irrelevant document is 1 for every relevant one returned.
    """
    truth = qrels.groupBy("query_id").agg(F.count_if(F.col("rel") > 0).alias("relevant"), F.count_if(F.col("rel") == 0).alias("irrelevant"))
    before = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    good = F.coalesce(F.col("rel") > 0, F.lit(False))
    rows = judged(ranked, qrels).join(truth, "query_id").withColumns({"good": good, "hits": F.count_if(good).over(before), "bad": F.count_if(F.col("rel") == 0).over(before)})
    gain = lambda rel: (F.pow(F.lit(2.0), rel) - 1)
    log2 = lambda pos: F.log2(pos + 1.0)
    bpref = F.when(F.col("irrelevant") == 0, 1.0).otherwise(1 - F.least("bad", "relevant") / F.greatest(F.least("relevant", "irrelevant"), F.lit(1)))
    each = rows.groupBy("query_id").agg(
        F.count("*").alias("returned"), F.count_if("good").alias("found"),
        *[F.count_if(F.col("good") & (F.col("pos") <= k)).alias(f"in_{k}") for k in ks],
        F.count_if(F.col("good") & (F.col("pos") <= F.col("relevant"))).alias("in_r"),
        F.sum(F.when(F.col("good"), F.col("hits") / F.col("pos")).otherwise(0.0)).alias("ap_sum"),
        F.sum(gain(F.coalesce("rel", F.lit(0))) / log2(F.col("pos"))).alias("dcg"),
        F.sum(F.when(F.col("good"), bpref).otherwise(0.0)).alias("bpref_sum"),
    )
    best = qrels.filter("rel > 0").withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")))
    size = ranked.groupBy("query_id").agg(F.max("pos").alias("depth"))
    ideal = best.join(size, "query_id").filter("pos <= depth").groupBy("query_id").agg(F.sum(gain(F.col("rel")) / log2(F.col("pos"))).alias("idcg"))
    out = truth.join(each, "query_id", "left").join(ideal, "query_id", "left").na.fill(0)
    p, r = _ratio(F.col("found"), F.col("returned")), _ratio(F.col("found"), F.col("relevant"))
    return out.select(
        "query_id", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"),
        *[(F.col(f"in_{k}") / k).alias(f"p_at_{k}") for k in ks],
        _ratio(F.col("in_r"), F.col("relevant")).alias("r_precision"), _ratio(F.col("ap_sum"), F.col("relevant")).alias("ap"),
        _ratio(F.col("dcg"), F.col("idcg")).alias("ndcg"), _ratio(F.col("bpref_sum"), F.col("relevant")).alias("bpref"),
    )


def precision_curve(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, level, precision): the best precision at recall of at least 0.0, 0.1 ... 1.0."""
    before = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    truth = qrels.groupBy("query_id").agg(F.count_if(F.col("rel") > 0).alias("relevant"))
    hit = judged(ranked, qrels).withColumn("hits", F.count_if(F.col("rel") > 0).over(before)).filter("rel > 0").join(truth, "query_id")
    points = hit.select("query_id", (F.col("hits") / F.col("relevant")).alias("r"), (F.col("hits") / F.col("pos")).alias("p"))
    levels = truth.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("tenth"))
    met = levels.join(points, "query_id", "left")
    best = F.max(F.when(F.col("r") >= F.col("tenth") / 10 - 1e-9, F.col("p")))
    return met.groupBy("query_id", "tenth").agg(F.coalesce(best, F.lit(0.0)).alias("precision")).select("query_id", (F.col("tenth") / 10).alias("level"), "precision")


def suspect_judgements(qrels: DataFrame, least: int = 8) -> DataFrame:
    """Queries with many judgements, none of them irrelevant."""
    return qrels.groupBy("query_id").agg(F.count("*").alias("judged"), F.min("rel").alias("least_rel")).filter((F.col("judged") >= least) & (F.col("least_rel") > 0)).select("query_id", "judged")


def _counts(rows: DataFrame, grams: Column, *by: str) -> DataFrame:
    return rows.select(*by, F.explode(grams).alias("gram")).groupBy(*by, "gram").agg(F.count("*").alias("n"))


def _clipped(pairs: DataFrame, make, orders: tuple[int, ...]) -> DataFrame:
    """pairs(pair_id, hypothesis, reference) -> (pair_id, n, common, hyp, ref): n-grams in common, clipped, and of each side."""
    out = None
    for n in orders:
        h, r = (_counts(pairs, make(F.col(side), n), "pair_id").withColumnRenamed("n", short) for side, short in (("hypothesis", "h"), ("reference", "r")))
        both = h.join(r, ["pair_id", "gram"], "full").na.fill(0, ["h", "r"])
        one = both.groupBy("pair_id").agg(F.lit(n).alias("n"), F.sum(F.least("h", "r")).alias("common"), F.sum("h").alias("hyp"), F.sum("r").alias("ref"))
        out = one if out is None else out.unionByName(one)
    return out


def rouge(pairs: DataFrame, n: int = 1) -> DataFrame:
    """pairs(pair_id, hypothesis, reference arrays of words) -> (pair_id, precision, recall, f1), counts clipped."""
    c = _clipped(pairs, T.word_ngrams, (n,))
    p, r = _ratio(F.col("common"), F.col("hyp")), _ratio(F.col("common"), F.col("ref"))
    return pairs.select("pair_id").join(c, "pair_id", "left").select("pair_id", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"))


def bleu(pairs: DataFrame, most: int = 4) -> DataFrame:
    """One row for the corpus: bleu (0 to 100), brevity and the precisions; any zero precision makes bleu 0."""
    sums = _clipped(pairs, T.word_ngrams, tuple(range(1, most + 1))).groupBy("n").agg(F.sum("common").alias("common"), F.sum("hyp").alias("hyp"), F.sum("ref").alias("ref"))
    each = lambda k, c: F.coalesce(F.max(F.when(F.col("n") == k, F.col(c))), F.lit(0))
    row = sums.agg(*[_ratio(each(k, "common"), each(k, "hyp")).alias(f"p{k}") for k in range(1, most + 1)], each(1, "hyp").alias("hyp"), each(1, "ref").alias("ref"))
    brevity = F.when(F.col("hyp") > F.col("ref"), 1.0).when(F.col("hyp") == 0, 0.0).otherwise(F.exp(1 - F.try_divide("ref", "hyp")))
    least = F.least(*[F.col(f"p{k}") for k in range(1, most + 1)])
    logs = sum((F.log(F.greatest(F.col(f"p{k}"), F.lit(1e-300))) for k in range(2, most + 1)), F.log(F.greatest(F.col("p1"), F.lit(1e-300))))
    return row.select(F.when(least > 0, 100 * brevity * F.exp(logs / most)).otherwise(0.0).alias("bleu"), brevity.alias("brevity"), *[f"p{k}" for k in range(1, most + 1)])


def sentence_bleu(pairs: DataFrame, most: int = 4) -> DataFrame:
    """(pair_id, bleu), one added to both counts of orders above 1."""
    c = _clipped(pairs, T.word_ngrams, tuple(range(1, most + 1)))
    add = F.when(F.col("n") > 1, 1).otherwise(0)
    logs = c.groupBy("pair_id").agg(F.avg(F.log(F.greatest(_ratio(F.col("common") + add, F.col("hyp") + add), F.lit(1e-300)))).alias("mean"), F.min(F.when(F.col("n") == 1, F.col("common"))).alias("one"), F.max(F.when(F.col("n") == 1, F.col("hyp"))).alias("hyp"), F.max(F.when(F.col("n") == 1, F.col("ref"))).alias("ref"))
    brevity = F.when(F.col("hyp") > F.col("ref"), 1.0).otherwise(F.exp(1 - F.try_divide("ref", "hyp")))
    return logs.select("pair_id", F.when(F.col("one") > 0, 100 * brevity * F.exp("mean")).otherwise(0.0).alias("bleu"))


def chrf(pairs: DataFrame, most: int = 6, beta: float = 2.0) -> DataFrame:
    """pairs(pair_id, hypothesis, reference strings) -> (pair_id, chrf): spaces left out, precisions and recalls
    averaged over the orders where the side has n-grams. A pair's n-grams stay in its row."""
    bare = pairs.select("pair_id", *[F.regexp_replace(c, r"\s+", "").alias(c) for c in ("hypothesis", "reference")])
    counts = bare.select("pair_id", udfs.shared_grams("hypothesis", "reference", F.lit(most)).alias("common"), F.length("hypothesis").alias("h"), F.length("reference").alias("r"))
    orders = F.sequence(F.lit(1), F.lit(most))
    mean = lambda side: F.aggregate(F.filter(orders, lambda n: n <= F.col(side)), F.lit(0.0), lambda a, n: a + F.get("common", n - 1) / (F.col(side) - n + 1)) / F.least(F.lit(most), side)
    means = counts.select("pair_id", *[F.when(F.col(side) > 0, mean(side)).otherwise(0.0).alias(name) for side, name in (("h", "p"), ("r", "r"))])
    p, r, b = F.col("p"), F.col("r"), beta * beta
    return means.select("pair_id", (100 * _ratio((1 + b) * p * r, b * p + r)).alias("chrf"))


def word_errors(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, hypothesis, reference arrays of words) -> (pair_id, errors, words, wer), wer null without words.

    Words become single characters, numbered within the pair, so the built-in edit distance counts words.
    """
    known = F.array_distinct(F.concat("reference", "hypothesis"))
    wide = lambda side: F.array_join(F.transform(F.col(side), lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(F.col("known"), w) + 0x4E00), 4, "0")), "UTF-16BE")), "")
    rows = pairs.withColumn("known", known)
    errors = F.levenshtein(wide("reference"), wide("hypothesis"))
    return rows.select("pair_id", errors.cast("long").alias("errors"), F.size("reference").cast("long").alias("words"), F.try_divide(errors, F.size("reference")).alias("wer"))
