"""German clauses put in order: parts of a clause, each with its kind and place in the source, become a sequence of words.

A main clause has one part or its subject before the finite verb, which stands second; a question its question word; a
subordinate clause its finite verb last; what follows zu and um its infinitive. Between them parts stand by a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of what stands between the verbs, by kind.
MIDDLE = {"subj": 0, "refl": 1, "pronoun": 2, "pronoun to": 3, "early": 4, "iobj": 5, "other": 6, "neg": 7, "pred": 8}
# Question words.
WH = "wer was wen wem wessen wo wann wie warum welche welcher welches welchen welchem woher wohin".split()
#: Zones of a clause, from first to last.
INTRO, PRE, HEAD, FRONT, FINITE, FIELD, FIXED, PREFIX, REST, LAST, AFTER = range(11)

PARTS = "clause_id string, kind string, pos int, pronoun boolean, clause boolean, words array<string>"
CLAUSES = "clause_id string, type string, verb_pos int, finite string, rest array<string>, prefix string, fixed array<string>, intro array<string>"


def _key(early: Column) -> Column:
    kind, pronoun = F.col("kind"), F.coalesce("pronoun", F.lit(False))
    own = F.when(pronoun & (kind == "obj"), "pronoun").when(pronoun & (kind == "iobj"), "pronoun to").when((kind == "conn") | ((kind == "adv") & early), "early").when(kind.isin("subj", "refl", "neg", "pred", "iobj"), kind).otherwise("other")
    return F.coalesce(*(F.when(own == k, n) for k, n in MIDDLE.items()))


def linearized(clauses: DataFrame, parts: DataFrame) -> DataFrame:
    """(clause_id, words, front): every clause's words in order, and the kind of the part before its verb, if any.

    clauses: type (main, imperative, question, sub, zu, um), verb_pos (the finite verb's place in the source), the verb:
    finite, rest (participles and infinitives), prefix, which goes before the verb or to its end; fixed words before the
    last verbs, intro words before all. parts: kind (subj, refl, obj, iobj, conn, adv, neg, pred, pre, nachfeld or any
    other), pos, the place in the source, whether it is a pronoun or a clause of its own.

    Before a main clause's verb stands the first part that is before subject and verb in the source and no connective,
    else the subject, else the first connective. Parts of equal keys stand by their places, of equal places by their words.
    A clause without parts is its verbs; null words are none. Parts of no clause are left out.
    """
    c = F.col
    empty = F.array().cast("array<string>")
    known = clauses.select("clause_id", c("type").alias("_type"), c("verb_pos").alias("_verb"), c("prefix").isNotNull().alias("_prefix"))
    rows = parts.withColumn("words", F.coalesce("words", empty)).join(known, "clause_id")
    whole = Window.partitionBy("clause_id")  # a clause has few parts
    rows = rows.withColumn("_subject", F.min(F.when(c("kind") == "subj", c("pos"))).over(whole))
    first = F.lower(F.get("words", F.lit(0)))
    ahead = ~c("kind").isin("subj", "refl", "neg", "pred", "nachfeld", "pre") & (c("pos") < F.least("_verb", F.coalesce("_subject", "_verb")))
    main = F.when(ahead & (c("kind") != "conn"), 0).when((c("kind") == "subj") & (c("pos") == c("_subject")), 1).when(ahead, 2)
    asks = F.when((ahead | ((c("kind") == "subj") & (c("pos") == c("_subject")) & (c("pos") < c("_verb")))) & first.isin(*WH), F.when(ahead, 0).otherwise(1))
    rank = F.when(c("_type") == "main", main).when(c("_type") == "question", asks)
    place = F.struct("rank", "pos", "words", "kind")
    ranked = rows.withColumn("rank", rank).withColumn("_front", F.min(F.when(c("rank").isNotNull(), place)).over(whole))
    rows = ranked.withColumn("_is", F.coalesce(place == c("_front"), F.lit(False)))
    zone = F.when(c("kind") == "nachfeld", AFTER).when(c("kind") == "pre", PRE).when("_is" if False else c("_is"), FRONT).otherwise(FIELD)
    key = F.when(zone == FIELD, _key(c("pos") < c("_verb"))).otherwise(0)
    words = F.when(c("_is") & F.coalesce("clause", F.lit(False)), F.concat("words", F.array(F.lit(",")))).otherwise(c("words"))
    placed = rows.select("clause_id", F.struct(zone.alias("zone"), key.alias("key"), "pos", words.alias("words")).alias("x"), F.when(c("_is"), c("kind")).alias("front"))
    one = lambda zone, words: F.struct(F.lit(zone).alias("zone"), F.lit(0).alias("key"), F.lit(0).alias("pos"), words.alias("words"))
    open_ = c("type").isin("main", "imperative", "question")
    rest, finite = F.coalesce("rest", empty), F.when(c("finite").isNotNull() & (c("finite") != ""), F.array("finite")).otherwise(empty)
    apart = F.when(c("prefix").isNotNull() & (F.size(rest) == 0), F.array("prefix")).otherwise(empty)
    joined = F.when(F.size(apart) > 0, F.transform(finite, lambda w: F.concat("prefix", w))).otherwise(finite)
    infinite = c("type").isin("zu", "um")
    own = F.array(
        one(INTRO, F.coalesce("intro", empty)), one(HEAD, F.when(c("type") == "um", F.array(F.lit("um"))).otherwise(empty)), one(FINITE, F.when(open_, finite).otherwise(empty)), one(FIXED, F.coalesce("fixed", empty)),
        one(PREFIX, F.when(open_, apart).otherwise(empty)), one(REST, rest), one(LAST, F.when(open_ | infinite, empty).otherwise(joined)),
    )
    verbs = clauses.select("clause_id", F.explode(own).alias("x"), F.lit(None).cast("string").alias("front"))
    done = verbs.union(placed).groupBy("clause_id").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.max("front").alias("front"))
    return done.select("clause_id", F.flatten(F.transform("xs", lambda x: x["words"])).alias("words"), "front")
