"""Registered queries of lexicons, evaluation, registries and files. Where the tables have no lexicon, trials or trees, columns
of theirs stand in for them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import evaluation, index, lexicon, matching, search, summarize, tables
from textlake.plans.queries import INDEX, ORACLES, PATTERN, SIGNIFICANT, TF, _index, _queries, _scores, query, r6, table, toks
from textlake.sources import files

_PLAIN = "translate(lower({}), 'ё', 'е')"


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries: names are words, brands what they mean, kinds the parts of speech."""
    p, kind = table(spark, sf_dir, "part"), F.get(F.array(*map(F.lit, ("noun", "verb", "adj"))), (F.col("p_size") % 3).cast("int"))
    return p.select(F.col("p_name").alias("en"), kind.alias("pos"), F.col("p_brand").alias("de"), F.when(F.col("p_size") % 2 == 0, "").otherwise("it").alias("domain"), F.col("p_partkey").alias("rank"))


LEXICON = "lex AS (SELECT p_name AS en, (['noun', 'verb', 'adj'])[p_size % 3 + 1] AS pos, p_brand AS de, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'it' END AS domain, p_partkey AS rank FROM part)"


@query(f"""WITH {LEXICON}, u AS (SELECT en, pos, 'user' AS de, domain, rank - 1000000000 AS rank FROM lex WHERE rank % 10 = 3)
SELECT *, 'seed' AS source FROM lex WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.en = lex.en AND u.pos = lex.pos AND u.domain = lex.domain) UNION ALL SELECT *, 'user' FROM u""")
def lexicon_overlay(spark, sf_dir):
    seed = _lexicon(spark, sf_dir)
    return lexicon.overlay(seed, seed.filter("rank % 10 = 3").withColumn("de", F.lit("user")))


@query(f"""WITH {LEXICON}, r AS (SELECT * FROM lex WHERE contains(lower(en), 'ring'))
SELECT *, (SELECT count(*) FROM r) AS total FROM r ORDER BY CASE WHEN lower(en) = 'ring' THEN 0 WHEN starts_with(lower(en), 'ring') THEN 1 ELSE 2 END, lower(en), rank LIMIT 50 OFFSET 5""")
def lexicon_page(spark, sf_dir):
    return lexicon.browse(_lexicon(spark, sf_dir), "ring", offset=5)


@query(f"""WITH {LEXICON} SELECT pos, domain, count(*) AS entries, count(DISTINCT en) AS words, count(DISTINCT de) AS meanings FROM lex GROUP BY GROUPING SETS ((pos, domain), (pos), ())""")
def lexicon_counts(spark, sf_dir):
    return lexicon.counts(_lexicon(spark, sf_dir))


@query(f"""WITH {LEXICON}, asked AS (SELECT p_partkey AS word_id, lower(p_name) AS en, (['noun', 'verb', 'adv', 'adj'])[p_partkey % 4 + 1] AS pos FROM part),
t(pos, step, other) AS (VALUES ('noun', 0, 'noun'), ('noun', 1, 'name'), ('noun', 2, 'verb'), ('verb', 0, 'verb'), ('verb', 1, 'noun'), ('adj', 0, 'adj'), ('adj', 1, 'adv'), ('adj', 2, 'verb'), ('adv', 0, 'adv'), ('adv', 1, 'adj')),
first AS (SELECT lower(en) AS en, pos, arg_min(de, (CASE WHEN domain = 'it' THEN 0 ELSE 1 END, rank)) AS de FROM lex GROUP BY ALL)
SELECT word_id, f.en, f.pos, f.de, step FROM asked a JOIN t ON a.pos = t.pos JOIN first f ON f.en = a.en AND f.pos = t.other QUALIFY row_number() OVER (PARTITION BY word_id ORDER BY step) = 1""")
def lexicon_lookup(spark, sf_dir):
    pos = F.get(F.array(*map(F.lit, ("noun", "verb", "adv", "adj"))), (F.col("p_partkey") % 4).cast("int"))
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("word_id"), F.col("p_name").alias("en"), pos.alias("pos"))
    return lexicon.lookup(asked, _lexicon(spark, sf_dir), "it")


@query(f"""WITH p AS (SELECT DISTINCT ws[i] || ' ' || ws[i + 1] AS phrase, 2 AS size FROM (SELECT regexp_extract_all({_PLAIN.format('text')}, '{PATTERN}') AS ws FROM benchmark), range(1, len(ws)) r(i) UNION SELECT DISTINCT ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2], 3 FROM (SELECT regexp_extract_all({_PLAIN.format('text')}, '{PATTERN}') AS ws FROM benchmark), range(1, len(ws) - 1) r(i)),
d AS (SELECT doc_id, i - 1 AS pos, ws[i] || ' ' || ws[i + 1] AS two, CASE WHEN i + 2 <= len(ws) THEN ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS three FROM (SELECT doc_id, regexp_extract_all({_PLAIN.format('text')}, '{PATTERN}') AS ws FROM documents), range(1, len(ws)) r(i)),
m AS (SELECT doc_id, pos, 2 AS size, two AS phrase FROM d JOIN p ON two = phrase UNION ALL SELECT doc_id, pos, 3, three FROM d JOIN p ON three = phrase)
SELECT doc_id, pos, max(size) AS size, arg_max(phrase, size) AS phrase FROM m GROUP BY doc_id, pos""")
def longest_phrases(spark, sf_dir):
    words = T.tokens("text")
    runs = table(spark, sf_dir, "benchmark").select(F.explode(F.concat(T.word_ngrams(words, 2), T.word_ngrams(words, 3))).alias("phrase")).distinct()
    found = lexicon.longest_phrases(table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("pos", "word")), runs, 3)
    return found.withColumn("pos", F.col("pos").cast("long"))


@query("""WITH r AS (SELECT o_orderpriority AS en, o_orderstatus AS pos, 1 AS count, 1 AS texts, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'seen' END AS example, o_orderdate AS last_seen FROM orders)
SELECT en, pos, CAST(sum(count) AS BIGINT) AS count, CAST(sum(texts) AS BIGINT) AS texts, max(example) AS example, max(last_seen) AS last_seen FROM r GROUP BY en, pos""")
def unknown_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("en"), F.col("o_orderstatus").alias("pos"), F.lit(1).cast("long").alias("count"), F.lit(1).cast("long").alias("texts"), F.when(F.col("o_custkey") % 2 == 0, "").otherwise("seen").alias("example"), F.col("o_orderdate").alias("last_seen"), "o_orderkey")
    each = lambda keep: rows.filter(keep).groupBy("en", "pos").agg(F.sum("count").alias("count"), F.sum("texts").alias("texts"), F.max("example").alias("example"), F.max("last_seen").alias("last_seen"))
    return lexicon.unknown_words(each("o_orderkey % 3 = 0"), each("o_orderkey % 3 <> 0"))


# A word's own ending stands for its tag, and the word without a last s for its lemma.
_EXAMPLES = f"ex AS (SELECT DISTINCT form, CASE WHEN length(form) % 2 = 0 THEN 'A' ELSE 'B' END AS tag, regexp_replace(form, '(e?s|n)$', '') AS lemma FROM ({toks('text', 'benchmark')}) WHERE length(form) >= 4)"
_RULES = """ends AS (SELECT tag, length(form) - length(lemma) AS strip, '' AS add, substr(form, length(form) - n + 1) AS suffix FROM ex, range(1, 5) t(n) WHERE n <= length(form)),
rules AS (SELECT suffix, tag, strip, add, count(*) AS n FROM ends GROUP BY suffix, tag, strip, add HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY suffix, tag ORDER BY count(*) DESC, strip, add) = 1)"""


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens("text")).alias("form")).filter(F.length("form") >= 4).distinct()
    return words.select("form", F.when(F.length("form") % 2 == 0, "A").otherwise("B").alias("tag"), F.regexp_replace("form", "(e?s|n)$", "").alias("lemma"))


@query(f"WITH {_EXAMPLES}, {_RULES} SELECT suffix, tag, CAST(strip AS INTEGER) AS strip, add, n FROM rules")
def suffix_rules(spark, sf_dir):
    return lexicon.suffix_rules(_examples(spark, sf_dir))


@query(f"""WITH {_EXAMPLES}, {_RULES}, w AS (SELECT DISTINCT form, CASE WHEN length(form) % 2 = 0 THEN 'A' ELSE 'B' END AS tag FROM ({toks('text', 'documents')})),
e AS (SELECT form, tag, right(form, k) AS suffix FROM w, range(1, 5) t(k) WHERE k <= length(form)),
m AS (SELECT form, tag, strip, add FROM e JOIN rules USING (suffix, tag) WHERE strip <= length(form) QUALIFY row_number() OVER (PARTITION BY form, tag ORDER BY length(suffix) DESC) = 1)
SELECT form, tag, substr(form, 1, length(form) - coalesce(strip, 0)) || coalesce(add, '') AS lemma FROM w LEFT JOIN m USING (form, tag)""")
def suffix_lemmas(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.tokens("text")).alias("form")).distinct()
    return lexicon.lemmatize(words.withColumn("tag", F.when(F.length("form") % 2 == 0, "A").otherwise("B")), lexicon.suffix_rules(_examples(spark, sf_dir)))


@query("""SELECT l_returnflag AS language, l_linestatus AS kind, l_suppkey % 3 AS condition, count(*) AS trials, round(sum(l_linenumber) / sum(l_quantity), 6) AS wer, round(avg(CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 0 END), 6) AS exact, round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0 END), 6) AS reaction, round(sum(l_tax) / sum(l_discount + 1), 6) AS rtf
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_suppkey % 3), (l_linestatus, l_suppkey % 3))""")
def trial_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("language"), F.col("l_linestatus").alias("kind"), (F.col("l_suppkey") % 3).alias("condition"), F.col("l_linenumber").alias("errors"), F.col("l_quantity").alias("words"), (F.col("l_linenumber") == 1).alias("exact"), (F.col("l_quantity") > 25).alias("reacted"), F.col("l_tax").alias("seconds"), (F.col("l_discount") + 1).alias("audio"))
    return matching.trial_tally(rows).select("language", "kind", "condition", "trials", r6("wer"), r6("exact"), r6("reaction"), r6("rtf"))


@query(f"""WITH {INDEX}, q AS (SELECT DISTINCT item_id AS query_id, form AS lemma FROM ({toks('text', 'benchmark', 'item_id')}) WHERE {SIGNIFICANT}),
c AS (SELECT query_id, doc_id, lemma, round(weight, 9) AS weight, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(weight, 9) DESC, lemma DESC) AS n FROM q JOIN post USING (lemma))
SELECT query_id, doc_id, string_agg(lemma, ' ' ORDER BY n) FILTER (n <= 5) AS lemmas, round(sum(weight) FILTER (n <= 5), 6) AS total FROM c GROUP BY query_id, doc_id""")
def explained_hits(spark, sf_dir):
    vectors = search.query_vectors(_queries(spark, sf_dir))
    postings = _index(spark, sf_dir, vectors)[0].withColumn("weight", F.round("weight", 9))
    told = search.explain(vectors, postings)
    return told.select("query_id", "doc_id", F.array_join(F.transform("terms", lambda t: t["lemma"]), " ").alias("lemmas"), F.round(F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["value"]), 6).alias("total"))


@query("""WITH e AS (SELECT event_type AS method, count(*) AS total, count(*) FILTER (user_id % 3 > 0) AS correct, avg(value) AS mean_ms FROM events GROUP BY 1)
SELECT method, total, correct, total - correct AS errors, round(correct / total, 6) AS accuracy, round(mean_ms, 6) AS mean_ms, round(1000 / mean_ms, 6) AS per_second, round(mean_ms / min(mean_ms) OVER (), 6) AS slowdown FROM e""")
def method_speeds(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 3 > 0).alias("correct"), F.col("value").alias("ms"))
    return evaluation.speed(runs).select("method", "total", "correct", "errors", *map(r6, ("accuracy", "mean_ms", "per_second", "slowdown")))


@query("SELECT event_type AS method, round(avg(value), 6) AS confidence FROM events GROUP BY 1")
def mean_confidences(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.col("value").alias("confidence"))
    return evaluation.mean_confidence(rows).select("method", r6("confidence"))


_TEXTS = ORACLES["sentence_scores"].rsplit("SELECT doc_id, idx", 1)[0]


@query(f"""{_TEXTS.rstrip()}, x AS (SELECT doc_id, idx, lines.text AS text, score * pos_doc * pos_par AS weight FROM sc JOIN lines USING (doc_id, idx)),
k AS (SELECT 'extraction' AS method, *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, idx) AS n FROM x UNION ALL SELECT 'lead', *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) FROM x),
c AS (SELECT method, size, doc_id, w, count(*) AS n FROM (SELECT method, size, doc_id, unnest(regexp_extract_all({_PLAIN.format('text')}, '{PATTERN}')) AS w FROM k, (VALUES (3), (5), (10)) s(size) WHERE n <= size) GROUP BY ALL),
r AS (SELECT doc_id, unnest(regexp_extract_all({_PLAIN.format('text')}, '{PATTERN}')) AS w FROM documents WHERE doc_id % 2 = 0), m AS (SELECT doc_id, w, count(*) AS m FROM r GROUP BY ALL), z AS (SELECT doc_id, count(*) AS size_of FROM r GROUP BY ALL),
h AS (SELECT method, size, doc_id, sum(least(n, m)) AS hits FROM c JOIN m USING (doc_id, w) GROUP BY ALL), e AS (SELECT DISTINCT method, size, doc_id FROM k, (VALUES (3), (5), (10)) s(size) WHERE n <= size)
SELECT method, size, count(*) AS documents, round(avg(coalesce(hits, 0) / size_of), 6) AS r1 FROM e JOIN z USING (doc_id) LEFT JOIN h USING (method, size, doc_id) GROUP BY ALL""")
def summary_sizes(spark, sf_dir):
    references = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", T.tokens("text").alias("words"))
    return evaluation.by_size(_scores(spark, sf_dir), references, (3, 5, 10)).select("method", "size", "documents", r6("r1"))


@query("""WITH t AS (SELECT p_type AS lemma, p_size % 3 AS pos, p_name AS form, p_brand AS tag, CASE WHEN p_size % 2 = 0 THEN p_name END AS german FROM part),
f AS (SELECT lemma, pos, form, count(*) AS n FROM t GROUP BY ALL), g AS (SELECT lemma, pos, german, count(*) AS n FROM t WHERE german IS NOT NULL GROUP BY ALL)
SELECT lemma, pos, count(*) AS n, (SELECT string_agg(form || ':' || f.n, ' ' ORDER BY f.n DESC, form) FROM f WHERE f.lemma = t.lemma AND f.pos = t.pos) AS forms, count(DISTINCT tag) AS tags, (SELECT string_agg(german || ':' || g.n, ' ' ORDER BY g.n DESC, german) FROM g WHERE g.lemma = t.lemma AND g.pos = t.pos) AS translations FROM t GROUP BY lemma, pos""")
def word_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("lemma"), (F.col("p_size") % 3).alias("pos"), F.col("p_name").alias("form"), F.col("p_brand").alias("tag"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("german"))
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["value"], s["n"].cast("string"))), " ").alias(c)
    return evaluation.word_list(rows).select("lemma", "pos", "n", flat("forms"), F.size("tags").cast("long").alias("tags"), flat("translations"))


_STATUS = f"CASE WHEN regexp_full_match(form, '[0-9]+') THEN 'number' WHEN known THEN 'dict' WHEN regexp_matches(form, '(tion|ment|ed)$') THEN 'rule' WHEN length(form) = 1 THEN 'name' ELSE 'unknown' END"


@query(f"""WITH v AS (SELECT DISTINCT form FROM ({toks('text', 'benchmark')})), w AS (SELECT doc_id, {_STATUS} AS status FROM (SELECT d.doc_id, d.form, v.form IS NOT NULL AS known FROM ({toks('text', 'documents', 'doc_id')}) d LEFT JOIN v USING (form))),
c AS (SELECT doc_id, count(*) AS words, count(*) FILTER (status = 'dict') AS dictionary, count(*) FILTER (status = 'rule') AS rule, count(*) FILTER (status = 'name') AS names, count(*) FILTER (status = 'number') AS numbers, count(*) FILTER (status = 'unknown') AS unknown FROM w GROUP BY doc_id)
SELECT *, round(coalesce((dictionary + rule) / nullif(words - names - numbers, 0), 1), 6) AS coverage FROM c""")
def lexicon_coverage(spark, sf_dir):
    known = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens("text")).alias("form")).distinct().withColumn("known", F.lit(True))
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens("text")).alias("form")).join(known, "form", "left")
    form = F.col("form")
    status = F.when(form.rlike("^[0-9]+$"), "number").when(F.col("known"), "dict").when(form.rlike("(tion|ment|ed)$"), "rule").when(F.length(form) == 1, "name").otherwise("unknown")
    return evaluation.coverage(words.select("doc_id", status.alias("status")), "doc_id").withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {TF}, k AS (SELECT doc_id, lemma FROM tf QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(lemma) DESC, lemma) <= 10), f AS (SELECT doc_id, lemma FROM tf JOIN (SELECT doc_id, count(*) AS size FROM k GROUP BY doc_id) USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, lemma) <= size),
r AS (SELECT DISTINCT doc_id, form AS lemma FROM ({toks("split_part(text, '.', 1)", 'documents', 'doc_id')}))
SELECT doc_id, round(count(r.lemma) / count(*), 6) AS precision, round(any_value(p), 6) AS precision_tf FROM k LEFT JOIN r USING (doc_id, lemma) JOIN (SELECT doc_id, count(r.lemma) / count(*) AS p FROM f LEFT JOIN r USING (doc_id, lemma) GROUP BY doc_id) USING (doc_id) GROUP BY doc_id""")
def keyword_precision(spark, sf_dir):
    """Words of the first sentence stand in for a reference, a document's longest words for its keywords."""
    texts = table(spark, sf_dir, "documents").filter("doc_id is not null").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    every = lambda part: F.flatten(F.transform("texts", lambda t: T.tokens(part(t))))
    words = texts.select("doc_id", F.filter(every(lambda t: t), lambda w: T.is_significant(w)).alias("words"), every(lambda t: F.substring_index(t, ".", 1)).alias("reference"))
    longest = F.array_sort(F.transform(F.array_distinct("words"), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    docs = words.withColumn("keywords", F.transform(F.slice(longest, 1, 10), lambda x: x["w"]))
    return evaluation.keyword_scores(docs).select("doc_id", r6("precision"), r6("precision_tf"))


_CLOSE = "CASE WHEN prefix >= 4 AND prefix >= 0.6 * least(length(a), length(b)) THEN greatest(1 - levenshtein(a, b) / greatest(length(a), length(b)), 0.75) ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END"


@query(f"""WITH n AS (SELECT n_name AS name, regexp_extract_all(lower(n_name), '[a-z]+') AS ws FROM nation), p AS (SELECT item_id AS phrase_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ws FROM benchmark),
w AS (SELECT phrase_id, name, len(n.ws) AS k, unnest(n.ws) AS a, p.ws AS others FROM p, n), o AS (SELECT phrase_id, name, k, a, unnest(others) AS b FROM w),
s AS (SELECT *, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, 1, CAST(i AS INTEGER)) = substr(b, 1, CAST(i AS INTEGER)))) AS prefix FROM o), m AS (SELECT phrase_id, name, k, a, max({_CLOSE}) AS c FROM s GROUP BY ALL),
f AS (SELECT phrase_id, name, round(avg(c) + 0.05 * (any_value(k) - 1), 9) AS score FROM m GROUP BY ALL HAVING min(c) >= 0.6)
SELECT phrase_id, name, score FROM f QUALIFY row_number() OVER (PARTITION BY phrase_id ORDER BY score DESC, name) = 1""")
def named_nations(spark, sf_dir):
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    aliases = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), words("n_name").alias("words"))
    return evaluation.named(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), words("text").alias("words")), aliases)


_LATIN = "lower(word)"
for _a, _b in T.LATIN.items():
    _LATIN = f"replace({_LATIN}, '{_a}', '{_b}')"
_LATIN = f"translate({_LATIN}, '{T.LATIN_ONE[0]}ъь', '{T.LATIN_ONE[1]}')"


@query(f"""WITH c AS (SELECT lang, form AS word, count(*) AS n FROM ({toks('text', 'documents', 'lang')}) WHERE lang IS NOT NULL AND length(form) >= 5 GROUP BY ALL), s AS (SELECT *, {_LATIN} AS shown FROM c)
SELECT lang, word, shown, n FROM s WHERE n >= 2 AND (SELECT count(DISTINCT lang) FROM s x WHERE x.shown = s.shown) = 1""")
def distinct_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").filter("lang is not null").select("lang", F.explode(T.tokens("text")).alias("word")).filter(F.length("word") >= 5)
    return evaluation.distinct_across(words, T.latinize("word"))


@query("""WITH p AS (SELECT DISTINCT p_brand AS doc_id, p_name AS phrase, string_split(p_name, ' ') AS terms FROM part UNION SELECT DISTINCT p_brand, split_part(p_name, ' ', 1), [split_part(p_name, ' ', 1)] FROM part UNION SELECT DISTINCT p_brand, p_name || ' x', string_split(p_name || ' x', ' ') FROM part WHERE p_size % 2 = 0)
SELECT a.doc_id, a.phrase, arg_min(b.phrase, (-len(b.terms), b.phrase)) AS parent FROM p a LEFT JOIN p b ON a.doc_id = b.doc_id AND len(b.terms) < len(a.terms) AND list_has_all(a.terms, b.terms) GROUP BY ALL""")
def nested_phrases(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    names = [F.col("p_name"), F.split("p_name", " ")[0], F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" x")))]
    rows = parts.select(F.col("p_brand").alias("doc_id"), F.explode(F.array(*names)).alias("phrase")).filter("phrase is not null").distinct()
    return evaluation.nested(rows.select("doc_id", "phrase", F.split("phrase", " ").alias("terms"), F.lit(1.0).alias("weight"))).select("doc_id", "phrase", "parent")


@query("""WITH p AS (SELECT conv_id AS doc_id, turn AS par, length(text) % 60 AS chars, length(text) % 3 AS sentences, length(text) % 7 = 0 AS border FROM conversations),
m AS (SELECT a.doc_id, a.par AS first, b.par AS last, sum(c.chars) + count(*) - 1 AS chars, sum(c.sentences) AS s, bool_or(c.border) AS bad, count(*) AS n FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.par <= b.par JOIN p c ON c.doc_id = a.doc_id AND c.par BETWEEN a.par AND b.par GROUP BY ALL)
SELECT doc_id, first, last, CAST(chars AS BIGINT) AS chars FROM m WHERE NOT bad AND chars BETWEEN 40 AND 90 AND s >= 2""")
def passages(spark, sf_dir):
    """Turns of a conversation stand in for paragraphs; borders and sizes follow from their lengths."""
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("par"), (n % 60).alias("chars"), (n % 3).alias("sentences"), (n % 7 == 0).alias("border"))
    return evaluation.passages(rows, 40, 90, 2)


@query("""WITH t(operation, number, text) AS (VALUES ('open', 0, 'open …'), ('open', 1, 'show me …'), ('open', 2, '… please'), ('stop', 0, 'stop'), ('stop', 1, 'be quiet')),
v AS (SELECT 'open' AS operation, n_nationkey AS place, lower(n_name) AS value FROM nation)
SELECT operation, number, text AS phrase FROM t WHERE operation = 'stop' UNION ALL SELECT operation, number, replace(text, '…', value) FROM t JOIN v USING (operation) WHERE number = 0 OR place % 3 = number""")
def filled_templates(spark, sf_dir):
    rows = [("open", 0, "open …"), ("open", 1, "show me …"), ("open", 2, "… please"), ("stop", 0, "stop"), ("stop", 1, "be quiet")]
    templates = spark.createDataFrame(rows, "operation string, number int, text string")
    values = table(spark, sf_dir, "nation").select(F.lit("open").alias("operation"), F.col("n_nationkey").alias("place"), F.lower("n_name").alias("value"))
    return evaluation.filled(templates, values)


@query("""WITH s AS (SELECT DISTINCT source AS root_path, 'old' AS label FROM documents WHERE source IS NOT NULL), u AS (SELECT DISTINCT source AS root_path, upper(source) AS label FROM documents WHERE source IS NOT NULL AND length(source) % 2 = 0)
SELECT root_path, coalesce(u.label, s.label) AS label, (SELECT count(*) FROM documents d WHERE d.source || '/' || d.doc_id LIKE root_path || '/%') AS documents FROM s LEFT JOIN u USING (root_path)""")
def source_registry(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("source is not null")
    roots = docs.select(F.col("source").alias("root_path")).distinct()
    named = tables.upsert(roots.withColumn("label", F.lit("old")), roots.filter(F.length("root_path") % 2 == 0).withColumn("label", F.upper("root_path")), "root_path")
    return tables.under_roots(named, docs.select(F.concat_ws("/", "source", "doc_id").alias("path")))


def written(spark: SparkSession, write: Callable[[str], None]) -> str:
    """A new folder that driver and executors share, with what `write` puts there; spark.checkpoint.dir, or in local mode
    a temporary one."""
    shared, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not shared and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{shared.rstrip('/') if shared else tempfile.mkdtemp(prefix='spark-')}/textlake-{uuid.uuid4().hex}"
    write(path)
    return path


@query("SELECT CAST(d.doc_id % 40 AS INTEGER) AS query_id, d.doc_id, CAST(quality + toxic AS INTEGER) AS rel FROM labels d JOIN documents USING (doc_id)")
def qrels_file(spark, sf_dir):
    """Judgements written as CSV and read back, their slugs resolved by the documents' paths."""
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("query_id"), F.concat(F.lit("d"), "doc_id").alias("doc_slug"), (F.col("quality") + F.col("toxic")).alias("rel"))
    path = written(spark, lambda path: files.save_csv(rows, path, "query_id", "doc_slug"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/docs/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return files.qrels(spark, path, docs)[0]


@query(f"SELECT item_id AS sent_id, array_to_string(regexp_extract_all(text, '{PATTERN}'), ' ') AS forms, len(regexp_extract_all(text, '{PATTERN}')) AS words FROM benchmark")
def treebank_file(spark, sf_dir):
    """Sentences written in ten columns and read back."""
    words = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    token = lambda w, i: F.struct((i + 1).alias("id"), w.alias("form"), F.lower(w).alias("lemma"), F.lit("X").alias("upos"), F.lit("_").alias("xpos"), F.lit("_").alias("feats"), i.alias("head"), F.lit("dep").alias("deprel"), F.lit(True).alias("space_after"))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("sent_id"), F.regexp_replace("text", r"\s+", " ").alias("text"), F.transform(words, token).alias("tokens"))
    read = files.conllu(spark, written(spark, lambda path: files.to_conllu(rows).write.text(path)))
    return read.select(F.col("sent_id").cast("long").alias("sent_id"), F.array_join(F.transform("tokens", lambda t: t["form"]), " ").alias("forms"), F.size("tokens").cast("long").alias("words"))


@query("""SELECT p_name AS key, 'de ' || p_brand AS de, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT lower(p_type), 'andere', count(*) FROM part GROUP BY ALL""")
def dictionary_file(spark, sf_dir):
    """Dictionary lines of two senses each, written and read back."""
    parts = table(spark, sf_dir, "part")
    line = F.concat(F.lit("de "), "p_brand", F.lit(" | andere :: to "), "p_name", F.lit(" (x) | "), "p_type")
    path = written(spark, lambda path: parts.select(line.alias("value")).write.text(path))
    return files.dictionary(spark.read.text(path)).groupBy("key", "de").agg(F.count("*").alias("n"))
