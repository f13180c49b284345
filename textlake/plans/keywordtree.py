"""Registered queries of keyword trees, stems and phrases. The tables' German knows no capitals within sentences: small
words whose letters are a multiple of three have one here, so that there are nouns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions.stems import german
from textlake.operators import keywordtree
from textlake.operators.keywordtree import PREFIXES, WORD
from textlake.plans.queries import query, table
from textlake.session import cut

PIECE = rf"{WORD}|[^\s\p{{L}}]+"
WORDS_SQL = rf"""s AS (SELECT doc_id, generate_subscripts(ps, 1) AS part, unnest(ps) AS p FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?\n]+') AS ps FROM documents WHERE lang = 'de' AND text IS NOT NULL)),
c AS (SELECT doc_id, part, list_transform(regexp_extract_all(p, '{WORD.replace("'", "''")}|[^\s\p{{L}}]+'), lambda x: CASE WHEN length(x) % 3 = 0 AND regexp_matches(x, '^[a-zäöü]') THEN upper(x[1]) || lower(substr(x, 2)) ELSE x END) AS ps FROM s),
e AS (SELECT doc_id, part, i AS pos, ps[i] AS surface, i > 1 AND regexp_matches(coalesce(ps[i - 1], ''), '^\p{{L}}') AS adjacent FROM c, range(1, len(ps) + 1) t(i)),
w AS (SELECT *, pos = min(pos) OVER (PARTITION BY doc_id, part) AS initial, regexp_matches(surface, '^\p{{Lu}}') AS large FROM e WHERE regexp_matches(surface, '^\p{{L}}'))"""
COMPOUND_SQL = f"(length({{h}}) >= 4 AND {{t}} <> {{h}} AND (starts_with({{t}}, {{h}}) OR contains({{t}}, '-' || {{h}}) OR (ends_with({{t}}, {{h}}) AND length(regexp_replace(substr({{t}}, 1, length({{t}}) - length({{h}})), '[s-]+$', '')) >= 3 AND regexp_replace(substr({{t}}, 1, length({{t}}) - length({{h}})), '[s-]+$', '') NOT IN {PREFIXES})))"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").filter("lang = 'de' AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("part", "p"))
    pieces = F.transform(F.regexp_extract_all("p", F.lit(PIECE), F.lit(0)), lambda x: F.when((F.length(x) % 3 == 0) & x.rlike("^[a-zäöü]"), F.initcap(x)).otherwise(x))
    return keywordtree.words(parts.select("doc_id", "part", F.array_join(pieces, " ").alias("text"), F.lit(False).alias("heading")))


@query(rf"""WITH {WORDS_SQL},
k AS (SELECT *, lower(surface) AS low, regexp_full_match(surface, '[A-Za-zÄÖÜäöüßÀ-ÖØ-öø-ÿ''’‐-]+') AND length(surface) > 1 AS counted FROM w),
n AS (SELECT k.*, coalesce(b.low, k.low) AS term FROM k LEFT JOIN (SELECT DISTINCT doc_id, surface, low FROM k WHERE counted) b ON k.counted AND regexp_full_match(k.surface, '\p{{Lu}}.{{2,}}s') AND b.doc_id = k.doc_id AND b.surface = substr(k.surface, 1, length(k.surface) - 1)),
u AS (SELECT doc_id, term, count(*) FILTER (counted AND NOT initial AND large) AS l, count(*) FILTER (counted AND NOT initial AND NOT large) AS m FROM n GROUP BY ALL),
g AS (SELECT n.*, l > 0 AND l >= m AS noun_term, counted AND large AND l > 0 AND l >= m AS noun, NOT large AND length(surface) > 4 AND regexp_matches(low, '(en|er|es|em|e)$') AS adjective FROM n JOIN u USING (doc_id, term)),
fm AS (SELECT doc_id, term, noun_term, surface, large, count(*) AS c FROM g WHERE counted GROUP BY ALL),
tf AS (SELECT doc_id, term, noun_term, sum(c) AS tf, first(surface ORDER BY large <> noun_term, c DESC, length(surface), surface) AS s FROM fm GROUP BY ALL),
t AS (SELECT tf.*, CASE WHEN noun_term THEN s ELSE lower(s) END AS shown, ln((SELECT count(DISTINCT doc_id) FROM w) / df) AS idf FROM tf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term)),
hl AS (SELECT doc_id, list([{{'w': tf * idf, 't': term, 's': shown, 'f': tf}}] ORDER BY -(tf * idf), term) AS xs FROM t WHERE noun_term AND tf * idf > 0 GROUP BY doc_id),
hc AS (SELECT doc_id, list_reduce(list_prepend([], xs), lambda a, x: CASE WHEN len(a) < 10 AND len(list_filter(a, lambda h: {COMPOUND_SQL.format(t='x[1].t', h='h.t')})) = 0 THEN list_concat(a, x) ELSE a END) AS hs FROM hl),
h AS (SELECT doc_id, unnest(hs) AS h FROM hc),
pr AS (SELECT *, lag(term) OVER o AS bt, lag(surface) OVER o AS bs, lag(counted AND adjective) OVER o AS ba FROM g WINDOW o AS (PARTITION BY doc_id, part ORDER BY pos)),
pf AS (SELECT pr.doc_id, [bt, pr.term] AS terms, CASE WHEN regexp_matches(lower(bs), '^.{{3,}}(en|er|es|em)$') THEN substr(lower(bs), 1, length(bs) - 2) || 'e' ELSE lower(bs) END || ' ' || shown AS form, count(*) AS c FROM pr JOIN t ON t.doc_id = pr.doc_id AND t.term = pr.term WHERE adjacent AND noun AND ba GROUP BY ALL),
pp AS (SELECT doc_id, terms, sum(c) AS freq, first(form ORDER BY c DESC, form) AS text FROM pf GROUP BY ALL HAVING sum(c) >= 2),
pm AS (SELECT p.doc_id, p.terms, text, 'phrase' AS kind, freq, freq * ((coalesce(a.idf, 0) + coalesce(b.idf, 0)) / 2) AS weight FROM pp p LEFT JOIN t a ON a.doc_id = p.doc_id AND a.term = terms[1] LEFT JOIN t b ON b.doc_id = p.doc_id AND b.term = terms[2] WHERE coalesce(a.idf, 0) + coalesce(b.idf, 0) > 0),
cm AS (SELECT DISTINCT t.doc_id, [t.term] AS terms, t.shown AS text, 'compound' AS kind, t.tf AS freq, t.tf * t.idf AS weight FROM t JOIN h ON h.doc_id = t.doc_id WHERE noun_term AND t.tf >= 2 AND t.tf * t.idf > 0 AND {COMPOUND_SQL.format(t='t.term', h='h.h.t')} AND NOT EXISTS (SELECT 1 FROM h x WHERE x.doc_id = t.doc_id AND x.h.t = t.term)),
al AS (SELECT * FROM pm UNION ALL SELECT * FROM cm),
an AS (SELECT al.doc_id, terms, text, kind, freq, weight, first(h.h.s ORDER BY h.h.w DESC, h.h.s DESC) FILTER (len(list_filter(terms, lambda q: q = h.h.t OR {COMPOUND_SQL.format(t='q', h='h.h.t')})) > 0) AS head FROM al LEFT JOIN h ON h.doc_id = al.doc_id GROUP BY al.doc_id, terms, text, kind, freq, weight),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, head ORDER BY weight DESC, text) AS r FROM an)
SELECT doc_id, NULL AS head, h.s AS text, 'word' AS kind, CAST(h.f AS BIGINT) AS freq, round(h.w, 6) AS weight FROM h
UNION ALL SELECT doc_id, head, text, CASE WHEN head IS NULL THEN 'loose' ELSE kind END, CAST(freq AS BIGINT), round(weight, 6) FROM rk WHERE r <= CASE WHEN head IS NULL THEN 5 ELSE 4 END""")
def keyword_tree(spark, sf_dir):
    """Keyword trees of all German documents; terms are words in small letters, which SQL can tell too."""
    rows = cut(keywordtree.german_words(_words(spark, sf_dir), stem=F.lower))  # terms and phrases read them
    found = cut(keywordtree.terms(rows))  # heads, phrases, compounds and weights read them
    done = keywordtree.tree(found, keywordtree.heads(found), keywordtree.german_phrases(rows, found))
    return done.select("doc_id", "head", "text", "kind", "freq", F.round("weight", 6).alias("weight"))


@query()
def german_stems(spark, sf_dir):
    """Stems of all different words of the German documents."""
    words = _words(spark, sf_dir).select(F.lower("surface").alias("word")).distinct()
    return words.select("word", german(F.col("word")).alias("stem"))
