"""Registered queries of sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import segments
from textlake.plans.queries import query, table

_SHORT = {k: str(tuple(v)).replace("'", "''").replace("''", "'") for k, v in segments.ABBREVIATIONS.items()}
_HELD = " OR ".join(f"(lang = '{k}' AND word IN {_SHORT[k]})" for k in ("de", "en", "fr", "es"))
_CLOSERS = "»“”\"'')\\]’"
_OPENERS = "«„“\"''(\\[—–-"


@query(rf"""WITH d AS (SELECT doc_id, lang, string_split(regexp_replace(text, '([.!?…]+[{_CLOSERS}]*)(\s+)((?:[{_OPENERS}][ {_OPENERS}]*)?[\p{{Lu}}\p{{Nd}}])', '\1\2' || chr(1) || '\3', 'g'), chr(1)) AS ps FROM documents WHERE lang IN ('de', 'en', 'fr', 'es') AND text IS NOT NULL),
p AS (SELECT doc_id, lang, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM d),
k AS (SELECT *, lower(regexp_replace(regexp_extract(p, '(?:^|\s)(\S*[^\s.!?…])\.[{_CLOSERS}]*\s*$', 1), '^[«„"''(\[]+', '')) AS word FROM p),
h AS (SELECT doc_id, i, p, (regexp_full_match(replace(replace(word, '.', ''), '-', ''), '\p{{L}}') OR regexp_full_match(word, '\p{{L}}{{1,3}}(\.\p{{L}}{{1,3}})+') OR {_HELD} OR (lang = 'de' AND regexp_full_match(word, '\d{{1,2}}')) OR regexp_full_match(trim(p), '(\d{{1,3}}(\.\d{{1,3}})*|[IVXLC]{{1,6}})\.')) AS kept FROM k),
g AS (SELECT doc_id, i, p, sum(CASE WHEN prior THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (SELECT *, coalesce(lag(kept) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS prior FROM h)),
t AS (SELECT doc_id, s, regexp_replace(regexp_replace(string_agg(p, '' ORDER BY i), '^\s+', ''), '\s+$', '') AS text FROM g GROUP BY ALL)
SELECT doc_id, count(*) AS sentences, sha256(string_agg(text, chr(10) ORDER BY s)) AS digest FROM t WHERE text <> '' GROUP BY doc_id""")
def language_sentences(spark, sf_dir):
    """Sentences of every document by the rules of its language."""
    docs = table(spark, sf_dir, "documents").filter("lang IN ('de', 'en', 'fr', 'es') AND text IS NOT NULL")
    cut = F.coalesce(*(F.when(F.col("lang") == k, segments.prose(F.col("text"), k)) for k in ("de", "en", "fr", "es")))
    rows = docs.select("doc_id", F.transform(cut, lambda s: s["text"]).alias("s")).filter(F.size("s") > 0)
    return rows.select("doc_id", F.size("s").cast("long").alias("sentences"), F.sha2(F.array_join("s", "\n"), 256).alias("digest"))
