"""Registered queries of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import reports
from textlake.plans import studies  # noqa: F401  (registers copied_shares)
from textlake.plans.queries import LETTERS_SQL, NGRAMS_SQL, ORACLES, PATTERN, QUERIES, SIGNIFICANT, _profile_sql, _profiles, query, r6, table

_OVERLAP = """SELECT owner, lang, found, n - found AS missing, round(found / n, 6) AS share, round(coverage, 6) AS coverage
FROM (SELECT d.owner, l.owner AS lang, count(*) AS found, sum(d.n) / round(max(d.n / d.weight)) AS coverage FROM d JOIN l USING (feature) WHERE l.weight >= {least} GROUP BY ALL) JOIN (SELECT owner, count(*) AS n FROM d GROUP BY owner) USING (owner)"""


@query(f"WITH {_profile_sql(LETTERS_SQL, 'doc_id', None, 'd')}, {_profile_sql(LETTERS_SQL, 'lang', None, 'l')} {_OVERLAP.format(least='1e-4')}")
def alphabet_coverage(spark, sf_dir):
    found = reports.profile_overlap(_profiles(spark, sf_dir, "alphabet", "doc_id", None), _profiles(spark, sf_dir, "alphabet", "lang", None), 1e-4)
    return found.select("owner", "lang", "found", "missing", r6("share"), r6("coverage"))


@query(f"WITH {_profile_sql(NGRAMS_SQL, 'doc_id', 300, 'd')}, {_profile_sql(NGRAMS_SQL, 'lang', 300, 'l')} {_OVERLAP.format(least='0')}")
def ngram_overlap(spark, sf_dir):
    found = reports.profile_overlap(_profiles(spark, sf_dir, "ngram", "doc_id", 300), _profiles(spark, sf_dir, "ngram", "lang", 300))
    return found.select("owner", "lang", "found", "missing", r6("share"), r6("coverage"))


@query(rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, text, list_filter(list_transform(CASE WHEN regexp_matches(text, '\n\s*\n') THEN regexp_split_to_array(text, '\n\s*\n') ELSE string_split(text, chr(10)) END, lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '') AS ps FROM t)
SELECT doc_id, CAST(len(ps) AS BIGINT) AS paragraphs, CAST(coalesce(list_sum(list_transform(ps, lambda p: len(list_filter(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')))), 0) AS BIGINT) AS sentences,
CAST(len(regexp_extract_all(translate(lower(text), 'ё', 'е'), '{PATTERN}')) AS BIGINT) AS words, length(text) AS chars FROM b""")
def document_sizes(spark, sf_dir):
    return reports.sizes(table(spark, sf_dir, "documents"))


@query(f"""WITH w AS (SELECT lang, unnest(regexp_extract_all(translate(lower(text), 'ё', 'е'), '{PATTERN}')) AS form FROM documents WHERE lang IS NOT NULL), c AS (SELECT lang, form AS word, count(*) AS n FROM w WHERE {SIGNIFICANT} GROUP BY ALL HAVING count(*) >= 2)
SELECT * FROM (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 1500""")
def frequent_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").filter("lang is not null").select("lang", F.explode(T.tokens("text")).alias("word"))
    return reports.frequent_words(words.filter(T.is_significant(F.col("word"))), "lang").withColumn("rank", F.col("rank").cast("long"))


@query(r"""SELECT conv_id, turn, round(coalesce(len(list_filter(p, lambda t: regexp_matches(t, '[0-9%&§€$+=<>#@]'))) / nullif(len(p), 0), 0), 6) AS leftover
FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS p FROM conversations)""")
def leftover_signs(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(reports.leftover_share("text"), 6).alias("leftover"))


@query(f"SELECT count(*) FILTER (copied - shared > 0.0050001) AS wins, count(*) FILTER (copied - shared < -0.0050001) AS losses, count(*) FILTER (abs(copied - shared) <= 0.0050001) AS ties FROM ({ORACLES['copied_shares']})")
def copied_or_shared(spark, sf_dir):
    return reports.head_to_head(QUERIES["copied_shares"](spark, sf_dir), "copied", "shared", 0.0050001)
