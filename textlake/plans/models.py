"""Registered queries of stored models and of query analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.operators import index, models, queryanalysis, suggest
from textlake.plans.evaluation import written
from textlake.plans.queries import NGRAMS_SQL, PATTERN, SIGNIFICANT, _profile_sql, _profiles, query, r6, table, toks


@query(f"WITH {_profile_sql(NGRAMS_SQL, 'lang', 300, 'p')} SELECT owner, feature, n, rank, round(weight, 6) AS weight FROM p")
def stored_profiles(spark, sf_dir):
    """Profiles of the documents' languages, stored twice as a model and read back in their first version."""
    def save(path: str) -> None:
        profiles = _profiles(spark, sf_dir, "ngram", "lang", 300)
        models.save_profiles(profiles, path)
        models.save_profiles(profiles.filter("rank < 5"), path)

    found = models.load_profiles(spark, written(spark, save), 1)
    return found.select("owner", "feature", "n", F.col("rank").cast("long").alias("rank"), r6("weight"))


@query(f"""WITH t AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, regexp_extract_all(translate(lower(text), 'ё', 'е'), '{PATTERN}') AS ws FROM benchmark)),
l AS (SELECT form, count(*) AS n FROM ({toks('text', 'documents')}) WHERE {SIGNIFICANT} GROUP BY form), k AS (SELECT form FROM l WHERE n >= 20), s AS (SELECT form AS word FROM l ORDER BY n DESC, form LIMIT 10),
m AS (SELECT item_id, i, w, w IN (SELECT word FROM s) AS stopped, w IN (SELECT form FROM k) AS known FROM t)
SELECT item_id AS query_id, CAST(count(*) AS BIGINT) AS tokens, CAST(count(*) FILTER (stopped) AS BIGINT) AS stop_words, CAST(count(DISTINCT w) FILTER (NOT stopped AND length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+')) AS BIGINT) AS lemmas,
coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT stopped AND NOT known AND length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+')), '') AS unknown FROM m GROUP BY item_id""")
def analyzed_queries(spark, sf_dir):
    """How every benchmark item is understood as a query, against the documents' words seen twenty times or more."""
    forms = index.form_vocabulary(table(spark, sf_dir, "documents"))
    known = forms.filter("freq >= 20")
    stop = forms.orderBy(F.desc("freq"), "form").limit(10).select(F.col("form").alias("word"))
    groups = known.orderBy(F.desc("freq"), "form").limit(40).agg(F.array_sort(F.collect_list("form")).alias("words"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    done = queryanalysis.analyze(queries, known.select(F.col("form").alias("lemma")), known, stop, suggest.thesaurus(groups))
    size = lambda c: F.size(c).cast("long").alias(c)
    return done.select("query_id", size("tokens"), size("stop_words"), size("lemmas"), F.array_join("unknown", " ").alias("unknown"))
