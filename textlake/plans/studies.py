"""More registered queries: studies, finds, readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import index, langprofiles, mlp, search, studies
from textlake.plans.queries import INDEX, LETTERS_SQL, PATTERN, SIGNIFICANT, WORD_PAIRS, _documents, _index, _profile_sql, _profiles, _queries, _word_pairs, query, r6, table, toks

CONFIGURATIONS = {"base": search.Modifiers(), "strict": search.Modifiers(strict=True), "flat": search.Modifiers(flat_idf=True), "short": search.Modifiers(short_bonus=True)}


@query()
def search_configurations(spark, sf_dir):
    vectors = search.query_vectors(_queries(spark, sf_dir))
    postings, documents = _index(spark, sf_dir, vectors)
    judged = table(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("query_id"), "doc_id", (F.col("quality") + F.col("toxic")).alias("rel"))
    found = studies.compare_searches(vectors, postings, _documents(spark, sf_dir, documents), judged, CONFIGURATIONS)
    return found.select("configuration", "queries", *map(r6, ("precision", "recall", "ap", "ndcg", "bpref")))


_MIXED = "trim(regexp_replace(lower(trim(concat_ws(' ', substr(a, 1, 400 - 20 * step), substr(b, 1, 20 * step)))), '[^\\p{L}]+', ' ', 'g'))"


@query(f"""WITH {_profile_sql(LETTERS_SQL, 'lang', None, 'l')}, a AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, text AS a FROM documents WHERE lang = 'en'), b AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, text AS b FROM documents WHERE lang = 'de'),
c AS (SELECT i, step, feature, count(*) AS n FROM (SELECT i, CAST(step AS INTEGER) AS step, unnest(string_split(replace({_MIXED}, ' ', ''), '')) AS feature FROM a JOIN b USING (i), (SELECT CAST(unnest(range(0, 21)) AS INTEGER) AS step)) WHERE feature <> '' GROUP BY ALL),
w AS (SELECT i, step, feature, n / sum(n) OVER (PARTITION BY i, step) AS weight FROM c), m AS (SELECT i, step, l.owner AS lang, sum(least(w.weight, l.weight)) AS common FROM w JOIN l USING (feature) GROUP BY ALL),
d AS (SELECT o.i, o.step, g.lang, 1 - coalesce(common, 0) AS distance FROM (SELECT DISTINCT i, step FROM w) o CROSS JOIN (SELECT DISTINCT owner AS lang FROM l) g LEFT JOIN m ON m.i = o.i AND m.step = o.step AND m.lang = g.lang),
t AS (SELECT step, lang AS predicted FROM d QUALIFY row_number() OVER (PARTITION BY i, step ORDER BY distance, lang) = 1)
SELECT step / 20 AS ratio, count(*) AS pairs, round(avg(CASE WHEN predicted = 'de' THEN 1.0 ELSE 0 END), 6) AS share FROM t GROUP BY step""")
def language_mixtures(spark, sf_dir):
    languages = _profiles(spark, sf_dir, "alphabet", "lang", None)
    found = studies.mixture_study(table(spark, sf_dir, "documents"), "en", "de", languages)
    return found.select("ratio", "pairs", r6("share"))


@query(r"""WITH w AS (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')), ' ') AS x FROM documents)),
p AS (SELECT doc_id, word, pos, CAST(floor(coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 200) AS BIGINT) AS k FROM w WHERE word <> '')
SELECT doc_id, k AS window_no, string_agg(word, ' ' ORDER BY pos) AS text FROM p WHERE k < 5 GROUP BY ALL HAVING length(string_agg(word, ' ' ORDER BY pos)) >= 100""")
def word_windows(spark, sf_dir):
    return studies.word_windows(table(spark, sf_dir, "documents"), 200).withColumnRenamed("window", "window_no")


@query()
def spoken_numbers(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    numbers = studies.number_table(parts)
    made = parts.join(numbers, F.col("p_partkey") % 1000 == F.col("number"))
    said = F.when(F.col("p_size") % 3 == 0, F.col("number").cast("string")).when(F.col("p_size") % 3 == 1, F.col("words")).otherwise(F.concat("words", F.lit("n")))
    return studies.spoken_numbers(made.select(F.col("p_partkey").alias("phrase_id"), said.alias("text")), numbers)


@query(rf"""WITH b AS (SELECT doc_id, unnest(x) AS p, generate_subscripts(x, 1) - 1 AS par FROM (SELECT doc_id, list_filter(list_transform(CASE WHEN regexp_matches(text, '\n\s*\n') THEN regexp_split_to_array(text, '\n\s*\n') ELSE string_split(text, chr(10)) END, lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '') AS x FROM documents)),
h AS (SELECT * FROM ({toks('p', 'b', 'doc_id', 'par')}) WHERE starts_with(form, 'the'))
SELECT doc_id, count(*) AS n, count(DISTINCT par) AS paragraphs, count(DISTINCT form) AS forms, coalesce(min(par) FILTER (par >= 2), min(par)) AS nearest FROM h GROUP BY doc_id""")
def find_word(spark, sf_dir):
    paragraphs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.blocks("text")).alias("par", "text"))
    found = studies.find_word(paragraphs, "the", 2)
    return found.select("doc_id", "n", F.size("pars").cast("long").alias("paragraphs"), F.size("forms").cast("long").alias("forms"), F.col("nearest").cast("long").alias("nearest"))


@query(f"""WITH {INDEX}, c AS (SELECT df, count(*) AS n FROM dfs GROUP BY df), t AS (SELECT df, CAST(floor(3 * coalesce(sum(n) OVER (ORDER BY df ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER ()) + 1 AS INTEGER) AS third FROM c) SELECT lemma, df, third FROM dfs JOIN t USING (df)""")
def lemma_thirds(spark, sf_dir):
    df = index.document_frequencies(index.term_frequencies(table(spark, sf_dir, "documents")))
    return studies.by_thirds(df, "df").select("lemma", "df", "third")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'redeemed' WHEN o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1997-01-01' THEN 'expired' ELSE 'open' END AS state FROM orders")
def pledge_states(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("due_at"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate").cast("timestamp")).alias("redeemed_at"))
    return studies.expiring(rows, F.lit("1997-01-01").cast("timestamp")).select("id", "state")


@query(f"""WITH {WORD_PAIRS}, g AS (SELECT pair_id, list_transform(range(1, len(h)), lambda i: h[i] || ' ' || h[i + 1]) AS hg, list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1]) AS rg, h, r FROM pw)
SELECT pair_id, round(coalesce(len(list_filter(hg, lambda x: list_contains(rg, x))) / nullif(len(hg), 0), 0), 6) AS copied, round(coalesce(len(list_distinct(list_intersect(h, r))) / nullif(len(list_distinct(h)), 0), 0), 6) AS shared FROM g""")
def copied_shares(spark, sf_dir):
    return studies.copied_share(_word_pairs(spark, sf_dir)).select("pair_id", r6("copied"), r6("shared"))


MARKERS = {"common": ["the", "and", "of"], "romance": ["la", "de", "que"], "german": ["der", "und", "die"]}


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(lower(text), 'ё', 'е'), '{PATTERN}') AS ws FROM documents), c AS (SELECT doc_id, len(list_filter(ws, lambda w: w IN ('the', 'and', 'of'))) AS a, len(list_filter(ws, lambda w: w IN ('der', 'und', 'die'))) AS b, len(list_filter(ws, lambda w: w IN ('la', 'de', 'que'))) AS c FROM t)
SELECT doc_id, CASE WHEN a > b AND a > c THEN 'common' WHEN b > a AND b > c THEN 'german' WHEN c > a AND c > b THEN 'romance' ELSE 'none' END AS domain FROM c""")
def document_domains(spark, sf_dir):
    return studies.detect_domain(table(spark, sf_dir, "documents"), MARKERS, "none")


@query(f"""WITH v AS (SELECT DISTINCT form AS word FROM ({toks('text', 'documents')}) WHERE {SIGNIFICANT}), e AS (SELECT word, substr(word, i) AS head FROM v, range(2, greatest(length(word) - 3, 2)) t(i) WHERE length(substr(word, i)) >= 5)
SELECT word, arg_max(head, length(head)) AS head FROM e WHERE head IN (SELECT word FROM v) GROUP BY word""")
def compound_heads(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.tokens("text")).alias("word")).filter(T.is_significant(F.col("word")))
    return studies.contained_words(words)


@query("SELECT n_nationkey, array_to_string(string_split(upper(n_name), ''), '-') AS spelled FROM nation")
def spelled_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", studies.spelled("n_name").alias("spelled"))


@query()
def langid_network(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    network = mlp.fit(docs.select(F.col("lang").alias("owner"), "text"))
    told = langprofiles.classify(mlp.distances(docs.select(F.col("doc_id").alias("owner"), "text"), network))
    gold = docs.select(F.col("doc_id").alias("owner"), F.col("lang").alias("gold"))
    return langprofiles.confusion(told.join(gold, "owner"))
