"""Registered queries of inflection, writing, sound and tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.operators import german, sound, tagger, wordformation, writing
from textlake.plans.queries import query, table

# Capitalised words of German documents stand in for nouns; their length picks gender, article and adjective.
NOUNS_SQL = r"""n AS (SELECT lemma, length(lemma) AS k FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS lemma FROM documents WHERE lang = 'de') WHERE regexp_full_match(lemma, '\p{Lu}[a-zäöüß]{3,}')),
p AS (SELECT lemma, (['m', 'f', 'n'])[k % 3 + 1] AS gender, lemma || CASE WHEN lemma LIKE '%e' THEN 'n' WHEN k % 3 = 1 THEN 'en' ELSE 'e' END AS plural, (['def', 'indef', 'none'])[(k // 3) % 3 + 1] AS kind, (['neu', 'hoch', 'dunkel', 'teuer'])[k % 4 + 1] AS adjective, (['pos', 'comp', 'sup'])[(k // 2) % 3 + 1] AS degree FROM n)"""
_E = {"def": (german.DEFINITE, german.WEAK), "indef": (german.INDEFINITE, german.MIXED), "none": (dict.fromkeys(german.DEFINITE, ("",) * 4), german.STRONG)}
ENDINGS_SQL = ", ".join(f"('{kind}', '{form}', '{c}', '{a}', '{e}')" for kind, (arts, ends) in _E.items() for form in arts for c, a, e in zip(german.CASES, arts[form], ends[form], strict=True))


@query(f"""WITH {NOUNS_SQL}, e(kind, form, casus, article, ending) AS (VALUES {ENDINGS_SQL}),
s(adjective, degree, stem) AS (VALUES ('neu', 'pos', 'neu'), ('neu', 'comp', 'neuer'), ('neu', 'sup', 'neust'), ('hoch', 'pos', 'hoh'), ('hoch', 'comp', 'höher'), ('hoch', 'sup', 'höchst'), ('dunkel', 'pos', 'dunkl'), ('dunkel', 'comp', 'dunkler'), ('dunkel', 'sup', 'dunkelst'), ('teuer', 'pos', 'teur'), ('teuer', 'comp', 'teurer'), ('teuer', 'sup', 'teuerst')),
x AS (SELECT *, CASE WHEN number = 'pl' THEN plural || CASE WHEN casus = 'D' AND NOT regexp_matches(plural, '[ns]$') THEN 'n' ELSE '' END WHEN casus <> 'G' OR gender = 'f' OR regexp_matches(lemma, '(us|os|is|as)$') THEN lemma
WHEN regexp_matches(lemma, '(s|ß|x|z|sch)$') OR (len(regexp_extract_all(lower(lemma), '[aeiouyäöü]+')) = 1 AND NOT regexp_matches(lemma, '[aeiouyäöü]$')) THEN lemma || 'es' ELSE lemma || 's' END AS noun
FROM p JOIN (VALUES ('sg'), ('pl')) v(number) ON TRUE JOIN e USING (kind) JOIN s USING (adjective, degree) WHERE form = CASE WHEN number = 'pl' THEN 'pl' ELSE gender END)
SELECT lemma, number, casus, article || CASE WHEN article = '' THEN '' ELSE ' ' END || stem || ending || ' ' || noun AS phrase FROM x""")
def noun_phrases(spark, sf_dir):
    pick = lambda k, *names: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    words = table(spark, sf_dir, "documents").filter("lang = 'de'").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("lemma"))
    nouns, k = words.filter(F.col("lemma").rlike(r"^\p{Lu}[a-zäöüß]{3,}$")).distinct(), F.length("lemma")
    plural = F.concat("lemma", F.when(F.col("lemma").endswith("e"), "n").when(k % 3 == 1, "en").otherwise("e"))
    rows = nouns.select("lemma", pick(k % 3, "m", "f", "n").alias("gender"), plural.alias("plural"), pick(F.floor(k / 3) % 3, "def", "indef", "none").alias("kind"), pick(k % 4, "neu", "hoch", "dunkel", "teuer").alias("adjective"), pick(F.floor(k / 2) % 3, "pos", "comp", "sup").alias("degree"))
    return german.decline(rows).select("lemma", "number", "casus", "phrase")


PIECES = r'[\p{L}\p{N}]+|[.,;:!?()"]'


@query(rf"""WITH a AS (SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '{PIECES}'), ' ') AS t FROM conversations),
q AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, '"( ([^"]* )?)"', '„\1“', 'g'), '"', '„', 'g') AS t FROM a),
c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '([,(„;:])( ,)+', '\1', 'g'), '(, )+([.!?)“;:])', '\2', 'g'), '^([,;]( |$))+', '') AS t FROM q),
s AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(t, ' ([,.;:!?)“])', '\1', 'g'), '([(„]) ', '\1', 'g')) AS t FROM c)
SELECT conv_id, turn, regexp_extract(t, '^[^\p{{L}}\p{{N}}]*') || upper(substr(t, length(regexp_extract(t, '^[^\p{{L}}\p{{N}}]*')) + 1, 1)) || substr(t, length(regexp_extract(t, '^[^\p{{L}}\p{{N}}]*')) + 2) AS text FROM s""")
def assembled_turns(spark, sf_dir):
    tokens = F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", writing.assemble(tokens).alias("text"))


@query()
def dictated_conversations(spark, sf_dir):
    said = F.regexp_replace(F.regexp_replace("text", ",", " komma "), r"[.!?]+", " punkt ")
    return writing.dictated(table(spark, sf_dir, "conversations").withColumn("text", said), "de", "conv_id", "turn")


# Vectors stand in for sound: 16 components are a frame.
@query("""WITH f AS (SELECT vec_id, list_transform(range(0, len(embedding) // 16), lambda i: 20 * log10(greatest(sqrt(list_sum(list_transform(embedding[i * 16 + 1:i * 16 + 16], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 16), 1e-6))) AS l FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT vec_id, CASE WHEN len(l) = 0 THEN [-120.0] ELSE l END AS l FROM f), h AS (SELECT vec_id, l, list_filter(l, lambda v: v > greatest(-50.0, list_max(l) - 30)) AS loud FROM g)
SELECT vec_id, CAST(len(l) AS BIGINT) AS frames, round(list_max(l), 4) AS loudest, round(CASE WHEN len(loud) = 0 THEN -120.0 ELSE 10 * log10(list_sum(list_transform(loud, lambda v: 10.0 ** (v / 10))) / len(loud)) END, 4) AS speech FROM h""")
def sound_levels(spark, sf_dir):
    levels = sound.frame_levels("embedding", 16)
    rows = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    return rows.select("vec_id", F.size(levels).cast("long").alias("frames"), F.round(F.array_max(levels), 4).alias("loudest"), F.round(sound.speech_level("embedding", 16), 4).alias("speech"))


@query("""WITH r AS (SELECT vec_id, list_transform(range(0, len(embedding) * 3 // 2), lambda i: CAST(embedding[CAST(i * 2 // 3 AS INTEGER) + 1] AS DOUBLE) + (CAST(embedding[least(CAST(i * 2 // 3 AS INTEGER) + 2, len(embedding))] AS DOUBLE) - CAST(embedding[CAST(i * 2 // 3 AS INTEGER) + 1] AS DOUBLE)) * (i * 2 % 3) / 3) AS s FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, CAST(len(s) AS BIGINT) AS n, round(list_sum(s), 4) AS total, round(list_sum(list_transform(s, lambda x: x * x)), 4) AS power FROM r""")
def sound_resampled(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", sound.resample("embedding", 2, 3).alias("s"))
    total = lambda f: F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + f(x)), 4)
    return rows.select("vec_id", F.size("s").cast("long").alias("n"), total(lambda x: x).alias("total"), total(lambda x: x * x).alias("power"))


@query()
def tagged_turns(spark, sf_dir):
    """No table has parts of speech: classes of words by rule stand in for them, and the tagger learns them from context."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0))
    kind = lambda w: F.when(w.rlike(r"^\p{N}+$"), "number").when(w.rlike(r"^[^\p{L}\p{N}]$"), "mark").when(w.rlike(r"^\p{Lu}"), "capital").otherwise("word")
    turns = table(spark, sf_dir, "conversations").filter("text is not null").select(F.concat_ws("/", "conv_id", "turn").alias("id"), words.alias("words")).withColumn("tags", F.transform("words", kind))
    model = tagger.train(turns, "id", passes=2)
    return tagger.accuracy(tagger.tag(tagger.with_certain(turns, tagger.certain_words(turns), "id"), model))


_RULES_SQL = ", ".join(f"({i}, '{e}', '{g}', '{m}', {c})" for i, (p, e, g, _, m, c) in enumerate(wordformation.ENDINGS) if p == "noun")


@query(f"""WITH w AS (SELECT DISTINCT lower(x) AS en FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS x FROM documents) WHERE length(x) >= 3),
r(place, suffix, german, more, confidence) AS (VALUES {_RULES_SQL}),
f AS (SELECT en, suffix, german, more, confidence FROM w JOIN r ON ends_with(en, suffix) AND length(en) > length(suffix) + 2 QUALIFY row_number() OVER (PARTITION BY en ORDER BY place) = 1),
g AS (SELECT *, left(en, length(en) - length(suffix)) AS stem FROM f),
h AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(stem, 'c$', ''), 'c([eiy])', 'z\\1', 'g'), 'ck?', 'k', 'g') || CASE WHEN stem LIKE '%c' THEN 'k' ELSE '' END || german AS low FROM g)
SELECT en, upper(substr(low, 1, 1)) || substr(low, 2) AS de, CAST(confidence AS DOUBLE) AS confidence FROM h""")
def guessed_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("en")).withColumn("pos", F.lit("noun"))
    lexicon = spark.createDataFrame([], "en string, pos string, de string, gender string, plural string, rank int")
    return wordformation.guess(words, lexicon).select("en", "de", "confidence")
