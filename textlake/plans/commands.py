"""Registered queries of spoken commands: what nations and regions are called by is said in sentences made from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.operators import commands
from textlake.plans.queries import query, table

TEMPLATES = [
    ("list", 0, "liste der aufträge", None, 0, "normal"), ("list", 1, "welche aufträge gibt es", None, 0, "normal"), ("open", 0, "öffne den auftrag {target}", "target", 4, "normal"), ("open", 1, "öffne {target}", "target", 4, "normal"),
    ("find", 0, "finde das wort {word}", "word", 2, "normal"), ("stop", 0, "halt", None, 0, "normal"), ("begin", 0, "beginne das diktat", None, 0, "normal"), ("end", 0, "beende das diktat", None, 0, "dictation"),
    ("bad", 0, "öffne {target} jetzt", "target", 4, "normal"), ("bad", 1, "{target}", "target", 4, "normal"), ("bad", 2, "halt {x}", None, 0, "normal"), ("bad", 3, "halt {", None, 0, "normal"), ("bad", 4, "", None, 0, "normal"),
]
FILLERS = ["bitte", "mal"]
SAID = ["liste der auftraege", "welche aufträge gibt s", "bitte öffne den auftrag {}", "öfne den auftrag {}", "also gut öffne {}", "finde das wort {}", "halt", "hald", "beende das diktat", "beginne das dikat", "öffne mal {} und lies alles vor was da steht", "{}", "finde ein wort {} bitte"]


def templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(TEMPLATES, "operation string, number int, text string, slot string, slot_words int, mode string")
    places = spark.createDataFrame([(o, i) for i, o in enumerate(dict.fromkeys(t[0] for t in TEMPLATES))], "operation string, place int")
    return commands.parsed(rows).join(places, "operation")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One phrase for each customer: a sentence with the number or the nation of the customer in it."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lower("n_name").alias("nation"))
    rows = table(spark, sf_dir, "customer").join(nations, "c_nationkey")
    filler = F.when(F.col("c_custkey") % 2 == 0, F.col("nation")).otherwise(F.col("c_custkey").cast("string"))
    said = F.get(F.array(*map(F.lit, SAID)), (F.col("c_custkey") % len(SAID)).cast("int"))
    return rows.select(F.col("c_custkey").alias("phrase_id"), F.replace(said, F.lit("{}"), filler).alias("text"))


@query(f"""WITH t(operation, number, text, slot, words, mode) AS (VALUES {', '.join(str(tuple('' if x is None else x for x in t)) for t in TEMPLATES)})
SELECT operation, CAST(number AS INTEGER) AS number, CASE WHEN text = '' THEN 'empty' WHEN regexp_matches(regexp_replace(text, '\\{{[a-z]+\\}}', ' ', 'g'), '[{{}}]') THEN 'stray braces' WHEN trim(regexp_replace(text, '\\{{[a-z]+\\}}', ' ', 'g')) = '' THEN 'no words'
WHEN slot = '' AND regexp_matches(text, '\\{{[a-z]+\\}}') THEN 'no slot here' WHEN slot <> '' AND NOT ends_with(text, '{{' || slot || '}}') THEN 'slot not at the end' END AS error FROM t""")
def command_templates(spark, sf_dir):
    """What is wrong with templates, for every one of them."""
    return templates(spark).select("operation", "number", "error")


_PHRASE = "replace(replace(replace(replace({}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
_VALID = [(o, i, n, t, s, w, m) for i, o in enumerate(dict.fromkeys(t[0] for t in TEMPLATES)) for (p, n, t, s, w, m) in TEMPLATES if p == o and o != "bad"]
_SHAPES = ", ".join(f"('{o}', {i}, {n}, '{t.split(' {')[0]}', {'true' if s else 'false'}, {w}, '{m}')" for o, i, n, t, s, w, m in _VALID)


@query(f"""WITH q AS (SELECT c_custkey AS id, replace(({SAID})[c_custkey % {len(SAID)} + 1], '{{}}', CASE WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE CAST(c_custkey AS VARCHAR) END) AS text FROM customer JOIN nation ON n_nationkey = c_nationkey),
h AS (SELECT id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS ws FROM q),
f AS (SELECT id, 0 AS variant, list_filter(ws, lambda w: w NOT IN ('bitte', 'mal')) AS ws FROM h UNION ALL SELECT id, 1, ws FROM h WHERE len(list_filter(ws, lambda w: w IN ('bitte', 'mal'))) > 0),
k AS (SELECT id, variant, s AS skipped, ws[s + 1:] AS ws FROM f, range(0, least(2, len(ws) - 1) + 1) r(s)),
b AS (SELECT id, variant, skipped, head, head = len(ws) AS whole, {_PHRASE.format("array_to_string(ws[1:head], ' ')")} AS said, ws[head + 1:] AS rest FROM k, range(1, len(ws) + 1) r(head)),
t(operation, place, number, raw, slotted, words, mode) AS (VALUES {_SHAPES}),
p AS (SELECT *, {_PHRASE.format('raw')} AS shape, len(string_split(raw, ' ')) AS n FROM t),
m AS (SELECT *, 1 - levenshtein(said, shape) / greatest(length(said), length(shape)) AS l FROM b JOIN p ON CASE WHEN slotted THEN NOT whole AND abs(head - n) <= 1 AND len(rest) <= words ELSE whole END),
c AS (SELECT *, round(l - 0.04 * skipped, 6) AS score FROM m WHERE l >= 0.75),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id, operation ORDER BY score DESC, n DESC, variant, number, skipped, l DESC, head) = 1),
w AS (SELECT * FROM o WHERE mode = 'normal' AND score >= CASE WHEN length(shape) <= 5 THEN 0.8 ELSE 0.75 END QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, n DESC, place) = 1)
SELECT id AS phrase_id, operation, score, CAST(skipped AS INTEGER) AS skipped, CASE WHEN slotted THEN array_to_string(rest, ' ') END AS raw FROM w
WHERE score >= coalesce((SELECT max(x.score) FROM o x WHERE x.id = w.id AND x.mode <> 'normal'), 0)""")
def command_slots(spark, sf_dir):
    """The command that every customer's phrase calls, and what fills its slot."""
    good = templates(spark).filter("error IS NULL")
    return commands.match(_phrases(spark, sf_dir), good, "normal", FILLERS).select("phrase_id", "operation", "score", "skipped", "raw")
