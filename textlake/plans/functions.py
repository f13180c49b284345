"""Registered queries of Column functions over the tables' texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import snippets as show
from textlake.plans.queries import PATTERN, query, table, toks
from textlake.sources import files

_WORDS = ["the", "and", "der", "que"]
_LIST = "['the', 'and', 'der', 'que']"
_PLAIN = "translate(lower({}), 'ё', 'е')"


def _wanted():
    return F.array(*map(F.lit, _WORDS))


_ESCAPE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents),
p AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{PATTERN}|[^\p{{L}}\p{{N}}]+') AS x FROM t)),
a AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM p),
h AS (SELECT doc_id, place FROM a WHERE list_contains({_LIST}, {_PLAIN.format('piece')})),
c AS (SELECT doc_id, greatest(place - 100, 0) AS start, CASE WHEN place <= 100 THEN count(*) FILTER (place < 300) OVER (PARTITION BY doc_id) ELSE count(*) OVER (PARTITION BY doc_id ORDER BY place RANGE BETWEEN 100 PRECEDING AND 199 FOLLOWING) END AS n FROM h),
b AS (SELECT doc_id, n AS hits, CAST(start AS BIGINT) AS start FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, start) = 1),
r AS (SELECT doc_id, text, coalesce(hits, 0) AS hits, coalesce(start, 0) AS start FROM t LEFT JOIN b USING (doc_id)),
s AS (SELECT doc_id, text, hits, CASE WHEN start > 0 AND instr(substr(text, start + 1), ' ') BETWEEN 1 AND 30 THEN start + instr(substr(text, start + 1), ' ') ELSE start END AS start FROM r),
f AS (SELECT *, substr(text, start + 1, 300) AS cut, start + 300 < length(text) AS more FROM s),
l AS (SELECT *, length(cut) - instr(reverse(cut), ' ') AS last FROM f)
SELECT doc_id, hits, CASE WHEN start > 0 THEN '…' ELSE '' END || CASE WHEN more AND hits > 0 AND contains(cut, ' ') AND last > 180 THEN left(cut, last) ELSE cut END || CASE WHEN more THEN '…' ELSE '' END AS snippet FROM l""")
def best_snippets(spark, sf_dir):
    return show.best_stretch(table(spark, sf_dir, "documents"), _wanted())


@query(rf"""SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '{PATTERN}|[^\p{{L}}\p{{N}}]+'), lambda p: CASE WHEN list_contains({_LIST}, {_PLAIN.format('p')}) THEN '<mark>' || {_ESCAPE.format('p')} || '</mark>' ELSE {_ESCAPE.format('p')} END), '') AS marked,
array_to_string(list_filter({_LIST}, lambda w: list_contains(regexp_extract_all({_PLAIN.format('text')}, '{PATTERN}'), w)), ' ') AS matched FROM conversations""")
def highlighted_turns(spark, sf_dir):
    found = F.array_join(F.filter(_wanted(), lambda w: F.array_contains(show.matched("text", _wanted()), w)), " ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", show.highlight("text", _wanted()).alias("marked"), found.alias("matched"))


_LATIN_SQL = "lower(form)"
for _a, _b in T.LATIN.items():
    _LATIN_SQL = f"replace({_LATIN_SQL}, '{_a}', '{_b}')"
_LATIN_SQL = f"translate({_LATIN_SQL}, '{T.LATIN_ONE[0]}ъь', '{T.LATIN_ONE[1]}')"


@query(f"SELECT DISTINCT form, {_LATIN_SQL} AS latin FROM ({toks('text', 'documents')})")
def latin_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.tokens("text")).alias("form")).distinct()
    return words.select("form", T.latinize("form").alias("latin"))


_CYR, _LAT = "length(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g'))", "length(regexp_replace(text, '[^A-Za-zÄÖÜäöüß]', '', 'g'))"


@query(f"SELECT doc_id, CASE WHEN {_CYR} >= {_LAT} AND {_CYR} > 0 THEN 'ru' ELSE 'de' END AS script FROM documents")
def script_languages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.script_language("text").alias("script"))


_PHRASE = "trim(regexp_replace(translate(replace(replace(replace(replace(lower({}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'ёéèêáàâíóúñç', 'еeeeaaaiounc'), '[^a-zа-я0-9]+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, {_PHRASE.format('text')} AS phrase FROM conversations")
def phrase_forms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.phrase("text").alias("phrase"))


@query("SELECT conv_id, turn, array_to_string(regexp_extract_all(replace(lower(text), '-', ' '), '[a-zäöüß0-9]+'), ' ') AS words FROM conversations")
def comparison_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.comparison_words("text"), " ").alias("words"))


@query(f"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
x AS (SELECT w AS a, lead(w) OVER (PARTITION BY substr(w, 1, 2) ORDER BY w) AS b FROM v),
y AS (SELECT a, b, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, 1, CAST(i AS INTEGER)) = substr(b, 1, CAST(i AS INTEGER)))) AS prefix, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS s FROM x WHERE b IS NOT NULL)
SELECT a, b, CAST(prefix AS INTEGER) AS prefix, round(CASE WHEN prefix >= 4 AND prefix >= 0.6 * least(length(a), length(b)) THEN greatest(s, 0.75) ELSE s END, 6) AS score FROM y""")
def same_words(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("a")).distinct()
    pairs = words.withColumn("b", F.lead("a").over(Window.partitionBy(F.substring("a", 1, 2)).orderBy("a"))).filter("b is not null")
    return pairs.select("a", "b", T.common_prefix("a", "b").alias("prefix"), F.round(T.same_word("a", "b"), 6).alias("score"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 AND o_orderkey % 100 <> 11 THEN 'заказ' WHEN o_orderkey % 10 BETWEEN 2 AND 4 AND o_orderkey % 100 NOT BETWEEN 12 AND 14 THEN 'заказа' ELSE 'заказов' END AS ru, CASE WHEN o_orderkey = 1 THEN 'Auftrag' ELSE 'Aufträge' END AS de FROM orders""")
def plural_forms(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.plural_ru(key, "заказ", "заказа", "заказов").alias("ru"), T.plural_de(key, "Auftrag", "Aufträge").alias("de"))


@query("SELECT p_partkey, translate(format('{:,d}', p_partkey * 1009) || '.' || p_size, ',.', '.,') AS german FROM part")
def german_numbers(spark, sf_dir):
    english = F.concat(F.format_number(F.col("p_partkey") * 1009, 0), F.lit("."), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", T.german_number(english).alias("german"))


@query("SELECT p_partkey, p_size || '' AS size, p_brand AS brand, '1' AS sale, 3 AS keys FROM part")
def pair_maps(spark, sf_dir):
    written = F.concat(F.lit("size="), F.col("p_size").cast("string"), F.lit("; brand = "), "p_brand", F.lit(" ; sale"))
    m = T.pair_map(written)
    return table(spark, sf_dir, "part").select("p_partkey", m["size"].alias("size"), m["brand"].alias("brand"), m["sale"].alias("sale"), F.size(m).alias("keys"))


@query("SELECT p_partkey, split_part(p_type, ' ', 1) AS kind, p_size || '' AS size FROM part")
def feature_maps(spark, sf_dir):
    written = F.concat(F.lit("Kind="), F.split("p_type", " ")[0], F.lit("|Size="), F.col("p_size").cast("string"))
    m = T.pair_map(written, "|")
    return table(spark, sf_dir, "part").select("p_partkey", m["Kind"].alias("kind"), m["Size"].alias("size"))


@query(r"""WITH w AS (SELECT DISTINCT lang, unnest(regexp_extract_all(text, '[\p{L}\p{N}''-]+')) AS word FROM documents)
SELECT lang, word, regexp_full_match(word, '(?i)[a-zäöüßàáâçèéêëìíîïñòóôùúûÿœæ]+([-''][a-zäöüßàáâçèéêëìíîïñòóôùúûÿœæ]+)*') AS own, regexp_full_match(word, '(?i)[a-zäöüßàáâçèéêëìíîïñòóôùúûÿœæ]+([-''][a-zäöüßàáâçèéêëìíîïñòóôùúûÿœæ]+)*') AND length(word) > 1 AND lower(word) NOT IN ('the', 'and', 'der', 'que') AS counted FROM w""")
def script_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}'-]+"), F.lit(0))).alias("word")).distinct()
    lang = F.coalesce("lang", F.lit(""))
    return words.select("lang", "word", T.in_script("word", lang).alias("own"), T.is_counted(F.col("word"), lang, tuple(_WORDS)).alias("counted"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace('  ' || text, '. ', '. ' || chr(8203)), chr(8203), '', 'g'), '[ \t]+', ' ', 'g'), '(?m)^ | $', '', 'g') AS cleaned FROM documents""")
def cleaned_documents(spark, sf_dir):
    noisy = F.replace(F.concat(F.lit("  "), "text"), F.lit(". "), F.lit(". ​"))
    return table(spark, sf_dir, "documents").select("doc_id", T.cleaned(noisy).alias("cleaned"))


@query(r"""WITH s AS (SELECT item_id, split_part(text, chr(10), 1) AS s FROM benchmark)
SELECT item_id, CASE WHEN length(s) < 20 THEN 'Indeed, ' || s ELSE upper(substr(s, 1, 1)) || substr(s, 2) END AS compressed FROM s""")
def compressed_sentences(spark, sf_dir):
    first = F.split("text", "\n")[0]
    marked = F.concat(F.lit("Indeed, "), F.regexp_replace(first, r"\.$", " [3, p. 12] (vgl. Abb. 4)."))
    return table(spark, sf_dir, "benchmark").select("item_id", T.compressed(marked, ("in", "indeed")).alias("compressed"))


@query("""WITH p AS (SELECT conv_id, turn, text AS new, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations),
c AS (SELECT *, len(list_filter(range(1, least(length(old), length(new)) + 1), lambda i: substr(old, 1, CAST(i AS INTEGER)) = substr(new, 1, CAST(i AS INTEGER)))) AS common FROM p WHERE old IS NOT NULL)
SELECT conv_id, turn, CAST(common AS INTEGER) AS common, substr(old, CAST(common AS INTEGER) + 1) AS removed FROM c""")
def turn_differences(spark, sf_dir):
    old = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("old", old).filter("old is not null").withColumn("d", T.difference("old", "text"))
    return rows.select("conv_id", "turn", "d.common", "d.removed")


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS written FROM conversations)
SELECT written, unnest(list_filter(string_split(""" + _PHRASE.format("written") + """, ' '), lambda p: p <> '')) AS compared FROM w""")
def spelled_words(spark, sf_dir):
    pairs = table(spark, sf_dir, "conversations").select(F.explode(T.spelled_pairs("text")).alias("p")).select("p.*")
    return pairs.distinct()


@query("""WITH l AS (SELECT event_id, greatest(0, CAST(round_even(event_id % 101 - 5.0 * (event_id % 13), 0) AS INTEGER)) AS level FROM events)
SELECT event_id, level, CASE WHEN level > 70 THEN 'full' WHEN level >= 30 THEN 'normal' WHEN level >= 10 THEN 'hungry' ELSE 'starved' END AS state, round(least(1.6, 0.8 + 0.8 * level / 100), 2) AS size FROM l""")
def decayed_levels(spark, sf_dir):
    d = T.decayed((F.col("event_id") % 101).cast("int"), (F.col("event_id") % 13).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", d.alias("d")).select("event_id", "d.level", "d.state", "d.size")


@query("""WITH p AS (SELECT p_partkey, replace(p_name, ' ', '|') || '*' AS de, (['m', 'f', 'n', 'pl', ''])[p_partkey % 5 + 1] AS g, CASE WHEN p_size % 3 = 0 THEN '-' WHEN p_size % 3 = 1 THEN '' ELSE p_name || 'e' END AS plural FROM part)
SELECT p_partkey, CASE WHEN g IN ('m', 'f', 'n') THEN (CASE g WHEN 'm' THEN 'der ' WHEN 'f' THEN 'die ' ELSE 'das ' END) || replace(replace(de, '|', ''), '*', '') || CASE WHEN plural IN ('', '-') THEN '' ELSE ' (Pl. ' || plural || ')' END WHEN g = 'pl' THEN 'die ' || replace(replace(de, '|', ''), '*', '') || ' (Pl.)' ELSE replace(replace(de, '|', ''), '*', '') END AS shown FROM p""")
def entry_lines(spark, sf_dir):
    de = F.concat(F.replace("p_name", F.lit(" "), F.lit("|")), F.lit("*"))
    gender = F.get(F.array(*map(F.lit, ("m", "f", "n", "pl", ""))), (F.col("p_partkey") % 5).cast("int"))
    plural = F.when(F.col("p_size") % 3 == 0, "-").when(F.col("p_size") % 3 == 1, "").otherwise(F.concat("p_name", F.lit("e")))
    return table(spark, sf_dir, "part").select("p_partkey", T.entry_shown(de, gender, plural).alias("shown"))


@query(rf"""WITH w AS (SELECT conv_id, turn, regexp_extract_all({_PLAIN.format('text')}, '{PATTERN}') AS ws, text FROM conversations)
SELECT conv_id, turn, len(list_filter(ws, lambda w: w NOT IN ('the', 'and', 'der', 'que'))) = 0 OR (len(ws) = 1 AND length(ws[1]) <= 2) AS noise,
len(list_filter(regexp_extract_all(text, '[^.!?\n]+[.!?]+'), lambda s: regexp_full_match(regexp_replace(trim(s), '[.!?]+$', ''), '\p{{L}}+([ ,]+\p{{L}}+)*') AND len(string_split(trim(regexp_replace(regexp_replace(trim(s), '[.!?]+$', ''), '[ ,]+', ' ', 'g')), ' ')) BETWEEN 4 AND 14)) AS speakable FROM w""")
def spoken_turns(spark, sf_dir):
    sentences = F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]+"), F.lit(0))
    fit = F.filter(sentences, lambda s: T.is_speakable(F.trim(s)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_hesitation(T.tokens("text"), tuple(_WORDS)).alias("noise"), F.size(fit).cast("long").alias("speakable"))


@query(f"""WITH w AS (SELECT item_id, regexp_extract_all({_PLAIN.format('text')}, '{PATTERN}')[1:3] AS h FROM benchmark)
SELECT item_id, replace(replace(text, h[1], '<' || h[1] || '>'), h[2], '<' || h[2] || '>') AS corrected FROM benchmark JOIN w USING (item_id)""")
def corrected_queries(spark, sf_dir):
    words = F.slice(T.tokens("text"), 1, 2)
    pairs = F.transform(words, lambda w: F.struct(w.alias("wrong"), F.concat(F.lit("<"), w, F.lit(">")).alias("right")))
    return table(spark, sf_dir, "benchmark").select("item_id", T.replaced(F.col("text"), pairs).alias("corrected"))


@query("""WITH t AS (SELECT o_orderkey, list_transform(range(1, 6), lambda i: (o_orderkey * 7 + i * i * (o_custkey % 5 + 1)) % 6) AS h FROM orders),
a AS (SELECT o_orderkey, list_transform(range(1, 6), lambda i: [least(h[i], i), greatest(h[i], i)]) AS arcs FROM t)
SELECT o_orderkey, len(list_filter(arcs, lambda x: len(list_filter(arcs, lambda y: x[1] < y[1] AND y[1] < x[2] AND x[2] < y[2])) > 0)) = 0 AS projective FROM a""")
def projective_trees(spark, sf_dir):
    """Heads made from keys stand in for trees, of which the tables have none."""
    heads = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: ((F.col("o_orderkey") * 7 + i * i * (F.col("o_custkey") % 5 + 1)) % 6).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", files.is_projective(heads).alias("projective"))
