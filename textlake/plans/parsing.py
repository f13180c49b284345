"""Registered queries of trees. No table has trees: every word hangs on the next longer word of its sentence, without
one on the last before it that is as long; a word's length gives its part of speech, and with its place its label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.operators import clauses, parsing
from textlake.plans.evaluation import written
from textlake.plans.queries import PATTERN, query, table
from textlake.session import cut
from textlake.sources import files

TAGS = ("NOUN", "VERB", "ADJ", "DET", "AUX", "ADV", "PROPN")
LABELS = ("nsubj", "aux", "obj", "case", "advmod", "conj", "det", "ccomp")
SENTENCES_SQL = rf"""x AS (SELECT conv_id, turn, s, regexp_extract_all(p, '{PATTERN}') AS ws FROM (SELECT conv_id, turn, unnest(ps) AS p, generate_subscripts(ps, 1) AS s FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[.!?\n]+') AS ps FROM conversations WHERE text IS NOT NULL))),
w AS (SELECT conv_id || '.' || turn || '.' || (s - 1) AS sent_id, ws FROM x WHERE len(ws) > 0),
t AS (SELECT sent_id, i, ws[i] AS form, length(ws[i]) AS k FROM w, range(1, len(ws) + 1) r(i)),
h AS (SELECT a.sent_id, a.i, any_value(a.form) AS form, any_value(a.k) AS k, coalesce(min(b.i) FILTER (b.i > a.i AND b.k > a.k), max(b.i) FILTER (b.i < a.i AND b.k >= a.k), 0) AS head FROM t a JOIN t b USING (sent_id) GROUP BY a.sent_id, a.i),
g AS (SELECT *, ({list(TAGS)})[k % {len(TAGS)} + 1] AS upos, CASE head WHEN 0 THEN 'root' ELSE ({list(LABELS)})[(k + CASE WHEN head < i THEN 3 ELSE 0 END) % {len(LABELS)} + 1] END AS deprel FROM h)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent_id, text, tokens) of every sentence of every turn, trees by rule."""
    parts = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.posexplode(F.split("text", r"[.!?\n]+")).alias("s", "text"))
    found = parts.select(F.concat_ws(".", "conv_id", "turn", "s").alias("sent_id"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("ws")).filter(F.size("ws") > 0)
    rows = found.withColumn("k", F.transform("ws", F.length)).withColumn("at", F.sequence(F.lit(1), F.size("ws")))
    later = "array_min(filter(at, j -> j > i + 1 AND k[j - 1] > k[i]))"
    rows = rows.withColumn("heads", F.expr(f"transform(ws, (w, i) -> coalesce({later}, array_max(filter(at, j -> j <= i AND k[j - 1] >= k[i])), 0))"))
    names = {n: f"array({', '.join(repr(x) for x in v)})" for n, v in (("tag", TAGS), ("label", LABELS))}
    label = f"CASE WHEN heads[i] = 0 THEN 'root' ELSE {names['label']}[(k[i] + CASE WHEN heads[i] < i + 1 THEN 3 ELSE 0 END) % {len(LABELS)}] END"
    token = f"named_struct('id', i + 1, 'form', w, 'lemma', lower(w), 'upos', {names['tag']}[k[i] % {len(TAGS)}], 'xpos', '_', 'feats', '_', 'head', heads[i], 'deprel', {label}, 'space_after', true)"
    return rows.select("sent_id", F.array_join("ws", " ").alias("text"), F.expr(f"transform(ws, (w, i) -> {token})").alias("tokens"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sentences, written as a treebank file and read back."""
    return files.conllu(spark, written(spark, lambda path: files.to_conllu(sentences(spark, sf_dir)).write.text(path)))


@query(f"""WITH {SENTENCES_SQL} SELECT sent_id, CAST(2 * count(*) AS BIGINT) AS moves, string_agg(head, ' ' ORDER BY i) AS heads FROM g GROUP BY sent_id""")
def oracle_trees(spark, sf_dir):
    """The trees that a parser makes whose every move loses least, read from a treebank file: its own trees again."""
    told = trees(spark, sf_dir).select("sent_id", parsing.oracle(F.transform("tokens", lambda t: t["head"])).alias("o"))
    return told.select("sent_id", F.size("o.moves").cast("long").alias("moves"), F.array_join(F.col("o.heads").cast("array<string>"), " ").alias("heads"))


def _columns(rows: DataFrame) -> DataFrame:
    names = {"words": "form", "tags": "upos", "heads": "head", "labels": "deprel"}
    return rows.select("sent_id", *(F.expr(f"transform(tokens, t -> t.{f})").alias(c) for c, f in names.items()))


#: A quarter of the sentences, by their id's hash, teaches nothing.
HELD_OUT = "crc32(CAST(sent_id AS BINARY)) % 4 = 2"


@query()
def parser_scores(spark, sf_dir):
    """Attachment of every sentence's words by a parser that learned from the sentences not held out."""
    rows = cut(_columns(trees(spark, sf_dir))).withColumn("held_out", F.expr(HELD_OUT))
    model = parsing.train(rows.filter("NOT held_out"), "sent_id")
    return parsing.attachment(parsing.parse(rows.repartition("sent_id"), model), ["held_out"])


@query(f"""WITH RECURSIVE {SENTENCES_SQL},
up AS (SELECT sent_id, i, i AS top FROM g UNION ALL SELECT up.sent_id, up.i, g.head FROM up JOIN g ON g.sent_id = up.sent_id AND g.i = up.top WHERE g.head > 0),
span AS (SELECT sent_id, top AS i, min(i) AS first, max(i) AS last FROM up GROUP BY ALL),
c AS (SELECT p.sent_id, p.i, any_value(p.upos) AS upos, any_value(p.deprel) AS deprel, bool_or(k.deprel = 'case') AS cased, bool_or(k.deprel = 'nsubj') AS subject, coalesce(max(k.i) FILTER (k.deprel = 'nsubj' AND k.i < p.i), 0) AS at FROM g p JOIN g k ON k.sent_id = p.sent_id AND k.head = p.i GROUP BY p.sent_id, p.i),
l AS (SELECT *, CASE WHEN cased AND upos <> 'VERB' THEN 'PP' WHEN subject OR (upos IN ('VERB', 'AUX') AND deprel IN ('root', 'ccomp', 'conj')) THEN 'S' ELSE CASE upos WHEN 'NOUN' THEN 'NP' WHEN 'PROPN' THEN 'NP' WHEN 'VERB' THEN 'VP' WHEN 'AUX' THEN 'VP' WHEN 'ADJ' THEN 'AP' WHEN 'ADV' THEN 'AdvP' WHEN 'DET' THEN 'DP' END END AS label FROM c)
SELECT sent_id, label, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last FROM l JOIN span USING (sent_id, i)
UNION ALL SELECT l.sent_id, 'VP', CAST(least(l.i, min(s.first)) AS BIGINT), CAST(greatest(l.i, coalesce(max(s.last), 0)) AS BIGINT) FROM l LEFT JOIN (SELECT g.*, first, last FROM g JOIN span USING (sent_id, i)) s ON s.sent_id = l.sent_id AND s.head = l.i AND (s.i > l.i OR (s.i > l.at AND s.deprel IN ('aux', 'advmod'))) WHERE label = 'S' GROUP BY l.sent_id, l.i""")
def tree_phrases(spark, sf_dir):
    """Constituents of all trees of a treebank file."""
    found = trees(spark, sf_dir).select("sent_id", F.explode(parsing.phrases("tokens")).alias("p"))
    return found.select("sent_id", "p.label", F.col("p.first").cast("long").alias("first"), F.col("p.last").cast("long").alias("last"))


# A word of eight letters or more is written in two with a hyphen. The first part and the hyphen hang on the last, but in
# words of an even number of letters the hyphen hangs on the word after or, at the end, the first: such words stay three.
@query(rf"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark),
e AS (SELECT item_id, p, ws[p] AS x, p < len(ws) AND length(ws[p]) >= 8 AND length(ws[p]) % 2 = 0 AS torn FROM w, range(1, len(ws) + 1) t(p)),
n AS (SELECT item_id, p, CASE WHEN length(x) < 8 THEN [x] WHEN torn THEN [substr(x, 1, 4), '-', substr(x, 5)] ELSE [substr(x, 1, 4) || '-' || substr(x, 5)] END AS fs FROM e)
SELECT item_id, string_agg(array_to_string(fs, ' '), ' ' ORDER BY p) AS forms, CAST(sum(len(fs)) AS BIGINT) AS words, CAST(sum(len(fs)) AS BIGINT) AS heads_inside FROM n GROUP BY item_id""")
def merged_hyphens(spark, sf_dir):
    """A treebank file of words and their parts, read with hyphen groups merged where they have one head."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("ws"))
    each = words.select("item_id", F.posexplode("ws").alias("p", "x"), F.size("ws").alias("n"))
    long = F.length("x") >= 8
    parts = F.when(long, F.array(F.substring("x", 1, 4), F.lit("-"), F.substring("x", F.lit(5), F.length("x")))).otherwise(F.array("x"))
    torn = long & (F.length("x") % 2 == 0) & (F.col("p") + 1 < F.col("n"))
    flat = each.select("item_id", "p", torn.alias("torn"), F.posexplode(parts).alias("q", "form"), F.size(parts).alias("m"))
    order = F.struct("p", "q", "m", "torn", "form")
    rows = flat.groupBy("item_id").agg(F.array_sort(F.collect_list(order)).alias("ts"))
    inside = "CASE WHEN t.m = 3 AND t.q = 1 AND t.torn THEN i + 3 WHEN t.m = 3 AND t.q < 2 THEN i + 3 - t.q WHEN i + 1 = size(ts) THEN 0 ELSE i + 2 END"
    token = f"named_struct('id', i + 1, 'form', t.form, 'lemma', lower(t.form), 'upos', 'X', 'xpos', '_', 'feats', '_', 'head', {inside}, 'deprel', 'dep', 'space_after', t.q + 1 = t.m)"
    made = rows.select(F.col("item_id").cast("string").alias("sent_id"), F.lit("-").alias("text"), F.expr(f"transform(ts, (t, i) -> {token})").alias("tokens"))
    read = parsing.merge_hyphens(files.conllu(spark, written(spark, lambda path: files.to_conllu(made).write.text(path))))
    inside = F.size(F.filter("tokens", lambda t: t["head"].between(0, F.size("tokens"))))
    return read.select(F.col("sent_id").cast("long").alias("item_id"), F.array_join(F.transform("tokens", lambda t: t["form"]), " ").alias("forms"), F.size("tokens").cast("long").alias("words"), inside.cast("long").alias("heads_inside"))


_KINDS = {"nsubj": "subj", "obj": "obj", "det": "iobj", "advmod": "adv", "case": "pred", "aux": "neg", "conj": "conn", "ccomp": "nachfeld"}
_KIND_SQL = f"CASE c.deprel {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in _KINDS.items())} END"
_ORDER = "CASE WHEN kind = 'obj' AND n < 3 THEN 2 WHEN kind = 'iobj' AND n < 3 THEN 3 WHEN kind = 'conn' OR (kind = 'adv' AND pos < verb) THEN 4 ELSE CASE kind WHEN 'subj' THEN 0 WHEN 'iobj' THEN 5 WHEN 'neg' THEN 7 WHEN 'pred' THEN 8 ELSE 6 END END"


@query(f"""WITH RECURSIVE {SENTENCES_SQL},
up AS (SELECT sent_id, i, i AS top FROM g UNION ALL SELECT up.sent_id, up.i, g.head FROM up JOIN g ON g.sent_id = up.sent_id AND g.i = up.top WHERE g.head > 0),
v AS (SELECT sent_id, i AS verb, form, (['main', 'sub', 'um', 'imperative'])[k % 4 + 1] AS type FROM g WHERE head = 0),
p AS (SELECT v.sent_id, verb, type, c.i AS pos, {_KIND_SQL} AS kind, count(*) AS n, string_agg(m.form, ' ' ORDER BY m.i) AS words FROM v JOIN g c ON c.sent_id = v.sent_id AND c.head = verb JOIN up ON up.sent_id = v.sent_id AND up.top = c.i JOIN g m ON m.sent_id = up.sent_id AND m.i = up.i GROUP BY ALL),
a AS (SELECT *, min(pos) FILTER (kind = 'subj') OVER (PARTITION BY sent_id) AS subject FROM p),
f AS (SELECT *, CASE WHEN type <> 'main' THEN NULL WHEN kind NOT IN ('subj', 'neg', 'pred', 'nachfeld') AND pos < least(verb, coalesce(subject, verb)) THEN CASE kind WHEN 'conn' THEN 2 ELSE 0 END WHEN pos = subject THEN 1 END AS rank FROM a),
o AS (SELECT *, rank IS NOT NULL AND row_number() OVER (PARTITION BY sent_id ORDER BY rank NULLS LAST, pos) = 1 AS front FROM f),
z AS (SELECT sent_id, CASE WHEN kind = 'nachfeld' THEN 9 WHEN front THEN 2 ELSE 4 END AS zone, CASE WHEN front OR kind = 'nachfeld' THEN 0 ELSE {_ORDER} END AS key, pos, words FROM o
UNION ALL SELECT sent_id, CASE WHEN type IN ('main', 'imperative') THEN 3 ELSE 8 END, 0, 0, CASE type WHEN 'um' THEN 'zu ' || form ELSE form END FROM v UNION ALL SELECT sent_id, 1, 0, 0, 'um' FROM v WHERE type = 'um')
SELECT sent_id, string_agg(words, ' ' ORDER BY zone, key, pos) AS words FROM z GROUP BY sent_id""")
def ordered_clauses(spark, sf_dir):
    """Every tree as a German clause: the root is its verb, what hangs on it its parts, pronouns if they are short."""
    # The file is read once, and a tree's spans are found and cut in its row: rows are clauses and their parts then.
    phrases = F.filter(parsing.phrases("tokens"), lambda p: p["label"] != "-")
    rows = cut(trees(spark, sf_dir).select(F.col("sent_id").alias("clause_id"), "tokens", phrases.alias("phrases")))
    roots = rows.select("*", F.explode(F.filter("tokens", lambda t: t["head"] == 0)).alias("root"))
    kind = F.expr("array('main', 'sub', 'um', 'imperative')[length(root.form) % 4]")
    um = F.col("type") == "um"
    heads = roots.withColumn("type", kind).select("clause_id", "type", F.col("root.id").alias("verb_pos"), F.when(~um, F.col("root.form")).alias("finite"), F.when(um, F.array(F.lit("zu"), "root.form")).otherwise(F.array().cast("array<string>")).alias("rest"), F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("array<string>").alias("fixed"), F.lit(None).cast("array<string>").alias("intro"))
    kids = roots.select("*", F.explode(F.filter("tokens", lambda t: t["head"] == F.col("root.id"))).alias("kid"))
    end = lambda side, pick: F.coalesce(pick(F.transform(F.filter("phrases", lambda p: p["id"] == F.col("kid.id")), lambda p: p[side])), "kid.id")
    first, last = end("first", F.array_min), end("last", F.array_max)
    words = F.transform(F.slice("tokens", first, last - first + 1), lambda t: t["form"])
    kind = F.coalesce(*(F.when(F.col("kid.deprel") == k, v) for k, v in _KINDS.items()))
    parts = kids.select("clause_id", kind.alias("kind"), F.col("kid.id").alias("pos"), (F.size(words) < 3).alias("pronoun"), F.lit(False).alias("clause"), words.alias("words"))
    return clauses.linearized(heads, parts).select(F.col("clause_id").alias("sent_id"), F.array_join("words", " ").alias("words"))
