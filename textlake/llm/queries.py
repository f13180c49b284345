"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import ann, bpe, decontam, divergence, langid, quality, repair, secrets, sigtree, simhash, substrings, tokencount, urls
from textlake.llm.shared import held_out, table

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Least score that counts as good.
GOOD = 0.7
BPE_FILE = "byte_bpe_50k.tiktoken"
PIECES_FILE = "piece_bpe_32k.model"


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 100, among all others."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages: mixed text without secrets."""
    return table(spark, sf_dir, "pages").select(F.col("url").alias("text")).filter("text IS NOT NULL")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole document: base spans, and those the conditional random field adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs, plain=addresses(spark, sf_dir)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.fit(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, links at two bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = table(spark, sf_dir, "pages")
    found = urls.judge(pages.select("page_id", "url"), urls.fit(pages), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "block_odds")


def op6_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every whole document, counted only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, public_tokenizers.path(PIECES_FILE)).select("doc_id", "n_tokens")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole document's byte-level BPE ids and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, decoded=True)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return done.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that repeated windows of 20 words cover."""
    done = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """The quality classifier, learned from labelled documents that are not held out."""
    return quality.fit(quality.training_rows(docs, table(spark, sf_dir, "labels"), learn_from=~held_out()))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = quality.score(docs, quality_model(spark, docs, sf_dir))
    return done.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item of any length that it holds."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shortest=1)


def op11_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of four-word shingles of every whole document, and their components at a similarity of 0.85."""
    return sigtree.join(table(spark, sf_dir, "documents"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with turns dropped, emptied, cut, repeated or given to the user, by a hash of conversation and turn.

    `times` is how often a turn stands then. Nulls count as one space, in the hash too.
    """
    names = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fate = F.crc32(F.concat(names[0], F.lit(":"), names[1]).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(names[3], "[.!?]", "")).otherwise(names[3])
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(names[2]).alias("role"), text.alias("text"), times.alias("times"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and least repair of every conversation, after damage."""
    return repair.digests(repair.repair(damaged(table(spark, sf_dir, "conversations")), times="times"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of sources and terms that set them apart, over every whole document."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that corpus_pipeline.run() makes of documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ann, op2_secrets, op3_langid, op4_simhash, op5_urls, op6_tokencount, op7_bpe, op8_substrings, op9_quality, op10_decontam, op11_ngramjoin, op12_repair, op13_divergence, pipeline)}

# Windows of 20 words that also start earlier, the words they cover, what is left.
SUBSTRINGS_SQL = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, row_number() OVER (PARTITION BY ws[i:i + 19] ORDER BY doc_id, i) AS r FROM w, range(1, len(ws) - 18) t(i)),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM win, range(0, 20) t(o) WHERE r > 1),
each AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS k FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

# Where at most m of `size` places differ, some ceil((size - m) / (m + 1)) in a row agree: so many words find every
# pair, whatever the item's size, then places are counted.
DECONTAM_SQL = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item_id, w, least(13, len(w)) AS size, least(13, len(w)) - greatest(ceil(least(13, len(w)) * 0.8 - 1e-9), 1) AS m FROM b WHERE len(w) > 0),
i AS (SELECT item_id, w, size, CAST(ceil((size - m) / (m + 1)) AS BIGINT) AS run FROM s),
dg AS (SELECT doc_id, run, k, w[k:k + run - 1] AS g FROM d, (SELECT DISTINCT run FROM i), range(1, len(w) - run + 2) t(k)),
bg AS (SELECT item_id, run, k, w[k:k + run - 1] AS g FROM i, range(1, len(w) - run + 2) t(k)),
c AS (SELECT DISTINCT doc_id, item_id, dg.k - bg.k AS shift FROM dg JOIN bg USING (run, g)),
a AS (SELECT doc_id, item_id, shift, size, j, CAST(d.w[j + shift] = i.w[j] AS INTEGER) AS same FROM c JOIN d USING (doc_id) JOIN i USING (item_id), range(1, len(i.w) + 1) t(j) WHERE j + shift BETWEEN 1 AND len(d.w)),
m AS (SELECT doc_id, item_id, size, j + shift - 1 AS place, sum(same) OVER f AS matched, count(*) OVER f AS n FROM a WINDOW f AS (PARTITION BY doc_id, item_id, shift ORDER BY j ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, place) AS r FROM m WHERE n = size)
SELECT doc_id, item_id, CAST(matched AS BIGINT) AS matched, CAST(size AS BIGINT) AS "window", CAST(place AS BIGINT) AS place FROM k WHERE r = 1 AND matched >= ceil(size * 0.8 - 1e-9)"""

# A turn is read from four points of the grammar (nothing, system, user, pairs); of each, the least (cost, audit,
# lines). Before a turn up to two may be inserted. CRC-32 is folded from its table.
REPAIR_SQL = r"""WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
h AS (SELECT n.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(id, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, b: xor(t[xor(a & 255, b) + 1], a >> 8)), 4294967295) % 20 AS fate FROM n, tab),
g AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) k(k)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM g),
f AS (SELECT *, lag(role[1]) OVER w AS prior, CASE WHEN core = '' THEN 0 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 1 WHEN core[-1] NOT IN ('.', '!', '?') THEN 2 ELSE 3 END AS fault FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
x AS (SELECT *, {'r': role[1], 'role': role, 'text': text, 'gone': fault < 2, 'late': CASE fault WHEN 2 THEN 3 ELSE 0 END,
  's0': {'c': 0, 'a': '', 'l': ''}, 's1': {'c': 9000000, 'a': '', 'l': ''}, 's2': {'c': 9000000, 'a': '', 'l': ''}, 's3': {'c': 9000000, 'a': '', 'l': ''}} AS e FROM f),
v AS (SELECT conv_id, list_prepend({'r': '', 'role': '', 'text': '', 'gone': false, 'late': 0, 's0': {'c': 0, 'a': '', 'l': ''}, 's1': {'c': 9000000, 'a': '', 'l': ''}, 's2': {'c': 9000000, 'a': '', 'l': ''}, 's3': {'c': 9000000, 'a': '', 'l': ''}}, list(e ORDER BY pos)) AS es,
  max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 0) AS blank, count(*) FILTER (fault = 1) AS duplicate, count(*) FILTER (fault = 2) AS truncated,
  count(*) FILTER (prior IS NOT NULL AND prior || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id),
w AS (SELECT *, list_reduce(es, lambda p, q: list_transform([{
    'u': list_min([p.s2, {'c': p.s0.c + 3, 'a': p.s0.a || 'I', 'l': p.s0.l || chr(10) || 'user:'}, {'c': p.s1.c + 3, 'a': p.s1.a || 'I', 'l': p.s1.l || chr(10) || 'user:'}, {'c': p.s3.c + 3, 'a': p.s3.a || 'I', 'l': p.s3.l || chr(10) || 'user:'}]),
    'w': list_min([p.s3, {'c': p.s2.c + 3, 'a': p.s2.a || 'I', 'l': p.s2.l || chr(10) || 'assistant:'}, {'c': p.s0.c + 6, 'a': p.s0.a || 'II', 'l': p.s0.l || chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': p.s1.c + 6, 'a': p.s1.a || 'II', 'l': p.s1.l || chr(10) || 'user:' || chr(10) || 'assistant:'}])}],
   lambda i: {'r': q.r, 'role': q.role, 'text': q.text, 'gone': q.gone, 'late': q.late,
    's0': {'c': p.s0.c + 4, 'a': p.s0.a || 'D', 'l': p.s0.l},
    's1': list_min([{'c': p.s1.c + 4, 'a': p.s1.a || 'D', 'l': p.s1.l}, {'c': CASE WHEN q.gone OR q.r <> 's' THEN 9000000 ELSE p.s0.c + q.late END, 'a': p.s0.a || 'K', 'l': p.s0.l || chr(10) || q.role || ':' || q.text}]),
    's2': list_min([{'c': i.u.c + 4, 'a': i.u.a || 'D', 'l': i.u.l}] || list_transform([p.s0, p.s1, i.w], lambda z: {'c': z.c + q.late + CASE WHEN q.gone THEN 9000000 WHEN q.r = 'u' THEN 0 ELSE 3 END, 'a': z.a || CASE q.r WHEN 'u' THEN 'K' ELSE 'R' END, 'l': z.l || chr(10) || CASE q.r WHEN 'u' THEN q.role ELSE 'user' END || ':' || q.text})),
    's3': list_min([{'c': i.w.c + 4, 'a': i.w.a || 'D', 'l': i.w.l}, {'c': i.u.c + q.late + CASE WHEN q.gone THEN 9000000 WHEN q.r = 'a' THEN 0 ELSE 3 END, 'a': i.u.a || CASE q.r WHEN 'a' THEN 'K' ELSE 'R' END, 'l': i.u.l || chr(10) || CASE q.r WHEN 'a' THEN q.role ELSE 'assistant' END || ':' || q.text}])})[1]) AS z FROM v),
b AS (SELECT *, list_min([z.s0, z.s3, {'c': z.s2.c + 3, 'a': z.s2.a || 'I', 'l': z.s2.l || chr(10) || 'assistant:'}, {'c': z.s1.c + 6, 'a': z.s1.a || 'II', 'l': z.s1.l || chr(10) || 'user:' || chr(10) || 'assistant:'}]) AS best FROM w)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(substr(coalesce(best.l, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN b ON k.conv_id IS NOT DISTINCT FROM b.conv_id"""

DIVERGENCE_SQL = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT lang, source, r, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
  1 + (CAST(1000000000 AS HUGEINT) * (sum(n) OVER (PARTITION BY lang, term) + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM s JOIN v USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM y WHERE part = 'pair' OR rank <= 50"""

NGRAMJOIN_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, range(1, greatest(len(w) - 2, 2)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

ORACLES = {"op8_substrings": SUBSTRINGS_SQL, "op10_decontam": DECONTAM_SQL, "op11_ngramjoin": NGRAMJOIN_SQL, "op12_repair": REPAIR_SQL, "op13_divergence": DIVERGENCE_SQL}
