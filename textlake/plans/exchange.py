"""Registered queries of text that leaves and enters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textlake.operators import exchange
from textlake.plans.evaluation import written
from textlake.plans.queries import query, table

KINDS = ["NOUN", "VERB"]


@query("""WITH f AS (SELECT p_name AS en, CASE WHEN p_partkey % 3 = 0 THEN 'VERB' ELSE 'NOUN' END AS pos, p_brand AS de, CASE WHEN p_partkey % 2 = 0 THEN 'tech' ELSE 'general' END AS domain, p_partkey AS k FROM part),
old AS (SELECT DISTINCT lower(en) AS l, pos, de, domain FROM f WHERE k % 5 = 0), new AS (SELECT DISTINCT lower(en) AS l, min(en) OVER (PARTITION BY lower(en), pos, de, domain) AS en, pos, de, domain FROM f WHERE k % 4 <> 1),
last AS (SELECT l, pos, count(*) AS n FROM old GROUP BY l, pos)
SELECT en, pos, de, domain, CAST(row_number() OVER (PARTITION BY l, pos ORDER BY de, domain) + coalesce(n, 0) - 1 AS INTEGER) AS rank FROM (SELECT * FROM new WHERE (l, pos, de, domain) NOT IN (SELECT l, pos, de, domain FROM old)) LEFT JOIN last USING (l, pos)""")
def lexicon_transfer(spark, sf_dir):
    """Parts as lexicon entries written as a file and read into a lexicon that has every fifth of them."""
    pos, domain = F.when(F.col("p_partkey") % 3 == 0, "VERB").otherwise("NOUN"), F.when(F.col("p_partkey") % 2 == 0, "tech").otherwise("general")
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("en"), pos.alias("pos"), F.col("p_brand").alias("de"), none.alias("gender"), none.alias("plural"), none.alias("extra"), domain.alias("domain"), F.col("p_partkey").alias("k"))
    old = rows.filter("k % 5 = 0").groupBy("en", "pos", "de", "domain").agg(F.first("gender").alias("gender"), F.first("plural").alias("plural"), F.first("extra").alias("extra"))
    old = old.withColumn("rank", F.row_number().over(Window.partitionBy(F.lower("en"), "pos").orderBy("de", "domain")) - 1)
    path = written(spark, lambda path: exchange.lexicon_lines(rows.filter("k % 4 <> 1").withColumn("rank", F.lit(0))).write.text(path))
    return exchange.imported(spark, path, old, KINDS).select("en", "pos", "de", "domain", "rank")


@query(r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, list_reduce(list_prepend('', ws), lambda a, w: CASE WHEN a = '' THEN w WHEN length(a) - length(regexp_extract(a, '^(?s:.*)\n')) + 1 + length(w) > 78 THEN a || chr(10) || w ELSE a || ' ' || w END) AS t FROM d)
SELECT doc_id, CAST(len(string_split(t, chr(10))) AS BIGINT) AS lines, sha256('  ' || replace(t, chr(10), chr(10) || '  ')) AS digest FROM l""")
def wrapped_documents(spark, sf_dir):
    """Every document in lines of at most 80 characters, two of them indent."""
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", exchange.wrapped(F.col("text"), 80, "  ").alias("ls"))
    return rows.select("doc_id", F.size("ls").cast("long").alias("lines"), F.sha2(F.array_join("ls", "\n"), 256).alias("digest"))


@query("""WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n, min(c_custkey) AS f FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY ALL)
SELECT nation, segment, n FROM c QUALIFY row_number() OVER (PARTITION BY nation ORDER BY n DESC, f) = 1""")
def commonest_segments(spark, sf_dir):
    """Each nation's commonest market segment, of equal ones the one met first."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_custkey")
    return exchange.most_common(rows, "nation", "segment", "c_custkey")
