"""Registered queries of reading aloud. Orders, lines and customers give the numbers that their sentences hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions.numerals import DIGITS, HUNDRED, MONTHS, STEMS
from textlake.operators import aloud, reading
from textlake.plans.queries import query, table

SHORT = [("z. B.", "zum Beispiel", "any"), ("d. h.", "das heißt", "any"), ("bzw.", "beziehungsweise", "any"), ("usw.", "und so weiter", "end"), ("Nr.", "Nummer", "number"), ("ca.", "circa", "any"), ("Mio.", "Millionen", "any"), ("Dr.", "Doktor", "any"), ("Prof.", "Professor", "any"), ("vgl.", "vergleiche", "any"), ("Abb.", "Abbildung", "number")]
NAMES = [("RAM", "Ramm"), ("NASA", "'Nasa"), ("JSON", "'Dschäison"), ("C++", "Zeh plus plus")]


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(SHORT, reading.ABBREVIATIONS), spark.createDataFrame(NAMES, reading.READINGS)


def _list(words: list[str]) -> str:
    return f"[{', '.join(repr(w) for w in words)}]"


def group_sql(n: str) -> str:
    return f"(CASE WHEN {n} // 100 > 1 THEN ({_list(DIGITS)})[{n} // 100 + 1] ELSE '' END || CASE WHEN {n} // 100 > 0 THEN 'hundert' ELSE '' END || CASE WHEN {n} % 100 > 0 THEN ({_list(HUNDRED)})[{n} % 100 + 1] ELSE '' END)"


def cardinal_sql(n: str) -> str:
    """Up to 999,999,999."""
    million = f"CASE WHEN {n} // 1000000 = 0 THEN '' WHEN {n} // 1000000 = 1 THEN 'eine Million ' ELSE {group_sql(f'({n} // 1000000)')} || ' Millionen ' END"
    thousand = f"CASE WHEN {n} // 1000 % 1000 = 0 THEN '' WHEN {n} // 1000 % 1000 = 1 THEN 'tausend' ELSE regexp_replace({group_sql(f'({n} // 1000 % 1000)')}, 'eins$', 'ein') || 'tausend' END"
    return f"CASE WHEN {n} = 0 THEN 'null' ELSE trim({million} || {thousand} || {group_sql(f'({n} % 1000)')}) END"


def year_sql(n: str) -> str:
    return f"CASE WHEN {n} BETWEEN 1100 AND 1999 THEN ({_list(HUNDRED)})[{n} // 100 + 1] || 'hundert' || CASE WHEN {n} % 100 > 0 THEN ({_list(HUNDRED)})[{n} % 100 + 1] ELSE '' END ELSE {cardinal_sql(n)} END"


ORDERS_SQL = f"""o AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS c, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders),
w AS (SELECT k, 'Am ' || ({_list(STEMS)})[d + 1] || 'en ' || ({_list(MONTHS)})[m] || ' ' || {year_sql('y')} || ' kamen ' || CASE WHEN k = 1 THEN 'ein' ELSE {year_sql('k')} END || ' Posten für ' || {cardinal_sql('(c // 100)')} || ' Komma ' || ({_list(DIGITS)})[c // 10 % 10 + 1] || ' ' || ({_list(DIGITS)})[c % 10 + 1] || ' Euro, das heißt der ' || ({_list(STEMS)})[k % 99 + 2] || 'e Teil von ' || {cardinal_sql('(k % 7 + 2)')} || ' bis ' || {cardinal_sql('(k % 7 + 20)')} || '.' AS spoken FROM o)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, text): a sentence of every order with its date, number, price, an ordinal and a range. Orders are few bytes each and
    their sentences much work, so they are dealt to all tasks, however few their files are."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"), "o_orderdate")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    price = F.format_string("%d,%02d €", F.floor(F.col("c") / 100), F.col("c") % 100)
    text = F.concat(F.date_format("o_orderdate", "'Am 'd.M.yyyy' kamen '"), F.col("k").cast("string"), F.lit(" Posten für "), price, F.lit(", d. h. der "), (F.col("k") % 99 + 1).cast("string"), F.lit(". Teil von "), F.concat_ws("–", F.col("k") % 7 + 2, F.col("k") % 7 + 20), F.lit("."))
    return rows.select("k", text.alias("text"))


@query(f"WITH {ORDERS_SQL} SELECT k, spoken FROM w")
def spoken_orders(spark, sf_dir):
    """A sentence of every order in words."""
    return aloud.read(_orders(spark, sf_dir), *_tables(spark)).select("k", "spoken")


#: Customers' balances, each in a category of its own, and what is expected: in every ninth row what is written.
@query(f"""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, CAST(abs(round(c_acctbal * 100)) AS BIGINT) AS b FROM customer),
g AS (SELECT CASE WHEN k % 9 = 0 THEN 0 ELSE 1 END AS ok, (['zahl', 'ordinal', 'einheit', 'bruch'])[k % 4 + 1] AS category FROM c)
SELECT category, count(*) AS cases, CAST(sum(ok) AS BIGINT) AS correct, round(sum(ok) / count(*), 6) AS accuracy FROM g GROUP BY GROUPING SETS ((category), ())""")
def normalization_accuracy(spark, sf_dir):
    """How many of the customers' lines are read as expected, by category and in all; the words expected are joined from
    tables of number words, not made by the reader."""
    stems = spark.createDataFrame([(i, w, s) for i, (w, s) in enumerate(zip(HUNDRED, STEMS, strict=True))], "n int, word string, stem string")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 98 + 2).cast("int").alias("n")).join(F.broadcast(stems), "n")
    n, word, stem = F.col("n").cast("string"), F.col("word"), F.col("stem")
    forms = [("zahl", F.concat(F.lit("Es sind "), n, F.lit(" Zeilen.")), F.concat(F.lit("Es sind "), word, F.lit(" Zeilen."))), ("ordinal", F.concat(F.lit("Im "), n, F.lit(". Abschnitt.")), F.concat(F.lit("Im "), stem, F.lit("en Abschnitt."))), ("einheit", F.concat(F.lit("Er braucht "), n, F.lit(" ms.")), F.concat(F.lit("Er braucht "), word, F.lit(" Millisekunden."))), ("bruch", F.concat(F.lit("Es gilt "), n, F.lit(":1.")), F.concat(F.lit("Es gilt "), word, F.lit(" zu eins.")))]
    row = F.get(F.array(*(F.struct(F.lit(c).alias("category"), t.alias("text"), w.alias("expected")) for c, t, w in forms)), (F.col("k") % 4).cast("int"))
    lines = rows.select("k", row.alias("r")).select("k", "r.category", "r.text", F.when(F.col("k") % 9 == 0, F.col("r.text")).otherwise(F.col("r.expected")).alias("expected"))
    return reading.accuracy(reading.read(lines, "k", *_tables(spark))).withColumnRenamed("right", "correct")


@query()
def spoken_documents(spark, sf_dir):
    """Every sentence of the German documents in words."""
    docs = table(spark, sf_dir, "documents").filter("lang = 'de'").select("doc_id", "text")
    return reading.prepare(docs, "doc_id", *_tables(spark)).select("doc_id", "paragraph", "sentence", "spoken", "changed")
