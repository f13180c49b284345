"""Reading aloud: golden sentences of every kind of token, context, tidy text, odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from textlake.functions import numerals, udfs
from textlake.operators import reading
from textlake.plans.reading import NAMES, SHORT

# Sentences and how they are read.
GOLD = [
    ("Es gibt 1024 mögliche Zustände.", "Es gibt tausendvierundzwanzig mögliche Zustände."),
    ("Die Tabelle hat 1.000.000 Zeilen.", "Die Tabelle hat eine Million Zeilen."),
    ("Insgesamt wurden 12 345 Dokumente geprüft.", "Insgesamt wurden zwölftausenddreihundertfünfundvierzig Dokumente geprüft."),
    ("Der Wert liegt bei -5.", "Der Wert liegt bei minus fünf."),
    ("Nach 1 Durchlauf ist das Ergebnis fertig.", "Nach einem Durchlauf ist das Ergebnis fertig."),
    ("Seit 1969 gibt es das Netz.", "Seit neunzehnhundertneunundsechzig gibt es das Netz."),
    ("In den 1950er-Jahren war der Begriff neu.", "In den neunzehnhundertfünfziger Jahren war der Begriff neu."),
    ("In den 80er Jahren entstanden Expertensysteme.", "In den achtziger Jahren entstanden Expertensysteme."),
    ("Die 2. Auflage erschien später.", "Die zweite Auflage erschien später."),
    ("Er belegte den 7. Platz.", "Er belegte den siebten Platz."),
    ("Die Ergebnisse stehen in der 4. Spalte.", "Die Ergebnisse stehen in der vierten Spalte."),
    ("Ein 2. Versuch war erfolgreich.", "Ein zweiter Versuch war erfolgreich."),
    ("Die Konferenz fand vom 12. bis 14. Juni statt.", "Die Konferenz fand vom zwölften bis vierzehnten Juni statt."),
    ("Der Anteil beträgt 3,5 %.", "Der Anteil beträgt drei Komma fünf Prozent."),
    ("Die Ausgabe 3.11 ist schneller.", "Die Ausgabe drei Punkt elf ist schneller."),
    ("Rund 3/4 der Nutzer stimmten zu.", "Rund drei Viertel der Nutzer stimmten zu."),
    ("Das Verhältnis beträgt 3:1.", "Das Verhältnis beträgt drei zu eins."),
    ("Die Datei ist 1 MB groß.", "Die Datei ist ein Megabyte groß."),
    ("Ein Zugriff dauert 1 ms.", "Ein Zugriff dauert eine Millisekunde."),
    ("Die Temperatur stieg auf 85 °C.", "Die Temperatur stieg auf fünfundachtzig Grad Celsius."),
    ("Am 12.03.2021 wurde die Studie veröffentlicht.", "Am zwölften März zweitausendeinundzwanzig wurde die Studie veröffentlicht."),
    ("Das Treffen beginnt um 14:30 Uhr.", "Das Treffen beginnt um vierzehn Uhr dreißig."),
    ("Gauß lebte 1777–1855.", "Gauß lebte siebzehnhundertsiebenundsiebzig bis achtzehnhundertfünfundfünfzig."),
    ("Das gilt z.B. für Datenbanken.", "Das gilt zum Beispiel für Datenbanken."),
    ("Prof. Dr. Weber leitet das Projekt.", "Professor Doktor Weber leitet das Projekt."),
    ("Siehe vgl. Abb. 3 hier.", "Siehe vergleiche Abbildung drei hier."),
    ("Das System kostet 3 Mio. Euro.", "Das System kostet drei Millionen Euro."),
    ("Die CPU führt Befehle aus.", "Die Zeh Peh Uh führt Befehle aus."),
    ("Mehrere GPUs rechnen parallel.", "Mehrere Geh Peh Uhs rechnen parallel."),
    ("Das Projekt wurde von der DARPA gefördert.", "Das Projekt wurde von der Darpa gefördert."),
    ("Die DSGVO regelt den Datenschutz.", "Die Deh Ess Geh Fau Oh regelt den Datenschutz."),
    ("Das Protokoll IPv6 ersetzt IPv4.", "Das Protokoll Ih Peh Fau sechs ersetzt Ih Peh Fau vier."),
    ("Die Sprache Fortran II war verbreitet.", "Die Sprache Fortran zwei war verbreitet."),
    ("Die Sprache C++ ist schnell.", "Die Sprache Zeh plus plus ist schnell."),
    ("Die Laufzeit ist O(n log n).", "Die Laufzeit ist Oh von Enn log Enn."),
    ("Im schlechtesten Fall gilt O(n²).", "Im schlechtesten Fall gilt Oh von Enn Quadrat."),
    ("Es gibt 2^10 Möglichkeiten.", "Es gibt zwei hoch zehn Möglichkeiten."),
    ("Mehr unter https://de.wikipedia.org/wiki/Compiler.", "Mehr unter Deh Eh Punkt wikipedia Punkt org."),
    ("Schreiben Sie an info@example.de.", "Schreiben Sie an info at example Punkt Deh Eh."),
    ("Mehrere Arbeiten [3, 4] bestätigen das.", "Mehrere Arbeiten bestätigen das."),
    ("Laut § 9a ist das erlaubt.", "Laut Paragraf neun Ah ist das erlaubt."),
]
# Sentences of our own, for rules the others leave out.
OWN = [
    ("Es kostet 1 Mio. Euro.", "Es kostet eine Million Euro."),
    ("Nach 1 Übung ist Schluss.", "Nach einer Übung ist Schluss."),
    ("Es blieb 1, Auto fort.", "Es blieb eins, Auto fort."),
    ("1. Einleitung", "eins, Einleitung."),
    ("Um 9:05 ist Beginn.", "Um neun Uhr fünf ist Beginn."),
    ("J. von Neumann (siehe O(n)) war da!", "Jott von Neumann, siehe Oh von Enn, war da!"),
    ("Die Nummer #7 und 0049 und 12345678901234567890.", "Die Nummer Nummer sieben und null null vier neun und eins zwei drei vier fünf sechs sieben acht neun null eins zwei drei vier fünf sechs sieben acht neun null."),
    ("Am 31.12.99 und 45.13.2020.", "Am einunddreißigsten Dezember neunundneunzig und fünfundvierzig dreizehn zweitausendzwanzig."),
    ("Ja... nein. Doch", "Ja, nein, Doch."),
    ("", ""),
    ("   ", ""),
    ("?!", ""),
]


def words(text):
    return re.findall(r"\w+", text.lower())


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame([*SHORT, ("Nr.", "doppelt", "any")], reading.ABBREVIATIONS), spark.createDataFrame(NAMES, reading.READINGS)


def test_sentences(spark, tables):
    cases = [*GOLD, *OWN]
    rows = spark.createDataFrame([(i, t, "x", "y") for i, (t, _) in enumerate(cases)] + [(-1, None, "x", "y")], "id long, text string, t string, kind string")
    got = {r["id"]: r for r in reading.read(rows, "id", *tables).collect()}
    assert got[-1]["spoken"] is None and got[-1]["tokens"] is None
    for i, (text, want) in enumerate(cases):
        assert words(got[i]["spoken"]) == words(want), text
        assert "".join(t["text"] for t in got[i]["tokens"]) == text
    for i, (_, want) in enumerate(OWN):
        assert got[len(GOLD) + i]["spoken"] == want


def test_options_and_english(spark, tables):
    english = spark.createDataFrame([("Deep Learning", "'Diep 'Lörning"), ("Cloud", "'Klaud")], reading.READINGS)
    rows = spark.createDataFrame([(1, "Deep Learning in der Cloud [12] auf www.w3.org/x1.")], "id long, text string")
    said = reading.read(rows, "id", *tables, english=english, citations=True, urls="full").first()["spoken"]
    assert said == "Diep Lörning in der Klaud Quelle zwölf auf Weh drei Punkt org Schrägstrich Iks eins."
    assert reading.read(rows, "id", *tables, urls="skip").first()["spoken"] == "Deep Learning in der Cloud auf."


def test_numerals(spark):
    numbers = [*range(0, 1300, 7), 1000, 1001, 21_001, 100_000, 123_456, 999_999, 10**6, 2_000_001, 10**9, 5 * 10**12 + 7, -3]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long")
    n = F.col("n")
    got = rows.select("n", numerals.cardinal(n).alias("c"), numerals.year(n).alias("y"), F.when(n.between(1, 999), numerals.ordinal_stem(n)).alias("o"), numerals.cardinal(F.lit(10**15)).alias("none")).collect()
    for r in got:
        assert r["c"] == udfs.german_cardinal(r["n"]) and r["y"] == udfs.german_year(r["n"]) and r["none"] is None
        assert r["o"] is None or r["o"] + "e" == udfs.german_ordinal(r["n"])


def test_documents(spark, tables):
    docs = spark.createDataFrame([(1, "Am 3. Mai ist es so. Dann 5 %.\n\nEnde"), (2, None), (3, "")], "doc_id long, text string")
    got = reading.prepare(docs, "doc_id", *tables).orderBy("doc_id", "paragraph", "sentence").collect()
    assert [(r["doc_id"], r["paragraph"], r["spoken"], r["changed"]) for r in got] == [(1, 0, "Am dritten Mai ist es so.", 1), (1, 0, "Dann fünf Prozent.", 1), (1, 1, "Ende.", 0)]
    none = docs.filter("doc_id > 9")
    assert reading.prepare(none, "doc_id", *tables).collect() == []


def test_accuracy(spark):
    rows = spark.createDataFrame([("a", "Ein  Wort.", "ein wort"), ("a", None, "x"), ("b", "drei", "drei")], "category string, spoken string, expected string")
    got = {r["category"]: (r["cases"], r["right"], r["accuracy"]) for r in reading.accuracy(rows).collect()}
    assert got == {"a": (2, 1, 0.5), "b": (1, 1, 1.0), None: (3, 2, 0.666667)}


def test_tokens_are_not_broadcast(spark):
    """Tokens of all sentences compress well, but are as many as the sentences': only the two given tables are broadcast."""
    tables = [spark.createDataFrame([], s) for s in (reading.ABBREVIATIONS, reading.READINGS)]
    rows = spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("Am 3. Mai kamen "), F.col("id").cast("string"), F.lit(" Posten.")).alias("text"))
    done = reading.read(rows, "k", *tables).select("k", "spoken")
    assert "Am dritten Mai kamen sieben Posten." in [r["spoken"] for r in done.collect()]
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin [t#" not in "".join(x for x in plan.split("\n") if "LeftOuter" not in x)


def test_read_where_sentences_lie(spark):
    """aloud.read() makes the tokens and words of read(), of whatever a sentence holds, and shuffles nothing."""
    from textlake.operators import aloud

    texts = """Am 3.4.2021 kamen 1 Posten für 144449,04 €, d. h. der 1. Teil von 2–20.|Der 3. Mai, am 31.12.99 und 41.13.2020 um 8:30 Uhr, gegen 9:15, 3:1 und 25:99 Uhr.|1. Punkt. 2. Punkt im 3. Absatz (siehe Abb. 3 bzw. S. 4).
Die NASA und IBM, GPUs, CPUa, XML und die JSON-Datei in C++; Karl IV und XII.|Er las 1.234.567,8 km/h, -5 °C, 1 ms, 1 GB, 0,5 %, 1 Stunde, mit 1 Zeitung und 1 Haus, 1 Mio. Leute und 1 Mrd., 2 Mio.
https://www.example.org/a/b_c-2?x=1 und www.tu-berlin.de/ oder max.muster@uni-x1.de [3] [4, 5–7] […]|1990er, 80ern, 2000er-Jahren, 1914-1918, 7 – 9, 2.10.3, 3/4, 7/3, 1/2, 1/100, 99/101, x^2, 2^-10, a^n, f(x) und f(g(y)) (mit x).
12345678901234567890 und 007, 1000000000000000, 999999999999999; 1 000 000 Euro|A1, 3D, B2B, x86, Ab12Cd, É4|α + β ≤ γ² → ∅ & § 5 #7 # 3 * ~ _ \\ † @ © ½|"Zitat" ‚x‘ «y» – Strich – ... … ?! !? ;; ,, :|T. S. Eliot. J. Kant|
z.B. z. B. usw. Prof. Dr. Nr. 5 vgl. ca. 7 Nr. x|der im ein 5. Tag; ein 5. Tag; die 5. Stunde; in der 5. Stunde; 20. Januar; jeder 101. 111. 200. 999. Gast|ßÄÖ ÄÖÜ ÉTÉ naïve Ωmega привет 日本 😀 Привет1 \t tab \x0b|machine learning heißt Deep-Learning, Cloud, CLOUD 1 Cloud|1 Kette, 1 Ende, 1 Universität, nach 1 Minute. 1 UNIVERSITÄT|1,5 und -1 und −1 und 1100 1999 2000 1099 1.100 01|12:5 12:60 0:00 24:00 Uhr ab 7:05|||.|(|)|1""".replace("\n", "|").split("|")
    tables = spark.createDataFrame([("z. B.", "zum Beispiel", "any"), ("d. h.", "das heißt", "any"), ("bzw.", "beziehungsweise", "any"), ("usw.", "und so weiter", "end"), ("Nr.", "Nummer", "number"), ("ca.", "circa", "any"), ("Mio.", "Millionen", "after"), ("Mrd.", "Milliarden", "any"), ("Dr.", "Doktor", "any"), ("Abb.", "Abbildung", "number")], reading.ABBREVIATIONS), spark.createDataFrame([("NASA", "'Nasa"), ("JSON", "'Dschäison"), ("C++", "Zeh plus plus")], reading.READINGS)
    english = spark.createDataFrame([("machine learning", "maschin 'lörning"), ("Cloud", "Klaud"), ("Deep-Learning", "Diep Lörning")], reading.READINGS)
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "k int, text string")
    for options in ({}, {"citations": True, "urls": "full", "english": english}, {"urls": "skip", "english": english}):
        done = aloud.read(rows, *tables, **options)
        assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
        got, want = ({r["k"]: (r["spoken"], r["tokens"]) for r in df.collect()} for df in (done, reading.read(rows, "k", *tables, **options)))
        for k, w in want.items():
            assert got[k] == w, (texts[k], [(a, b) for a, b in zip(got[k][1] or [], w[1] or [], strict=False) if a != b][:3])
        assert len(got) == len(want) == len(texts) + 1


def test_spoken_orders_shuffle_no_token(spark, tmp_path):
    from textlake.plans.queries import QUERIES
    import textlake.plans.reading  # noqa: F401

    rows = spark.range(20).selectExpr("id AS o_orderkey", "CAST(id * 1000.5 AS DOUBLE) AS o_totalprice", "TIMESTAMP_NTZ '1997-01-15 00:00:00' AS o_orderdate")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    done = QUERIES["spoken_orders"](spark, str(tmp_path))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Generate" not in plan
    assert done.filter("k = 1").first()["spoken"] == "Am fünfzehnten Januar neunzehnhundertsiebenundneunzig kamen ein Posten für tausend Komma fünf null Euro, das heißt der zweite Teil von drei bis einundzwanzig."
