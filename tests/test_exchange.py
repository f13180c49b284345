"""Lexicon files, wrapped text against textwrap, tables, bytes, trees as lines, commonest values."""

import textwrap

from pyspark.sql import functions as F

from textlake.operators import exchange as X

ENTRIES = "en string, pos string, de string, gender string, plural string, extra string, domain string, rank int"


def test_lexicon(spark, tmp_path):
    old = spark.createDataFrame([("House", "NOUN", "Haus", "n", None, None, None, 0), ("house", "NOUN", "Bau", "m", "Bauten", "a\tb", "tech", 1), ("go", "VERB", "gehen", None, None, None, "general", 0)], ENTRIES)
    lines = [r["value"] for r in X.lexicon_lines(old).collect()]
    assert lines == ["# en\tpos\tde\tgender\tplural\textra\tdomain", "go\tVERB\tgehen\t\t\t\tgeneral", "House\tNOUN\tHaus\tn\t\t\t", "house\tNOUN\tBau\tm\tBauten\ta b\ttech"]
    path = tmp_path / "in.tsv"
    path.write_text("# kommentar\nhouse\tnoun\tHaus\n HOUSE \tnoun\tHeim\tn\nHouse\tnoun\tHeim\nhouse\tnoun\tHaus\t\t\t\ttech\nx\ty\nred\tADJ\trot\n\tNOUN\tleer\ngo\tverb\tfahren\t\t\t\t \n\n", encoding="utf-8")
    got = {(r["en"], r["pos"], r["de"], r["domain"], r["rank"], r["source"]) for r in X.imported(spark, str(path), old, ["NOUN", "VERB"]).collect()}
    assert got == {("HOUSE", "NOUN", "Heim", "general", 3, "user"), ("house", "NOUN", "Haus", "tech", 2, "user"), ("go", "VERB", "fahren", "general", 1, "user")}


def test_wrapped(spark):
    texts = ["", "  ", "ein", "eins zwei drei vier fünf " * 9, "x" * 40 + " y", "a " + "b" * 30 + " c d", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.wrapped(F.col("t"), 20, "  ").alias("w")).collect()
    for r in rows:
        text = texts[r["i"]]
        if text is None:
            assert r["w"] is None
        else:
            assert r["w"] == (textwrap.wrap(text, 20, initial_indent="  ", subsequent_indent="  ", break_long_words=False, break_on_hyphens=False) or ["  "])


def test_lines_and_bytes(spark):
    row = spark.createDataFrame([("ab\ncd", "ein langes Wort", None)], "a string, b string, c string")
    assert row.select(X.table_line([F.col("a"), F.col("b"), F.col("c")], [6, 8, 3])).first()[0] == "ab cd  | ein lan… |"
    got = row.select(X.encoded(F.col("a"), "utf-16").alias("u"), X.encoded(F.col("a"), "utf-8-sig").alias("s")).first()
    assert bytes(got["u"]).decode("utf-16") == "ab\r\ncd" and bytes(got["s"]).decode("utf-8-sig") == "ab\r\ncd"


def test_commonest_and_kept(spark):
    rows = spark.createDataFrame([(1, "b", 3), (1, "a", 2), (1, "a", 5), (1, "b", 1), (1, None, 0), (2, "z", 9)], "k int, v string, o int")
    assert {tuple(r) for r in X.most_common(rows, "k", "v", "o").collect()} == {(1, "b", 2), (2, "z", 1)}
    assert {r["k"] for r in X.kept(rows, rows.filter("k = 2"), "k").collect()} == {1}


def test_trees(spark):
    tree = spark.createDataFrame(
        [(1, None, None, "Haus", "word", 3, 2.0), (1, None, None, "Netz", "word", 5, 9.0), (1, "Netz", None, "neues Netz", "phrase", 2, 3.0), (1, "Netz", "neues Netz", "ganz neues Netz", "phrase", 2, 1.0), (1, "Netz", None, "Netzwerk", "compound", 2, 4.0), (1, None, None, "loser Satz", "loose", 2, 1.0), (1, None, None, "noch einer", "loose", 2, 2.0), (2, None, None, "nur lose", "loose", 2, 1.0)],
        "doc_id int, head string, parent string, text string, kind string, freq int, weight double",
    )
    got = {r["doc_id"]: r["text"] for r in X.tree_lines(tree).collect()}
    assert got == {1: "    Netz\n        Netzwerk\n        neues Netz\n            ganz neues Netz\n    Haus\nnoch einer, loser Satz", 2: "nur lose"}
