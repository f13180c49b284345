"""Keyword trees: stems against a plain version, terms, heads, phrases of both kinds, attachment, nesting, odd documents."""



from pyspark.sql import functions as F

from textlake.functions.stems import german
from textlake.operators import keywordtree as K

# Words and their stems.
STEMS = {
    "aufeinanderfolgende": "aufeinanderfolg", "kategorischen": "kategor", "kategorie": "kategori", "auffällig": "auffall", "aufgeblasen": "aufgeblas", "häuser": "haus", "Häusern": "haus",
    "mächtigen": "machtig", "verwaltung": "verwalt", "häufigkeit": "haufig", "ähnlichkeit": "ahnlich", "künstliche": "kunstlich", "datenbanken": "datenbank", "systems": "system", "bedürfnissen": "bedurfnis",
    "straße": "strass", "freiheitlich": "freiheit", "sicherheit": "sich", "erste": "erst", "ab": "ab", "": "",
}


def plain(word):
    """The same algorithm with regions as numbers, step by step."""
    vowels = "aeiouyäöü"
    w = list(word.lower().replace("ß", "ss"))
    for i in range(1, len(w) - 1):
        if w[i] in "uy" and w[i - 1] in vowels and w[i + 1] in vowels:
            w[i] = w[i].upper()
    w = "".join(w)

    def region(start):
        for i in range(start + 1, len(w)):
            if w[i] not in vowels and w[i - 1] in vowels:
                return i + 1
        return len(w)

    r1 = region(0)
    r2, r1 = region(r1), max(r1, 3)

    def ends(*suffixes):
        return next((s for s in sorted(suffixes, key=len, reverse=True) if w.endswith(s)), None)

    if s := ends("em", "ern", "er", "e", "en", "es"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)]
            if s in ("e", "en", "es") and w.endswith("niss"):
                w = w[:-1]
    elif w.endswith("s") and w[-2:-1] and w[-2] in "bdfghklmnrt" and len(w) - 1 >= r1:
        w = w[:-1]
    if s := ends("en", "er", "est"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)]
    elif w.endswith("st") and len(w) > 5 and w[-3] in "bdfghklmnt" and len(w) - 2 >= r1:
        w = w[:-2]
    if s := ends("end", "ung"):
        if len(w) - 3 >= r2:
            w = w[:-3]
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
    elif s := ends("ig", "ik", "isch"):
        if len(w) - len(s) >= r2 and w[-len(s) - 1 : -len(s)] != "e":
            w = w[: -len(s)]
    elif ends("lich", "heit"):
        if len(w) - 4 >= r2:
            w = w[:-4]
            if ends("er", "en") and len(w) - 2 >= r1:
                w = w[:-2]
    elif w.endswith("keit") and len(w) - 4 >= r2:
        w = w[:-4]
        if (s := ends("lich", "ig")) and len(w) - len(s) >= r2:
            w = w[: -len(s)]
    return w.translate(str.maketrans("äöüUY", "aouuy"))


def test_stems(spark):
    built = [a + b + c for a in ("", "ver", "niss", "straß", "quäu", "bey", "freu") for b in ("lich", "ig", "eig", "isch", "heit", "keit", "ung", "end", "er", "st") for c in ("", "e", "en", "es", "ern", "s", "st", "est", "keit", "heiten", "ungen", "ste")]
    words = [*STEMS, *built]
    got = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", german(F.col("w")).alias("s")).collect()}
    for w in words:
        assert got[w] == plain(w), w
    for w, want in STEMS.items():
        assert got[w] == want


def parts(spark, texts):
    return spark.createDataFrame([(d, i, t, h) for d, i, t, h in texts], "doc_id long, part int, text string, heading boolean")


def test_german_tree(spark):
    texts = [
        (1, 0, "Eine relationale Datenbank ist eine Datenbank, und die relationalen Datenbanken sind groß.", False),
        (1, 1, "Das Datenbanksystem der Datenbank, ein Datenbanksystem, kennt schnelle Abfragen.", False),
        (1, 2, "Die schnelle Abfrage und Goethes Haus, denn Goethe baute das Haus 12 Haus.", False),
        (1, 3, "Relationale Datenbank", True),
        (2, 0, "Nichts davon steht hier.", False), (3, 0, "", False), (4, 0, None, False),
    ]
    rows = K.german_words(K.words(parts(spark, texts)), stop=spark.createDataFrame([("eine",), ("die",)], "word string"))
    near = {(r["surface"], r["adjacent"], r["initial"]) for r in rows.filter("part = 2").collect()}
    assert ("Haus", False, False) in near and ("Die", False, True) in near and ("Goethes", True, False) in near
    found = K.terms(rows)
    terms = {r["term"]: r for r in found.filter("doc_id = 1").collect()}
    assert terms["datenbank"]["tf"] == 5 and terms["datenbank"]["shown"] == "Datenbank" and terms["datenbank"]["noun_term"]
    assert terms["goeth"]["tf"] == 2 and "ein" in terms and not terms["relational"]["noun_term"] and terms["relational"]["shown"] == "relationale"
    tops = K.heads(found, top=3)
    assert [r["shown"] for r in tops.filter("doc_id = 1").orderBy("rank").collect()] == ["Datenbank", "Haus", "Abfrage"]
    got = K.tree(found, tops, K.german_phrases(rows, found)).filter("doc_id = 1").collect()
    assert {(r["head"], r["parent"], r["text"], r["kind"], r["freq"]) for r in got} == {
        (None, None, "Datenbank", "word", 5), (None, None, "Haus", "word", 3), (None, None, "Abfrage", "word", 2),
        ("Datenbank", None, "relationale Datenbank", "phrase", 2), ("Datenbank", None, "Datenbanksystem", "compound", 2), ("Abfrage", None, "schnelle Abfrage", "phrase", 2),
    }
    assert not K.tree(found, tops, K.german_phrases(rows, found)).filter("doc_id > 2").count()
    none = K.german_words(K.words(parts(spark, [])))
    assert K.tree(K.terms(none), K.heads(K.terms(none)), K.german_phrases(none, K.terms(none))).collect() == []


def test_loose_and_nested(spark):
    found = spark.createDataFrame([(1, t, t, True, 3, 1.0) for t in ("a1", "b1", "c1", "z1", "y1")], "doc_id long, term string, shown string, noun_term boolean, tf long, idf double")
    tops = spark.createDataFrame([(1, 1, "a1", "a1", 3, 9.0)], "doc_id long, rank int, term string, shown string, tf long, weight double")
    phrases = spark.createDataFrame([(1, ["a1", "b1"], "A B", 3), (1, ["c1", "a1", "b1"], "C A B", 2), (1, ["a1", "z1"], "A Z", 2), (1, ["a1", "z1"], "A Zs", 1), (1, ["z1", "y1"], "Z Y", 2), (1, ["y1", "q1"], "einmal", 1)], "doc_id long, terms array<string>, form string, n long")
    got = {(r["head"], r["parent"], r["text"], r["kind"]) for r in K.tree(found, tops, phrases).collect()}
    assert got == {(None, None, "a1", "word"), ("a1", None, "A B", "phrase"), ("a1", "A B", "C A B", "phrase"), ("a1", None, "A Z", "phrase"), (None, None, "Z Y", "loose")}


def test_compounds(spark):
    cases = [("datenbanksystem", "datenbank", True), ("lieblingssohn", "sohn", True), ("versohn", "sohn", False), ("datenbank", "datenbank", False), ("alt-sohn-neu", "sohn", True), ("absohn", "sohn", False), ("reha", "eh", False)]
    rows = spark.createDataFrame(cases, "t string, h string, want boolean").select("want", K.contains_compound(F.col("t"), F.col("h")).alias("got"), K.derived(F.lit("лазерный"), F.lit("лазер")).alias("d"), K.derived(F.lit("сетевой"), F.lit("сеть")).alias("n")).collect()
    assert all(r["want"] == r["got"] and r["d"] and not r["n"] for r in rows)



def test_cased_phrases(spark):
    """Nouns N, adjectives A, genitives G, persons P: `A1` agrees with what shares its number."""
    def row(doc, pos, code, adjacent=True):
        kind, group = code[0], code[1:]
        return (doc, 0, pos, code, adjacent and pos > 0, pos == 0, code.lower(), True, kind in "NGP", kind == "A", kind == "G", kind == "P", False, f"{code}-lemma", [group])

    sentences = {1: ["A1", "A1", "N1"], 2: ["A2", "N1"], 3: ["N1", "G2", "G3"], 4: ["N1", "A2", "G2"], 5: ["P1", "P2", "P3"], 6: ["P1", "P2", "N1"], 7: ["N1", "A3", "G2"]}
    rows = spark.createDataFrame([row(d, i, c) for d, cs in sentences.items() for i, c in enumerate(cs)] + [row(8, 0, "A1"), row(8, 1, "N1", False)], "doc_id long, part int, pos int, surface string, adjacent boolean, initial boolean, term string, counted boolean, noun boolean, adjective boolean, genitive boolean, person boolean, abbreviation boolean, lemma string, agrees array<string>")
    got = {}
    for r in K.cased_phrases(rows).collect():
        got.setdefault(r["doc_id"], set()).add((tuple(r["terms"]), r["form"]))
    assert got[1] == {(("a1", "n1"), "A1-lemma N1-lemma"), (("a1", "a1", "n1"), "A1-lemma A1-lemma N1-lemma")}
    assert 2 not in got and 7 not in got and 8 not in got
    assert got[3] == {(("n1", "g2"), "N1-lemma g2"), (("n1", "g2", "g3"), "N1-lemma g2 g3"), (("g2", "g3"), "G2-lemma g3")}
    assert (("n1", "a2", "g2"), "N1-lemma a2 g2") in got[4]
    assert got[5] == {(("p1", "p2", "p3"), "P1-lemma P2-lemma P3-lemma")} and got[6] == {(("p1", "p2"), "P1-lemma P2-lemma")}
