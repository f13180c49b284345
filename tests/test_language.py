"""Inflection, writing, sound and tagging on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import german, langprofiles, mlp, sound, tagger, wordformation, writing

NOUNS = "lemma string, gender string, plural string, kind string, adjective string, degree string"


def test_declension(spark):
    rows = [("Hund", "m", "Hunde", "def", "alt", "pos"), ("Zeit", "f", "Zeiten", "indef", "hoch", "comp"), ("Buch", "n", "Bücher", "none", "teuer", None), ("Eltern", "pl", None, "def", None, None), ("Virus", "m", "Viren", "def", "lila", "pos"), ("Ding", "n", "Dinge", "odd", "neu", "pos")]
    got = {(r.lemma, r.number, r.casus): r.phrase for r in german.decline(spark.createDataFrame(rows, NOUNS)).collect()}
    assert [got["Hund", "sg", c] for c in "NADG"] == ["der alte Hund", "den alten Hund", "dem alten Hund", "des alten Hundes"]
    assert [got["Hund", "pl", c] for c in "ND"] == ["die alten Hunde", "den alten Hunden"]
    assert got["Zeit", "sg", "D"] == "einer höheren Zeit" and got["Zeit", "pl", "N"] == "höheren Zeiten"
    assert got["Buch", "sg", "N"] == "teures Buch" and got["Buch", "sg", "G"] == "teuren Buches" and got["Buch", "pl", "D"] == "teuren Büchern"
    assert got["Eltern", "pl", "G"] == "der Eltern" and len([k for k in got if k[0] == "Eltern"]) == 4
    assert got["Virus", "sg", "G"] == "des lila Virus"
    assert not [k for k in got if k[0] == "Ding"]
    assert german.decline(spark.createDataFrame([], NOUNS)).count() == 0


@pytest.mark.parametrize("adjective, forms", [("neu", "neu neuer am neusten"), ("gut", "gut besser am besten"), ("kalt", "kalt kälter am kältesten"), ("heiß", "heiß heißer am heißesten"), ("praktisch", "praktisch praktischer am praktischsten"), ("flexibel", "flexibel flexibler am flexibelsten"), ("leise", "leise leiser am leisesten")])
def test_degrees(spark, adjective, forms):
    row = spark.range(1).select(*[german.predicative(F.lit(adjective), F.lit(d)) for d in ("pos", "comp", "sup")]).first()
    assert " ".join(row) == forms


@pytest.mark.parametrize(
    "tokens, text",
    [
        ([",", "er", "sagt", ",", ",", '"', "hallo", '"', ",", "."], "Er sagt, „hallo“."),
        (["``", "ja", "''", "(", ",", "nein", ",", ")", "!"], "„Ja“ (nein)!"),
        (["", "3", "äpfel"], "3 äpfel"),
        (['"', "a", '"', "b", '"'], "„A“ b „"),
        ([], ""),
        (None, None),
    ],
)
def test_assemble(spark, tokens, text):
    assert spark.createDataFrame([(tokens,)], "t array<string>").select(writing.assemble("t")).first()[0] == text


@pytest.mark.parametrize(
    "language, phrases, text",
    [
        ("de", ["ich gehe heim", "komma aber langsam"], "Ich gehe heim, aber langsam."),
        ("de", ["er sagte doppelpunkt anführungszeichen auf ich komme punkt anführungszeichen zu"], "Er sagte: „Ich komme.“"),
        ("de", ["das ist der punkt", "neuer absatz", "und weiter ausrufezeichen"], "Das ist der punkt.\n\nUnd weiter!"),
        ("ru", ["моя точка зрения запятая да", "новый абзац конец"], "Моя точка зрения, да.\n\nКонец."),
        ("ru", ["один точка с запятой два многоточие", None, ""], "Один; два…"),
        ("xx", ["komma  bleibt"], "Komma bleibt."),
    ],
)
def test_dictated(spark, language, phrases, text):
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate(phrases)], "k int, i int, text string")
    assert [r.text for r in writing.dictated(rows, language, "k", "i").collect()] == [text]


def test_dictated_nothing(spark):
    assert writing.dictated(spark.createDataFrame([(1, 1, None), (2, 1, " ")], "k int, i int, text string"), "de", "k", "i").count() == 0


def one(spark, samples, column):
    return spark.createDataFrame([([float(x) for x in samples],)], "s array<double>").select(column).first()[0]


def test_levels(spark):
    wave = np.sin(np.arange(1600) * 2 * np.pi / 16)
    assert one(spark, wave, sound.frame_levels("s", 160)) == pytest.approx([-3.0103] * 10, abs=0.01)
    assert one(spark, [], sound.frame_levels("s", 160)) == [-120.0]
    assert one(spark, [*wave, *[0] * 1600], sound.speech_level("s", 160)) == pytest.approx(-3.0103, abs=0.01)
    assert len(one(spark, [*[0] * 320, *wave, *[0] * 320], sound.trim("s", 160, keep=16))) == 1632
    assert one(spark, [0] * 320, sound.trim("s", 160)) == []
    assert one(spark, wave / 10, sound.speech_level(sound.normalize("s", 160, -20.0), 160)) == pytest.approx(-20, abs=0.01)


def test_shapes(spark):
    assert one(spark, [1] * 8, sound.fade("s", 4)) == pytest.approx([0, 1 / 3, 2 / 3, 1, 1, 2 / 3, 1 / 3, 0])
    assert one(spark, [1, 2], sound.pad("s", 1, 2)) == [0, 1, 2, 0, 0]
    assert max(one(spark, [0.5, 3.0], sound.soft_limit("s"))) <= 0.97
    assert one(spark, range(5), sound.frames("s", 2)) == [[0, 1], [2, 3]]


@pytest.mark.parametrize("rate, target", [(2, 3), (3, 1), (4, 2), (8, 8)])
def test_resample(spark, rate, target):
    x = np.random.default_rng(1).normal(size=40)
    y, width = x, max(1, round(rate / target))
    if rate > target:
        y = np.convolve(x, np.ones(width) / width, mode="same")
    want = np.interp(np.arange(40 * target // rate) * (rate / target), np.arange(40), y)
    assert one(spark, x, sound.resample("s", rate, target)) == pytest.approx(want.tolist())
    assert one(spark, [], sound.resample("s", rate, target)) == []


def test_noise(spark):
    wave = 0.1 * np.sin(np.arange(4000) * 2 * np.pi / 16)
    noisy = np.array(one(spark, wave, sound.add_noise("s", F.lit(7), 10.0, 160)))
    assert 10 * np.log10((wave**2).mean() / ((noisy - wave) ** 2).mean()) == pytest.approx(10, abs=0.5)
    assert one(spark, wave, sound.add_noise("s", F.lit(7), 10.0, 160)) == noisy.tolist()
    assert one(spark, [0] * 9, sound.add_noise("s", F.lit(7), 10.0, 4)) == [0] * 9


def test_tagger(spark):
    """A word after `the` is a noun, the same word after `to` a verb."""
    rows = [(i, ["the", w, "to", v, "."], ["D", "N", "T", "V", "M"]) for i, (w, v) in enumerate((a, b) for a in ("run", "walk", "play") for b in ("run", "walk", "play", "rest"))]
    train = spark.createDataFrame([*rows, (99, None, None), (98, [], [])], "id int, words array<string>, tags array<string>")
    model = tagger.train(train, "id", shards=3, passes=5)
    known = tagger.certain_words(train, least=10)
    assert {r.word: r.tag for r in known.collect()} == {"the": "D", "to": "T", ".": "M"}
    sure = tagger.with_certain(train, known, "id")
    assert {r.id: r.sure for r in sure.filter("id in (0, 98, 99)").collect()} == {0: ["D", None, "T", None, "M"], 98: [], 99: None}
    assert tagger.tag(sure, model).filter("told <> tags").count() == 0
    told = tagger.tag(spark.createDataFrame([(1, ["the", "rest", "to", "jump", "."]), (2, None), (3, [])], "id int, words array<string>"), model)
    assert {r.id: r.told for r in told.collect()} == {1: ["D", "N", "T", "V", "M"], 2: None, 3: []}
    wrong = tagger.accuracy(tagger.tag(train, model)).filter("gold <> told").count()
    assert wrong == 0
    assert tagger.train(train.filter("id > 200"), "id").classes == []


LEXICON = [("data", "noun", "Daten", "pl", "-"), ("flow", "noun", "Fluss", "m", "Flüsse"), ("security", "noun", "Sicherheit", "f", "-"), ("gap", "noun", "Lücke", "f", "Lücken"), ("rule", "noun", "Regel", "f", "Regeln"), ("execute", "verb", "aus|führen", "", ""), ("calculate", "verb", "berechnen", "", ""), ("linear", "adj", "linear", "", ""), ("happy", "adj", "glücklich", "", ""), ("power", "noun", "Kraft", "f", "Kräfte"), ("efficient", "adj", "effizient", "", "")]


@pytest.mark.parametrize(
    "word, pos, de, plural",
    [
        ("optimization", "noun", "Optimisierung", "Optimisierungen"),
        ("Formalism", "noun", "Formalismus", "Formalismen"),
        ("happiness", "noun", "Glücklichkeit", "Glücklichkeiten"),
        ("dataflow", "noun", "Datenfluss", "Datenflüsse"),
        ("security-gap", "noun", "Sicherheitslücke", "Sicherheitslücken"),
        ("microflow", "noun", "Mikrofluss", "-"),
        ("algorithmic", "adj", "algorithmisch", ""),
        ("executable", "adj", "ausführbar", ""),
        ("nonlinear", "adj", "nichtlinear", ""),
        ("powerless", "adj", "kraftlos", ""),
        ("rule-based", "adj", "regelbasiert", ""),
        ("virtualize", "verb", "virtualisieren", ""),
        ("communicate", "verb", "kommunizieren", ""),
        ("recalculate", "verb", "wieder|berechnen", ""),
        ("efficiently", "adv", "effizient", ""),
        ("interactively", "adv", "interaktiv", ""),
    ],
)
def test_guess(spark, word, pos, de, plural):
    lexicon = spark.createDataFrame([(*e, i) for i, e in enumerate(LEXICON)], "en string, pos string, de string, gender string, plural string, rank int")
    words = spark.createDataFrame([(word, pos), (word, pos), (None, "noun"), ("xy", "noun"), ("zzzz", "noun")], "en string, pos string")
    assert [(r.de, r.plural) for r in wordformation.guess(words, lexicon).collect()] == [(de, plural)]


def test_ngrams_are_counted_in_tasks_as_by_columns(spark):
    """Counts and profiles of texts of any characters, owners of several texts, none and null ones."""
    from pyspark.sql import functions as F

    from textlake.functions import text as T
    from textlake.operators import langprofiles

    rows = [(1, "Das da, das!"), (1, "da ist ein Übermut"), (2, "сеть и сети"), (3, "数据 data 数据库 ế"), (4, ""), (5, None), (6, "123 ."), (None, "nobody"), (7, "x" * 40 + " y")]
    docs = spark.createDataFrame(rows, "owner long, text string")
    plain = docs.select("owner", F.explode(T.padded_ngrams(T.letters("text"))).alias("feature")).groupBy("owner", "feature").agg(F.count("*").alias("n"))
    counts = langprofiles.features(docs, "ngram")
    assert sorted(map(str, counts.collect())) == sorted(map(str, plain.collect()))
    for limit in (5, 300):
        want = langprofiles.profiles(plain.filter("owner is not null"), limit).select("owner", "feature", "n", "rank", "weight")
        got = langprofiles.own_profiles(docs, limit)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert "hashpartitioning(feature" not in got._jdf.queryExecution().executedPlan().toString()


def test_equal_distances_tie_in_any_order(spark):
    from textlake.operators import langprofiles

    languages = spark.createDataFrame([("a", f, r) for f, r in zip("pqrstu", (1, 5, 9, 0, 2, 7))] + [("b", f, r) for f, r in zip("utsrqp", (1, 5, 9, 0, 2, 7))], "owner string, feature string, rank int")
    docs = spark.createDataFrame([(1, f, 3) for f in "pqrstu"], "owner long, feature string, rank int")
    assert len({r.distance for r in langprofiles.rank_distance(docs, languages).collect()}) == 1


def test_network_counts_and_keeps_within_tasks(spark):
    """Running n-grams are added up before they are shuffled, and a task lets go of no more fragments than are learnt from."""
    rows = [("en", "the path and the way"), ("en", "the path"), ("xx", "𝒜𝒷 я"), ("xx", ""), ("xx", None), ("y", "a")]
    docs = spark.createDataFrame(rows, "owner string, text string").coalesce(1)
    found = langprofiles.features(docs, "running")
    each = docs.select("owner", F.explode(T.running_ngrams(T.letters("text"))).alias("feature")).groupBy("owner", "feature").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, each.collect()))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    texts = docs.limit(1).crossJoin(spark.range(500)).select("owner", F.concat_ws(" ", F.lit("path"), F.sha2(F.col("id").cast("string"), 256)).alias("t")).coalesce(1)
    kept = texts.mapInArrow(mlp._least(20), "owner string, f string")
    least = texts.union(texts).union(texts).orderBy(F.xxhash64("t"), "t").limit(20).collect()  # a short text is a fragment of each of three sizes
    assert sorted(r["f"] for r in kept.collect()) == sorted(r["t"] for r in least)
