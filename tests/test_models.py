"""Stored models score as before; query analysis by hand."""

import pytest
from pyspark.sql import functions as F

from textlake.operators import langprofiles, models, parsing, queryanalysis, suggest, tagger


def test_versions(spark, tmp_path):
    path = str(tmp_path / "tags")
    one = tagger.Tagger(["B", "A"], {"word=x": {"A": 1.5, "B": -0.25}, "bias": {"B": 0.125}})
    assert models.versions(spark, path) == [] and models.save_tagger(spark, one, path) == 1
    assert models.save_tagger(spark, tagger.Tagger(["A"], {}), path) == 2 and models.save_tagger(spark, one, path, 0.2) == 3
    assert models.load_tagger(spark, path, 1) == one
    assert models.load_tagger(spark, path, 2) == tagger.Tagger(["A"], {})
    assert models.load_tagger(spark, path).weights == {"word=x": {"A": 1.5, "B": -0.25}}
    (tmp_path / "tags" / "version=3" / "weights" / "_SUCCESS").unlink()  # never finished
    assert models.versions(spark, path) == [1, 2] and models.load_tagger(spark, path).weights == {}
    with pytest.raises(FileNotFoundError):
        models.load_tagger(spark, path, 9)


def test_parser_and_profiles(spark, tmp_path):
    model = parsing.Parser({"t0=N": {"left": 0.1, "shift": -3.0}}, ["obj", "subj"], {"bias": {"obj": 2.0}})
    models.save_parser(spark, model, str(tmp_path / "p"))
    read = models.load_parser(spark, str(tmp_path / "p"))
    assert read == model
    words = spark.createDataFrame([(1, ["a", "b", "c"], ["N", "V", "N"])], "k int, words array<string>, tags array<string>")
    assert parsing.parse(words, read).first()["told"] == parsing.parse(words, model).first()["told"]
    docs = spark.createDataFrame([("de", "das haus"), ("en", "the house")], "owner string, text string")
    made = langprofiles.profiles(langprofiles.features(docs, "ngram"), 20).select("owner", "feature", "n", F.col("rank").cast("int").alias("rank"), "weight")
    models.save_profiles(made, str(tmp_path / "n"))
    assert sorted(map(tuple, models.load_profiles(spark, str(tmp_path / "n")).collect())) == sorted(map(tuple, made.collect()))


def test_analysis(spark):
    info = spark.createDataFrame([("сети", "сеть", "noun", 0.9), ("сети", "сети", "verb", 0.1), ("сеть", "сеть", "noun", 1.0), ("маршрут", "маршрут", "noun", 1.0)], queryanalysis.INFO)
    lemmas = spark.createDataFrame([("сеть",), ("маршрут",), ("путь",)], "lemma string")
    vocabulary = spark.createDataFrame([("маршрут", 5), ("сети", 3)], "form string, freq long")
    stop = spark.createDataFrame([("и",), ("В",)], "word string")
    same = suggest.thesaurus(spark.createDataFrame([(["маршрут", "путь", "дорога"],)], "words array<string>"))
    queries = spark.createDataFrame([(1, "Сети и маршурт в сети 7"), (2, None), (3, "маршрут"), (4, "и в")], "query_id int, text string")
    got = {r["query_id"]: r for r in queryanalysis.analyze(queries, lemmas, vocabulary, stop, same, info).collect()}
    one = got[1]
    assert one["tokens"] == ["сети", "и", "маршурт", "в", "сети", "7"] and one["stop_words"] == ["и", "в"]
    assert [tuple(m) for m in one["morphology"]] == [("сети", "сеть", "noun", True), ("маршурт", "маршурт", None, False), ("сети", "сеть", "noun", True)]
    assert one["lemmas"] == ["сеть", "маршурт"] and one["unknown"] == ["маршурт"] and one["corrections"] == {"маршурт": "маршрут"}
    assert one["corrected"] == "Сети и маршрут в сети 7" and one["expansions"] == {"маршурт": ["маршрут"]} and one["synonyms"] == {}
    assert got[2]["tokens"] == [] and got[2]["corrected"] is None and got[2]["lemmas"] == []
    assert got[3]["synonyms"] == {"маршрут": ["путь"]} == got[3]["expansions"]
    assert got[4]["stop_words"] == ["и", "в"] and got[4]["morphology"] == []
    log = queryanalysis.logged(spark.createDataFrame([("alt", "alt", 2)], "raw_query string, normalized string, results_count long"), spark.createDataFrame([tuple(r) for r in got.values()], queryanalysis.analyze(queries, lemmas, vocabulary, stop, same, info).schema), spark.createDataFrame([(3, 8)], "query_id int, n long"))
    assert sorted(map(tuple, log.filter("raw_query in ('alt', 'маршрут')").collect())) == [("alt", "alt", 2), ("маршрут", "маршрут", 8)]
