"""Snippets, text rules and evaluation on small cases, nulls and empty tables among them."""

import pytest
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import evaluation, lexicon, snippets, studies, tables


def test_best_stretch(spark):
    long = "word " * 100 + "lake river lake end " + "tail " * 100
    docs = spark.createDataFrame([(1, long), (2, "short  text\nhere"), (3, None), (4, ""), (5, "x " * 400)], "doc_id int, text string")
    got = {r.doc_id: r for r in snippets.best_stretch(docs, F.array(F.lit("lake"), F.lit("river"))).collect()}
    assert got[1].hits == 3 and got[1].snippet.startswith("…word") and "lake river lake" in got[1].snippet and got[1].snippet.endswith("tail…")
    assert [got[i].snippet for i in (2, 3, 4)] == ["short text here", None, ""]
    assert got[5].hits == 0 and got[5].snippet == ("x " * 400)[:300] + "…"
    assert snippets.best_stretch(docs.limit(0), F.array(F.lit("lake"))).count() == 0


def column(spark, value, made, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(made.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("Lake <b> & lake-side", "<mark>Lake</mark> &lt;b&gt; &amp; lake-side"), ("", ""), (None, None)],
)
def test_highlight(spark, text, want):
    assert column(spark, text, snippets.highlight("s", F.array(F.lit("lake")))) == want


@pytest.mark.parametrize(
    ("sentence", "want"),
    [
        ("Das gilt [3, с. 45] auch hier (vgl. Abb. 3).", "Das gilt auch hier."),
        ("Кроме того, система работает достаточно быстро.", "Система работает достаточно быстро."),
        ("Кроме того, да.", "Кроме того, да."),
        ("[1]", "[1]"),
        (None, None),
    ],
)
def test_compressed(spark, sentence, want):
    assert column(spark, sentence, T.compressed("s", ("кроме того", "так"))) == want


def test_text_rules(spark):
    assert column(spark, "Ärger", T.in_script("s", F.lit("de"))) is True
    assert column(spark, "Ёлка-сад", T.in_script("s", F.lit("ru"))) is True
    assert column(spark, "code", T.in_script("s", F.lit("ru"))) is False
    assert column(spark, " a ​ b\r\nc­  ", T.cleaned("s")) == "a b\nc"
    assert tuple(column(spark, "abc,", T.difference("s", F.lit("abd")))) == (2, "c,")
    assert [tuple(p) for p in column(spark, "Räuber, É", T.spelled_pairs("s"))] == [("Räuber", "raeuber"), ("É", "e")]
    assert tuple(column(spark, 60, T.decayed(F.col("s"), F.lit(2.0)), "int")) == (50, "normal", 1.2)
    assert column(spark, ["äh", "hm"], T.is_hesitation(F.col("s"), ("äh", "hm")), "array<string>") is True
    assert column(spark, "Der Wald, der groß ist.", T.is_speakable(F.col("s"))) is True
    assert column(spark, "Im Jahr 1900 war es so.", T.is_speakable(F.col("s"))) is False


def test_numbered_ranges(spark):
    rows = spark.range(0, 5000, 3).withColumn("v", F.col("id") * 2)
    got = studies.numbered(rows, "id").filter("i <> id / 3 + 1 or v <> id * 2")
    assert got.count() == 0 and studies.numbered(rows, "id").count() == rows.count()
    assert studies.numbered(rows.limit(0), "id").count() == 0


def test_coverage_and_speed(spark):
    words = spark.createDataFrame([(1, "dict"), (1, "rule"), (1, None), (1, "name"), (2, "number")], "doc_id int, status string")
    assert {r.doc_id: (r.words, r.unknown, r.coverage) for r in evaluation.coverage(words, "doc_id").collect()} == {1: (4, 1, 2 / 3), 2: (1, 0, 1.0)}
    runs = spark.createDataFrame([("a", True, 2.0), ("a", False, 4.0), ("b", True, 6.0), ("c", True, 0.0)], "method string, correct boolean, ms double")
    assert {r.method: (r.errors, r.slowdown) for r in evaluation.speed(runs).collect()} == {"a": (1, 1.0), "b": (0, 2.0), "c": (0, 0.0)}
    assert evaluation.speed(runs.limit(0)).count() == 0


def test_nested_and_named(spark):
    rows = [(1, "net", ["net"], 3.0), (1, "neural net", ["neural", "net"], 2.0), (1, "deep neural net", ["deep", "neural", "net"], 1.0), (1, "tree", ["tree"], 1.0), (2, "neural", ["neural"], 1.0)]
    got = evaluation.nested(spark.createDataFrame(rows, "doc_id int, phrase string, terms array<string>, weight double"))
    assert {(r.doc_id, r.phrase): r.parent for r in got.collect()} == {(1, "net"): None, (1, "neural net"): "net", (1, "deep neural net"): "neural net", (1, "tree"): None, (2, "neural"): None}
    phrases = spark.createDataFrame([(1, ["about", "onegin"]), (2, ["nothing"]), (3, []), (4, None)], "phrase_id int, words array<string>")
    aliases = spark.createDataFrame([("Onegin", ["onegina"]), ("Empty", [])], "name string, words array<string>")
    assert [(r.phrase_id, r.name) for r in evaluation.named(phrases, aliases).collect()] == [(1, "Onegin")]


def test_registry_and_counts(spark):
    roots = spark.createDataFrame([("a",), ("a/b",), ("c",)], "root_path string")
    paths = spark.createDataFrame([("a/1",), ("a/b/2",), ("ab/3",), (None,)], "path string")
    assert {r.root_path: r.documents for r in tables.under_roots(roots, paths).collect()} == {"a": 2, "a/b": 1, "c": 0}
    entries = spark.createDataFrame([], "en string, pos string, de string, domain string")
    assert [r.entries for r in lexicon.counts(entries).collect()] in ([], [0])


def test_lookup_meets_one_entry_of_a_word(spark):
    """Of many entries of one word the best alone is joined; the domain's before general ones, then rank."""
    from textlake.operators import lexicon

    entries = spark.createDataFrame([("Ring", "noun", f"de{i}", "it" if i % 3 == 0 else "" if i % 3 == 1 else "med", 1000 - i) for i in range(900)] + [("ring", "verb", "läuten", "", 1)], "en string, pos string, de string, domain string, rank int")
    words = spark.createDataFrame([(i, "RING", p) for i, p in enumerate(("noun", "verb", "adj", "adv", "name"))], "word_id long, en string, pos string")
    found = lexicon.lookup(words, entries, "it")
    assert sorted(tuple(r) for r in found.collect()) == [(0, "Ring", "noun", "de897", 0), (1, "ring", "verb", "läuten", 0), (2, "ring", "verb", "läuten", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]
