"""Hand-computed values of each operator."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.functions import udfs
from textlake.operators import index, langprofiles, lexicon, matching, metrics, search, suggest, summarize, tables


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


LEMMAS = [("сети", "сеть")]


@pytest.fixture(scope="module")
def tiny(spark):
    docs = spark.createDataFrame([(1, "Сеть сеть коммутатор"), (2, "Сети маршрутизатор"), (3, "Борщ рецепт")], "doc_id long, text string")
    return index.build(docs, lemmas=spark.createDataFrame(LEMMAS, "form string, lemma string"))


def test_weights(tiny):
    postings, documents = tiny
    w = {(r.doc_id, r.lemma): r.weight for r in postings.collect()}
    assert w[1, "сеть"] == pytest.approx(2 * math.log10(1.5)) and w[1, "коммутатор"] == pytest.approx(math.log10(3))
    norms = {r.doc_id: r.norm for r in documents.collect()}
    assert norms[1] == pytest.approx(math.hypot(2 * math.log10(1.5), math.log10(3)))


def test_inverse_frequency(spark):
    f = lambda n, df: T.inverse_frequency(F.lit(n), F.lit(df))
    assert one(spark, f(10, 1), f(3, 2), f(5, 5), f(0, 1), f(3, 0)) == pytest.approx((1.0, math.log10(1.5), 0, 0, 0))


def test_search_and_modifiers(spark, tiny):
    postings, documents = tiny
    queries = spark.createDataFrame([(1, "сеть"), (1, "маршрутизатор"), (2, "борщ")], "query_id int, lemma string")
    vectors = search.query_vectors(queries)
    found = [(r.query_id, r.doc_id) for r in search.search(vectors, postings, documents).orderBy("query_id", "rank").collect()]
    assert found == [(1, 2), (1, 1), (2, 3)]
    strict = search.search(vectors, postings, documents, search.Modifiers(strict=True)).collect()
    assert {(r.query_id, r.doc_id) for r in strict} == {(1, 2), (2, 3)}
    dated = documents.withColumns({"host": F.lit("a"), "date": F.lit("20240105")})
    assert not search.search(vectors, postings, dated, search.Modifiers(ban_host="a")).count()
    assert search.search(vectors, postings, dated, search.Modifiers(date_from="20240105", date_to="20240105")).count() == 3
    assert not search.search(vectors, postings, dated, search.Modifiers(date_from="20240106")).count()
    top = search.explain(vectors, postings).filter("doc_id = 2 and query_id = 1").first().terms
    assert [t.lemma for t in top] == ["маршрутизатор", "сеть"]


def test_synonyms_never_change_typed_lemmas(spark, tiny):
    synonyms = suggest.thesaurus(spark.createDataFrame([(["борщ", "рецепт", "суп"],)], "words array<string>"))
    queries = spark.createDataFrame([(1, "борщ")], "query_id int, lemma string")
    got = {(r.lemma, r.weight, r.typed) for r in search.query_vectors(queries, synonyms, tiny[0].select("lemma").distinct()).collect()}
    assert got == {("борщ", 1.0, True), ("рецепт", 0.5, False)}


def test_rocchio_moves_to_liked(spark, tiny):
    postings, documents = tiny
    vectors = search.query_vectors(spark.createDataFrame([(1, "сеть")], "query_id int, lemma string"))
    marks = spark.createDataFrame([(1, 1, 1), (1, 3, -1)], "query_id int, doc_id long, mark int")
    got = {r.lemma: r.weight for r in search.rocchio(vectors, postings, documents, marks).collect()}
    norm = math.hypot(2 * math.log10(1.5), math.log10(3))
    assert got == pytest.approx({"сеть": 1 + 0.75 * 2 * math.log10(1.5) / norm, "коммутатор": 0.75 * math.log10(3) / norm})


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([(1, p, d) for p, d in enumerate([1, 3, 2, 4, 5], 1)] + [(2, p, d) for p, d in enumerate([1, 2, 5, 3, 4], 1)], "query_id int, pos int, doc_id int")
    qrels = spark.createDataFrame([(q, d, r) for q in (1, 2) for d, r in {1: 2, 2: 1, 5: 1, 3: 0, 4: 0}.items()], "query_id int, doc_id int, rel int")
    a, b = metrics.retrieval(ranked, qrels, (1, 2, 3)).orderBy("query_id").collect()
    assert (a.precision, a.recall, a.p_at_1, a.p_at_2, a.p_at_3) == pytest.approx((0.6, 1.0, 1.0, 0.5, 2 / 3))
    assert a.r_precision == pytest.approx(2 / 3) and a.ap == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert b.ndcg == pytest.approx(1.0) and b.bpref == 1.0 and a.bpref < 1.0
    curve = [r.precision for r in metrics.precision_curve(ranked, qrels).filter("query_id = 1").orderBy("level").collect()]
    assert len(curve) == 11 and curve[0] == 1.0 and curve == sorted(curve, reverse=True)
    many = spark.createDataFrame([(1, d, 1) for d in range(8)] + [(2, d, int(d > 0)) for d in range(9)], "query_id int, doc_id int, rel int")
    assert [r.query_id for r in metrics.suspect_judgements(many).collect()] == [1]


def test_edit_distances(spark):
    assert udfs.osa_distance("коммутатор", "коммутатро") == 1 and udfs.osa_distance("ca", "abc") == 3
    assert udfs.osa_distance("abcdef", "uvwxyz", 2) == 3 and udfs.osa_distance("", "") == 0
    assert one(spark, T.similarity(F.lit(""), F.lit("")), T.similarity(F.lit("abcd"), F.lit("abce")), T.same_word(F.lit("сочинение"), F.lit("сочинении"))) == pytest.approx((1.0, 0.75, 8 / 9))
    assert one(spark, T.common_prefix(F.lit("abcx"), F.lit("abd")), T.common_prefix(F.lit(""), F.lit("a"))) == (2, 0)


def test_alignment():
    assert [k for k, *_ in udfs.align("открой сочинение три".split(), "открой сочинении".split())] == ["ok", "sub", "del"]
    assert [k for k, *_ in udfs.align([], ["a"])] == ["ins"] and udfs.align([], []) == []


def test_ngrams(spark):
    assert sorted(one(spark, T.padded_ngrams(F.lit("да"), 3))[0]) == sorted(["д", "а", "_д", "да", "а_", "_да", "да_"])
    assert one(spark, T.running_ngrams(F.lit("a"), 3))[0] == ["a", " a", "a ", " a "]
    assert one(spark, T.padded_ngrams(F.lit("")), T.word_ngrams(F.array(F.lit("a")), 2)) == ([], [])


def test_profile_distances(spark):
    docs = spark.createDataFrame([("a", "hola mundo"), ("b", "xyz")], "owner string, text string")
    for method, limit in (("ngram", 300), ("alphabet", None)):
        p = langprofiles.profiles(langprofiles.features(docs, method), limit)
        d = {(r.owner, r.lang): r.distance for r in (langprofiles.rank_distance if limit else langprofiles.share_distance)(p, p).collect()}
        assert d["a", "a"] == pytest.approx(0) and d["b", "b"] == pytest.approx(0)
        assert 0.9 < d["a", "b"] <= 1.0
    got = langprofiles.classify(spark.createDataFrame([("x", "de", 0.2), ("x", "ru", 0.4), ("y", "de", 0.3), ("y", "ru", 0.3)], "owner string, lang string, distance double"))
    assert {r.owner: (r.predicted, round(r.confidence, 6)) for r in got.collect()} == {"x": ("de", 0.5), "y": ("de", 0.0)}


def test_votes_and_scores(spark):
    votes = spark.createDataFrame([(1, "a", "de", 0.1), (1, "b", "ru", 0.9), (1, "c", "de", 0.2), (2, "a", "de", 0.1), (2, "b", "ru", 0.9)], "owner int, method string, predicted string, confidence double")
    assert {r.owner: (r.predicted, round(r.agreement, 3)) for r in langprofiles.consensus(votes).collect()} == {1: ("de", 0.667), 2: ("ru", 0.5)}
    verdicts = spark.createDataFrame([("de", "de"), ("de", "ru"), ("ru", "ru")], "gold string, predicted string")
    got = {r.lang: (r.precision, r.recall, round(r.f1, 6)) for r in langprofiles.class_scores(langprofiles.confusion(verdicts)).collect()}
    assert got == {"de": (1.0, 0.5, 0.666667), "ru": (0.5, 1.0, 0.666667)}
    rows = spark.createDataFrame([("m", 10, 0.99), ("m", 20, 0.9), ("m", 40, 0.96), ("m", 80, 1.0)], "method string, length int, acc double")
    assert langprofiles.stable_from(rows, "length", "acc", 0.95, "method").first().stable_from == 40


def test_summary_weights(spark):
    tf = spark.createDataFrame([("A", "кот", 2), ("A", "ловить", 1), ("A", "мышь", 1), ("A", "спать", 1), ("B", "собака", 1), ("B", "ловить", 1), ("B", "кот", 1), ("C", "мышь", 1), ("C", "есть", 1), ("C", "сыр", 1)], "doc_id string, lemma string, tf int")
    w = {(r.doc_id, r.lemma): r.weight for r in summarize.term_weights(tf, F.lit(3)).collect()}
    assert w["A", "кот"] == pytest.approx(math.log(1.5)) and w["A", "ловить"] == pytest.approx(0.304099, abs=1e-6) and w["A", "спать"] == pytest.approx(0.823959, abs=1e-6)


def test_oracle_and_keywords(spark):
    sentences = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c", "d", "e"]), (1, 2, ["a"])], "doc_id long, idx int, words array<string>")
    references = spark.createDataFrame([(1, ["a", "c", "d"])], "doc_id long, words array<string>")
    assert [r.idx for r in summarize.oracle_selection(sentences, references).orderBy("step").collect()] == [1, 0]
    weights = spark.createDataFrame([(1, "haus", 3, 1.0), (1, "hausbau", 2, 1.0), (1, "garten", 1, 1.0)], "doc_id long, lemma string, tf int, weight double")
    assert [r.lemma for r in summarize.keywords(weights, 2).orderBy("rank").collect()] == ["haus", "garten"]


def pairs(spark, *rows):
    return spark.createDataFrame([(i, h.split(), r.split()) for i, (h, r) in enumerate(rows)], "pair_id int, hypothesis array<string>, reference array<string>")


def test_overlap_metrics(spark):
    a, b = metrics.rouge(pairs(spark, ("а а а", "а"), ("x y", "")), 1).orderBy("pair_id").collect()
    assert (a.recall, a.precision, b.f1) == pytest.approx((1.0, 1 / 3, 0.0))
    hyp, ref = "der compiler übersetzt die programm schnell heute", "der compiler übersetzt das programm schnell ."
    r = metrics.bleu(pairs(spark, (hyp, ref))).first()
    assert (r.p1, r.p2, r.bleu) == pytest.approx((5 / 7, 3 / 6, 0))
    same = metrics.bleu(pairs(spark, (ref, ref))).first()
    assert (same.bleu, same.brevity) == pytest.approx((100, 1))
    assert [x.bleu for x in metrics.sentence_bleu(pairs(spark, (ref, ref), ("q", "z"))).orderBy("pair_id").collect()] == pytest.approx([100, 0])
    text = spark.createDataFrame([(0, "abc def", "abcdef"), (1, "xyz", "abc")], "pair_id int, hypothesis string, reference string")
    assert [x.chrf for x in metrics.chrf(text).orderBy("pair_id").collect()] == pytest.approx([100, 0])
    rows = metrics.word_errors(pairs(spark, ("a b c", "a x c d"), ("a", ""), ("", "a b"))).orderBy("pair_id").collect()
    assert [(x.errors, x.words) for x in rows] == [(2, 4), (1, 0), (2, 2)] and rows[1].wer is None


def test_numbers(spark):
    assert [udfs.german_year(n) for n in (1954, 1100, 2021)] == ["neunzehnhundertvierundfünfzig", "elfhundert", "zweitausendeinundzwanzig"]
    assert [udfs.german_cardinal(n) for n in (0, 1, 21, 101, 1001, 31000, 2_000_001)] == ["null", "eins", "einundzwanzig", "hunderteins", "tausendeins", "einunddreißigtausend", "zwei Millionen eins"]
    cardinals = {7: "sieben", 11: "elf", 12: "zwölf", 16: "sechzehn", 17: "siebzehn", 30: "dreißig", 99: "neunundneunzig", 100: "hundert", 256: "zweihundertsechsundfünfzig", 1000: "tausend", 1024: "tausendvierundzwanzig", 2009: "zweitausendneun", 101000: "hunderteintausend", 10**6: "eine Million", 2_500_000: "zwei Millionen fünfhunderttausend", 3 * 10**9: "drei Milliarden", -5: "minus fünf"}
    assert {n: udfs.german_cardinal(n) for n in cardinals} == cardinals
    assert udfs.german_cardinal(1954, spaced=True) == "tausend neunhundert vierundfünfzig"
    years = {1900: "neunzehnhundert", 1843: "achtzehnhundertdreiundvierzig", 999: "neunhundertneunundneunzig"}
    assert {n: udfs.german_year(n) for n in years} == years
    assert [udfs.german_ordinal(n) for n in (1, 3, 8, 12, 20, 101)] == ["erste", "dritte", "achte", "zwölfte", "zwanzigste", "hunderterste"]
    ordinals = {(3, "en"): "dritten", (7, "er"): "siebter", (19, "en"): "neunzehnten", (21, "en"): "einundzwanzigsten", (100, "e"): "hundertste", (1000, "es"): "tausendstes"}
    assert {k: udfs.german_ordinal(*k) for k in ordinals} == ordinals
    assert one(spark, *[T.plural_ru(F.lit(n), "день", "дня", "дней") for n in (1, 3, 11, 14, 22)]) == ("день", "дня", "дней", "дней", "дня")
    assert one(spark, T.german_number(F.lit("1,234.5"))) == ("1.234,5",)


def test_normal_forms(spark):
    assert one(spark, T.phrase(F.lit("Straße, Füße")), T.phrase(F.lit("Café „Müller“")), T.phrase(F.lit("Ещё раз — ёлка"))) == ("strasse fuesse", "cafe mueller", "еще раз елка")
    assert one(spark, T.tokens(F.lit("Ёж, e-mail и X1!")))[0] == ["еж", "e-mail", "и", "x1"]
    assert one(spark, T.letters(F.lit("Grün 12-Äpfel!")), T.latinize(F.lit("щука")), T.script_language(F.lit("да yes")))[:2] == ("grün äpfel", "shchuka")
    assert one(spark, *[T.date_key(F.lit(v)) for v in ("05.01.2024", "2024-01-05 10:00:00", "soon", "")]) == ("20240105", "20240105", "", "")
    assert one(spark, T.pair_map(F.lit("a=1; b ;c=x=y")))[0] == {"a": "1", "b": "1", "c": "x=y"}
    assert one(spark, T.word_shape(F.lit("McDonald12")), T.tag_form(F.lit("1984")), T.tag_form(F.lit("12")), T.tag_form(F.lit("Word"))) == ("XxXxd", "!YEAR", "!DIGITS", "word")
    assert one(spark, T.fragments(F.lit("abcdefgh"), 4, 3), T.fragments(F.lit("ab"), 4, 3), T.fragments(F.lit(""), 4, 3)) == (["abcd", "defg"], ["ab"], [])


def test_levels(spark):
    full = F.array(*[F.lit(int(32767 * math.sin(2 * math.pi * i / 100))).cast("smallint") for i in range(100)])
    silent, sine = one(spark, T.level_db(F.array(F.lit(0), F.lit(0))), T.level_db(full))
    assert silent == -100 and sine == pytest.approx(-3.01, abs=0.05)


def test_sentences():
    cut = lambda t: [t[a:b] for a, b in udfs.sentence_spans(t)]
    assert cut("Dr. Smith came. He left!\nNew line") == ["Dr. Smith came.", "He left!", "New line"]
    assert cut("Am 3. Mai war es z.B. kalt. Ende") == ["Am 3. Mai war es z.B. kalt.", "Ende"]
    assert cut("") == [] and cut("  \n ") == []
    assert [w for w, *_ in udfs.penn_tokens("I don't pay $5.50, see https://a.b/c")] == ["I", "do", "n't", "pay", "$", "5.50", ",", "see", "https://a.b/c"]


def test_markup(spark):
    html = "<html><head><title> A &amp; B </title></head><body><script>x<y</script><p>One</p><p>Two&nbsp;x</p><!-- no --></body></html>"
    assert one(spark, T.html_title(F.lit(html)), T.html_text(F.lit(html))) == ("A & B", "One\nTwo x")
    assert one(spark, T.main_part(F.lit("<p>a</p><article>b</article>")), T.dehyphenate(F.lit("Wort-\nteil"))) == ("b", "Wortteil")


def test_suggestions(spark):
    vocabulary = spark.createDataFrame([("коммутатор", 5), ("комната", 9), ("кот", 2)], "form string, freq long")
    words = spark.createDataFrame([("коммутатро",), ("кит",), ("zzz",), ("оммутатор",), ("caot",), ("xoat",), ("coasst",), ("coaste",)], "word string")
    more = vocabulary.union(spark.createDataFrame([("coat", 3), ("coats", 3), ("coast", 3)], "form string, freq long"))
    # under four letters nothing; a swap is one edit; short words keep their first letter, long ones need not
    assert {r.word: (r.correction, r.distance) for r in suggest.corrections(words, more).collect()} == {"коммутатро": ("коммутатор", 1), "оммутатор": ("коммутатор", 1), "caot": ("coat", 1), "coasst": ("coast", 1), "coaste": ("coast", 1)}
    history = spark.createDataFrame([("комната с видом", 1)], "query string, n long")
    got = suggest.autocomplete(spark.createDataFrame([("ком",)], "prefix string"), history, vocabulary).orderBy("rank").collect()
    assert [r.suggestion for r in got] == ["комната с видом", "комната", "коммутатор"]


def test_lexicon(spark):
    lines = spark.createDataFrame([(0, 1, "# no"), (0, 2, "house\tnoun\tHaus\tn"), (0, 3, "run\tverb\tlaufen"), (0, 4, "bad"), (0, 5, "house\tnoun\tGebäude\tn\t\t\tlaw")], "file_no int, line_no int, value string")
    entries = lexicon.parse_lines(lines)
    assert entries.count() == 3
    user = entries.filter("de = 'Haus'").withColumn("de", F.lit("Heim"))
    merged = lexicon.overlay(entries, user)
    assert {r.de for r in merged.collect()} == {"Heim", "laufen", "Gebäude"}
    words = spark.createDataFrame([(1, "House", "noun"), (2, "run", "noun"), (3, "none", "noun")], "word_id int, en string, pos string")
    assert {r.word_id: r.de for r in lexicon.lookup(words, merged).collect()} == {1: "Heim", 2: "laufen"}
    assert {r.word_id: r.de for r in lexicon.lookup(words, merged, "law").collect()}[1] == "Gebäude"
    assert lexicon.browse(merged, "ho", limit=1).first().total == 2
    tokens = spark.createDataFrame([(1, i, w) for i, w in enumerate("in the long run we run".split())], "doc_id int, pos int, word string")
    phrases = spark.createDataFrame([("the long run",), ("the long",), ("in the",)], "phrase string")
    assert {(r.pos, r.phrase) for r in lexicon.longest_phrases(tokens, phrases).collect()} == {(0, "in the"), (1, "the long run")}
    assert lexicon.translate_words(tokens, merged).first().translation == "in the long laufen we laufen"
    examples = spark.createDataFrame([("walked", "VBD", "walk"), ("talked", "VBD", "talk"), ("cities", "NNS", "city"), ("ladies", "NNS", "lady")], "form string, tag string, lemma string")
    rules = lexicon.suffix_rules(examples)
    new = spark.createDataFrame([("jumped", "VBD"), ("parties", "NNS"), ("xyz", "NN")], "form string, tag string")
    assert {r.form: r.lemma for r in lexicon.lemmatize(new, rules).collect()} == {"jumped": "jump", "parties": "party", "xyz": "xyz"}


def test_commands(spark):
    templates = spark.createDataFrame([("read", "lies vor"), ("count", "wie viele wörter hat der aufsatz"), ("stop", "halt")], "operation string, text string")
    phrases = spark.createDataFrame([(1, "ließ vor"), (2, "wieviele wörter hat der aufsatz"), (3, "bitte halt"), (4, "etwas ganz anderes")], "phrase_id int, text string")
    assert {r.phrase_id: r.operation for r in matching.match(phrases, templates).collect()} == {1: "read", 2: "count", 3: "stop"}


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert {tuple(r) for r in tables.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), "id").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    positions = spark.createDataFrame([("x", "a", 2, 10), ("x", "b", 3, 4), ("x", "c", 5, 20)], "account string, item string, units int, price int")
    assert {r.item: r.taken for r in tables.spend(positions, 35).collect()} == {"b": 3, "a": 2, "c": 1}
    waves = tables.wave_sizes(spark.createDataFrame([(1, 10), (2, 7)], "id int, total long"), 4)
    assert [r["size"] for r in waves.filter("id = 1").orderBy("wave").collect()] == [1, 2, 3, 4]
    assert sum(r["size"] for r in waves.filter("id = 2").collect()) == 7


def test_network():
    from textlake.operators import mlp

    texts = ["the thing that", "then the other", "with those things"] * 10 + ["que la casa", "una cosa que", "la mesa con"] * 10
    network = mlp.train(texts, ["en"] * 30 + ["es"] * 30, [" t", "th", "qu", "a ", "la", "e "])
    p = network.probabilities(np.sqrt(mlp.shares(["the path", "la vaca"], network.features)))
    assert network.languages == ["en", "es"] and p[0, 0] > 0.5 > p[1, 0] and np.allclose(p.sum(1), 1)
    assert mlp.shares([""], ["a"]).sum() == 0
