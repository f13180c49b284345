"""What grows with the square of the input, or moves all of it again, does not pass a shuffle; rows stay those of plain versions."""

import re
from collections import Counter

from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import clauses, evaluation, index, metrics, parsing, search, studies, summarize
from textlake.plans import keywordtree as keywordtree_plans


def docs(spark, n=40):
    words = F.concat_ws(" ", F.lit("the"), *[F.concat(F.lit(c), (F.col("id") % k).cast("string")) for c, k in (("aa", 3), ("bb", 7), ("cc", 11))], F.concat(F.lit("zz"), F.col("id").cast("string")))
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words, words).alias("text"))
    return rows.union(spark.createDataFrame([(1, "aa1 twice"), (None, "bb2"), (n, None), (n + 1, "")], "doc_id long, text string"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_similar_pairs_stay_in_tasks(spark):
    postings, documents = index.build(docs(spark))
    sources = docs(spark).filter("doc_id % 10 = 0")
    found = search.similar(postings, documents, sources)
    assert not [x for x in plan(found).split("\n") if "hashpartitioning(source_id" in x and "doc_id" in x.split("hashpartitioning")[1]]
    rows = {(r["doc_id"], r["other_id"]): r["score"] for r in found.collect()}
    weights = {}
    for r in postings.collect():
        weights.setdefault(r["doc_id"], {})[r["lemma"]] = r["weight"]
    norms = {r["doc_id"]: r["norm"] for r in documents.collect()}
    for (a, b), score in rows.items():
        own = {w: x for w, x in weights[a].items() if x > 0}
        dot = sum(x * weights[b].get(w, 0) for w, x in own.items())
        assert abs(dot / (sum(x * x for x in own.values()) ** 0.5 * norms[b]) - score) < 1e-9


def test_similar_of_every_document_in_blocks(spark, monkeypatch, tmp_path):
    """All documents have their nearest, as the query's SQL finds them, however many blocks they are dealt into."""
    import duckdb

    from textlake.operators import tiles
    from textlake.plans.queries import ORACLES, QUERIES

    every = docs(spark, 150).filter("doc_id is not null").dropDuplicates(["doc_id"])
    every.unionByName(spark.createDataFrame([(900, "the"), (901, "the"), (902, "aa1 aa1 cc3")], "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(f"SELECT doc_id, rank, other_id, score FROM ({ORACLES['similar_docs']}) ORDER BY doc_id, rank").fetchall()
    assert len({w[0] for w in want}) > 140
    for tile, least, short in ((6_000_000, 250_000, 256), (100, 250_000, 1), (6_000_000, 10, 5)):
        monkeypatch.setattr(search, "TILE", tile)
        monkeypatch.setattr(search, "LEAST_TILE", least)
        monkeypatch.setattr(tiles, "SHORT", short)  # of this process alone: workers have the module's
        got = QUERIES["similar_docs"](spark, str(tmp_path)).select("doc_id", "rank", "other_id", "score").orderBy("doc_id", "rank").collect()
        assert [tuple(r) for r in got] == want


def test_block_scores_are_plain_sums(monkeypatch):
    import numpy as np

    from textlake.operators import tiles

    rng = np.random.default_rng(7)
    vectors = [dict(zip(rng.choice(60, rng.integers(1, 25), replace=False).tolist(), rng.uniform(0.1, 2, 25).tolist(), strict=False)) for _ in range(1500)]
    vectors += vectors[:200] + [{3: 1.0}] * 30
    lists = lambda vs: (np.array([len(v) for v in vs]), np.array([k for v in vs for k in v]), np.array([w for v in vs for w in v.values()]))
    norms = np.array([sum(w * w for w in v.values()) ** 0.5 for v in vectors])
    ids = rng.permutation(len(vectors)) * 3
    block = tiles.Block(ids, norms, *lists(vectors))
    for short, cells in ((256, 1 << 20), (1, 5000), (10**6, 1)):
        monkeypatch.setattr(tiles, "SHORT", short)
        monkeypatch.setattr(tiles, "CELLS", cells)
        asked = [{3: 2.0}, {999: 1.0}, *vectors[:40]]
        source, doc, score = block.nearest(np.array([10**6, 10**6 + 1, *ids[:40]]), *lists(asked), 10)
        for own, v in zip([10**6, 10**6 + 1, *ids[:40]], asked, strict=True):
            plain = sorted((-round(sum(w * o.get(k, 0) for k, w in v.items()) / n / sum(w * w for w in v.values()) ** 0.5, 10), i) for i, o, n in zip(ids.tolist(), vectors, norms.tolist(), strict=True) if i != own)
            want = [(i, -s) for s, i in plain[:10] if s < 0]
            got = sorted(zip(doc[source == own].tolist(), np.round(score[source == own], 10).tolist(), strict=True), key=lambda x: (-x[1], x[0]))
            assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-9)


def test_index_of_common_and_rare_words(spark, monkeypatch):
    """Whether a word is broadcast or shuffled, it has the same postings; texts of one key are one document."""
    every = lambda: sorted((str(r["doc_id"]), r["lemma"], r["tf"], r["df"], round(r["weight"], 9)) for r in index.build(docs(spark))[0].collect())
    found = every()
    assert ("1", "aa1", 3, 13) in [r[:4] for r in found] and ("None", "bb2", 1, 7) in [r[:4] for r in found]
    for common in (1, 10):
        monkeypatch.setattr(index, "COMMON", common)
        assert every() == found


def test_sentence_weights_move_no_words(spark):
    """Scores are those of weights joined to words, also when a key repeats, and no shuffle holds (document, sentence, word)."""
    every = docs(spark).withColumn("text", F.concat_ws(". ", "text", F.lit("The end"), "text"))
    sentences = summarize.sentence_rows(every, T.simple_sentences("par_text"))
    found = summarize.weigh_sentences(sentences, index.size(every))
    assert not [x for x in plan(found).split("\n") if "hashpartitioning" in x and "idx" in x and "lemma" in x.split("hashpartitioning")[1]]
    plain = summarize.sentence_scores(sentences, summarize.term_weights(index.term_frequencies(every), index.size(every)))
    rows = lambda df: sorted((str(r["doc_id"]), r["idx"], round(r["score"], 9), r["rank"]) for r in df.collect() if r["doc_id"] is not None)
    assert rows(found) == rows(plain) and len(rows(found)) > 80


def asked(spark):
    return search.query_vectors(spark.createDataFrame([(q, w) for q in range(3) for w in ("the", f"aa{q}", f"bb{q + 1}", f"zz{q * 10}", "no-such")], "query_id long, lemma string"))


def test_searches_meet_queries_in_tasks(spark):
    """No pair of a query and a document passes a shuffle, several configurations read the postings once, and rows are
    those of searches one by one, also when the index holds the queries' words only."""
    vectors = asked(spark)
    every = {"base": search.Modifiers(), "strict": search.Modifiers(strict=True), "flat": search.Modifiers(flat_idf=True, square=True), "short": search.Modifiers(short_bonus=True)}
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 8), r["matched"]) for r in df.collect())
    postings, documents = index.build(docs(spark))
    few, same = index.build(docs(spark), wanted=vectors)
    found = search.search_all(vectors, few, same, every)
    assert not [x for x in plan(found).split("\n") if "hashpartitioning(query_id" in x and "doc_id" in x.split("hashpartitioning")[1].split(")")[0]]
    assert few.count() < postings.count()
    norms = lambda d: sorted((r["doc_id"], r["term_count"], round(r["norm"], 9)) for r in d.filter("doc_id is not null").collect())
    assert norms(same) == norms(documents)
    for name, m in every.items():
        assert rows(found.filter(F.col("configuration") == name)) == rows(search.search(vectors, postings, documents, m))
    weights = {(r["doc_id"], r["lemma"]): r["weight"] for r in postings.collect()}
    norm = {r["doc_id"]: r["norm"] for r in documents.collect()}
    words = {}
    for v in vectors.collect():
        words.setdefault(v["query_id"], []).append(v["lemma"])
    for q, rank, doc, score, matched in rows(found.filter("configuration = 'base'")):
        assert abs(sum(weights.get((doc, w), 0) for w in words[q]) / (len(words[q]) ** 0.5 * norm[doc]) - score) < 1e-7
        assert matched == sorted(w for w in words[q] if (doc, w) in weights)


def test_explanations_move_no_pairs(spark):
    """The heaviest words of every query and document, found beside the document's postings."""
    postings, _ = index.build(docs(spark))
    vectors = asked(spark)
    found = search.explain(vectors, postings, 2)
    assert not [x for x in plan(found).split("\n") if "hashpartitioning(query_id" in x and "doc_id" in x.split("hashpartitioning")[1].split(")")[0]]
    want = {}
    for r in postings.join(vectors.withColumnRenamed("weight", "w"), "lemma").collect():
        want.setdefault((r["query_id"], r["doc_id"]), []).append((r["weight"], r["lemma"]))
    got = {(r["query_id"], r["doc_id"]): [tuple(t) for t in r["terms"]] for r in found.collect()}
    assert got == {k: sorted(v, reverse=True)[:2] for k, v in want.items()}


def test_chrf_moves_no_grams(spark):
    """A pair's n-grams stay in its row; figures are those of plain counts, whatever the letters."""
    texts = [("abc def", "abcdef"), ("aaaa", "aa"), ("", "x"), ("y", ""), (None, "abc"), ("größe 😀😀", "gröss 😀"), ("ab" * 50, "ba" * 40)]
    pairs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "pair_id int, hypothesis string, reference string")
    found = metrics.chrf(pairs)
    assert "Exchange" not in plan(found)
    for r in found.collect():
        h, f = (re.sub(r"\s+", "", t or "") for t in texts[r["pair_id"]])
        each = []
        for a, b in ((h, f), (f, h)):
            grams = lambda s, n: Counter(s[i : i + n] for i in range(len(s) - n + 1))
            shares = [(grams(a, n) & grams(b, n)).total() / (len(a) - n + 1) for n in range(1, 7) if len(a) >= n]
            each.append(sum(shares) / len(shares) if shares else 0)
        p, q = each
        assert abs(r["chrf"] - (100 * 5 * p * q / (4 * p + q) if p + q else 0)) < 1e-9


def test_equal_numbers_are_compared_once(spark):
    """Phrases meet number words by what they say, once; ties go to the smaller number."""
    numbers = spark.createDataFrame([("zwei", 2), ("drei", 3), ("zwex", 9), ("zwel", 7)], "words string, number long")
    phrases = spark.createDataFrame([(i, t) for i, t in enumerate(["zwei", " ZWEI", "zwey", "17", "vier", None, "dreii", "zwey"])], "phrase_id long, text string")
    found = studies.spoken_numbers(phrases, numbers)
    assert "hashpartitioning(phrase_id" not in plan(found) and "hashpartitioning(said" in plan(found)
    assert sorted((r["phrase_id"], r["number"], round(r["score"], 6)) for r in found.collect()) == [(0, 2, 1.0), (1, 2, 1.0), (2, 2, 0.75), (3, 17, 1.0), (6, 3, 0.8), (7, 2, 0.75)]


def test_keywords_are_chosen_in_their_row(spark):
    """No Python sees a document's words; heads are those of a plain choice, also among equal weights."""
    words = [(d, w, 1 + (i + d) % 3, 0.5 * (i % 4)) for d in range(5) for i, w in enumerate("haus haustür tür ab garten gartenhaus zaun übung üben straße rasse hof bahnhof".split())]
    weights = spark.createDataFrame(words, "doc_id long, lemma string, tf long, weight double")
    found = summarize.keywords(weights, 4)
    assert "Pandas" not in plan(found)
    want = []
    for d in range(5):
        taken = []
        for value, w in sorted((-tf * x, w) for k, w, tf, x in words if k == d and x > 0 and len(w) > 2):
            if len(taken) < 4 and not any(w in t or t in w for _, t in taken):
                taken.append((value, w))
        want += [(d, n, w, -value) for n, (value, w) in enumerate(taken, 1)]
    assert sorted(tuple(r) for r in found.collect()) == want


def test_keyword_scores_stay_in_their_row(spark):
    """No word is shuffled or joined; shares are those of plain counts, ties by name."""
    rows = [(0, ["b", "x"], ["a", "b", "b", "c", "a"], ["a", "x", "x"]), (1, [], ["a"], ["a"]), (2, ["q", "r", "s"], ["q", "r", "r", "s"], ["r"]), (3, ["a"], [], [])]
    found = evaluation.keyword_scores(spark.createDataFrame(rows, "doc_id long, keywords array<string>, words array<string>, reference array<string>"))
    assert "Exchange" not in plan(found)
    assert sorted((r[0], round(r[1], 6), round(r[2], 6)) for r in found.collect()) == [(0, 0.5, 0.5), (2, 0.333333, 0.333333), (3, 0.0, 0.0)]


def test_parts_of_a_clause_are_placed_together(spark):
    """Subject and front are found beside a clause's parts: parts meet their clauses by one join."""
    heads = spark.createDataFrame([("a", "main", 2, "sieht", [], None, None, None)], clauses.CLAUSES)
    parts = spark.createDataFrame([("a", "subj", 1, False, False, ["er"]), ("a", "obj", 3, True, False, ["es"]), ("a", "adv", 0, False, False, ["heute"]), ("b", "adv", 0, False, False, ["nie"])], clauses.PARTS)
    found = clauses.linearized(heads, parts)
    assert plan(found).split("Initial Plan")[-1].count("Join ") == 1
    assert [tuple(r) for r in found.collect()] == [("a", ["heute", "sieht", "er", "es"], "adv")]


def test_training_reads_the_treebank_once(spark, monkeypatch):
    """The sentences learned from are chosen once, not at every pass."""
    seen = []
    monkeypatch.setattr(parsing.perceptron, "train", lambda examples, *a: seen.append(plan(examples)) or {})
    trees = spark.range(3).selectExpr("string(id) sent_id", "array('a', 'b') words", "array('X', 'Y') tags", "array(2, 0) heads", "array('obj', 'root') labels")
    assert parsing.train(trees, "sent_id").labels == ["obj", "root"]
    assert len(seen) == 2 and not [p for p in seen if "TakeOrdered" in p or "Sort" in p]


def test_keyword_trees_read_words_once(spark):
    """Words and terms are written once: no text is taken apart for every table that is made of them."""
    assert "regexp_extract_all" not in plan(keywordtree_plans.keyword_tree(spark, "/root/testdata/sf0.001"))
