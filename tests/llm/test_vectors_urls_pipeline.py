"""Vector search, URL filters and the pipeline against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.llm import ann, urls
from textlake.llm.queries import RULES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:500] = x[300]
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    odd = [(1000, None, 0), (1100, [0.0] * 16, 0), (1200, [float("nan")] * 16, 0), (1300, [1.0] * 15 + [None], 0), (1400, [1.0] * 8, 0), (1500, [float("inf")] * 16, 0), (None, [1.0] * 16, 0), (1600, [], 0)]
    return spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int"), x.astype(np.float64)


def brute(x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:k]
    return [(int(i), float(d[i])) for i in order]


@pytest.mark.parametrize("block", [20_000, 60])
def test_search(vectors, block):
    df, x = vectors
    rows = ann.search(df, F.col("vec_id") % 100 == 0, probes=1.0, block=block).collect()
    for q in range(0, 900, 100):
        got = [(r.vec_id, r.score) for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])]
        want = brute(x, q)
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want], rtol=0, atol=1e-12)
    assert {r.query_id for r in rows} == set(range(0, 900, 100))


def test_recall(vectors):
    df, x = vectors
    rows = ann.search(df, F.col("vec_id") % 10 == 0).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(found[q] & {i for i, _ in brute(x, q)}) for q in range(0, 900, 10)]
    assert np.mean(hits) >= 9


def test_structured_vectors_need_few_parts(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16)) * 6
    x = (centres[rng.integers(60, size=6000)] + rng.normal(size=(6000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    model = ann.train(x[:3000].astype(float), 16)
    assert ann.probes_needed(model, x[3000:].astype(float), 0.95) <= 3  # under a fifth of the parts
    rows = ann.search(df, F.col("vec_id") % 100 == 0, parts=16, sample=3000, tune=2000).collect()
    x = x.astype(np.float64)
    hits = [len({r.vec_id for r in rows if r.query_id == q} & {i for i, _ in brute(x, q)}) for q in range(0, 6000, 100)]
    assert np.mean(hits) >= 9


def test_repeated_ids_other_lengths_and_clashing_names(spark):
    schema = "vec_id long, embedding array<float>, id string, part int, near string"
    rows = [(0, [0.0, 1.0]), (0, [0.0, 9.0]), (1, [0.0, 2.0]), (1, [0.0, 5.0]), (1, [0.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0, 1.0, 1.0]), (100, [1.0, 1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], schema)
    got = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 100 == 0, probes=1.0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 3.0), (100, 1, 3, 1.0)]


def test_small_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert not ann.search(spark.createDataFrame([], schema), F.lit(True)).count()
    one = spark.createDataFrame([(0, [1.0, 2.0], 0)], schema)
    assert not ann.search(one, F.lit(True)).count()
    two = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0, 3.0], 0)], schema)
    assert [tuple(r) for r in ann.search(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8))
    part = ann.balanced_parts(ann.neighbour_graph(x, 10), x, 5, rng)
    assert np.bincount(part, minlength=5).max() <= 110 and set(part) == set(range(5))


URLS = ["http://a.Example.COM/en/7x?q=1", "https://x.com/en/", "http://com/en/zz#f", "http://notcom/en/", "no scheme", None, "", "://", "http://h", "http://h?x/y", "ftp://user@q.net:80/de/8/", "http://example.net/de/9", "http://m.example.net/de/81", "http://a.org/es", "HTTP://A.ORG/es/1://z/", "http://big-casino-win.net/fr/3"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "<p>good words here and there</p>" * 3) for i, u in enumerate([*URLS, *[f"http://plain{i}.org/de/{i}" for i in range(40)], *["http://casino-win.net/fr/1"] * 5])], "page_id long, url string, html string")
    rows = {r.page_id: r for r in urls.judge(pages, urls.fit(pages), RULES).collect()}
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        assert (rows[i].host, rows[i].path) == (host, path)
        assert rows[i].rule == (max(fits)[1] if fits else None)
        if fits:
            assert rows[i].verdict == max(fits)[2]
    assert rows[len(URLS) - 1].verdict == "block" and rows[8].verdict == "allow" and {r.verdict for r in rows.values()} == {"allow", "block"}
    empty = pages.limit(0)
    assert not urls.judge(empty, urls.fit(empty), RULES).count()


def test_url_rules_are_those_of_the_contract(spark):
    from pyspark.sql import functions as F

    told = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {rule: verdict for verdict, rule in RULES} == told and len(RULES) == 5
    urls_ = {"http://a.net/de/1": ("net/de/", "allow"), "http://example.net/de/81": ("example.net/de/8", "block"), "http://m.example.net/de/7": ("net/de/", "allow")}
    host, path = urls.split_url(F.col("url"))
    rule, verdict = urls.rule_columns(F.col("host"), F.col("path"), RULES)
    rows = spark.createDataFrame([(u,) for u in urls_], "url string").select("url", host.alias("host"), path.alias("path")).select("url", rule.alias("rule"), verdict.alias("verdict")).collect()
    assert {r.url: (r.rule, r.verdict) for r in rows} == urls_


def brute_split(name, counts):
    """Every cut of a name; least cost, then fewer words, then the longer last word."""
    import itertools
    from math import log

    if name.isdigit():
        return ["0"]
    once = log(sum(counts.values()) + 1)
    cost = lambda w: once - log(counts[w]) if w in counts else once + 3 * len(w)
    cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(name)), n) for n in range(len(name)))
    every = [[name[a:b] for a, b in zip((0, *c), (*c, len(name)), strict=True)] for c in cuts]
    return min(every, key=lambda ws: (round(sum(map(cost, ws)), 9), len(ws), -len(ws[-1])))


def test_segmentation_is_the_likeliest(spark):
    counts = {"free": 50, "bets": 20, "be": 5, "ts": 5, "f": 1, "casino": 7, "win": 3}
    words = spark.createDataFrame(list(counts.items()), "w string, n long")
    names = ["freebets", "freebe", "tsfree", "xfree", "f", "winwin", "casinowin", "zzzz", "2024", "été"]
    got = {r.part: r.words for r in urls.segmented(spark.createDataFrame([(n,) for n in names], "part string"), words, sum(counts.values()) + 1).collect()}
    assert got == {n: brute_split(n, counts) for n in names} and got["freebets"] == ["free", "bets"]


def test_bayes_equals_brute_force_and_reaches_beyond_its_seeds(spark):
    from math import log

    plain = [f"http://{w}.org/{t}/{i}" for i, w in enumerate(["river", "stone", "letter", "window", "garden"] * 8) for t in ("news", "about")]
    bad = [f"http://{w}.org/offer/{i}" for i, w in enumerate(["casinofarm", "farm-casino", "pokerfarm"] * 5)] + ["http://fine.org/casino/poker/9"]
    odd = ["http://farm.org/offer/1", "http://farm.org/offer/77", "http://unheard.org/", None, "", "http://" + "stone" * 400 + ".org/x", "http://two\nlines.org/a\nb"]
    rows = [(i, u, "<p>river stone letter window garden casino farm poker news about offer org fine</p>", "x", 1.0) for i, u in enumerate([*plain, *bad, *odd, plain[0]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, HOST string, block_odds double")
    model = urls.fit(pages, seeds=("casino", "poker"), rounds=0)
    got = urls.judge(pages, model, [])
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict", "block_odds"]
    got = {r.page_id: r for r in got.collect()}
    counts = {r.w: r.n for r in model.words.collect()}
    import re

    def tokens(u):
        _, mark, rest = (u or "").partition("://")
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest if mark else "").groups()
        return [m + w for m, t in (("", host.lower()), ("/", path.lower())) for p in re.findall("[a-z]+|[0-9]+", t) for w in (brute_split(p, counts) if len(p) < 16 else ["stone"] * 400)]

    bags = {r[0]: tokens(r[1]) for r in rows}
    label = {i: any(t.lstrip("/") in ("casino", "poker") for t in b) for i, b in bags.items()}
    vocabulary = {t for b in bags.values() for t in b}
    n = {side: {t: 1 + sum(b.count(t) for i, b in bags.items() if label[i] == side) for t in vocabulary} for side in (True, False)}
    total = {side: sum(n[side].values()) + 1 for side in n}
    prior = log((sum(label.values()) + 1) / (len(label) - sum(label.values()) + 1))
    for i, b in bags.items():
        want = prior + sum(log(n[True][t] / total[True]) - log(n[False][t] / total[False]) for t in b)
        assert got[i].block_odds == pytest.approx(want, abs=1e-9)
        assert got[i].verdict == ("block" if want > 0 else "allow")
    again = {r.page_id: r.verdict for r in urls.judge(pages, urls.fit(pages, seeds=("casino", "poker")), []).collect()}
    first = len(plain) + len(bad)
    assert again[first] == again[first + 1] == "block", "the seed word is gone, what came with it tells"
    assert all(again[i] == "allow" for i in range(len(plain))) and again[first - 1] == "block"


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def holds(text, items):
    """Does a text hold one of the items: 80 % of 13 words in a row, of a shorter item 80 % of it?"""
    import re
    from math import ceil

    split = lambda t: np.array([hash(w) for w in re.split(r"[^\w]+|_", (t or "").lower()) if w])
    doc = split(text)
    for item in map(split, items):
        size = min(13, len(item))
        for shift in range(1 - len(item), len(doc)) if size else ():
            a, b = max(shift, 0), min(shift + len(item), len(doc))
            agree = np.cumsum(np.concatenate([[0], doc[a:b] == item[a - shift : b - shift]]))
            if len(agree) > size and (agree[size:] - agree[:-size]).max() >= ceil(0.8 * size - 1e-9):
                return True
    return False


def test_pipeline(spark):
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from textlake.llm import bpe, queries, secrets
    from textlake.llm.shared import Scratch, table

    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    scores = {r.doc_id: r.score for r in queries.op9_quality(spark, SF).collect()}
    kept = {i for i in rows if scores[i] >= 0.7}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, SF).cache()
        assert out.columns == columns, name
        if name == "near_duplicates":
            sets, root = {i: shingles(rows[i].text) for i in kept}, {i: i for i in kept}
            for i in sorted(kept):
                for j in sorted(kept):
                    if j < i and root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                        low, high = sorted((root[i], root[j]))
                        root = {k: low if r == high else r for k, r in root.items()}
            kept = {i for i in kept if root[i] == i}
        if name == "decontamination":
            items = [r.text for r in table(spark, SF, "benchmark").collect()]
            kept = {i for i in kept if not holds(rows[i].text, items)}
        assert {r.doc_id for r in out.collect()} == kept, name
        if name == "secrets":
            assert all(not secrets.base_spans(r.text) and r.n_chars == len(r.text) for r in out.collect())
    before = list(Scratch.opened)
    last = corpus_pipeline.run(spark, SF).collect()
    assert len(Scratch.opened) == len(before) + 1, "the tables of the stages are gone, the last result is not"
    assert {r.doc_id for r in last} == kept and all(r.round_trip and len(r.token_ids) == r.n_tokens for r in last)
    texts = {r.doc_id: r.text for r in out.collect()}
    ranks = bpe.coder(public_tokenizers.path(queries.BPE_FILE), public_tokenizers.PATTERN).ranks
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(list(r.token_ids) == other.encode_ordinary(texts[r.doc_id]) for r in last)


def test_stages_take_nulls_repeats_and_clashing_names(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _score double, _key string, row int, node long"
    long = "a long text of many words " * 4000
    texts = [None, "", " ", "one", "token = 'abcdefghijkl0123'", long, long, "plain words stand here"]
    docs = spark.createDataFrame([*[(i, t, None, None, None, 0.5, "k", 1, 2) for i, t in enumerate(texts)], (3, "one", None, None, None, 0.5, "k", 1, 2), (None, "no id", None, None, None, None, None, None, None)], schema)
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, "plain words stand here"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name != "tokens":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        if name == "near_duplicates":
            assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == [(0, None), (3, "one"), (4, texts[4]), (5, long), (7, texts[7])] and len(got) == 6
        if name == "decontamination":
            assert {r.doc_id for r in got} == {None, 0, 1, 2, 3, 4, 5, 6} and len(got) == 9
        if name in ("secrets", "tokens"):
            assert len(got) == 10
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.columns == out.columns and not none.count(), name
