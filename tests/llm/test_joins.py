"""The n-gram Jaccard join and the source divergence audit against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from textlake.llm import divergence, sigtree

DOCS = "doc_id long, text string, lang string, source string, node int, lang_ string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingle_set(text, size=4):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def classes(rows, similar=85):
    """Component of each row by comparing all sets."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= similar * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def family():
    """Copies, chains of small changes around the limit, shared passages, odd texts."""
    rng = random.Random(11)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    made = [None, "", " \n\t", "Eins", "eins", "zwei drei", "zwei  DREI", "a b c d", "a b c d e", "A b\tc d", "ab " * 300, "x" * 9000]
    for size in (6, 7, 8, 12, 20, 40, 90, 200):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for step in range(9):
            made.append(" ".join(base))
            for _ in range(1 + step % 3):
                base[rng.randrange(size)] = rng.choice(vocabulary)
            if step % 4 == 3:
                base = base + [rng.choice(vocabulary) for _ in range(max(size // 12, 1))]
                size = len(base)
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    made += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(25)]
    long = [rng.choice(vocabulary) for _ in range(30_000)]
    made += [" ".join(long), " ".join(long[:-900]), " ".join(long[:25_000])]
    return made


@pytest.mark.parametrize(("sets", "count"), [(2_000, 1), (5, 2)])
def test_join_is_every_pair(spark, family, monkeypatch, sets, count):
    monkeypatch.setattr(sigtree, "SETS", sets)
    monkeypatch.setattr(sigtree, "FEW", 10**6 if count == 1 else 0)
    rows = [(i, t) for i, t in enumerate(family)] + [(3, family[20]), (None, family[20]), (None, "allein und ohne Namen hier"), (20, family[20])]
    table = spark.createDataFrame([(k, t, "x", "y", 7, "z") for k, t in rows], DOCS).repartition(5)
    got = sorted(map(tuple, sigtree.join(table).collect()), key=str)
    assert got == classes(rows)


def test_join_of_nothing(spark):
    assert sigtree.join(spark.createDataFrame([], DOCS)).collect() == []


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(5)
    for n in (7, 8, 11, 12, 17, 18, 60, 61, 300, 1000):
        for _ in range(20):
            one = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            share = n
            while 100 * (share - 1) >= 85 * (n + n - share + 1):  # as many replaced as allowed
                share -= 1
            two = np.unique(np.r_[one[rng.permutation(n)[:share]], rng.integers(0, 2**63, n - share).astype(np.uint64)])
            short = one[rng.permutation(n)[: -(-85 * n // 100)]]
            for other in (two, np.sort(short)):
                assert set(sigtree.part_keys(one, 85)[0]) & set(sigtree.part_keys(other, 85)[0]), n


def test_tree_prunes(family):
    sets = [s for s in {sigtree.shingles(t).tobytes(): sigtree.shingles(t) for t in family if t}.values() if len(s)]
    counts = {}
    found = sigtree.linked(list(range(len(sets))), sets, 85, counts=counts)
    assert found and counts["sets"] < len(sets) * (len(sets) - 1) // 20


def audit_plain(rows, fewest, most):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in terms}:
        seen, n = Counter(), defaultdict(Counter)
        for own, source, found in terms:
            if own == lang:
                seen.update(set(found))
                n[source].update(found)
        kept = [t for t, k in seen.items() if k >= fewest]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // total for t in kept}

        q, p = shares(sum(n.values(), Counter())), {s: shares(c) for s, c in n.items()}
        for s in n:
            apart = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in n if o != s]
            above = [(p[s][t] - q[t], t) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", apart, None), ("term", above, most)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("side", "terms", "quarter", "light"), [(128, 512, 4, 128), (2, 5, 4, 3), (3, 7, 1, 10**6), (4, 3, 10**6, 10**6)])
def test_audit(spark, monkeypatch, side, terms, quarter, light):
    """Tiles, single sums and corrections, whatever is heavy: none, some or all terms."""
    for name, value in (("SIDE", side), ("TERMS", terms), ("QUARTER", quarter), ("LIGHT", light)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(3)
    vocabulary = ["Haus", "haus", "éa", "ÉA", "it's", "x1y", "日本", "ſ"] + [f"{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    rows = []
    for i in range(260):
        lang, source = rng.choice(["de", "de", "en", None]), rng.choice([None, "", *(f"s{k}" for k in range(9)), "hot", "hot"])
        start = hash((lang, source)) % 30 if source != "hot" else 0
        rows.append((" ".join(rng.choice(vocabulary[start : start + 25] or vocabulary) for _ in range(rng.randrange(40))), lang, source))
    rows += [(None, "de", "leer"), ("", "xx", "eins"), ("selten", "xx", "zwei"), (rows[0]), (rows[0])]
    table = spark.createDataFrame([(i, t, la, so, 1, "c") for i, (t, la, so) in enumerate(rows)], DOCS)
    got = sorted(map(tuple, divergence.audit(table, fewest=5, most=4).collect()))
    assert got == audit_plain(rows, 5, 4)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_shares_stay_exact(spark):
    rows = [(0, 1), (10**12, 10**13), (3, 9 * 10**15 // 1), (9 * 10**14, 9 * 10**15)]
    got = spark.createDataFrame(rows, "n long, total long").select(divergence.share("n", "total")).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 5) // t for n, t in rows]


def test_closing_closes_its_own_tables_whatever_fails(spark):
    from textlake.llm.shared import Scratch

    outside = Scratch(spark)
    made = []
    with pytest.raises(ValueError, match="stage"), Scratch.closing():
        made.append(Scratch(spark))
        made[0].write(spark.range(3))
        with Scratch.closing():
            made.append(Scratch(spark))
        assert made[1] not in Scratch.opened and made[0] in Scratch.opened
        raise ValueError("stage")
    assert made[0] not in Scratch.opened and outside in Scratch.opened
    outside.close()


def test_jaccard_takes_simhash_candidates(spark, monkeypatch):
    """Without bands, copies whose fingerprints differ by at most two bits are found by SimHash alone, and sets decide."""
    from textlake.llm import jaccard, simhash

    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(base), " ".join(f"v{i}" for i in range(600)), "", None]
    a, b = simhash.fingerprint(texts[0]), simhash.fingerprint(texts[1])
    assert a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    monkeypatch.setattr(jaccard, "band_hashes", lambda hashes: [])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard.drop_near_duplicates(docs).collect()) == [0, 3, 4]
    assert sorted(r["doc_id"] for r in jaccard.drop_near_duplicates(docs, similar=1.0).collect()) == [0, 1, 3, 4]
