"""Clause order against a plain version, and by hand."""

import random

from textlake.operators import clauses as C


def plain(clause, parts):
    _, kind, verb, finite, rest, prefix, fixed, intro = clause
    parts = sorted((p for p in parts if p[1] is not None), key=lambda p: (p[2], p[5]))
    pre, after = [p for p in parts if p[1] == "pre"], [p for p in parts if p[1] == "nachfeld"]
    parts = [p for p in parts if p[1] not in ("pre", "nachfeld")]
    subject = next((p for p in parts if p[1] == "subj"), None)
    anchor = min(verb, subject[2] if subject else verb)
    ahead = [p for p in parts if p[1] not in ("subj", "refl", "neg", "pred") and p[2] < anchor]

    def key(p):
        if p[3] and p[1] in ("obj", "iobj"):
            n = 2 if p[1] == "obj" else 3
        elif p[1] == "conn" or (p[1] == "adv" and p[2] < verb):
            n = 4
        else:
            n = {"subj": 0, "refl": 1, "iobj": 5, "neg": 7, "pred": 8}.get(p[1], 6)
        return n, p[2], p[5]

    front = None
    if kind == "main":
        front = next((p for p in ahead if p[1] != "conn"), subject or next(iter(ahead), None))
    elif kind == "question":
        asked = ahead + ([subject] if subject and subject[2] < verb else [])
        front = next((p for p in asked if p[5] and p[5][0].lower() in C.WH), None)
    middle = sorted((p for p in parts if p is not front), key=key)
    field = [w for p in middle for w in p[5]]
    head = intro + [w for p in pre for w in p[5]]
    verbs = [finite] if finite else []
    if kind in ("main", "imperative", "question"):
        out = head + (front[5] + ([","] if front[4] else []) if front else []) + verbs + field + fixed + ([prefix] if prefix and not rest else []) + rest
    elif kind in ("zu", "um"):
        out = head + (["um"] if kind == "um" else []) + field + fixed + rest
    else:
        out = head + field + fixed + rest + [(prefix if prefix and not rest else "") + w for w in verbs]
    return out + [w for p in after for w in p[5]], front[1] if front else None


def test_order(spark):
    rng = random.Random(2)
    rows, parts = [], []
    kinds = ["subj", "refl", "obj", "iobj", "conn", "adv", "neg", "pred", "pre", "nachfeld", "pp"]
    for i in range(300):
        places = rng.sample(range(12), 12)
        n = rng.randrange(7)
        rows.append((f"c{i}", rng.choice(["main", "main", "imperative", "question", "sub", "rel", "zu", "um"]), places.pop(), rng.choice(["macht", "hat", None, ""]), rng.choice([[], ["gemacht"], ["gemacht", "werden"]]), rng.choice([None, None, "auf"]), rng.choice([[], ["fest"]]), rng.choice([[], ["weil"]])))
        used = set()
        for k in range(n):
            kind = rng.choice(kinds)
            if kind == "subj" and "subj" in used:
                continue
            used.add(kind)
            parts.append((f"c{i}", kind, places[k], rng.random() < 0.3, rng.random() < 0.2, [rng.choice(["Wer", "wo", "der", "das"]), f"p{k}"][: rng.randrange(1, 3)]))
    extra = [("none", "subj", 1, False, False, ["x"]), ("c0", "obj", 99, None, None, None)]
    got = {r["clause_id"]: (r["words"], r["front"]) for r in C.linearized(spark.createDataFrame(rows, C.CLAUSES), spark.createDataFrame(parts + extra, C.PARTS)).collect()}
    assert set(got) == {r[0] for r in rows}
    for r in rows:
        own = [p for p in parts if p[0] == r[0]]
        assert got[r[0]] == plain(r, own), (r, own)


def test_sentences(spark):
    clauses = [("1", "main", 2, "lädt", [], "hoch", [], []), ("2", "sub", 2, "lädt", [], "hoch", [], ["weil"]), ("3", "main", 1, "hat", ["gelesen"], None, [], []), ("4", "um", 1, None, ["zu", "sehen"], None, [], []), ("5", "question", 2, "ist", [], None, [], [])]
    parts = [("1", "adv", 0, False, False, ["heute"]), ("1", "subj", 1, False, False, ["der", "Nutzer"]), ("1", "obj", 3, False, False, ["die", "Datei"]), ("1", "neg", 4, False, False, ["nicht"]),
             ("2", "subj", 1, False, False, ["er"]), ("2", "obj", 3, True, False, ["sie"]), ("3", "subj", 0, False, False, ["sie"]), ("3", "iobj", 2, True, False, ["ihm"]), ("3", "obj", 3, True, False, ["es"]),
             ("4", "obj", 2, False, False, ["mehr"]), ("5", "subj", 0, False, False, ["Welcher", "Weg"]), ("5", "pred", 3, False, False, ["kurz"])]
    got = {r["clause_id"]: " ".join(r["words"]) for r in C.linearized(spark.createDataFrame(clauses, C.CLAUSES), spark.createDataFrame(parts, C.PARTS)).collect()}
    assert got == {"1": "heute lädt der Nutzer die Datei nicht hoch", "2": "weil er sie hochlädt", "3": "sie hat es ihm gelesen", "4": "um mehr zu sehen", "5": "Welcher Weg ist kurz"}
    none = spark.createDataFrame([], C.CLAUSES)
    assert C.linearized(none, spark.createDataFrame(parts, C.PARTS)).collect() == []
