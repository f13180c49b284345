"""Commands with slots against a plain version, validation, veto, odd phrases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import commands
from textlake.plans.commands import FILLERS, TEMPLATES, templates

FOLD = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    return 1 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0


def plain(text, known, mode):
    """The best template of each operation, then the first that is good enough, unless another mode is nearer."""
    every = [w for w in re.findall(r"[^\W_]+", (text or "").lower())]
    variants = [[w for w in every if w not in FILLERS]]
    if variants[0] != every:
        variants.append(every)
    best = {}
    for operation, place, number, shape, slotted, most, own in known:
        for v, ws in enumerate(variants):
            for skip in range(min(2, len(ws) - 1) + 1 if ws else 0):
                tail, size = ws[skip:], len(shape.split())
                like, head = 0.0, len(tail)
                if not slotted:
                    like = alike(" ".join(tail).translate(FOLD), shape)
                else:
                    for k in (size - 1, size, size + 1):
                        if 1 <= k < len(tail) and len(tail) - k <= most:
                            x = alike(" ".join(tail[:k]).translate(FOLD), shape)
                            if x > like:
                                like, head = x, k
                if like < 0.75:
                    continue
                key = (round(like - 0.04 * skip, 6), size, -v, -number, -skip)
                if operation not in best or key > best[operation][0]:
                    best[operation] = (key, place, own, len(shape) <= 5, " ".join(tail[head:]) if slotted else None)
    good = [(k[0], k[1], -p, o, raw) for o, (k, p, own, short, raw) in best.items() if own == mode and k[0] >= (0.8 if short else 0.75)]
    if not good:
        return None
    top = max(good)
    if max((k[0] for k, _, own, _, _ in best.values() if own != mode), default=0) > top[0]:
        return None
    return top[3], top[0], top[4]


@pytest.mark.parametrize("mode", ["normal", "dictation"])
def test_phrases(spark, mode):
    known = [tuple(r) for r in templates(spark).filter("error IS NULL").select("operation", "place", "number", "shape", "slotted", "slot_words", "mode").collect()]
    rng = random.Random(4)
    said = [None, "", "  ", "bitte", "halt", "hallt", "bitte halt", "halt bitte mal", "öffne", "öffne den auftrag", "öffne den auftrag drei", "also jetzt öffne auftrag nummer sieben", "finde das wort haus und hof heute", "beende das diktat", "beginne das diktat", "x " * 500]
    for _ in range(120):
        ws = rng.choice([t[2].split(" {")[0] for t in TEMPLATES if t[0] != "bad"]).split() + rng.choice([[], ["sieben"], ["das", "große", "haus"], ["a", "b", "c", "d", "e"]])
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(ws))
            ws[i] = rng.choice([ws[i][:-1] or "x", ws[i] + "e", "mal", ws[i]])
        said.append(" ".join(rng.sample(["bitte", "also", "gut"], rng.randrange(3)) + ws))
    rows = spark.createDataFrame(list(enumerate(said)), "phrase_id long, text string")
    got = {r["phrase_id"]: (r["operation"], r["score"], r["raw"]) for r in commands.match(rows, templates(spark).filter("error IS NULL"), mode, FILLERS).collect()}
    for i, text in enumerate(said):
        assert got.get(i) == plain(text, known, mode), text


def test_slots_are_comparable_and_as_heard(spark):
    rows = spark.createDataFrame([(1, "Öffne den Auftrag Räuber Nr. 7!")], "phrase_id long, text string")
    row = commands.match(rows, templates(spark).filter("error IS NULL"), "normal").first()
    assert (row["operation"], row["score"], row["slot"], row["raw"]) == ("open", 1.0, "raeuber nr 7", "räuber nr 7")
    none = rows.filter("phrase_id > 1")
    assert not commands.match(none, templates(spark), "normal").count() and not commands.match(rows, templates(spark).limit(0), "normal").count()


def test_phrase_folds(spark):
    assert spark.range(1).select(T.phrase(F.lit("Räuber, Fuß"))).first()[0] == "raeuber fuss"
