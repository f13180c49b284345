"""Conversation repair: the parser against every sequence of edits, long and hot conversations against whole ones."""

import hashlib
import random
import re

import pytest

from textlake.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def every_edit(turns):
    """Least (cost, audit) of all edits with at most two insertions in a row."""
    best = (4 * len(turns), "D" * len(turns))

    def go(i, letters, cost, audit, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(turns) and LEGAL.match(letters):
            best = min(best, (cost, audit))
        if inserted < 2:
            for r in "ua":
                go(i, letters + r, cost + 3, audit + "I", inserted + 1)
        if i < len(turns):
            go(i + 1, letters, cost + 4, audit + "D", 0)
            if turns[i] != "d":
                late = 3 * turns[i].isupper()
                go(i + 1, letters + turns[i].lower(), cost + late, audit + "K", 0)
                for r in "ua":
                    go(i + 1, letters + r, cost + late + 3, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


@pytest.mark.parametrize("size", range(6))
def test_parser_and_chain(size, monkeypatch):
    rng = random.Random(size)
    for _ in range(60):
        turns = "".join(rng.choice("suaxSUAXdua") for _ in range(size))
        want = every_edit(turns)
        for block in (1, 2, 32):
            monkeypatch.setattr(repair, "BLOCK", block)
            assert repair.cheapest(turns) == want, (turns, block)


def _told(rows):
    """The plain reading of the same rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [(t, r, x) for t, r, x, n in rows for _ in range(n)]
    *n, audit, lines = repair._whole(turns)
    return (*n, audit, hashlib.sha256(lines.encode()).hexdigest())


@pytest.mark.parametrize(("most", "partitions"), [(4096, 1), (4096, 7), (5, 3)])
def test_repair_of_hot_and_odd_conversations(spark, most, partitions):
    rng = random.Random(most + partitions)
    rows = []
    for conv in [None, *range(12), *[99] * 9]:
        for _ in range(rng.randrange(14) if conv != 99 else 30):
            role, text = rng.choice([("user", "user"), ("assistant", "assistant"), ("system", "system"), (None, " "), ("", "")]), rng.choice([("Ja.", "Ja."), ("so", "so"), ("", ""), (None, " "), ("Wie? ", "Wie? "), ("a\nb.", "a\nb."), ("x" * 50 + "!", "x" * 50 + "!")])
            rows.append((conv, rng.choice([None, *range(9)]), role, text, rng.choice([0, 1, 1, 1, 2])))
    rows += [(7, 3, ("user", "user"), ("Gleich.", "Gleich."), 1)] * 40 + [(555, 1, ("user", "user"), ("weg", "weg"), 0)]
    table = spark.createDataFrame([(c, t, r[0], x[0], n, "other", 1) for c, t, r, x, n in rows], "conv_id long, turn long, role string, text string, times int, key string, at int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        done = repair.repair(table, times="times", most=most)
        got = {r[0]: tuple(r[1:]) for r in repair.digests(done).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    by = {}
    for c, t, r, x, n in rows:
        by.setdefault(c, []).append((t, r[1], x[1], n))
    assert got == {c: _told(r) for c, r in by.items()}
    assert got[555] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.digests(repair.repair(empty)).collect() == []


def test_long_text(spark):
    long = "wort " * 400_000 + "Ende."
    table = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "Ja.")], "conv_id long, turn long, role string, text string")
    row = repair.digests(repair.repair(table)).first()
    assert (row["cost"], row["audit"], row["repaired_sha256"]) == (0, "KK", hashlib.sha256(f"user:{long}\nassistant:Ja.".encode()).hexdigest())
