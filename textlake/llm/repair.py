"""Repair of conversations: what is wrong with them, and the cheapest edits that give an orderly exchange of turns.

The order wanted is a grammar over the first letters of roles: nothing, or one or more pairs of user and
assistant, after at most one system turn. An Earley parser reads the turns; besides keeping a turn, its scanner
may give it another role, pass over it, or go on without it, each at a price.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.shared import Scratch, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: Turns that are parsed at a time: a longer conversation is a chain of such blocks.
BLOCK = 16

#: What has been read of the grammar: nothing, a system turn, a user turn without its answer, whole pairs.
START, SYSTEM, USER, PAIR = range(4)
RULES = {"T": (("P",), ("T", "P")), "P": (("u", "a"),)}
#: From what has been read, to what is to be read -> what may stand in between.
BETWEEN = {
    START: {START: ((),), SYSTEM: (("s",),), USER: (("u",), ("T", "u"), ("s", "u"), ("s", "T", "u")), PAIR: (("T",), ("s", "T"))},
    SYSTEM: {SYSTEM: ((),), USER: (("u",), ("T", "u")), PAIR: (("T",),)},
    USER: {USER: ((), ("a", "u"), ("a", "T", "u")), PAIR: (("a",), ("a", "T"))},
    PAIR: {USER: (("u",), ("T", "u")), PAIR: ((), ("T",))},
}
#: Where a conversation may end.
ENDS = (START, PAIR)

Weight = tuple[int, str]


@lru_cache(maxsize=50_000)
def parse(turns: str, start: int = START, closing: bool = True) -> dict[int, Weight]:
    """Least (cost, audit) to read all turns from `start`, for each point of the grammar reached.

    A turn is a letter: `s`, `u`, `a` by its role, `x` for any other, in capitals if it is truncated, `d` if it has
    to go. closing: these are the last turns, so only ENDS are wanted and turns may be inserted after the last;
    else an insertion stands before the turn that follows it, in a later block.

    A chart column maps items (left side, right side, how much of it is read, where it began) to the least weight
    of what the item has read. Items that have read a terminal, and those of the whole block, may pass over turns.
    """
    columns: list[dict[tuple, Weight]] = [{} for _ in range(len(turns) + 1)]
    agenda: list[tuple] = []

    def put(at: int, item: tuple, weight: Weight) -> None:
        if item not in columns[at] or weight < columns[at][item]:
            columns[at][item] = weight
            if at == now:
                agenda.append(item)

    for now, column in enumerate(columns):
        agenda = list(column)
        if not now:
            for goal, sides in BETWEEN[start].items():
                if not closing or goal in ENDS:
                    for side in sides:
                        put(0, (goal, side, 0, 0), (0, ""))
        turn = turns[now : now + 1]
        late = TRUNCATED * turn.isupper()
        while agenda:
            item = agenda.pop()
            left, side, dot, began = item
            cost, audit = column[item]
            after = (left, side, dot + 1, began)
            if turn and (left in BETWEEN or 0 < dot < len(side)):
                put(now + 1, item, (cost + DELETE, audit + "D"))
            if dot == len(side):
                for waiting, (c, a) in list(columns[began].items()):
                    if waiting[1][waiting[2] : waiting[2] + 1] == (left,):
                        put(now, (*waiting[:2], waiting[2] + 1, waiting[3]), (c + cost, a + audit))
            elif side[dot] in RULES:
                for right in RULES[side[dot]]:
                    put(now, (side[dot], right, 0, now), (0, ""))
                for done, (c, a) in list(column.items()):  # what was read of no turn at all
                    if done[0] == side[dot] and done[2] == len(done[1]) and done[3] == now:
                        put(now, after, (cost + c, audit + a))
            else:
                if side[dot] in ROLES and (turn or closing):
                    put(now, after, (cost + INSERT, audit + "I"))
                if turn.lower() == side[dot]:
                    put(now + 1, after, (cost + KEEP + late, audit + "K"))
                elif turn and turn != "d" and side[dot] in ROLES:
                    put(now + 1, after, (cost + REROLE + late, audit + "R"))
    found: dict[int, Weight] = {}
    for (left, side, dot, _), weight in columns[-1].items():
        if left in BETWEEN and dot == len(side):
            found[left] = min(weight, found.get(left, weight))
    return found


class Chain:
    """The cheapest way through blocks, one after the other.

    Up to the end of a block two different audits differ in a letter that both have (each ends with the letter of a
    turn of its own), so their order never depends on what follows: for each point of the grammar the least cost
    and the rank of its audit among the others' are enough.
    """

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, int]] = {START: (0, 0)}
        self.came: list[dict[int, int]] = []

    def step(self, between: dict[tuple[int, int], Weight]) -> None:
        """Go through a block, given what it takes from one point to another."""
        least: dict[int, tuple] = {}
        for (p, q), (cost, audit) in between.items():
            if p in self.best:
                way = (self.best[p][0] + cost, self.best[p][1], audit, p)
                least[q] = min(way, least.get(q, way))
        order = sorted(least, key=lambda q: least[q][1:3])
        self.best = {q: (least[q][0], order.index(q)) for q in least}
        self.came.append({q: way[3] for q, way in least.items()})

    def path(self) -> tuple[list[int], Weight]:
        """The points before each block and after the last; what is still inserted there."""
        closings = {p: min(parse("", p).values()) for p in self.best}
        p = min(self.best, key=lambda p: (self.best[p][0] + closings[p][0], self.best[p][1]))
        points = [p]
        for came in reversed(self.came):
            points.append(came[points[-1]])
        return points[::-1], closings[p]


def ways(turns: str) -> dict[tuple[int, int], Weight]:
    """What a block takes from each point of the grammar to each."""
    return {(p, q): weight for p in BETWEEN for q, weight in parse(turns, p, False).items()}


def cheapest(turns: str) -> Weight:
    """Least (cost, audit) of a whole conversation."""
    if len(turns) <= BLOCK:
        return min(parse(turns).values())
    blocks = [ways(turns[i : i + BLOCK]) for i in range(0, len(turns), BLOCK)]
    chain = Chain()
    for block in blocks:
        chain.step(block)
    points, (cost, audit) = chain.path()
    steps = [block[pq] for block, pq in zip(blocks, zip(points, points[1:], strict=False), strict=True)]
    return cost + sum(c for c, _ in steps), "".join(a for _, a in steps) + audit


def edited(audit: str, turns: Iterable[tuple[str, str]], point: int = START) -> str:
    """`role:text` of each turn that the edits leave, joined by line ends."""
    rest, out = iter(turns), []
    for edit in audit:
        role, text = next(rest) if edit != "I" else ("", "")
        if edit == "D":
            continue
        wanted = "a" if point == USER else "u"
        out.append(f"{role if edit == 'K' else ROLES[wanted]}:{text}")
        point = SYSTEM if edit == "K" and role[:1] == "s" else PAIR if wanted == "a" else USER
    return "\n".join(out)


def letters(turns: list[tuple[str, str]], first: list[bool]) -> tuple[str, list[int]]:
    """The letters parse() reads, and how many turns are blank, duplicate and truncated. first: seen for the first time."""
    out, n = [], [0, 0, 0]
    for (role, text), new in zip(turns, first, strict=True):
        text = text.rstrip(BLANKS)
        fault = 0 if not text else 1 if not new else 2 if text[-1] not in ".!?" else None
        if fault is not None:
            n[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        out.append("d" if fault in (0, 1) else letter.upper() if fault == 2 else letter)
    return "".join(out), n


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"
_BLOCK = "turns array<long>, roles array<string>, texts array<string>"
_COSTS = "letters string, ways array<int>, audits array<string>"


def _whole(turns: list[tuple]) -> tuple:
    """FACTS of all turns (turn, role, text) of one conversation."""
    said, seen, first = [t[1:] for t in turns], set(), []
    for x in said:
        first.append(x not in seen)
        seen.add(x)
    read, n = letters(said, first)
    cost, audit = cheapest(read)
    known = [t[0] for t in turns if t[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, *n, illegal([r[:1] for r, _ in said]), cost, audit, edited(audit, said)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _mapped(df: DataFrame, run, schema: str, size: int = 2_000) -> DataFrame:
    """run(iterator of rows) gives rows of `schema`."""
    out = df.sparkSession.createDataFrame([], schema).schema
    arrow = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in out])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for row in run(_rows(batches)):
            held.append(row)
            weight += sum(len(x) for x in row if isinstance(x, str))
            if len(held) >= size or weight > 4_000_000:
                yield _batch(held, arrow)
                held, weight = [], 0
        yield _batch(held, arrow)

    return df.mapInArrow(go, out)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[kind]


def _packed(dealt: DataFrame, most: int) -> DataFrame:
    """Turns in order, side by side -> FACTS of conversations that surely stand in one task whole, blocks of the rest.

    Those are the first and the last of a task, which may go on in another, and those of more than `most` turns.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        at, held, size, key, broken, begun = TaskContext.get().partitionId() << 33, [], 0, None, True, False

        def flush(last: bool) -> Iterator[tuple]:
            nonlocal at
            if not broken and not last:
                yield key, at, True, *_whole(held), None, None, None
                at += 1
                return
            for i in range(0, len(held) or 1, BLOCK):
                yield key, at, False, *[None] * 8, *([t[k] for t in held[i : i + BLOCK]] for k in range(3))
                at += 1

        for k, turn, role, text, times in rows:
            if begun and k != key:
                yield from flush(False)
                held, size, broken = [], 0, False
            key, begun = k, True
            held += [(turn, role, text)] * times
            size += len(text) * times
            if len(held) > most or size > 1_000 * most:
                broken = True
                yield from flush(False)
                held, size = [], 0
        if begun:
            yield from flush(True)

    return _mapped(dealt, run, f"key long, at long, whole boolean, {FACTS}, {_BLOCK}")


def _joined(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """FACTS of every block of conversations that many tasks hold, summed over a conversation: the conversation's."""
    turns = blocks.select("key", "at", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "x"))
    same = turns.groupBy("key", "x.roles", F.md5("x.texts")).agg(F.min(F.struct("at", "i")).alias("one"))
    firsts = same.groupBy("one.at").agg(F.collect_list("one.i").alias("firsts"))  # at most BLOCK a block
    each = blocks.select("key", "at", F.explode_outer("turns").alias("turn"))
    known = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = each.groupBy("key").agg(F.min("at").alias("at"), F.coalesce(known, F.lit(0)).alias("gaps")).select("at", "gaps")

    def judge(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, at, roles, texts, firsts, gaps in rows:
            new = set(firsts or ())
            said = list(zip(roles, texts, strict=True))
            read, n = letters(said, [i in new for i in range(len(said))])
            found = ways(read)
            every = [found.get((p, q), (-1, "")) for p in BETWEEN for q in BETWEEN]
            yield key, at, gaps or 0, *n, roles, texts, read, *([x[k] for x in every] for k in (0, 1))

    met = blocks.drop("gaps").join(firsts, "at", "left").join(gaps, "at", "left").select("key", "at", "roles", "texts", "firsts", "gaps")
    judged = scratch.cut(_mapped(met, judge, f"key long, at long, gaps long, blank long, duplicate long, truncated long, roles array<string>, texts array<string>, {_COSTS}"))

    def compose(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Of each block: the points it goes between, the role letter before it, what is inserted after it."""
        held: list[tuple] = []  # (at, letter before): narrow, whatever the texts
        chain, key, before = Chain(), None, None

        def flush() -> Iterator[tuple]:
            points, (cost, audit) = chain.path()
            for i, (at, b) in enumerate(held):
                end = i + 1 == len(held)
                yield at, points[i], points[i + 1], b, cost * end, audit * end

        for k, at, ends, n, costs, audits in rows:
            if held and k != key:
                yield from flush()
                held, chain, before = [], Chain(), None
            key = k
            held.append((at, before))
            if n:
                before = ends
            chain.step({(i // 4, i % 4): (c, a) for i, (c, a) in enumerate(zip(costs, audits, strict=True)) if c >= 0})
        if held:
            yield from flush()

    narrow = judged.select("key", "at", F.substring(F.try_element_at("roles", F.lit(-1)), 1, 1).alias("ends"), F.size("roles").alias("n"), "ways", "audits")
    ordered = narrow.repartition("key").sortWithinPartitions("key", "at")
    path = _mapped(ordered, compose, "at long, p int, q int, before string, closing int, inserted string")

    def apply(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, at, gaps, blank, duplicate, truncated, roles, texts, costs, audits, p, q, before, closing, inserted in rows:
            audit, cost = audits[4 * p + q] + inserted, costs[4 * p + q] + closing
            initials = [r[:1] for r in roles]
            wrong = illegal([before] * (before is not None) + initials)
            yield key, at, False, gaps, blank, duplicate, truncated, wrong, cost, audit, edited(audit, zip(roles, texts, strict=True), p)

    return _mapped(judged.join(path, "at").select(*judged.columns[:8], "ways", "audits", "p", "q", "before", "closing", "inserted"), apply, f"key long, at long, whole boolean, {FACTS}")


def repair(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: str | None = None, most: int = 4_096) -> DataFrame:
    """Faults and least repair of every conversation: (key, at, whole, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired).

    Turns stand by `turn`, nulls first, then by role and text. A conversation is one row, `whole`, or, if more than one
    task holds its turns or it has more than `most`, several by rising `at`: numbers then add up, audits follow one
    another, and so do the lines of `repaired` (a row without lines is empty). `times`: how often a turn stands; a
    conversation whose turns all stand 0 times has zeros and empty texts. A null role or text is one space; a null
    key is a conversation of its own; equal rows are turns of their own, later ones duplicates. An empty role has no
    letter of the grammar. Other columns don't matter. No rows give no rows.

    Turns move once, dealt by ranges of (key, turn, role, text, a number of their own), so that a conversation of any
    share of all rows spreads over many tasks. Of such a one, only a letter and some weights a block meet in one task.
    """
    spark = turns.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    count = F.lit(1) if times is None else F.coalesce(F.col(times).cast("int"), F.lit(1))
    rows = turns.select(F.col(key).cast("long").alias("key"), F.col(turn).cast("long").alias("turn"), *said, count.alias("times")).withColumn("own", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("key", "turn", "role", "text")]
    dealt = rows.repartitionByRange(*order, F.col("own")).sortWithinPartitions(*order).drop("own")
    packed = scratch.cut(_packed(dealt, most))
    facts = ["key", "at", "whole", *(c.split()[0] for c in FACTS.split(", "))]
    done = packed.filter("whole").select(*facts).union(_joined(packed.filter("not whole"), scratch).select(*facts))
    return done.withColumnRenamed("key", key)


def digests(repaired: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row a conversation of what repair() returns: numbers added, audits joined, SHA-256 of all lines.

    Whole ones stay where they are; of the others, one row a block meets in a task, which reads them as a stream.
    """
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = repaired.filter("whole").select(key, *numbers, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, sums, audit, digest, empty = None, [], [], hashlib.sha256(), True
        for k, _, *n, edits, lines in rows:
            if held is not None and held[0] != k:
                yield held[0], *sums, "".join(audit), digest.hexdigest()
                held = None
            if held is None:
                held, sums, audit, digest, empty = (k,), [0] * len(n), [], hashlib.sha256(), True
            sums = [a + b for a, b in zip(sums, n, strict=True)]
            audit.append(edits)
            if lines:
                digest.update(("" if empty else "\n").encode() + lines.encode())
                empty = False
        if held is not None:
            yield held[0], *sums, "".join(audit), digest.hexdigest()

    parts = repaired.filter("not whole").select(F.col(key).alias("key"), "at", *numbers, "audit", "repaired")
    ordered = parts.repartition("key").sortWithinPartitions("key", "at")
    schema = f"key long, {', '.join(f'{n} long' for n in numbers)}, audit string, repaired_sha256 string"
    return whole.union(_mapped(ordered, run, schema))
