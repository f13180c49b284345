"""Dependency trees of sentences: a transition parser with a dynamic oracle, and what is made of trees.

Words are numbered from 0; a head is a word's number, or the sentence's size for the root, which stands behind the
last word. A state is (stack, next word, heads so far). Columns hold heads from 1, and 0 for the root.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.operators import perceptron
from textlake.operators.perceptron import Learner, Weights
from textlake.session import cut
from textlake.sources.files import is_projective

#: The next word goes on the stack; the top's head is the next word; the top's head is the one below it.
SHIFT, LEFT, RIGHT = "shift", "left", "right"


class State:
    """A sentence being read."""

    def __init__(self, size: int):
        self.size, self.at = size, 0
        self.stack: list[int] = []
        self.heads = [-1] * size
        self.before: list[list[int]] = [[] for _ in range(size + 1)]
        self.after: list[list[int]] = [[] for _ in range(size + 1)]

    def done(self) -> bool:
        return self.at == self.size and not self.stack

    def moves(self) -> list[str]:
        """Only the last word on the stack may hang on the root, so a tree has one top."""
        on = len(self.stack)
        return [SHIFT] * (self.at < self.size) + [RIGHT] * (on > 1) + [LEFT] * (on > 0 and (self.at < self.size or on == 1))

    def go(self, move: str) -> None:
        if move == SHIFT:
            self.stack.append(self.at)
            self.at += 1
            return
        child = self.stack.pop()
        head = self.at if move == LEFT else self.stack[-1]
        self.heads[child] = head
        (self.before if child < head else self.after)[head].append(child)

    def losses(self, gold: list[int]) -> dict[str, int]:
        """How many arcs of the tree `gold` can no longer be made after each move."""
        out = {}
        for move in self.moves():
            if move == SHIFT:
                below = self.stack[:-1]
                out[move] = (gold[self.at] in below) + sum(gold[s] == self.at for s in self.stack)
                continue
            top = self.stack[-1]
            lost = sum(gold[d] == top for d in range(self.at, self.size))
            given = self.at if move == LEFT else self.stack[-2]
            open_heads = [*self.stack[-2:-1], *range(self.at, self.size + 1)]
            out[move] = lost + (gold[top] != given and gold[top] in open_heads)
        return out


#: Features of words are of so many names a kind, so that weights are bounded whatever the vocabulary; those of tags are not.
NAMES = 1 << 14
WORDS = frozenset("w0 w1 v0 v1 w0t0 v0u0 w0v0 w0u0 t0v0 all gapw cw hw end_ cwht cthw words".split())


def _names(parts: dict[str, list[str]]) -> list[str]:
    return ["bias", *[f"{k}#{crc32('|'.join(v).encode()) % NAMES}" if k in WORDS else f"{k}={'|'.join(v)}" for k, v in parts.items()]]


def _form(word: str) -> str:
    return "#" if word[:1].isdigit() else word.lower()


def state_features(words: list[str], tags: list[str], s: State) -> list[str]:
    """What is seen of a state: the words and tags at the top of the stack and ahead, their outermost children, how
    many they have, and how far apart they are."""
    n = s.size

    def at(i: int | None) -> tuple[str, str]:
        return ("", "") if i is None or i > n else ("<root>", "ROOT") if i == n else (words[i], tags[i])

    s0, s1, s2 = (s.stack[-k] if len(s.stack) >= k else None for k in (1, 2, 3))
    outer = {
        "s0l": s.before[s0][-1] if s0 is not None and s.before[s0] else None,
        "s0r": s.after[s0][-1] if s0 is not None and s.after[s0] else None,
        "n0l": s.before[s.at][-1] if s.before[s.at] else None,
    }
    (w0, t0), (w1, t1), (_, t2) = at(s0), at(s1), at(s2)
    (v0, u0), (v1, u1), (_, u2) = at(s.at), at(s.at + 1), at(s.at + 2)
    tag = {k: at(i)[1] for k, i in outer.items()}
    gap = str(min(s.at - s0, 5)) if s0 is not None else "-"
    kids = (len(s.before[s0]), len(s.after[s0])) if s0 is not None else (0, 0)
    parts = {
        "w0": [w0], "t0": [t0], "w1": [w1], "t1": [t1], "v0": [v0], "u0": [u0], "v1": [v1], "u1": [u1],
        "w0t0": [w0, t0], "v0u0": [v0, u0], "t0u0": [t0, u0], "w0v0": [w0, v0], "w0u0": [w0, u0], "t0v0": [t0, v0],
        "all": [w0, t0, v0, u0], "t1t0": [t1, t0], "t1t0u0": [t1, t0, u0], "t0u0u1": [t0, u0, u1], "u0u1u2": [u0, u1, u2],
        "t2t1t0": [t2, t1, t0], "t1u0": [t1, u0], "gap": [t0, u0, gap], "gapw": [w0, v0, gap], "kids": [t0, *map(str, kids)],
        "s0r": [t0, tag["s0r"], u0], "s0l": [t0, tag["s0l"], u0], "n0l": [t0, u0, tag["n0l"]], "kidsn": [u0, str(len(s.before[s.at]))],
        "end": [t0, t1, str(s.at == n)],
    }
    return _names(parts)


def arc_features(words: list[str], tags: list[str], heads: list[int], child: int) -> list[str]:
    """What is seen of an arc in its finished tree: both words, direction and distance, neighbours, other children."""
    n, head = len(words), heads[child]
    hw, ht = ("<root>", "ROOT") if head == n else (words[head], tags[head])
    cw, ct = words[child], tags[child]
    way = "<" if child < head else ">"
    far = str(min(abs(head - child), 6))
    beside = [tags[k] for k in range(n) if heads[k] == head and k != child]
    below = sorted({tags[k] for k in range(n) if heads[k] == child})
    parts = {
        "cw": [cw], "ct": [ct], "hw": [hw], "ht": [ht], "end_": [cw[-3:]], "arc": [ct, ht, way], "cwht": [cw, ht, way], "cthw": [ct, hw, way],
        "words": [cw, hw], "far": [ct, ht, way, far], "around": [tags[child - 1] if child else "", ct, tags[child + 1] if child + 1 < n else ""],
        "below": [ct, *below[:5]], "beside": [ct, ht, way, str(len(beside)), *beside[:1]],
    }
    return _names(parts)


@dataclass(frozen=True)
class Parser:
    """Weights of moves and of labels, and the labels in order."""

    moves: Weights
    labels: list[str]
    arcs: Weights


def _lists(row: dict) -> tuple[list[str], list[str], list[int]]:
    words, tags = [_form(w) for w in row["words"]], list(row["tags"])
    return words, tags, [len(words) if h == 0 else h - 1 for h in row["heads"]]


def _visit_moves(row: dict, learner: Learner) -> None:
    """Read a sentence as the weights so far would, mistakes included: the oracle knows what is best from any state."""
    words, tags, gold = _lists(row)
    s = State(len(words))
    while not s.done():
        moves = s.moves()
        seen = state_features(words, tags, s)
        scores = learner.scores(moves, seen)
        told = max(moves, key=scores.__getitem__)
        losses = s.losses(gold)
        right = [m for m in moves if losses[m] == min(losses.values())]
        learner.learn(told if told in right else max(right, key=scores.__getitem__), told, seen)
        s.go(told)


def _visit_arcs(labels: list[str]):
    def visit(row: dict, learner: Learner) -> None:
        words, tags, gold = _lists(row)
        for child, right in enumerate(row["labels"]):
            if gold[child] < len(words):
                seen = arc_features(words, tags, gold, child)
                scores = learner.scores(labels, seen)
                learner.learn(right, max(labels, key=scores.__getitem__), seen)

    return visit


#: Sentences of a shard at most: what a task learns at once is bounded by them.
SHARD = 20_000


def train(trees: DataFrame, key: str, shards: int = 8, passes: int = 4) -> Parser:
    """trees(key, words, tags, heads, labels) -> a parser.

    Every sentence teaches, at every pass, in `shards` shards or as many more as SHARD asks for. Weights, which reach the
    driver, are bounded by NAMES, tags and labels. Sentences whose arcs cross, whose lists differ in size, or without words
    teach nothing.
    """
    sizes = [F.size(c) == F.size("words") for c in ("tags", "heads", "labels")]
    good = trees.filter((F.size("words") > 0) & sizes[0] & sizes[1] & sizes[2]).filter(is_projective(F.col("heads")) & (F.size(F.filter("heads", lambda h: h == 0)) == 1))
    known = cut(good.select(key, "words", "tags", "heads", "labels"))  # every pass reads them
    labels = sorted(r[0] for r in known.select(F.explode("labels")).distinct().collect() if r[0] is not None)
    shards = max(shards, -(-known.count() // SHARD))
    return Parser(perceptron.train(known, key, _visit_moves, shards, passes), labels, perceptron.train(known, key, _visit_arcs(labels), shards, passes))


def heads_of(words: list[str], tags: list[str], weights: Weights) -> list[int]:
    """The tree of a sentence: two moves a word."""
    s = State(len(words))
    while not s.done():
        moves = s.moves()
        s.go(moves[0] if len(moves) == 1 else perceptron.best(weights, moves, state_features(words, tags, s)))
    return s.heads


def parse(sentences: DataFrame, parser: Parser, words: str = "words", tags: str = "tags", name: str = "told") -> DataFrame:
    """Append `name`, a struct of heads (from 1, 0 for the root) and labels. Null sentences have a null one, those
    without words empty lists. Rows stay where they are."""
    shared = sentences.sparkSession.sparkContext.broadcast(parser)

    def label(p: Parser, seen: list[str]) -> str:
        """Only what hangs on the root is labelled so."""
        told = perceptron.best(p.arcs, p.labels, seen) if p.labels else "root"
        return "dep" if told == "root" else told

    @F.pandas_udf("heads array<int>, labels array<string>")
    def run(words: pd.Series, tags: pd.Series) -> pd.DataFrame:
        p, out = shared.value, []
        for one, two in zip(words, tags, strict=True):
            if one is None or two is None or len(one) != len(two):
                out.append((None, None))
                continue
            forms, classes = [_form(w) for w in one], list(two)
            heads = heads_of(forms, classes, p.moves)
            labels = ["root" if h == len(forms) else label(p, arc_features(forms, classes, heads, i)) for i, h in enumerate(heads)]
            out.append(([0 if h == len(forms) else h + 1 for h in heads], labels))
        return pd.DataFrame(out, columns=["heads", "labels"])

    told = run(F.col(words), F.col(tags))
    return sentences.withColumn(name, told).withColumn(name, F.when(F.col(f"{name}.heads").isNotNull(), F.col(name)))


def _oracle(heads: pd.Series) -> pd.DataFrame:
    out = []
    for column in heads:
        if column is None:
            out.append((None, None))
            continue
        gold = [len(column) if h == 0 else int(h) - 1 for h in column]
        s, moves = State(len(gold)), []
        while not s.done():
            losses = s.losses(gold)
            moves.append(min(losses, key=losses.__getitem__))
            s.go(moves[-1])
        out.append((moves, [0 if h == s.size else h + 1 for h in s.heads]))
    return pd.DataFrame(out, columns=["moves", "heads"])


def oracle(heads: Column | str) -> Column:
    """The moves that lose least of a tree at every state, and the tree that they make; of equal ones the first."""
    return F.pandas_udf(_oracle, "moves array<string>, heads array<int>")(heads)


def attachment(parsed: DataFrame, by: list[str], heads: str = "heads", labels: str = "labels", told: str = "told") -> DataFrame:
    """(by..., words, right_heads, right_labels, uas, las): words whose head is right, and whose label is too."""
    rows = F.arrays_zip(F.col(heads).alias("h"), F.col(labels).alias("l"), F.col(f"{told}.heads").alias("th"), F.col(f"{told}.labels").alias("tl"))
    each = parsed.select(*by, F.explode(rows).alias("x")).select(*by, (F.col("x.h") == F.col("x.th")).alias("head"), ((F.col("x.h") == F.col("x.th")) & F.col("x.l").eqNullSafe(F.col("x.tl"))).alias("both"))
    sums = each.groupBy(*by).agg(F.count("*").alias("words"), F.count_if("head").alias("right_heads"), F.count_if("both").alias("right_labels"))
    return sums.withColumn("uas", F.round(F.col("right_heads") / F.col("words"), 4)).withColumn("las", F.round(F.col("right_labels") / F.col("words"), 4))


#: Labels of subjects, of clauses' verbs, and of what stands between a subject and its verb with the verb; phrases by
#: part of speech. Fixed values.
SUBJECTS = ("nsubj", "nsubj:pass", "csubj", "csubj:pass", "nsubj:outer", "expl")
CLAUSES = ("root", "ccomp", "advcl", "acl:relcl", "parataxis", "csubj", "xcomp", "conj")
WITH_VERB = ("aux", "aux:pass", "cop", "advmod", "compound:prt")
PHRASES = {"NOUN": "NP", "PROPN": "NP", "PRON": "NP", "NUM": "NP", "VERB": "VP", "AUX": "VP", "ADJ": "AP", "ADV": "AdvP", "DET": "DP"}
PHRASE = "array<struct<id int, label string, first int, last int>>"


def _constituents(tokens: list[dict]) -> list[dict]:
    kids: dict[int, list[int]] = {}
    for t in tokens:
        kids.setdefault(t["head"], []).append(t["id"])
    by = {t["id"]: t for t in tokens}
    span, order, todo = {}, [], list(kids.get(0, []))
    while todo:  # heads before their children
        order.append(todo.pop())
        todo += kids.get(order[-1], [])
    for i in reversed(order):
        own = [span[k] for k in kids.get(i, [])]
        span[i] = min([i, *(a for a, _ in own)]), max([i, *(b for _, b in own)])
    out = []
    for i in sorted(order):
        below, t = kids.get(i, []), by[i]
        if not below:
            continue
        labels = [by[k]["deprel"] for k in below]
        verbal = t["upos"] in ("VERB", "AUX")
        if "case" in labels and t["upos"] != "VERB":
            label = "PP"
        elif any(x in SUBJECTS for x in labels) or (verbal and t["deprel"] in CLAUSES):
            label = "S"
        else:
            label = PHRASES.get(t["upos"], "XP")
        out.append({"id": i, "label": label, "first": span[i][0], "last": span[i][1]})
        if label == "S":  # its verb phrase: the verb, what stands with it after the subject, and all that follows
            subject = max((k for k in below if k < i and by[k]["deprel"] in SUBJECTS), default=0)
            inside = [k for k in below if k > i or (k > subject and by[k]["deprel"] in WITH_VERB)]
            out.append({"id": i, "label": "VP", "first": min([i, *(span[k][0] for k in inside)]), "last": max([i, *(span[k][1] for k in inside)])})
    return out


def _phrases(tokens: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _constituents(list(t)) for t in tokens], dtype=object)


def phrases(tokens: Column | str) -> Column:
    """Constituents of a tree of conllu() tokens, by their head word's number: what a word with dependents spans, and in
    a clause its verb phrase. Words that no root reaches are left out; null trees have null ones."""
    return F.pandas_udf(_phrases, PHRASE)(tokens)


def _merged(tokens: list[dict]) -> list[dict]:
    def word(t: dict) -> bool:
        return any(c.isalnum() for c in t["form"])

    groups, i = [], 0
    while i < len(tokens):
        j = i
        while j + 2 < len(tokens) and word(tokens[j]) and tokens[j + 1]["form"] == "-" and word(tokens[j + 2]) and not (tokens[j]["space_after"] or tokens[j + 1]["space_after"]):
            j += 2
        ids = {t["id"] for t in tokens[i : j + 1]}
        tops = [t for t in tokens[i : j + 1] if t["head"] not in ids]
        if len(tops) == 1:
            groups.append((tokens[i : j + 1], tops[0]))
        else:
            groups += [([t], t) for t in tokens[i : j + 1]]
        i = j + 1
    number = {t["id"]: n + 1 for n, (part, _) in enumerate(groups) for t in part}
    return [
        top | {"id": n + 1, "form": "".join(t["form"] for t in part), "lemma": "".join([*(t["form"] for t in part[:-1]), part[-1]["lemma"]]), "head": number.get(top["head"], 0), "space_after": part[-1]["space_after"]}
        for n, (part, top) in enumerate(groups)
    ]


def merge_hyphens(trees: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Words that hyphens join without a space become one, if one of them alone has its head outside; the others are
    numbered anew, and the new word has its head's place in the tree. Trees are conllu() rows."""
    kind = trees.schema[tokens].dataType

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _merged([dict(x) for x in t]) for t in column], dtype=object)

    return trees.withColumn(tokens, run(tokens))
