"""Row-local algorithms that no built-in function expresses, as Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def osa_distance(a: str, b: str, most: int | None = None) -> int:
    """Optimal string alignment: insert, delete, replace, swap neighbours, nothing edited twice. Beyond `most`: most + 1."""
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            now.append(best)
        if most is not None and min(now) > most:
            return most + 1
        two, one = one, now
    return one[-1] if most is None else min(one[-1], most + 1)


def shared(a: str, b: str, most: int) -> list[int]:
    """How many character n-grams, n = 1..most, both have, each as often as in the one with fewer."""
    out = []
    for n in range(1, most + 1):
        x, y = (Counter([s[i : i + n] for i in range(len(s) - n + 1)]) for s in (a, b))
        out.append(sum(min(k, y[g]) for g, k in x.items() if g in y))
    return out


def align(reference: list[str], hypothesis: list[str]) -> list[tuple[str, str, str]]:
    """(kind, reference word, hypothesis word) with kinds ok, sub, del, ins: a cheapest alignment.

    Among equally cheap ones, substitutions of words that share more letters' places are preferred, then
    deletions before insertions.
    """
    n, m = len(reference), len(hypothesis)
    cost = [[(j, 0.0) for j in range(m + 1)]]
    alike = lambda x, y: sum(p == q for p, q in zip(x, y, strict=False)) / max(len(x), len(y), 1)
    for i in range(1, n + 1):
        row = [(i, 0.0)]
        for j in range(1, m + 1):
            x, y = reference[i - 1], hypothesis[j - 1]
            c, s = cost[i - 1][j - 1]
            row.append(min((c + (x != y), s - alike(x, y)), (cost[i - 1][j][0] + 1, cost[i - 1][j][1]), (row[j - 1][0] + 1, row[j - 1][1])))
        cost.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j:
            x, y = reference[i - 1], hypothesis[j - 1]
            c, s = cost[i - 1][j - 1]
            if cost[i][j] == (c + (x != y), s - alike(x, y)):
                out.append(("ok" if x == y else "sub", x, y))
                i, j = i - 1, j - 1
                continue
        if i and cost[i][j] == (cost[i - 1][j][0] + 1, cost[i - 1][j][1]):
            out.append(("del", reference[i - 1], ""))
            i -= 1
        else:
            out.append(("ins", "", hypothesis[j - 1]))
            j -= 1
    return out[::-1]


# German number words.
ONES = ["null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf", "dreizehn", "vierzehn", "fünfzehn", "sechzehn", "siebzehn", "achtzehn", "neunzehn"]
TENS = ["", "", "zwanzig", "dreißig", "vierzig", "fünfzig", "sechzig", "siebzig", "achtzig", "neunzig"]
LARGE = [(10**12, "Billion", "Billionen"), (10**9, "Milliarde", "Milliarden"), (10**6, "Million", "Millionen")]


def german_cardinal(n: int, spaced: bool = False) -> str:
    """A whole number in German words, below a million as one word or, spaced, in words for each power."""
    if n < 0:
        return "minus " + german_cardinal(-n, spaced)
    for size, one, many in LARGE:
        if n >= size:
            head, rest = divmod(n, size)
            words = f"eine {one}" if head == 1 else f"{german_cardinal(head, spaced)} {many}"
            return f"{words} {german_cardinal(rest, spaced)}" if rest else words
    for size, name in ((1000, "tausend"), (100, "hundert")):
        if n >= size:
            head, rest = divmod(n, size)
            words = ("" if head == 1 else _joined(head)) + name
            return words + (" " * spaced + german_cardinal(rest, spaced) if rest else "")
    if n >= 20:
        ten, one = divmod(n, 10)
        return (f"{'ein' if one == 1 else ONES[one]}und" if one else "") + TENS[ten]
    return ONES[n]


def _joined(n: int) -> str:
    """A number in front of another word: eins loses its s."""
    words = german_cardinal(n)
    return words[:-1] if words.endswith("eins") else words


def german_year(n: int) -> str:
    """1100 to 1999 count hundreds."""
    if 1100 <= n <= 1999:
        head, rest = divmod(n, 100)
        return ONES[head] + "hundert" + (german_cardinal(rest) if rest else "")
    return german_cardinal(n)


def german_ordinal(n: int, ending: str = "e") -> str:
    """First to nineteenth take t, later ones st; a few are irregular."""
    irregular = {1: "erst", 3: "dritt", 7: "siebt", 8: "acht"}
    last = n % 100
    if last in irregular and n > 100:
        return german_cardinal(n - last) + irregular[last] + ending
    return (irregular[n] if n in irregular else german_cardinal(n) + ("t" if 0 < last < 20 else "st")) + ending


# Abbreviations that no sentence ends after.
ABBREVIATIONS = frozenset("z.b d.h u.a bzw ca dr prof nr vgl usw etc mr mrs ms st no fig e.g i.e vs abb hrsg jh inc ltd jr sr p pp m mme".split())
BREAK = re.compile(r"[.!?…]+[\"'»“”)\]]*(?=\s+|$)|\n+")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of sentences: cut after final punctuation unless an abbreviation, an initial or an ordinal
    number precedes it or a lower-case letter follows; line breaks always cut."""
    out, start = [], 0
    for m in BREAK.finditer(text):
        if not m.group().startswith("\n") and m.end() < len(text):
            before = re.search(r"(\S+)$", text[start : m.start()])
            word = (before.group(1) if before else "").lower().lstrip("(\"'„«")
            following = text[m.end() :].lstrip()[:1]
            if m.group()[0] == "." and (word in ABBREVIATIONS or len(word) == 1 and word.isalpha() or word.isdigit() and len(word) <= 2):
                continue
            if following.islower():
                continue
        end = m.end() if not m.group().startswith("\n") else m.start()
        if text[start:end].strip():
            lead = len(text[start:end]) - len(text[start:end].lstrip())
            out.append((start + lead, start + len(text[start:end].rstrip())))
        start = m.end()
    if text[start:].strip():
        lead = len(text[start:]) - len(text[start:].lstrip())
        out.append((start + lead, len(text.rstrip())))
    return out


CLITIC = re.compile(r"(?i)(n't|'(?:s|re|ve|ll|d|m))$")
CHUNK = re.compile(r"https?://\S+|\w+(?:[-'.]\w+)*|[$€£]|\d+(?:[.,]\d+)*%?|[^\w\s]")


def penn_tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end): words with clitics split off, numbers, currency, punctuation, addresses whole."""
    out = []
    for m in CHUNK.finditer(text):
        word, start = m.group(), m.start()
        clitic = None if "://" in word else CLITIC.search(word)
        if clitic and clitic.start():
            out += [(word[: clitic.start()], start, start + clitic.start()), (word[clitic.start() :], start + clitic.start(), m.end())]
        else:
            out.append((word, start, m.end()))
    return out


def _series(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*columns, strict=True)])


def _osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return _series(osa_distance, a, b).astype("Int32")


def _alignment(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    rows = lambda r, h: [{"kind": k, "reference": x, "hypothesis": y} for k, x, y in align(list(r), list(h))]
    return _series(rows, reference, hypothesis)


def _cardinal(n: pd.Series) -> pd.Series:
    return n.map(lambda x: None if pd.isna(x) else german_cardinal(int(x)))


def _year(n: pd.Series) -> pd.Series:
    return n.map(lambda x: None if pd.isna(x) else german_year(int(x)))


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _sentences(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else [{"start": a, "end": b, "text": t[a:b]} for a, b in sentence_spans(t)])


def _penn(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else [{"text": w, "start": a, "end": b} for w, a, b in penn_tokens(t)])


def _shared(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([shared(x or "", y or "", n) for x, y, n in zip(a, b, most, strict=True)], dtype=object)


# Functions are made when called: a worker imports this module too, and has no session to read types with.
def osa(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_osa, "int")(a, b)


def shared_grams(a: Column | str, b: Column | str, most: Column) -> Column:
    return F.pandas_udf(_shared, "array<int>")(a, b, most)


def alignment(reference: Column | str, hypothesis: Column | str) -> Column:
    return F.pandas_udf(_alignment, "array<struct<kind string, reference string, hypothesis string>>")(reference, hypothesis)


def cardinal(n: Column | str) -> Column:
    return F.pandas_udf(_cardinal, "string")(n)


def year(n: Column | str) -> Column:
    return F.pandas_udf(_year, "string")(n)


def nfc(text: Column | str) -> Column:
    return F.pandas_udf(_nfc, "string")(text)


def sentences(text: Column | str) -> Column:
    return F.pandas_udf(_sentences, "array<struct<start int, end int, text string>>")(text)


def penn(text: Column | str) -> Column:
    return F.pandas_udf(_penn, "array<struct<text string, start int, end int>>")(text)
