"""reading.read() in a task of its own: the same words, nothing shuffled.

reading.read() puts each different token into words once and joins it back, which moves every token of every sentence. Where
most tokens are numbers that come once, as in sentences made of keys and prices, that is most of its work. Here a task reads
a sentence where it lies and keeps the readings of the tokens it has met. A test holds one against the other.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions import numerals as N
from textlake.functions import udfs
from textlake.operators.reading import CLOCK, DATIVE, DATIVE_ONE, FEMININE, GENDERS, LETTER, MANY_UNITS, MATH, NOT_FEMININE, ONE_UNIT, ONSETS, PREPOSITIONS, ROMAN, SEPARATORS, SIGN, STRONG, TOKENS, W, WEAK, pattern


def _plain(java: str) -> str:
    """The same pattern for re with ASCII classes: letters and numbers of all scripts are written out."""
    return java.replace(r"\p{L}", _class("L")).replace(r"\p{N}", _class("N"))


@cache
def _class(letter: str) -> str:
    """Code points of a general category, as ranges of a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        has = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == letter
        if has and start is None:
            start = c
        elif not has and start is not None:
            out.append(f"{chr(start)}-{chr(c - 1)}")
            start = None
    return "".join(out)


def _re(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, re.ASCII | flags)


def _upper(t: str | None) -> bool:
    return bool(t) and unicodedata.category(t[0]) == "Lu"


# What runs of digits say.
def _digits(text: str) -> str:
    return " ".join(N.DIGITS[int(c)] for c in text)


def _long(text: str) -> int | None:
    n = int(text) if text else None
    return None if n is None or n >= 1 << 63 else n


def _cardinal(text: str) -> str:
    """In words, digit by digit if they are too many."""
    n = _long(text)
    return _digits(text) if n is None or n >= 10**15 else udfs.german_cardinal(n)


def _whole(text: str) -> str:
    return _digits(text) if len(text) > 1 and text[0] == "0" else _cardinal(text)


def _year(text: str) -> str:
    n = _long(text)
    return udfs.german_year(n) if n is not None and 1100 <= n <= 1999 else _cardinal(text)


def _stem(n: int | None) -> str | None:
    """An ordinal of less than 1,000 without its ending."""
    if n is None or n >= 1000:
        return None
    if n < 100:
        return N.STEMS[n]
    last = n % 100
    return udfs.german_cardinal(n - last) + ("st" if last == 0 else N.STEMS[last] if last < 20 else N.HUNDRED[last] + "st")


def _decade(n: int) -> str:
    rest = n % 100
    tail = udfs.TENS[rest // 10] if rest >= 20 else N.HUNDRED[rest] if rest else ""
    return ("" if n < 100 else udfs.german_year(n - rest)) + tail + "er"


def _fraction(a: str, b: str) -> str:
    n, m = _long(a), _long(b)
    if n is not None and m is not None and 0 < n < m <= 100:
        return f"{'ein' if n == 1 else _cardinal(a)} {N.DENOMINATORS[m]}"
    return f"{_cardinal(a)} Schrägstrich {_cardinal(b)}"


def _spell(text: str) -> str:
    """Names of letters; of other characters none."""
    return " ".join(LETTER.get(c.lower(), c) for c in text if c.isalpha())


_RUNS, _MARKS = _re("[0-9]+|[A-ZÄÖÜ][a-zäöüß]{2,}|[A-ZÄÖÜ]+|[a-zäöüß]+"), _re("[./_-]|[^./_-]+")
_NUMERIC, _DIGIT = _re(r"^\d+$"), _re(r"\d")


def _mixed(text: str) -> str:
    """Letters between digits: each run of its own."""
    say = lambda p: (_whole(p) if len(p) <= 6 else _digits(p)) if p[0] in "0123456789" else _spell(p) if len(p) <= 2 or p == p.upper() else p
    return " ".join(map(say, _RUNS.findall(text)))


_MARK = {".": "Punkt", "/": "Schrägstrich", "_": "Strich", "-": "Strich"}


def _dotted(text: str) -> str:
    """An address: names of its marks between its parts."""

    def name(p: str) -> str:
        if p in _MARK:
            return _MARK[p]
        if _NUMERIC.search(p):
            return udfs.german_cardinal(int(p)) if len(p) <= 4 else _digits(p)
        return _mixed(p) if _DIGIT.search(p) else _spell(p) if len(p) <= 2 else p

    return " ".join(map(name, _MARKS.findall(text)))


_VOWELS = "[AEIOUÄÖÜY]{1,2}"
_SYLLABLES = _re(f"^(?:{'|'.join(ONSETS)})?{_VOWELS}(?:[^AEIOUÄÖÜY]{{1,3}}{_VOWELS})*(?:[^AEIOUÄÖÜY]{{1,2}})?$")


def _acronym(text: str) -> str:
    """As a word, if it has the syllables of one, else by its letters; a small letter at the end is a plural or a letter."""
    end = text[-1] if "a" <= text[-1] <= "z" else ""
    stem = text[:-1] if end else text
    if not end and len(stem) >= 4 and _SYLLABLES.search(stem):
        return stem.capitalize()
    spelled = _spell(stem)
    return spelled + end if end == "s" else f"{spelled} {_spell(end)}" if end else spelled


_AMOUNT = _re(r"^(-?)([\d.\xa0\u202f ]*\d)(?:,(\d+))?\s?([^\d,]*)$")


def _number(t: str) -> tuple[str, str | None]:
    """(kind, reading) of a number, with its sign, fraction and unit."""
    m = _AMOUNT.search(t)
    sign, body, behind, unit = ("", "", "", "") if m is None else (x or "" for x in m.groups())
    digits = "".join(c for c in body if c in "0123456789")
    n = _long(digits)
    year = unit == "" and sign == "" and digits == body and n is not None and 1100 <= n <= 1999
    words = f"{_cardinal(digits)} Komma {_digits(behind)}" if behind else _year(digits) if year else _whole(digits)
    words = ("minus " if sign else "") + words
    one = n == 1 and not behind and not sign
    name = (ONE_UNIT if one else MANY_UNITS).get(unit)
    said = words if not unit else None if name is None else ("eine " if GENDERS[unit] == "f" else "ein ") + name if one else f"{words} {name}"
    return "unit" if unit else "decimal" if behind else "year" if year else "number", said


_DEC = _re(r"^(\d{2,4})er([ns]?)(?:-(Jahren?))?$")
_SPACES = _re(r"\s")
_LOOKED_UP = _re(rf"[{W}0-9@#^\[]")
_URL, _MAIL, _HEAD, _CITED = _re(r"^(?:https?://|www\.)"), _re("^[^@]+@.+"), _re(r"^(?:https?://)?(?:www\.)?"), _re(r"^\[.+\]$")
_THREE, _DATE, _TWO = _re(r"^\d+\.\s?\d+\.\s?\d+$"), _re(r"^\d{1,2}\.\s?\d{1,2}\.\s?(\d{2}|\d{4})$"), _re(r"^\d+\.\d+$")
_OCLOCK, _OCLOCK_2, _TIME, _RATIO = _re(r"^\d+:\d+\s?Uhr$"), _re(r":\d\d\D"), _re(r"^\d+:\d\d$"), _re(r"^\d+:\d+")
_RANGE, _FOUR, _VERSION, _THOUSANDS = _re(r"^\d+\s?[–—-]\s?\d+$"), _re(r"^\d{4}\D"), _re(r"^\d+(\.\d+)+$"), _re(r"^\d{1,3}(\.\d{3})+$")
_ORDINAL, _OVER, _POWER, _SIGNED = _re(r"^\d{1,3}\.$"), _re(r"^\d+/\d+$"), _re(r"^[^^]+\^.+$"), _re(r"^-?\d+$")
_BEGINS, _LETTERED, _ANY_DIGIT, _SHORT = _re(r"^-?\d"), _re(rf"^\d+[{W}]|\d[{W}]+\d"), _re("[0-9]"), _re("^[A-ZÄÖÜ]{2,}[a-z]?$")
_LETTER, _WORD, _DIGIT_RUNS = _re(rf"^[{W}]$"), _re(rf"^[{W}]"), _re(r"\d+")
_PUNCT, _BLANK, _BRIEF = _re(r"^[.,;:!?…]+$"), _re(r"^\s+$"), _re(rf"^[{W}]{{1,3}}$")
_FEMININE = _re(f"(?:{'|'.join(FEMININE)})$", re.IGNORECASE)
_WIDE, _BEFORE_MARK, _MARKS_TWICE, _LEAD = _re(r"\s+"), _re(r"\s+([,.;:!?])"), _re(r"([,;:])(?:\s*[,;:])+"), _re(r"^[\s,;:.]+")
_STOP, _CALL = _re(r"\.(?=\s|$)"), _re(r"[!?](?=\s)")

_DECIDED = frozenset("ordinal date either number abbreviation short symbol pause".split())
_SETS = {k: frozenset(v) for k, v in {"dative": DATIVE, "prepositions": PREPOSITIONS, "weak": WEAK, "strong": STRONG, "one": DATIVE_ONE, "clock": CLOCK, "not": NOT_FEMININE, "months": [*N.MONTHS, "Jänner"]}.items()}


def tidy(text: str, final: bool = True) -> str:
    """Spaces and marks of a sentence put together: no mark twice, no full stop inside, one at the end."""
    if "  " in text or not text.isprintable():
        text = _WIDE.sub(" ", text)
    if any(m in text for m in (" ,", " .", " ;", " :", " !", " ?")):
        text = _BEFORE_MARK.sub(r"\1", text)
    text = _LEAD.sub("", _MARKS_TWICE.sub(r"\1", text)).rstrip(" ")
    body = text.rstrip(".!?")
    end = text[len(body) :]
    if "." in body or "! " in body or "? " in body:
        body = _MARKS_TWICE.sub(r"\1", _CALL.sub(",", _STOP.sub(",", body)))
    body = body.rstrip(" ,;:")
    if not body:
        return ""
    return body + (end[0] if end and end[0] in "!?" else ".") if final else body


class Reader:
    """Reads one text after another. abbreviations: (written, expansion, place); acronyms, english: (written, reading)."""

    #: Readings kept: words come again, numbers less often.
    KEPT = 50_000

    def __init__(self, abbreviations: list[tuple[str, str, str]], acronyms: list[tuple[str, str]], english: list[tuple[str, str]], citations: bool, urls: str):
        signs = sorted({w for w, _ in acronyms if re.search(f"[^{W}0-9]", w)})
        phrases = sorted({w for w, _ in english if re.search(r"[\s-]", w)}, key=lambda p: (-len(p), p))
        shorts = sorted({(w, p) for w, _, p in abbreviations})
        # spaces, and a word before a space, are found first: no other alternative is met there, unless something written begins so
        first = "" if any(re.match(rf"\s|[{W}]+(?:\s|$)", w) for w in (*signs, *phrases, *(w for w, _ in shorts))) else rf"\s+|[{W}]+(?= )|"
        self.pattern = first + pattern(shorts, signs, phrases)
        self.short = {_SPACES.sub("", w): e for w, e, _ in reversed(abbreviations)}
        self.acronyms = dict(reversed(acronyms))
        self.english = {w.lower(): r.replace("'", "") for w, r in reversed(english)}
        self.citations, self.urls, self.known = citations, urls, {}
        self.find = None

    def _address(self, t: str) -> str:
        if _MAIL.search(t):
            return " at ".join(map(_dotted, t.split("@", 1)))
        host, _, path = _HEAD.sub("", t, count=1).partition("/")
        path = path.rstrip("/")
        return " Schrägstrich ".join(map(_dotted, [host, path] if self.urls == "full" and path else [host]))

    def _own(self, t: str) -> tuple[str, str | None, str | None] | None:
        """(kind, said, rest): what a token says alone. Of an ordinal and a date, `said` lacks the ending and `rest` follows it;
        of a time, `said` is that of a clock and `rest` of a ratio. Citations are left out unless asked for, addresses
        read as far as their host, `full` or not at all (`skip`)."""
        if t in self.acronyms:
            return "acronym", self.acronyms[t].replace("'", ""), None
        if t.isascii() and t.isdigit() and t not in self.short:
            n = _long(t)
            return ("year", _year(t), None) if n is not None and 1100 <= n <= 1999 else ("number", _whole(t), None)
        if t[0] in "hw" and _URL.search(t):
            return "url", "" if self.urls == "skip" else self._address(t), None
        if "@" in t and _MAIL.search(t):
            return "email", self._address(t), None
        runs = _DIGIT_RUNS.findall(t)
        if t[0] == "[" and _CITED.search(t):
            return "citation", ("Quellen " if len(runs) > 1 else "Quelle ") + " und ".join(map(_whole, runs)) if self.citations and runs else "", None
        a, b = ((_long(r) for r in runs[:2]) if len(runs) > 1 else (_long(runs[0]), None)) if runs else (None, None)
        dotted = "." in t
        if dotted and _DATE.search(t):
            if _THREE.search(t) and 1 <= a <= 31 and 1 <= b <= 12:
                return "date", _stem(a), f" {N.MONTHS[b - 1]} {_year(runs[2])}"
            if not _TWO.search(t):
                return "number", " ".join(map(_cardinal, runs)), None
        if ":" in t and _RATIO.search(t):
            clock = f"{'ein' if a == 1 else _cardinal(runs[0])} Uhr{' ' + _cardinal(runs[1]) if b else ''}"
            ratio = f"{_cardinal(runs[0])} zu {_cardinal(runs[1])}"
            day = a is not None and b is not None and a <= 24 and b < 60
            if day and _OCLOCK.search(t) and _OCLOCK_2.search(t):
                return "time", clock, None
            return ("either", clock, ratio) if day and _TIME.search(t) else ("number", ratio, None)
        short = self.short.get(_SPACES.sub("", t))
        if short is not None:
            return "abbreviation", short, None
        m = "er" in t and _DEC.search(t)
        if m:
            return "decade", _decade(a) + m[2] + (f" {m[3]}" if m[3] else ""), None
        if len(runs) == 2 and _RANGE.search(t):
            years = a is not None and b is not None and 1100 <= a <= 2099 and 1100 <= b <= 2099 and _FOUR.search(t)
            say = _year if years else _cardinal
            return "range", f"{say(runs[0])} bis {say(runs[1])}", None
        if dotted and _VERSION.search(t) and not _THOUSANDS.search(t):
            return "version", " Punkt ".join(map(_whole, runs)), None
        if dotted and _ORDINAL.search(t):
            return "ordinal", _stem(a), _cardinal(runs[0])
        if "/" in t and _OVER.search(t):
            return "fraction", _fraction(*runs[:2]), None
        if "^" in t and _POWER.search(t):
            power = lambda p: ("minus " if p[0] == "-" else "") + _whole(p.lstrip("-")) if _SIGNED.search(p) else _spell(p)
            return "formula", " hoch ".join(map(power, t.split("^"))), None
        if _BEGINS.search(t) and not _LETTERED.search(t):
            return *_number(t), None
        if _ANY_DIGIT.search(t):
            return "mixed", _mixed(t), None
        if _SHORT.search(t):
            return "short", _acronym(t), N.HUNDRED[ROMAN[t]] if t in ROMAN else None
        if _LETTER.search(t):
            return "letter", _spell(t), None
        if _WORD.search(t):
            return "word", t, None
        if t == "#":
            return "symbol", "", None
        if t in SIGN:
            return "formula" if t in MATH else "symbol", f" {SIGN[t]}{'' if t in '²³' else ' '}", None
        return None

    def _reading(self, t: str) -> tuple[str, str | None, str | None] | None:
        if not (_LOOKED_UP.search(t) or t in "&%§*_\\†@" or not all(c in " \t\n\x0b\f\r" or unicodedata.category(c)[0] == "P" for c in t)):
            return None
        own = self._own(t)
        if own and own[0] == "word" and t.lower() in self.english:
            return "english", self.english[t.lower()], None
        return own

    def _mark(self, t: str, i: int, ts: list[str]) -> tuple[str, str, None]:
        """A mark at place i."""
        before = ts[i - 1] if i else None
        if t == "." and before and len(before) == 1 and _upper(before) and i + 2 < len(ts) and ts[i + 1][0] in " \t\n\x0b\f\r" and _WORD.search(ts[i + 2]):
            return "quote", "", None
        if _PUNCT.search(t):
            return "punct", "," if "…" in t or t == "..." else t[0] if t[0] in "!?" else t[-1], None
        if _BLANK.search(t):
            return "space", " ", None
        if len(t) == 1 and t in "„“”\"‚‘’'«»›‹":
            return "quote", "", None
        if t == "(" and before and _BRIEF.search(before):
            return "formula", " von ", None
        if len(t) == 1 and t in "()[]{}–—":
            return "pause", ", ", None
        return ("space", " ", None) if t in ("-", "/") else ("symbol", "", None)

    def tokens(self, text: str) -> list[tuple[str, str, str | None]]:
        """(text, kind, written) of every token."""
        if self.find is None:
            self.find = _re(_plain(self.pattern)).findall
        if len(self.known) > self.KEPT:
            self.known.clear()
        ts, known, every, heard = self.find(text), self.known, [], []
        for i, t in enumerate(ts):
            own = known.get(t, self)
            if own is self:  # what "." and "(" are depends on what stands beside them
                own = self._reading(t) or (None if t in (".", "(") else self._mark(t, 0, ts))
                known[t] = own
            kind, said, rest = own or self._mark(t, i, ts)
            x = (t, i, kind, said, rest)
            every.append(x)
            if kind not in SEPARATORS:
                heard.append(x)
        closing, calls = set(), 0
        for t, i, _, said, _ in every:
            if t in ("(", ")"):
                if said == " von ":
                    calls += 1
                elif t == ")" and calls:
                    calls -= 1
                    closing.add(i)
        out = [(t, kind, said) for t, _, kind, said, _ in every]
        for place, x in enumerate(heard):
            if x[2] in _DECIDED:
                out[x[1]] = (x[0], x[2], self._in_context(x, place, heard, every))
        for i in closing:
            out[i] = (out[i][0], out[i][1], " ")
        return out

    def _in_context(self, x: tuple, place: int, heard: list[tuple], every: list[tuple]) -> str | None:
        """What a token says once its neighbours are known. heard: the tokens that separate nothing, x stands at `place`."""
        t, i, kind, said, rest = x
        before = heard[place - 1] if place else None
        after = heard[place + 1] if place + 1 < len(heard) else None
        told = lambda: before[0].lower() if before and not any(y[2] == "punct" for y in every[before[1] + 1 : i]) else None
        if kind in ("ordinal", "date"):
            if kind == "ordinal" and before is None:
                return rest + ","
            earlier = heard[place - 2] if place > 1 else None
            word = before[0].lower() if before and before[2] in ("word", "abbreviation") else None
            second = earlier[0].lower() if earlier and earlier[2] == "word" else None
            if word in _SETS["dative"] or (word == "der" and second in _SETS["prepositions"]):
                ending = "en"
            elif word in _SETS["weak"]:
                ending = "e"
            elif word in _SETS["strong"] or kind == "date" or (after and after[0] in _SETS["months"]):
                ending = "er"
            else:
                ending = "e"
            return None if said is None else said + ending + (rest if kind == "date" else "")
        if kind == "either":
            return said if told() in _SETS["clock"] else rest
        if kind == "number" and t == "1":
            if after and after[2] == "abbreviation" and after[3] in ("Millionen", "Milliarden"):
                return "eine"
            if after and after[2] in ("word", "english") and _upper(after[0]) and after[1] == i + 2 and every[i + 1][2] == "space":
                female = _FEMININE.search(after[0]) and after[0].lower() not in _SETS["not"]
                return ("einer" if female else "einem") if told() in _SETS["one"] else "eine" if female else "ein"
            return said
        if kind == "abbreviation" and said in ("Millionen", "Milliarden") and before and before[0] == "1" and before[2] == "number":
            return {"Millionen": "Million", "Milliarden": "Milliarde"}[said]
        if kind == "short" and rest is not None and before and _upper(before[0]) and before[2] in ("word", "acronym", "short", "english"):
            return rest
        return "Nummer " if t == "#" and after and after[2] in ("number", "year") else said

    def spoken(self, text: str) -> str:
        return tidy("".join([w for _, _, w in self.tokens(text) if w is not None]))


def read(sentences: DataFrame, abbreviations: DataFrame, acronyms: DataFrame, english: DataFrame | None = None, text: str = "text", citations: bool = False, urls: str = "short") -> DataFrame:
    """Append `tokens` (what is written, its kind and its words) and `spoken`, the sentence in words. Rows stay where they
    are; either column is made only if it is read.

    abbreviations(written, expansion, place), acronyms(written, reading) and english(written, reading) are tables of
    some thousand rows at most: readers have them at hand. English words are said as their readings; what is written stays
    in `tokens`. A null text has null tokens and is null.
    """
    rows = lambda df, *columns: [] if df is None else [tuple(r) for r in df.select(*columns).dropna(subset=["written"]).collect()]
    reader = Reader(rows(abbreviations, "written", "expansion", "place"), rows(acronyms, "written", "reading"), rows(english, "written", "reading"), citations, urls)

    def tokens(texts: pd.Series) -> pd.Series:
        each = lambda t: None if t is None else [{"text": a, "kind": b, "written": c} for a, b, c in reader.tokens(t)]
        return pd.Series([each(t) for t in texts], dtype=object)

    def spoken(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else reader.spoken(t) for t in texts], dtype=object)

    return sentences.select("*", F.pandas_udf(tokens, TOKENS)(F.col(text)).alias("tokens"), F.pandas_udf(spoken, "string")(F.col(text)).alias("spoken"))
