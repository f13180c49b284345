"""German numerals as Column functions: words come from short arrays that the rules of udfs fill."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions.udfs import LARGE, ONES, TENS, german_cardinal, german_ordinal


def _at(words: list[str], n: Column) -> Column:
    return F.get(F.split(F.lit("|".join(words)), r"\|"), n.cast("int"))


HUNDRED = [german_cardinal(n) for n in range(100)]
STEMS = [german_ordinal(n, "") if n else "nullst" for n in range(100)]
DIGITS = ONES[:10]
# Months; denominators that have a word of their own.
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
PARTS = {2: "halb", 3: "Drittel", 7: "Siebtel", 8: "Achtel", 100: "Hundertstel"}


def _denominator(n: int) -> str:
    word = german_cardinal(n).capitalize()
    return PARTS.get(n, word + ("tel" if n < 20 else "stel"))


DENOMINATORS = ["", "", *map(_denominator, range(2, 101))]


def _group(n: Column) -> Column:
    """Up to 999, without a word for 0."""
    hundreds, rest = F.floor(n / 100), n % 100
    return F.concat(F.when(hundreds > 1, _at(DIGITS, hundreds)).otherwise(""), F.when(hundreds > 0, "hundert").otherwise(""), F.when(rest > 0, _at(HUNDRED, rest)).otherwise(""))


def cardinal(number: Column) -> Column:
    """A whole number of less than 10**15 in words, below a million as one word; null beyond."""
    n = F.abs(number.cast("long"))
    parts = []
    for size, one, many in LARGE:
        count = F.floor(n / size) % 1000
        parts.append(F.when(count == 1, f"eine {one}").when(count > 1, F.concat(_group(count), F.lit(f" {many}"))).otherwise(""))
    thousands, rest = F.floor(n / 1000) % 1000, n % 1000
    head = F.when(thousands == 1, "tausend").when(thousands > 1, F.concat(F.regexp_replace(_group(thousands), "eins$", "ein"), F.lit("tausend"))).otherwise("")
    words = F.array_join(F.filter(F.array(*parts, F.concat(head, _group(rest))), lambda w: w != ""), " ")
    said = F.when(n == 0, "null").otherwise(F.concat(F.when(number < 0, "minus ").otherwise(""), words))
    return F.when(n < 10**15, said)


def year(n: Column) -> Column:
    """1100 to 1999 count hundreds."""
    rest = n % 100
    own = F.concat(_at(HUNDRED, F.floor(n / 100)), F.lit("hundert"), F.when(rest > 0, _at(HUNDRED, rest)).otherwise(""))
    return F.when(n.between(1100, 1999), own).otherwise(cardinal(n))


def ordinal_stem(n: Column) -> Column:
    """An ordinal of less than 1,000 without its ending; null beyond."""
    last = n % 100
    tail = F.when(last == 0, "st").when(last < 20, _at(STEMS, last)).otherwise(F.concat(_at(HUNDRED, last), F.lit("st")))
    return F.when(n < 100, _at(STEMS, n)).when(n < 1000, F.concat(_group(n - last), tail))


def digits(text: Column) -> Column:
    """Digits one by one; other characters are left out."""
    each = F.filter(F.split(F.regexp_replace(text, r"[^0-9]", ""), ""), lambda c: c != "")
    return F.array_join(F.transform(each, lambda c: _at(DIGITS, c)), " ")


def whole(text: Column) -> Column:
    """Digits as a number, one by one if they are too many for one or begin with a 0."""
    n = text.try_cast("long")
    return F.when(text.rlike(r"^0\d"), digits(text)).otherwise(F.coalesce(cardinal(n), digits(text)))


def decade(n: Column) -> Column:
    rest = n % 100
    tail = F.when(rest >= 20, _at(TENS, F.floor(rest / 10))).when(rest > 0, _at(HUNDRED, rest)).otherwise("")
    return F.concat(F.when(n < 100, "").otherwise(year(n - rest)), tail, F.lit("er"))


def fraction(a: Column, b: Column, words: Column) -> Column:
    """a/b of 0 < a < b <= 100, given a in words; null otherwise."""
    return F.when((a > 0) & (a < b) & (b <= 100), F.concat(F.when(a == 1, "ein").otherwise(words), F.lit(" "), _at(DENOMINATORS, b)))


def month(n: Column) -> Column:
    return F.when(n.between(1, 12), _at(MONTHS, n - 1))
