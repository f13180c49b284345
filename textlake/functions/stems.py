"""Stems of German words by the Snowball algorithm, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions.text import let

VOWELS = "aeiouyäöü"


def _region(word: Column) -> Column:
    """How many letters stand before the region after the first consonant that follows a vowel; all if there is none."""
    found = F.regexp_extract(word, f"^.*?[{VOWELS}][^{VOWELS}]", 0)
    return F.when(found == "", F.length(word)).otherwise(F.length(found))


def _cut(word: Column, ending: str, least: Column) -> Column:
    """The word without what `ending` finds at its end, if that begins `least` letters in at the earliest."""
    found = F.regexp_extract(word, f"({ending})$", 1)
    rest = F.length(word) - F.length(found)
    return F.when((found != "") & (rest >= least), F.substring(word, F.lit(1), rest)).otherwise(word)


def _first(word: Column, r1: Column) -> Column:
    """em, ern, er; e, en, es, after which niss loses an s; s after a consonant that takes one."""
    long, short = "em|ern|er", "en|es|e"
    plain = _cut(word, short, r1)
    without = F.when((plain != word) & plain.endswith("niss"), F.regexp_replace(plain, "s$", "")).otherwise(plain)
    return F.when(word.rlike(f"(?:{long})$"), _cut(word, "ern|em|er", r1)).when(word.rlike(f"(?:{short})$"), without).otherwise(_cut(word, "(?<=[bdfghklmnrt])s", r1))


def _second(word: Column, r1: Column) -> Column:
    """en, er, est; st after three letters and a consonant that takes it."""
    return F.when(word.rlike("(?:en|er|est)$"), _cut(word, "est|en|er", r1)).otherwise(_cut(word, "(?<=^.{3,60}[bdfghklmnt])st", r1))


def _third(word: Column, r1: Column, r2: Column) -> Column:
    """end, ung (with ig before); ig, ik, isch; lich, heit (with er or en before); keit (with lich or ig before)."""
    ung = _cut(word, "end|ung", r2)
    heit = _cut(word, "lich|heit", r2)
    keit = _cut(word, "keit", r2)
    return (
        F.when(word.rlike("(?:end|ung)$"), F.when(ung != word, _cut(ung, "(?<!e)ig", r2)).otherwise(word))
        .when(word.rlike("(?:ig|ik|isch)$"), _cut(word, "(?<!e)(?:isch|ig|ik)", r2))
        .when(word.rlike("(?:lich|heit)$"), F.when(heit != word, _cut(heit, "er|en", r1)).otherwise(word))
        .when(word.rlike("keit$"), F.when(keit != word, _cut(keit, "lich|ig", r2)).otherwise(word)).otherwise(word)
    )


def german(word: Column) -> Column:
    """The stem of a word, in lower case, umlauts as plain vowels."""
    low = F.regexp_replace(F.lower(word), "ß", "ss")
    low = F.regexp_replace(F.regexp_replace(low, f"(?<=[{VOWELS}])u(?=[{VOWELS}])", "U"), f"(?<=[{VOWELS}])y(?=[{VOWELS}])", "Y")

    def stem(x: Column) -> Column:
        w, r1, r2 = x["w"], F.greatest(x["r1"], F.lit(3)), x["r2"]
        done = let(_first(w, r1), lambda a: let(_second(a, r1), lambda b: _third(b, r1, r2)))
        return F.translate(done, "äöüUY", "aouuy")

    def regions(w: Column) -> Column:
        r1 = _region(w)
        return F.struct(w.alias("w"), r1.alias("r1"), (r1 + _region(F.substring(w, r1 + 1, F.length(w)))).alias("r2"))

    return let(let(low, regions), stem)
