"""German text as it is read aloud: numbers, units, dates, abbreviations, acronyms and signs in words.

A sentence is cut into tokens by one ordered alternation. What a token says of itself is worked out once for each
different token of all texts and joined back; what its neighbours decide (the ending of an ordinal, the gender of a
one) is a second pass over the sentence's array of tokens.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import numerals as N
from textlake.functions import text as T
from textlake.functions import udfs

W = "A-Za-zÄÖÜäöüßÀ-ÖØ-öø-ÿ"

# A unit's sign, its name for one and for several, its gender.
UNITS = """% Prozent Prozent n|‰ Promille Promille n|°C Grad_Celsius Grad_Celsius n|° Grad Grad n
kB Kilobyte Kilobyte n|KB Kilobyte Kilobyte n|KiB Kibibyte Kibibyte n|MB Megabyte Megabyte n|MiB Mebibyte Mebibyte n
GB Gigabyte Gigabyte n|GiB Gibibyte Gibibyte n|TB Terabyte Terabyte n|PB Petabyte Petabyte n|Byte Byte Byte n|Bytes Byte Byte n
bit Bit Bit n|Bit Bit Bit n|kbit Kilobit Kilobit n|Mbit Megabit Megabit n|Gbit Gigabit Gigabit n
bit/s Bit_pro_Sekunde Bit_pro_Sekunde n|Bit/s Bit_pro_Sekunde Bit_pro_Sekunde n|bps Bit_pro_Sekunde Bit_pro_Sekunde n
kbit/s Kilobit_pro_Sekunde Kilobit_pro_Sekunde n|Mbit/s Megabit_pro_Sekunde Megabit_pro_Sekunde n|Gbit/s Gigabit_pro_Sekunde Gigabit_pro_Sekunde n
kB/s Kilobyte_pro_Sekunde Kilobyte_pro_Sekunde n|MB/s Megabyte_pro_Sekunde Megabyte_pro_Sekunde n|GB/s Gigabyte_pro_Sekunde Gigabyte_pro_Sekunde n
Hz Hertz Hertz n|kHz Kilohertz Kilohertz n|MHz Megahertz Megahertz n|GHz Gigahertz Gigahertz n|THz Terahertz Terahertz n
ps Pikosekunde Pikosekunden f|ns Nanosekunde Nanosekunden f|µs Mikrosekunde Mikrosekunden f|μs Mikrosekunde Mikrosekunden f|ms Millisekunde Millisekunden f
s Sekunde Sekunden f|min Minute Minuten f|h Stunde Stunden f|nm Nanometer Nanometer m|µm Mikrometer Mikrometer m|mm Millimeter Millimeter m
cm Zentimeter Zentimeter m|m Meter Meter m|km Kilometer Kilometer m|km/h Kilometer_pro_Stunde Kilometer_pro_Stunde m
mg Milligramm Milligramm n|g Gramm Gramm n|kg Kilogramm Kilogramm n|mW Milliwatt Milliwatt n|W Watt Watt n|kW Kilowatt Kilowatt n|MW Megawatt Megawatt n
Wh Wattstunde Wattstunden f|kWh Kilowattstunde Kilowattstunden f|MWh Megawattstunde Megawattstunden f|mV Millivolt Millivolt n|V Volt Volt n|kV Kilovolt Kilovolt n
mA Milliampere Milliampere n|A Ampere Ampere n|J Joule Joule n|Ω Ohm Ohm n|px Pixel Pixel n|dpi Punkte_pro_Zoll Punkte_pro_Zoll m
fps Bild_pro_Sekunde Bilder_pro_Sekunde n|FLOPS Flops Flops n|GFLOPS Gigaflops Gigaflops n|TFLOPS Teraflops Teraflops n|PFLOPS Petaflops Petaflops n
€ Euro Euro m|EUR Euro Euro m|$ Dollar Dollar m|USD Dollar Dollar m|£ Pfund Pfund n"""
# Signs and their names; those of formulas are read only if formulas are.
SIGNS = """& und|+ plus|= gleich|≠ ungleich|< kleiner_als|> größer_als|≤ kleiner_gleich|≥ größer_gleich|≈ ungefähr|× mal|· mal|÷ geteilt_durch|± plus_minus
− minus|→ Pfeil|⇒ daraus_folgt|⇔ genau_dann_wenn|↔ genau_dann_wenn|∞ unendlich|√ Wurzel_aus|∑ Summe|∫ Integral|∈ Element_von|∉ nicht_Element_von
⊂ Teilmenge_von|⊆ Teilmenge_von|∪ vereinigt_mit|∩ geschnitten_mit|∀ für_alle|∃ es_existiert|∧ und|∨ oder|¬ nicht|⊕ exklusiv_oder|§ Paragraf|© Copyright
° Grad|% Prozent|‰ Promille|€ Euro|$ Dollar|£ Pfund|@ at|\\ Backslash|_ Unterstrich|^ hoch|² Quadrat|³ hoch_drei|¹ hoch_eins|½ ein_halb|¼ ein_Viertel|¾ drei_Viertel|† gestorben|∅ leere_Menge
α Alpha|β Beta|γ Gamma|δ Delta|ε Epsilon|ζ Zeta|η Eta|θ Theta|ι Iota|κ Kappa|λ Lambda|μ My|ν Ny|ξ Xi|π Pi|ρ Rho|σ Sigma|τ Tau|υ Ypsilon|φ Phi|χ Chi|ψ Psi|ω Omega
Γ Gamma|Δ Delta|Θ Theta|Λ Lambda|Π Pi|Σ Sigma|Φ Phi|Ψ Psi|Ω Omega|* mal|~ ungefähr"""
MATH = "+=≠<>≤≥≈×·÷±−→⇒⇔↔∞√∑∫∈∉⊂⊆∪∩∀∃∧∨¬⊕^²³¹∅*"
# Names of letters as they sound.
LETTERS = "a Ah b Beh c Zeh d Deh e Eh f Eff g Geh h Hah i Ih j Jott k Kah l Ell m Emm n Enn o Oh p Peh q Kuh r Err s Ess t Teh u Uh v Fau w Weh x Iks y Üpsilon z Zett ä Äh ö Öh ü Üh ß Eszett".split()
# What a syllable may begin with; Roman numbers that are read as such.
ONSETS = "SCH SPR STR BL BR CH DR FL FR GL GN GR KL KN KR PL PR SK SL SM SN SP ST SW TR TW ZW PH TH SH B C D F G H J K L M N P Q R S T V W X Z".split()
ROMAN = {"II": 2, "III": 3, "IV": 4, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "XI": 11, "XII": 12, "XIII": 13, "XIV": 14, "XV": 15, "XVI": 16, "XX": 20}
# Words after which an ordinal ends in -en, -e or -er, after which a one is dative, and a time of day is told.
DATIVE = "am im vom zum beim dem den des einem einen eines diesem diesen dieses seinem seinen ihrem ihren jedem jeden zur einer ab bis seit vor nach zwischen unserem unseren".split()
PREPOSITIONS = "in an auf aus bei mit nach von zu seit vor während wegen trotz unter über hinter neben zwischen ab bis gegenüber laut gemäß".split()
WEAK = "der die das diese dieses jede jedes eine".split()
STRONG = "ein kein jeder".split()
DATIVE_ONE = "mit nach von aus bei seit zu gegenüber nebst samt".split()
CLOCK = "um gegen ab bis von seit".split()
# Endings of feminine nouns, and nouns that are not feminine in spite of them.
FEMININE = "ung heit keit schaft ion tät ie ik ur enz anz ei in e".split()
NOT_FEMININE = """ende name auge interesse gebäude gelände erbe käse junge kunde experte bote affe löwe hase gedanke glaube wille friede buchstabe termin benzin magazin
medizin protein vitamin ruin pinguin kamin teil bit byte programm computer prozess modell verfahren netz beispiel element kriterium zeichen jahr""".split()

ABBREVIATIONS = "written string, expansion string, place string"
READINGS = "written string, reading string"
TOKENS = "array<struct<text string, kind string, written string>>"


def _table(text: str) -> list[list[str]]:
    return [[x.replace("_", " ") if i else x for i, x in enumerate(row.split(" "))] for line in text.split("\n") for row in line.split("|")]


def _look(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in pairs.items())), F.lit("\x1e"), F.lit("\x1f")), key)


ONE_UNIT, MANY_UNITS, GENDERS = ({r[0]: r[k] for r in _table(UNITS)} for k in (1, 2, 3))
SIGN = {r[0]: r[1] for r in _table(SIGNS)}
LETTER = dict(zip(LETTERS[::2], LETTERS[1::2], strict=True))


def pattern(abbreviations: list[tuple[str, str]] = (), specials: list[str] = (), phrases: list[str] = ()) -> str:
    """The ordered alternation. abbreviations: (written, place), spaces in them optional, place one of any, number (only
    before a number), after (only after one), end; specials: acronyms with signs in them; phrases: words that go together."""
    shorts = []
    for written, place in sorted(abbreviations, key=lambda a: (-len(a[0]), a[0])):
        one = r"\s?".join(re.escape(p) for p in written.split(" "))
        shorts.append(f"(?<=\\d\\s){one}" if place == "after" else one + (r"(?=\s?\d)" if place == "number" else ""))
    units = "|".join(re.escape(r[0]) for r in sorted(_table(UNITS), key=lambda r: -len(r[0])))
    longest = sorted(specials, key=lambda s: (-len(s), s))
    parts = [
        r"(?:https?://|www\.)[^\s<>\"„“”]+[^\s<>\"„“”.,;:!?)\]]",
        r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+",
        r"\[(?:\d+(?:\s*[,;–-]\s*\d+)*|…|\.\.\.)\]",
        r"(?<![\d.])\d{1,2}\.\s?\d{1,2}\.\s?(?:\d{4}|\d{2})(?![\d.,]\d)",
        r"(?<![\d:])\d{1,3}:\d{1,3}(?![\d:])(?:\s?Uhr\b)?",
        "|".join(map(re.escape, longest)),
        f"(?<![{W}])(?:{'|'.join(shorts)})" if shorts else "",
        rf"(?<![\d.,])\d{{2,4}}er[ns]?(?:-Jahre[n]?)?(?![{W}])",
        r"(?<![\p{L}\p{N}_.,])\d+\s?[–—-]\s?\d+(?![.,]?\d)(?![\p{L}\p{N}_])",
        r"(?<![\p{L}\p{N}_.,])(?!\d{1,3}(?:\.\d{3})+(?![\d.]))\d+(?:\.\d+)+(?!\d|,\d)",
        rf"(?<![\p{{L}}\p{{N}}_.,])\d{{1,3}}\.(?=\s+[{W}„\"(])",
        r"(?<![\p{L}\p{N}_/.,])\d+/\d+(?![\p{L}\p{N}_/])",
        r"(?:\d+|[A-Za-z])\^(?:-?\d+|[A-Za-z])",
        rf"(?<![\p{{L}}\p{{N}}_.,])(?:-(?=\d))?(?:\d{{1,3}}(?:[.  ]\d{{3}})+(?!\d)|\d{{1,3}}(?: \d{{3}})+(?![\d.,])|\d+)(?:,\d+)?(?![\d{W}])(?:\s?(?:{units})(?![{W}0-9]))?",
        rf"(?<![{W}0-9])(?=[{W}]*[0-9])(?=[0-9]*[{W}])[{W}0-9]+(?![{W}0-9])",
        rf"(?<![{W}0-9])[A-ZÄÖÜ]{{2,}}[a-z]?(?![{W}0-9])",
        "|".join(rf"(?i:(?<![{W}]){re.escape(p)}(?![{W}]))" for p in phrases),
        rf"[{W}]+(?:'[a-z]{{1,2}}(?![{W}]))?",
        r"\s+", r"[.,;:!?…]+", r"[„“”\"‚‘’'«»›‹]", r"[()\[\]{}]", r"[–—]", "-", "/", "(?s:.)",
    ]
    return "|".join(p for p in parts if p)


def _spell(text: Column) -> Column:
    """Names of letters; of other characters none."""
    each = F.filter(F.split(text, ""), lambda c: c.rlike(r"\p{L}"))
    return F.array_join(F.transform(each, lambda c: F.coalesce(_look(LETTER, F.lower(c)), c)), " ")


def _mixed(text: Column) -> Column:
    """Letters between digits: each run of its own."""
    runs = F.regexp_extract_all(text, F.lit("[0-9]+|[A-ZÄÖÜ][a-zäöüß]{2,}|[A-ZÄÖÜ]+|[a-zäöüß]+"), F.lit(0))
    said = F.transform(runs, lambda p: F.when(p.rlike("^[0-9]{1,6}$"), N.whole(p)).when(p.rlike("^[0-9]"), N.digits(p)).when((F.length(p) <= 2) | (p == F.upper(p)), _spell(p)).otherwise(p))
    return F.array_join(said, " ")


def _dotted(text: Column) -> Column:
    """An address: names of its marks between its parts."""
    runs = F.regexp_extract_all(text, F.lit("[./_-]|[^./_-]+"), F.lit(0))
    name = lambda p: (
        F.when(p == ".", "Punkt").when(p == "/", "Schrägstrich").when(p.isin("_", "-"), "Strich").when(p.rlike(r"^\d{1,4}$"), N.cardinal(p.try_cast("long")))
        .when(p.rlike(r"^\d+$"), N.digits(p)).when(p.rlike(r"\d"), _mixed(p)).when(F.length(p) <= 2, _spell(p)).otherwise(p)
    )
    return F.array_join(F.transform(runs, name), " ")


def _acronym(text: Column) -> Column:
    """As a word, if it has the syllables of one, else by its letters; a small letter at the end is a plural or a letter."""
    end = F.regexp_extract(text, "[a-z]$", 0)
    stem = F.regexp_replace(text, "[a-z]$", "")
    vowels = "[AEIOUÄÖÜY]{1,2}"
    word = stem.rlike(f"^(?:{'|'.join(ONSETS)})?{vowels}(?:[^AEIOUÄÖÜY]{{1,3}}{vowels})*(?:[^AEIOUÄÖÜY]{{1,2}})?$") & (F.length(stem) >= 4)
    spelled = _spell(stem)
    return F.when(word & (end == ""), F.initcap(stem)).when(end == "s", F.concat(spelled, end)).when(end != "", F.concat_ws(" ", spelled, _spell(end))).otherwise(spelled)


def _number(t: Column) -> tuple[Column, Column]:
    """(kind, reading) of a number, with its sign, fraction and unit."""
    part = lambda k: F.regexp_extract(t, r"^(-?)([\d.   ]*\d)(?:,(\d+))?\s?([^\d,]*)$", k)
    digits = F.regexp_replace(part(2), r"[^\d]", "")
    n, unit, behind = digits.try_cast("long"), part(4), part(3)
    plain = (unit == "") & (part(1) == "") & (digits == part(2))
    words = F.when(behind != "", F.concat(F.coalesce(N.cardinal(n), N.digits(digits)), F.lit(" Komma "), N.digits(behind))).when(plain & n.between(1100, 1999), N.year(n)).otherwise(N.whole(digits))
    words = F.concat(F.when(part(1) != "", "minus ").otherwise(""), words)
    one = (n == 1) & (behind == "") & (part(1) == "")
    article = F.when(_look(GENDERS, unit) == "f", "eine ").otherwise("ein ")
    said = F.when(unit == "", words).when(one, F.concat(article, _look(ONE_UNIT, unit))).otherwise(F.concat(words, F.lit(" "), _look(MANY_UNITS, unit)))
    kind = F.when(unit != "", "unit").when(behind != "", "decimal").when(plain & n.between(1100, 1999), "year").otherwise("number")
    return kind, said


def _run(text: Column) -> Column:
    n = text.try_cast("long")
    return F.struct(n.alias("n"), N.whole(text).alias("whole"), F.coalesce(N.cardinal(n), N.digits(text)).alias("cardinal"), F.coalesce(N.year(n), N.digits(text)).alias("year"), N.ordinal_stem(n).alias("stem"))


def readings(tokens: DataFrame, abbreviations: DataFrame, acronyms: DataFrame, citations: bool = False, urls: str = "short") -> DataFrame:
    """tokens(t), each once -> (t, kind, said, rest): what a token says alone. Of an ordinal and a date, `said` lacks the
    ending and `rest` follows it; of a time, `said` is that of a clock and `rest` of a ratio.

    abbreviations(written, expansion, place) and acronyms(written, reading) are joined; citations are left out unless
    asked for, and addresses read as far as their host, `full` or not at all (`skip`).
    """
    t, runs = F.col("t"), F.col("runs")
    first, second, third = (F.get(runs, F.lit(k)) for k in range(3))
    a, b = first["n"], second["n"]
    dated = a.between(1, 31) & b.between(1, 12)
    body = F.regexp_replace(t, r"^(?:https?://)?(?:www\.)?", "")
    host, path = F.regexp_extract(body, "^[^/]*", 0), F.regexp_replace(F.regexp_extract(body, "^[^/]*/(.*)$", 1), "/+$", "")
    mail = t.rlike("^[^@]+@.+")
    parts = F.when(mail, F.split(t, "@", 2)).when(F.lit(urls == "full") & (path != ""), F.array(host, path)).otherwise(F.array(host))
    address = T.let(F.transform(parts, _dotted), lambda p: F.when(mail, F.array_join(p, " at ")).otherwise(F.array_join(p, " Schrägstrich ")))
    wholes = F.transform(runs, lambda r: r["whole"])
    source = F.concat(F.when(F.size(runs) > 1, "Quellen ").otherwise("Quelle "), F.array_join(wholes, " und "))
    both_years = a.between(1100, 2099) & b.between(1100, 2099) & t.rlike(r"^\d{4}\D")
    say = lambda r: F.when(both_years, r["year"]).otherwise(r["cardinal"])
    clock = F.concat(F.when(a == 1, "ein").otherwise(first["cardinal"]), F.lit(" Uhr"), F.when(b > 0, F.concat(F.lit(" "), second["cardinal"])).otherwise(""))
    ratio = F.concat(first["cardinal"], F.lit(" zu "), second["cardinal"])
    dec = r"^(\d{2,4})er([ns]?)(?:-(Jahren?))?$"
    decade = F.concat(N.decade(a), F.regexp_extract(t, dec, 2), F.when(F.regexp_extract(t, dec, 3) != "", F.concat(F.lit(" "), F.regexp_extract(t, dec, 3))).otherwise(""))
    power = F.transform(F.split(t, r"\^"), lambda p: F.when(p.rlike(r"^-?\d+$"), F.concat(F.when(p.startswith("-"), "minus ").otherwise(""), N.whole(F.ltrim(p, F.lit("-"))))).otherwise(_spell(p)))
    kind, number = _number(t)
    cases = [
        (F.col("reading").isNotNull(), "acronym", F.regexp_replace("reading", "'", ""), None),
        (t.rlike(r"^(?:https?://|www\.)"), "url", F.lit("") if urls == "skip" else address, None),
        (mail, "email", address, None),
        (t.rlike(r"^\[.+\]$"), "citation", F.when(F.size(runs) > 0, source).otherwise("") if citations else F.lit(""), None),
        (t.rlike(r"^\d+\.\s?\d+\.\s?\d+$") & dated & t.rlike(r"^\d{1,2}\.\s?\d{1,2}\.\s?(\d{2}|\d{4})$"), "date", first["stem"], F.concat_ws(" ", F.lit(""), N.month(b), third["year"])),
        (t.rlike(r"^\d{1,2}\.\s?\d{1,2}\.\s?(\d{2}|\d{4})$") & ~t.rlike(r"^\d+\.\d+$"), "number", F.array_join(F.transform(runs, lambda r: r["cardinal"]), " "), None),
        (t.rlike(r"^\d+:\d+\s?Uhr$") & (a <= 24) & (b < 60) & t.rlike(r":\d\d\D"), "time", clock, None),
        (t.rlike(r"^\d+:\d\d$") & (a <= 24) & (b < 60), "either", clock, ratio),
        (t.rlike(r"^\d+:\d+"), "number", ratio, None),
        (F.col("expansion").isNotNull(), "abbreviation", F.col("expansion"), None),
        (t.rlike(dec), "decade", decade, None),
        (t.rlike(r"^\d+\s?[–—-]\s?\d+$"), "range", F.concat(say(first), F.lit(" bis "), say(second)), None),
        (t.rlike(r"^\d+(\.\d+)+$") & ~t.rlike(r"^\d{1,3}(\.\d{3})+$"), "version", F.array_join(wholes, " Punkt "), None),
        (t.rlike(r"^\d{1,3}\.$"), "ordinal", first["stem"], first["cardinal"]),
        (t.rlike(r"^\d+/\d+$"), "fraction", F.coalesce(N.fraction(a, b, first["cardinal"]), F.concat(first["cardinal"], F.lit(" Schrägstrich "), second["cardinal"])), None),
        (t.rlike(r"^[^^]+\^.+$"), "formula", F.array_join(power, " hoch "), None),
        (t.rlike(rf"^-?\d") & ~t.rlike(rf"^\d+[{W}]|\d[{W}]+\d"), kind, number, None),
        (t.rlike("[0-9]"), "mixed", _mixed(t), None),
        (t.rlike("^[A-ZÄÖÜ]{2,}[a-z]?$"), "short", _acronym(t), _look({k: N.HUNDRED[v] for k, v in ROMAN.items()}, t)),
        (t.rlike(rf"^[{W}]$"), "letter", _spell(t), None),
        (t.rlike(rf"^[{W}]"), "word", t, None),
        (t == "#", "symbol", F.lit(""), None),
        (_look(SIGN, t).isNotNull(), F.when(F.instr(F.lit(MATH), t) > 0, "formula").otherwise("symbol"), F.concat(F.lit(" "), _look(SIGN, t), F.when(t.isin("²", "³"), "").otherwise(" ")), None),
    ]
    told = F.lit(None).cast("struct<kind string, said string, rest string>")
    for test, kind, said, rest in reversed(cases):
        one = F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), said.alias("said"), (F.lit(None).cast("string") if rest is None else rest).alias("rest"))
        told = F.when(test, one).otherwise(told)
    short = abbreviations.select(F.regexp_replace("written", r"\s", "").alias("_w"), "expansion").dropDuplicates(["_w"])
    known = acronyms.select(F.col("written").alias("_a"), "reading").dropDuplicates(["_a"])
    met = tokens.join(short, F.regexp_replace(t, r"\s", "") == F.col("_w"), "left").join(known, t == F.col("_a"), "left")
    # each run of digits is put into words once, whatever its token makes of it
    met = met.withColumn("runs", F.transform(F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)), _run))
    return met.select("t", F.inline(F.filter(F.array(told), lambda r: r.isNotNull())))  # worked out once, whatever is read of it


def tidy(text: Column, final: bool = True) -> Column:
    """Spaces and marks of a sentence put together: no mark twice, no full stop inside, one at the end."""
    for found, put in ((r"\s+", " "), (r"\s+([,.;:!?])", "$1"), (r"([,;:])(?:\s*[,;:])+", "$1"), (r"^[\s,;:.]+", "")):
        text = F.regexp_replace(text, found, put)
    text = F.rtrim(text)
    end = F.regexp_extract(text, "[.!?]+$", 0)
    body = F.regexp_replace(text, "[.!?]+$", "")
    for found, put in ((r"\.(?=\s|$)", ","), (r"[!?](?=\s)", ","), (r"([,;:])(?:\s*[,;:])+", "$1"), (r"[ ,;:]+$", "")):
        body = F.regexp_replace(body, found, put)
    mark = F.when(end == "", ".").when(F.substring(end, 1, 1).isin("!", "?"), F.substring(end, 1, 1)).otherwise(".")
    return F.when(body == "", "").otherwise(F.concat(body, mark) if final else body)


def _among(word: Column, words: list[str]) -> Column:
    return F.coalesce(word.isin(*words), F.lit(False))


def _alone(t: Column, i: Column, ts: Column) -> Column:
    """(kind, said, rest) of a mark t at place i of the tokens ts."""
    before, after, next_ = (F.when(i + k >= 0, F.get(ts, i + k)) for k in (-1, 1, 2))
    initial = (t == ".") & before.rlike(r"^\p{Lu}$") & after.rlike(r"^\s") & next_.rlike(f"^[{W}]")
    mark = F.when(t.contains("…") | (t == "..."), ",").when(F.substring(t, 1, 1).isin("!", "?"), F.substring(t, 1, 1)).otherwise(F.substring(t, -1, 1))
    calls = before.rlike(rf"^[{W}]{{1,3}}$")
    return (
        F.when(initial, _told("quote", "")).when(t.rlike(r"^[.,;:!?…]+$"), _told("punct", mark)).when(t.rlike(r"^\s+$"), _told("space", " "))
        .when(t.rlike("^[„“”\"‚‘’'«»›‹]$"), _told("quote", "")).when((t == "(") & calls, _told("formula", " von ")).when(t.rlike(r"^[()\[\]{}–—]$"), _told("pause", ", "))
        .when(t.isin("-", "/"), _told("space", " ")).otherwise(_told("symbol", ""))
    )


def _told(kind: str, said: Column | str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(said) if isinstance(said, str) else said).alias("said"), F.lit(None).cast("string").alias("rest"))


def _closing(row: Column) -> Column:
    """Places of `)` that close a call: as many as calls are open."""

    def step(state: Column, x: Column) -> Column:
        opens, closes = x["said"] == " von ", (x["t"] == ")") & (state["open"] > 0)
        return F.struct((state["open"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("open"), F.when(closes, F.array_append(state["at"], x["i"])).otherwise(state["at"]).alias("at"))

    start = F.struct(F.lit(0).alias("open"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(F.filter(row, lambda x: x["t"].isin("(", ")")), start, step)["at"]


SEPARATORS = ("space", "punct", "quote", "pause")


def _in_context(x: Column, place: Column, said: Column, every: Column, closing: Column) -> Column:
    """What a token says once its neighbours are known. said: the tokens that separate nothing, x stands at `place`."""
    none = F.lit(None)
    near = lambda k: F.when(place + k >= 0, F.get(said, place + k))
    before, earlier, after = near(-1), near(-2), near(1)
    word = F.when(before["kind"].isin("word", "abbreviation"), F.lower(before["t"]))
    second = F.when(earlier["kind"] == "word", F.lower(earlier["t"]))
    heard = F.when(~F.exists(F.slice(every, F.coalesce(before["i"], F.lit(0)) + 2, F.greatest(x["i"] - F.coalesce(before["i"], F.lit(0)) - 1, F.lit(0))), lambda y: y["kind"] == "punct"), F.lower(before["t"]))
    ending = (
        F.when(_among(word, DATIVE) | ((word == "der") & _among(second, PREPOSITIONS)), "en").when(_among(word, WEAK), "e").when(_among(word, STRONG), "er")
        .when(x["kind"] == "date", "er").when(after["t"].isin(*N.MONTHS, "Jänner"), "er").otherwise("e")
    )
    noun = after["kind"].isin("word", "short", "english") & after["t"].rlike(r"^\p{Lu}") & (after["kind"] != "short")
    beside = (after["i"] == x["i"] + 2) & (F.get(every, x["i"] + 1)["kind"] == "space")
    female = after["t"].rlike(f"(?i)(?:{'|'.join(FEMININE)})$") & ~F.lower(after["t"]).isin(*NOT_FEMININE)
    great = {"Millionen": "Million", "Milliarden": "Milliarde"}
    one = F.when((after["kind"] == "abbreviation") & after["said"].isin(*great), "eine").when(noun & beside, F.when(_among(heard, DATIVE_ONE), F.when(female, "einer").otherwise("einem")).otherwise(F.when(female, "eine").otherwise("ein")))
    single = before.isNotNull() & (before["t"] == "1") & (before["kind"] == "number") & (x["kind"] == "abbreviation")
    roman = x["rest"].isNotNull() & before["t"].rlike(r"^\p{Lu}") & before["kind"].isin("word", "acronym", "short", "english")
    return (
        F.when((x["kind"] == "ordinal") & before.isNull(), F.concat(x["rest"], F.lit(",")))
        .when(x["kind"] == "ordinal", F.concat(x["said"], ending)).when(x["kind"] == "date", F.concat(x["said"], ending, x["rest"]))
        .when(x["kind"] == "either", F.when(_among(heard, CLOCK), x["said"]).otherwise(x["rest"]))
        .when((x["kind"] == "number") & (x["t"] == "1"), F.coalesce(one, x["said"]))
        .when(single & (x["said"] == "Millionen"), "Million").when(single & (x["said"] == "Milliarden"), "Milliarde")
        .when((x["kind"] == "short") & roman, x["rest"]).when((x["t"] == "#") & after["kind"].isin("number", "year"), "Nummer ")
        .when(F.array_contains(closing, x["i"]), " ").otherwise(x["said"])
    )


def read(sentences: DataFrame, key: str, abbreviations: DataFrame, acronyms: DataFrame, english: DataFrame | None = None, text: str = "text", citations: bool = False, urls: str = "short") -> DataFrame:
    """Append `tokens` (what is written, its kind and its words) and `spoken`, the sentence in words. The key is unique.

    abbreviations(written, expansion, place), acronyms(written, reading) and english(written, reading) are tables of
    some thousand rows at most: the first two and the phrases of the third are also alternatives of the pattern. English
    words are said as their readings; what is written stays in `tokens`. A null text has null tokens and is null.
    """
    rows = abbreviations.select("written", "place").distinct().collect()
    signs = [r[0] for r in acronyms.filter(F.col("written").rlike(f"[^{W}0-9]")).select("written").distinct().collect()]
    phrases = [] if english is None else [r[0] for r in english.filter(F.col("written").rlike(r"[\s-]")).select("written").distinct().collect()]
    cut = F.regexp_extract_all(F.col(text), F.lit(pattern([tuple(r) for r in rows], signs, sorted(phrases, key=lambda p: (-len(p), p)))), F.lit(0))
    cuts = sentences.withColumn("ts", cut)
    words = cuts.select(key, F.explode(F.array_distinct("ts")).alias("t")).filter(F.col("t").rlike(rf"[{W}0-9@#^\[]") | (~F.col("t").rlike(r"^[\s\p{P}]+$")) | F.col("t").isin("&", "%", "§", "*", "_", "\\", "†", "@"))
    said = readings(words.select("t").distinct(), abbreviations, acronyms, citations, urls)
    if english is not None:
        known = english.select(F.lower("written").alias("_e"), F.regexp_replace("reading", "'", "").alias("_r")).dropDuplicates(["_e"])
        said = said.join(known, (F.lower("t") == F.col("_e")) & F.col("kind").isin("word"), "left")
        said = said.select("t", F.when(F.col("_r").isNotNull(), "english").otherwise(F.col("kind")).alias("kind"), F.coalesce("_r", "said").alias("said"), "rest")
    # both sides grow with the texts, though shuffled bytes of few different tokens look small: neither may be broadcast
    met = words.join(said.hint("merge"), "t").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct("kind", "said", "rest")))).alias("told"))
    out = cuts.join(met.hint("merge"), key, "left")

    def first(t: Column, i: Column) -> Column:
        own = F.coalesce(F.try_element_at("told", t), _alone(t, i, F.col("ts")))
        return T.let(own, lambda x: F.struct(t.alias("t"), i.alias("i"), x["kind"].alias("kind"), x["said"].alias("said"), x["rest"].alias("rest")))

    out = out.withColumn("every", F.transform("ts", first))
    out = out.withColumn("heard", F.filter("every", lambda x: ~x["kind"].isin(*SEPARATORS))).withColumn("closing", _closing(F.col("every")))
    out = out.withColumn("places", F.transform("heard", lambda x: x["i"]))

    def second(x: Column) -> Column:
        place = F.array_position("places", x["i"]).cast("int") - 1
        told = F.when(x["kind"].isin("ordinal", "date", "either", "number", "abbreviation", "short", "symbol", "pause"), _in_context(x, place, F.col("heard"), F.col("every"), F.col("closing"))).otherwise(x["said"])
        return F.struct(x["t"].alias("text"), x["kind"].alias("kind"), told.alias("written"))

    out = out.withColumn("tokens", F.transform("every", second))
    return out.withColumn("spoken", tidy(F.array_join(F.transform("tokens", lambda x: x["written"]), ""))).select(*sentences.columns, "tokens", "spoken")


def prepare(docs: DataFrame, key: str, abbreviations: DataFrame, acronyms: DataFrame, text: str = "text", **options) -> DataFrame:
    """(key, paragraph, sentence, text, tokens, spoken, changed): every sentence of every document, read; `changed` counts
    the tokens that are read otherwise than written. Null and empty texts have no sentences."""
    blocks = docs.select(key, F.posexplode(T.blocks(F.coalesce(F.col(text), F.lit("")))).alias("paragraph", "block"))
    parts = blocks.select(key, "paragraph", F.posexplode(udfs.sentences("block")).alias("sentence", "s"))
    rows = parts.select(key, "paragraph", "sentence", F.col("s.text").alias("text"), F.concat_ws(":", key, "paragraph", "sentence").alias("_at"))
    done = read(rows, "_at", abbreviations, acronyms, **options)
    changed = F.size(F.filter("tokens", lambda x: ~x["kind"].isin(*SEPARATORS) & (x["written"] != x["text"])))
    return done.select(key, "paragraph", "sentence", "text", "tokens", "spoken", changed.alias("changed"))


def accuracy(rows: DataFrame, category: str = "category", told: str = "spoken", expected: str = "expected") -> DataFrame:
    """(category, cases, right, accuracy) of each category, and of all under a null category: the words are equal, whatever
    their case and the marks between them. A null counts as no words."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    sums = rows.select(F.col(category).alias("category"), (words(told) == words(expected)).alias("ok")).groupingSets([["category"], []], "category")
    out = sums.agg(F.count("*").alias("cases"), F.count_if("ok").alias("right"))
    return out.withColumn("accuracy", F.round(F.col("right") / F.col("cases"), 6))
