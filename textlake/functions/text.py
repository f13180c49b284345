"""Column functions over text: tokens, normal forms, n-grams, segments, markup, edit similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: letters and digits, hyphens inside.
# Possessive: nothing comes after, so nothing is ever given back, and no places to go back to are kept.
TOKEN = r"[\p{L}\p{N}]++(?:-[\p{L}\p{N}]++)*+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: an expression named inside a lambda would run again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column | str, pattern: str = TOKEN) -> Column:
    """Lower-case tokens in order; ё counts as е. Null text has null tokens."""
    return F.regexp_extract_all(F.translate(F.lower(_col(text)), "ё", "е"), F.lit(pattern), F.lit(0))


def is_significant(token: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """At least two characters, not all digits, not a stop-word."""
    good = (F.length(token) >= 2) & ~token.rlike(r"^\d+$")
    return good & ~token.isin(*stop_words) if stop_words else good


def counted(values: Column | str) -> Column:
    """(value, n) of an array's different values, in their order: equal ones stand together once it is sorted."""

    def runs(ws: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ws)), lambda i: (i == 0) | (i == F.size(ws)) | (F.get(ws, i) != F.get(ws, i - 1)))
        each = let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(ws, i).alias("value"), (F.get(at, k + 1) - i).alias("n"))))
        return F.filter(each, lambda x: x["n"].isNotNull())

    return let(F.sort_array(_col(values)), runs)


def letters(text: Column | str) -> Column:
    """Lower-case words of letters, single spaces between: everything else separates."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), r"[^\p{L}]+", " "))


def count_letters(normal: Column | str) -> Column:
    return F.length(F.replace(_col(normal), F.lit(" ")))


def _grams(text: Column, n: int) -> Column:
    """Character n-grams; sequence() counts down past its end, so shorter texts are guarded."""
    some = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, some).otherwise(F.array().cast("array<string>"))


def long_grams(text: Column, n: int) -> Column:
    """_grams for long texts: characters become an array first, as substring() would walk the text anew each time."""

    def grams(c: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), ""))
        return F.when(F.size(c) >= n, some).otherwise(F.array().cast("array<string>"))

    return let(F.array_remove(F.split(text, ""), ""), grams)


def padded_ngrams(normal: Column | str, longest: int = 5) -> Column:
    """n-grams, n = 1..longest, of each word between underscores; a lone underscore is none."""
    words = F.filter(F.split(_col(normal), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("_"), w, F.lit("_")))
    of = lambda n: F.transform(padded, lambda w: _grams(w, n))
    return F.filter(F.flatten(F.flatten(F.array(*map(of, range(1, longest + 1))))), lambda g: g != "_")


def running_ngrams(normal: Column | str, longest: int = 3) -> Column:
    """n-grams across words, a space before and after the text; those of spaces alone are none."""
    padded = F.concat(F.lit(" "), _col(normal), F.lit(" "))
    every = let(padded, lambda p: F.flatten(F.array(*[long_grams(p, n) for n in range(1, longest + 1)])))
    return F.filter(every, lambda g: F.trim(g) != "")


def word_ngrams(words: Column | str, n: int) -> Column:
    """Word n-grams, joined by one space."""

    def grams(w: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, some).otherwise(F.array().cast("array<string>"))

    return let(_col(words), grams)


def fragments(text: Column | str, size: int, step: int) -> Column:
    """Fixed-size windows of characters; a shorter text is one window, an empty one none."""

    def cut(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.length(t) - size, F.lit(step)), lambda i: F.substring(t, i + 1, F.lit(size)))
        return F.when(F.length(t) > size, many).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))

    return let(_col(text), cut)


def fragment_count(text: Column | str, size: int, step: int) -> Column:
    """How many windows fragments() cuts, none of them made."""
    n = F.length(_col(text))
    return F.when(n > size, F.floor((n - size) / step) + 1).when(n > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")


def last_fragment(text: Column | str, size: int, step: int) -> Column:
    """The last window of fragments(), the only one cut; of a text that is no longer than one, the text."""
    t = _col(text)
    return F.when(F.length(t) > size, F.substring(t, ((fragment_count(t, size, step) - 1) * step + 1).cast("int"), F.lit(size))).otherwise(t)


def phrase(text: Column | str) -> Column:
    """Comparable form of a spoken phrase: German and Cyrillic letters folded, accents dropped, words of a-z, а-я, 0-9."""
    t = F.lower(_col(text))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.translate(t, "ёéèêáàâíóúñç", "еeeeaaaiounc")
    return F.trim(F.regexp_replace(t, r"[^a-zа-я0-9]+", " "))


def comparison_words(text: Column | str) -> Column:
    """Words as speech scoring compares them: hyphens separate."""
    return F.regexp_extract_all(F.replace(F.lower(_col(text)), F.lit("-"), F.lit(" ")), F.lit(r"[a-zäöüß0-9]+"), F.lit(0))


# Latin spellings of Cyrillic and German letters, longest first.
LATIN = {"щ": "shch", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "ю": "yu", "я": "ya", "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
LATIN_ONE = ("абвгдеёзийклмнопрстуфыэ", "abvgdeezijklmnoprstufye")


def latinize(word: Column | str) -> Column:
    """Latin spelling; hard and soft signs are dropped."""
    w = F.lower(_col(word))
    for a, b in LATIN.items():
        w = F.replace(w, F.lit(a), F.lit(b))
    return F.translate(w, LATIN_ONE[0] + "ъь", LATIN_ONE[1])


def script_language(text: Column | str, cyrillic: str = "ru", latin: str = "de") -> Column:
    """The language of the script with more letters; as many of both count as Cyrillic."""
    t = _col(text)
    cyr = F.length(F.regexp_replace(t, r"[^Ѐ-ӿ]", ""))
    lat = F.length(F.regexp_replace(t, r"[^A-Za-zÄÖÜäöüß]", ""))
    return F.when((cyr >= lat) & (cyr > 0), cyrillic).otherwise(latin)


def blocks(text: Column | str) -> Column:
    """Paragraphs: between blank lines if there are any, else lines. Trimmed; empty ones are dropped."""
    t = _col(text)
    parts = F.when(t.rlike(r"\n\s*\n"), F.split(t, r"\n\s*\n")).otherwise(F.split(t, "\n"))
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def looks_like_heading(text: Column | str) -> Column:
    """Short, no final punctuation, starts with a capital or digit."""
    t = F.trim(_col(text))
    return (F.length(t) <= 120) & (F.size(F.split(t, r"\s+")) <= 14) & ~t.rlike(r"[.!?:;,]$") & t.rlike(r"^[\p{Lu}\p{N}]")


def simple_sentences(text: Column | str) -> Column:
    """Sentences cut after . ! ? and white space; the form SQL can also express."""
    return F.filter(F.transform(F.split(F.regexp_replace(_col(text), r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def word_shape(word: Column | str) -> Column:
    """Letters to X or x, digits to d, runs of one kind squeezed."""
    w = F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(word), r"\p{Lu}+", "X"), r"\p{Ll}+", "x"), r"\d+", "d")
    return w


def tag_form(word: Column | str) -> Column:
    """What a tagger sees of a word: years and digits collapse, the rest is lower case."""
    w = _col(word)
    return F.when(w.contains("-") & ~w.startswith("-"), "!HYPHEN").when(w.rlike(r"^\d{4}$"), "!YEAR").when(w.rlike(r"^\d"), "!DIGITS").otherwise(F.lower(w))


def snippet(text: Column | str, size: int = 300) -> Column:
    """The beginning of a text, with an ellipsis if cut."""
    t = _col(text)
    return F.concat(F.substring(t, F.lit(1), F.lit(size)), F.when(F.length(t) > size, "…").otherwise(""))


def html_text(html: Column | str) -> Column:
    """Visible text: scripts, styles, heads and comments dropped, block tags break lines, spaces collapse."""
    t = F.regexp_replace(_col(html), r"(?is)<(script|style|noscript|template|head|svg)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|ul|ol|tr|td|table|h[1-6]|nav|section|article|header|footer)\b[^>]*>", "\n")
    lines = F.regexp_replace(F.regexp_replace(unescape(F.regexp_replace(t, r"<[^>]*>", "")), r"[ \t\r\f]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(lines, r"^[ \n]+|[ \n]+$", "")


def html_title(html: Column | str, fallback: Column | None = None) -> Column:
    """<title>, else the first h1 or h2, else fallback; entities resolved, spaces collapsed."""
    pick = lambda tag: F.trim(F.regexp_replace(unescape(F.regexp_replace(F.regexp_extract(_col(html), rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"<[^>]*>", "")), r"\s+", " "))
    found = [F.when(pick(t) != "", pick(t)) for t in ("title", "h1", "h2")]
    return F.coalesce(*found, *([fallback] if fallback is not None else []), F.lit(""))


def main_part(html: Column | str) -> Column:
    """The markup of <article>, else <main>, else all."""
    h = _col(html)
    pick = lambda tag: F.regexp_extract(h, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", 1)
    return F.when(pick("article") != "", pick("article")).when(pick("main") != "", pick("main")).otherwise(h)


def dehyphenate(text: Column | str) -> Column:
    """Join words that a line break splits at a hyphen."""
    return F.regexp_replace(_col(text), r"(\p{Ll})-\n\s*(\p{Ll})", "$1$2")


def unescape(text: Column) -> Column:
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length; two empty strings are alike."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common prefix."""
    a, b = _col(a), _col(b)
    size = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), size), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.array_max(same)


def same_word(a: Column | str, b: Column | str) -> Column:
    """Similarity of two words; a long shared prefix lifts it to 0.75."""
    a, b = _col(a), _col(b)
    prefix = common_prefix(a, b)
    lifted = (prefix >= 4) & (prefix >= 0.6 * F.least(F.length(a), F.length(b)))
    return F.when(lifted, F.greatest(similarity(a, b), F.lit(0.75))).otherwise(similarity(a, b))


def date_key(value: Column | str) -> Column:
    """DD.MM.YYYY or YYYY-MM-DD, time ignored -> YYYYMMDD as text; anything else is empty, which bounds nothing."""
    v = F.trim(_col(value))
    dotted, iso = r"^(\d{2})\.(\d{2})\.(\d{4})", r"^(\d{4})-(\d{2})-(\d{2})"
    join = lambda p, order: F.concat(*[F.regexp_extract(v, p, i) for i in order])
    return F.coalesce(F.when(v.rlike(dotted), join(dotted, (3, 2, 1))).when(v.rlike(iso), join(iso, (1, 2, 3))), F.lit(""))


def plural_ru(number: Column, one: str, few: str, many: str) -> Column:
    ten, hundred = number % 10, number % 100
    return F.when((ten == 1) & (hundred != 11), one).when(ten.between(2, 4) & ~hundred.between(12, 14), few).otherwise(many)


def plural_de(number: Column, one: str, many: str) -> Column:
    return F.when(number == 1, one).otherwise(many)


def german_number(text: Column | str) -> Column:
    """English digit grouping to German: commas and points change places."""
    return F.translate(_col(text), ",.", ".,")


def pair_map(text: Column | str, pair: str = ";", equals: str = "=", missing: str = "1") -> Column:
    """`k=v;k2` -> map; a key without a value has `missing`. Spaces around parts are dropped."""
    parts = F.filter(F.transform(F.split(F.coalesce(_col(text), F.lit("")), f"\\Q{pair}\\E"), lambda p: F.trim(p)), lambda p: p != "")
    key = lambda p: F.trim(F.substring_index(p, equals, 1))
    value = lambda p: F.when(F.instr(p, equals) > 0, F.trim(F.substring(p, F.instr(p, equals) + 1, F.length(p)))).otherwise(missing)
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(key(p), value(p))))


def level_db(samples: Column | str) -> Column:
    """RMS level of 16-bit samples in dB of full scale; silence is -100."""
    s = _col(samples)
    power = F.aggregate(s, F.lit(0.0), lambda x, y: x + y.cast("double") * y.cast("double")) / F.greatest(F.size(s), F.lit(1))
    return F.when(power <= 0, F.lit(-100.0)).otherwise(F.greatest(F.lit(-100.0), 20 * F.log10(F.sqrt(power) / 32768)))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def inverse_frequency(documents: Column, df: Column) -> Column:
    """log10(N / df), zero where either isn't positive."""
    return F.when((documents > 0) & (df > 0), F.log10(documents / df)).otherwise(F.lit(0.0))


# The letters of words written in a language's own script.
CYRILLIC_WORD = r"(?iu)^[а-яё]+(?:-[а-яё]+)*$"
LATIN_WORD = r"(?iu)^[a-zäöüßàáâçèéêëìíîïñòóôùúûÿœæ]+(?:[-'][a-zäöüßàáâçèéêëìíîïñòóôùúûÿœæ]+)*$"
#: Characters that show nothing: soft hyphen, zero-width ones, marks of direction, byte-order mark.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"


def in_script(word: Column | str, language: Column | str) -> Column:
    """A word is wholly in the script of its language: Cyrillic for ru, else Latin."""
    w, l = _col(word), _col(language)
    return F.when(l == "ru", w.rlike(CYRILLIC_WORD)).otherwise(w.rlike(LATIN_WORD))


def is_counted(word: Column, language: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """In the language's script, longer than one letter, no stop-word."""
    good = in_script(word, language) & (F.length(word) > 1)
    return good & ~F.lower(word).isin(*stop_words) if stop_words else good


def cleaned(text: Column | str) -> Column:
    """Invisible characters dropped, spaces of each line squeezed and trimmed. Composed forms: see udfs.nfc."""
    t = F.regexp_replace(F.regexp_replace(_col(text), rf"[{INVISIBLE}]", ""), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t\f\u000b\u00a0\u2000-\u200a\u202f\u205f\u3000]+", " "), r"(?m)^ | $", "")


# References that a summary leaves out.
CITATION = r"\s*\[\s*\d+(?:\s*[,;–-]\s*\d+)*(?:\s*[,;]\s*(?:с|c|s|S|p|pp|стр)\.\s*\d+(?:\s*[–-]\s*\d+)?)?\s*\]"
FIGURE = r"(?iu)\s*\((?:см\.\s*|vgl\.\s*|siehe\s*|s\.\s*)?(?:рис|рисунок|табл|таблица|abb|abbildung|tab|tabelle|fig)\.?\s*[\d.,\s–-]*\)"


def compressed(sentence: Column | str, openings: tuple[str, ...] = (), least: int = 20) -> Column:
    """A sentence without citations, references to figures and, where `openings` names them (lower case), the phrase and
    comma that it begins with, if at least `least` characters are left. What would become empty stays as it was."""
    s = _col(sentence)
    t = F.regexp_replace(F.regexp_replace(s, CITATION, ""), FIGURE, "")
    if openings:
        start = "|".join(f"\\Q{o}\\E" for o in sorted(openings, key=len, reverse=True))
        rest = F.regexp_replace(t, rf"(?iu)^(?:{start}),\s*", "")
        lifted = F.concat(F.upper(F.substring(rest, F.lit(1), F.lit(1))), F.substring(rest, F.lit(2), F.length(rest)))
        t = F.when((rest != t) & (F.length(rest) >= least), lifted).otherwise(t)
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+([,.;:!?…])", "$1"), r"\s{2,}", " "))
    return F.when(t == "", s).otherwise(t)


def difference(old: Column | str, new: Column | str) -> Column:
    """(common, removed): how many characters both begin with, and what followed them in the old text."""
    o = _col(old)
    return let(common_prefix(o, new), lambda n: F.struct(n.alias("common"), F.substring(o, n + 1, F.length(o)).alias("removed")))


def spelled_pairs(text: Column | str) -> Column:
    """(written, compared) of every word: as it stands and as phrases are compared."""
    raw = F.regexp_extract_all(_col(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    parts = lambda w: F.transform(F.filter(F.split(phrase(w), " "), lambda p: p != ""), lambda p: F.struct(w.alias("written"), p.alias("compared")))
    return F.flatten(F.transform(raw, parts))


def decayed(level: Column, days: Column, a_day: float = 5.0) -> Column:
    """(level, state, size) of something fed: it loses `a_day` a day, never below 0; states by level; size from 0.8 to 1.6."""
    now = F.greatest(F.lit(0), F.bround(level - a_day * days)).cast("int")
    state = lambda n: F.when(n > 70, "full").when(n >= 30, "normal").when(n >= 10, "hungry").otherwise("starved")
    return let(now, lambda n: F.struct(n.alias("level"), state(n).alias("state"), F.round(F.least(F.lit(1.6), 0.8 + 0.8 * n / 100), 2).alias("size")))


def entry_word(german: Column | str) -> Column:
    """A lexicon's German without the marks for prefixes, endings and repeats."""
    return F.translate(_col(german), "|*~", "")


def entry_shown(german: Column, gender: Column, plural: Column, plural_mark: str = "Pl.") -> Column:
    """A noun with its article and plural; words without gender as they are."""
    article = F.when(gender == "m", "der").when(gender == "f", "die").when(gender == "n", "das")
    more = F.when(~plural.isin("", "-"), F.concat(F.lit(f" ({plural_mark} "), plural, F.lit(")"))).otherwise("")
    word = entry_word(german)
    return F.when(article.isNotNull(), F.concat(article, F.lit(" "), word, more)).when(gender == "pl", F.concat(F.lit("die "), word, F.lit(f" ({plural_mark})"))).otherwise(word)


def is_hesitation(words: Column, noises: tuple[str, ...]) -> Column:
    """Recognised words that say nothing: only noises, or one word of at most two letters."""
    return F.forall(words, lambda w: w.isin(*noises)) | ((F.size(words) == 1) & (F.length(F.get(words, F.lit(0))) <= 2))


def is_speakable(sentence: Column, least: int = 4, most: int = 14) -> Column:
    """A sentence fit for reading aloud: of `least` to `most` words, which are letters alone, commas allowed."""
    body = F.regexp_replace(sentence, r"[.!?]+$", "")
    return body.rlike(r"^\p{L}+(?:[ ,]+\p{L}+)*$") & F.size(F.split(F.trim(F.regexp_replace(body, "[ ,]+", " ")), " ")).between(least, most)


def replaced(text: Column, pairs: Column) -> Column:
    """Text with each pair(wrong, right) of an array replaced, one after the other."""
    return F.aggregate(F.coalesce(pairs, F.array().cast("array<struct<wrong string, right string>>")), text, lambda t, p: F.replace(t, p["wrong"], p["right"]))
