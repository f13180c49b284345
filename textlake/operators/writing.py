"""Writing text from tokens and from dictated phrases, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How marks are named in speech, in the order they are tried. ¶ is a new paragraph. A single word
# that can also be an ordinary one names the words around it that make it one.
SPOKEN = {
    "ru": [("точка с запятой", ";"), ("с (?:красной|красные|красная) (?:строки|строка)", "¶"), ("вопросительный знак", "?"), ("восклицательный знак", "!"), ("(?:новый|новые|новой) абзац", "¶"), ("(?:красная|красные|красной) (?:строка|строки)", "¶"), ("открыть кавычки", "«"), ("закрыть кавычки", "»"), ("многоточие", "…"), ("двоеточие", ":"), ("запятая", ","), ("точка(?! (?:зрения|опоры|отсчета|кипения|невозврата) )", "."), ("тире", "—")],
    "de": [("anführungszeichen auf", "„"), ("anführungszeichen zu", "“"), ("zitat (?:anfang|anfangen)", "„"), ("zitat ende", "“"), ("(?:neuer|neue|neuen) absatz", "¶"), ("neue zeile", "¶"), ("drei punkte", "…"), ("fragezeichen", "?"), ("ausrufezeichen", "!"), ("doppelpunkt", ":"), ("(?:semikolon|strichpunkt)", ";"), ("(?:komma|(?<! ich )komme)", ","), ("(?<! (?:der|den|dem|ein|einen|einem|kein|keinen|diesem|diesen|dieser|jedem|jeden|zum|im|am) )punkt", "."), ("gedankenstrich", "–")],
}
ENDS = ".!?…"
MARKS = ".,;:!?…"
OPENING = "«„("
CLOSING = "»“)"


def _each(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def _capital(word: Column) -> Column:
    """The first letter in upper case; marks in front stay, and so does a word that starts with a digit."""
    front = F.regexp_extract(word, r"^[^\p{L}\p{N}]*", 0)
    at = F.length(front) + 1
    return F.concat(front, F.upper(F.substring(word, at, F.lit(1))), F.substring(word, at + 1, F.length(word)))


def assemble(tokens: Column | str, capitalize: bool = True) -> Column:
    """A sentence from its tokens, in German typography. Null tokens give null, none an empty text.

    Quotation marks pair up as „ and “; a comma that follows another mark, or an opening one, or comes before a closing one
    goes; spaces stand as the marks want them; the first letter becomes a capital one. Marks count as such only where they are whole tokens.
    """
    text = F.array_join(F.filter(F.col(tokens) if isinstance(tokens, str) else tokens, lambda t: t != ""), " ")
    text = _each(text, ("(?<=^| )(?:“|``)(?= |$)", "„"), ("(?<=^| )(?:”|'')(?= |$)", "“"), ('(?<=^| )"( (?:[^"]* )?)"(?= |$)', "„$1“"), ('(?<=^| )"(?= |$)', "„"))
    text = _each(text, (r"(?<=^| )([,(\[„;:–])(?: ,)+(?= |$)", "$1"), (r"(?<=^| )(?:, )+([.!?)\]“;:])(?= |$)", "$1"), (r"^(?:[,;](?: |$))+", ""))
    text = _each(text, (r" ([,.;:!?)\]}“‘%…'])(?= |$)", "$1"), (r"(?<=^| |[(\[{„‚/])([(\[{„‚/]) ", "$1"))
    text = F.trim(text)
    return _capital(text) if capitalize else text


def spoken_marks(phrase: Column | str, language: str) -> Column:
    """Words that name marks become the marks, each between spaces; a language without names keeps all words."""
    text = F.concat(F.lit(" "), _each(F.trim(F.col(phrase) if isinstance(phrase, str) else phrase), (r"\s+", " ")), F.lit(" "))
    return F.trim(_each(text, *[(f"(?iu)(?<= ){said}(?= )", mark) for said, mark in SPOKEN.get(language, [])]))


def dictated(phrases: DataFrame, language: str, key: str, order: str, text: str = "text") -> DataFrame:
    """phrases(key, order, text) -> (key, text): what was dictated, one row a session.

    A phrase ends with a period unless it names an end itself or plainly goes on; a mark named right after another replaces
    it, so a phrase that starts with a comma takes the period before it back. Sentences start with a capital letter.
    Ties in order are broken by the text; null and empty phrases say nothing. A session's phrases become one text anyway,
    so they are gathered in one row.
    """
    marked = phrases.select(key, order, spoken_marks(F.col(text), language).alias("_said")).filter("_said <> ''")
    open_end = ~F.col("_said").rlike(rf"[{ENDS},;:—–¶{OPENING}]$") & ~F.col("_said").rlike(rf"[{ENDS}] ?[{CLOSING}]$")
    ended = marked.withColumn("_said", F.concat("_said", F.when(open_end, " .").otherwise("")))
    whole = ended.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_said"))), lambda s: s["_said"]), " ").alias("_said"))
    tidy = _each(
        F.col("_said"),
        (rf"([^{ENDS},;:—–¶{OPENING} ]) ¶(?= |$)", "$1 . ¶"),
        (r"(?<=^| )¶(?: ¶)+(?= |$)", "¶"),
        (rf"(?<=^| )(?:[{MARKS}] )+([{MARKS}])(?= |$)", "$1"),
        (rf"(?<=^|¶) ?(?:[{MARKS}](?: |$))+", " "),
        (r"^[ ¶]+", ""),
    )
    words = F.filter(F.split(tidy, " "), lambda w: w != "")
    before = lambda i, n: F.coalesce(F.get("_words", i - n), F.lit(""))
    starts = lambda i: (i == 0) | before(i, 1).rlike(f"^[{ENDS}¶]$") | (before(i, 1).rlike(f"^[{OPENING}]$") & before(i, 2).rlike(f"^[{ENDS}¶:]?$")) | (before(i, 1).rlike(f"^[{CLOSING}]$") & before(i, 2).rlike(f"^[{ENDS}]$"))
    cased = F.transform("_words", lambda w, i: F.when(starts(i), _capital(w)).otherwise(w))
    spaced = _each(F.array_join(cased, " "), (rf" ([{MARKS}{CLOSING}])(?= |$)", "$1"), (rf"(?<=^| )([{OPENING}]) ", "$1"), (" ?¶ ?", "\n\n"))
    return whole.withColumn("_words", words).select(key, F.regexp_replace(spaced, r"^\s+|\s+$", "").alias("text"))
