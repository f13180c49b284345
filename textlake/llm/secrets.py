"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds what they miss."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.shared import SHORT, add_columns

# The kinds of base spans, in this order; pattern, group that is measured, its least length.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Cheap necessary conditions of the first pattern.
WORDS = (b"passw", b"secret", b"token", b"api")

TOKEN = re.compile(r"\n|[\w+/.\-]+|[=:]+|[^\w\s+/.\-=:]+")
SECRET_WORD = re.compile(r"(?:password|passwd|pwd|passphrase|secret|token|api_?key|credentials?|auth|authorization|bearer|key)$", re.I | re.A)
#: Names that stand before a secret in altered training lines; no base pattern knows them.
NAMES = ("pwd", "auth", "credential", "bearer", "passphrase", "access_key", "client_key", "Authorization", "db_auth", "signing-key", "DB_PWD", "login", "psk")
#: Names that stand before what is no secret, however mixed it looks.
PLAIN_NAMES = ("id", "conn", "host", "path", "file", "class", "url", "build", "version", "image", "isbn", "ref", "order", "request-id", "commit", "user", "name", "table", "date", "See", "in", "from", "by")
#: Alphabets that values are rewritten in, so that no base pattern is what makes a secret.
ALPHABETS = ("0123456789ABCDEF", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-", string.ascii_letters + string.digits + "!$%&*#@")
BEGIN, INSIDE, OUT = 0, 1, 2
#: Distinct tokens whose classes a worker remembers before it starts afresh.
REMEMBER = 200_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place in KINDS) of the fixed patterns, by start, then kind."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"akia" in low:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


# Token classes: a mixed-radix number of shape, length, digits, variety, word kind and build.
SHAPES, LENGTHS, DIGITS, VARIETY, WORD_KINDS, BUILDS = 9, 8, 4, 4, 5, 7
CLASSES = SHAPES * LENGTHS * DIGITS * VARIETY * WORD_KINDS * BUILDS
PARTS = (SHAPES, LENGTHS, DIGITS, VARIETY, WORD_KINDS, BUILDS)
#: Runs that a name is built of: a word with or without a capital, capitals, digits.
RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DATED = re.compile(r"(?:19|20)\d\d[-_.]?(?:0[1-9]|1[0-2])[-_.]?(?:0[1-9]|[12]\d|3[01])")
CONTEXTS = 10
FILES = 16


def token_build(token: str) -> int:
    """What a token is built like: 1 a UUID, 2 a date or what holds one, 3 digits in groups, 4 a file, path or address of
    words, 5 words put together, 6 a path of mixed parts; 0 anything else, what is short or not ASCII too."""
    if len(token) < 8 or not token.isascii():
        return 0
    if token.isalpha() and token[1:].islower():  # most words, and the cheapest to tell
        return 5
    if len(token) == 36 and UUID.fullmatch(token):
        return 1
    if DATED.search(token):
        return 2
    if token[0].isdigit() and set(token) <= set("0123456789.-/+"):
        return 3
    runs = RUN.findall(token[:200])
    letters = [r for r in runs if not r[0].isdigit()]
    wordy = sum(len(r) for r in letters if len(r) >= 4) >= 0.6 * len(token[:200])
    parts = re.split(r"[/.]", token)
    if len(parts) > 1 and "+" not in token:
        return 4 if wordy else 6 if any(p.isalpha() and len(p) >= 2 for p in parts) else 0
    return 5 if wordy else 0


def token_class(token: str) -> int:
    """The class of a token by its own letters."""
    size = len(token)
    if token == "\n":
        shape = 8
    elif not token[0].isalnum() and not any(map(str.isalnum, token)):
        shape = 7
    elif token.isdigit():
        shape = 0
    elif not token.isascii():
        shape = 6
    elif token.isalpha():
        shape = 1 if token.islower() else 2 if token.isupper() else 3
    elif token.isalnum():
        shape = 4 if token == token.lower() or token == token.upper() else 5
    else:
        shape = 5
    length = next(i for i, top in enumerate((3, 7, 11, 15, 19, 31, 47, 1 << 62)) if size <= top)
    digits = 0.0 if shape in (1, 2, 3) else sum(map(str.isdigit, token)) / size
    digit = 0 if not digits else 1 if digits < 0.2 else 2 if digits < 0.7 else 3
    kinds = len(set(token))
    variety = min(3, kinds // 5)
    word = 1 if SECRET_WORD.search(token) else 2 if token.startswith("AKIA") else 3 if set(token) <= set("=:") else 4 if token[0] in "\"'" else 0
    out = 0
    for radix, part in zip(PARTS, (shape, length, digit, variety, word, token_build(token)), strict=True):
        out = out * radix + part
    return out


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every class: its parts as feature ids, and the context it is to its neighbours."""
    ids = np.arange(CLASSES)
    parts, at = [], 0
    rest, found = ids.copy(), []
    for radix in reversed(PARTS):
        found.append(rest % radix)
        rest //= radix
    found.reverse()
    for radix, part in zip(PARTS, found, strict=True):
        parts.append(part + at)
        at += radix
    shape, length, digit, _, word, build = found
    parts.append(at + (shape * LENGTHS + length))
    at += SHAPES * LENGTHS
    parts.append(at + (shape * DIGITS + digit) * WORD_KINDS + word)
    at += SHAPES * DIGITS * WORD_KINDS
    parts.append(at + (build * SHAPES + shape) * LENGTHS + length)
    for k in (0, 1, 2, 3, len(PARTS), len(PARTS) + 1):  # of a token with a build, that and its shape and length say it all
        parts[k] = np.where(build > 0, OWN - 1, parts[k])
    context = np.select([shape == 8, word == 1, word == 3, word == 4, shape == 7, shape == 0, (length >= 3) & (digit > 0), shape == 6], [1, 2, 3, 4, 5, 6, 7, 8], 9)
    return np.stack(parts, 1), context


OWN = sum(PARTS) + SHAPES * LENGTHS + SHAPES * DIGITS * WORD_KINDS + BUILDS * SHAPES * LENGTHS + 1
SLOTS = OWN + 3 * CONTEXTS + FILES


def file_class(text: str) -> int:
    """File features: how many digits and how many symbols a text has, in four steps each."""
    size = max(1, len(text))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    digits = np.count_nonzero((data >= 48) & (data <= 57)) / size
    symbols = np.count_nonzero((data > 32) & (data < 48) | (data > 57) & (data < 65) | (data > 90) & (data < 97) | (data > 122) & (data < 127)) / size
    step = lambda x: 0 if x < 0.01 else 1 if x < 0.04 else 2 if x < 0.12 else 3
    return step(digits) * 4 + step(symbols)


@dataclass(frozen=True)
class Model:
    """emit[slot, tag] and move[tag, tag] of the field; slots are features."""

    emit: np.ndarray
    move: np.ndarray


def viterbi(e: np.ndarray, move: np.ndarray) -> list[int]:
    """Best tags of one chain; ties prefer the lower tag number; INSIDE never opens a chain or follows OUT."""
    legal = move.copy()
    legal[OUT, INSIDE] = -1e9
    score = e[0].tolist()
    score[INSIDE] -= 1e9
    rows, back = legal.T.tolist(), []
    for now in e[1:].tolist():
        best = [max(range(3), key=lambda p, m=m: (score[p] + m[p], -p)) for m in rows]
        score = [score[p] + rows[t][p] + now[t] for t, p in enumerate(best)]
        back.append(best)
    tag = max(range(3), key=lambda t: (score[t], -t))
    out = [tag]
    for best in reversed(back):
        tag = best[tag]
        out.append(tag)
    return out[::-1]


def altered(line: str, start: int, end: int, rng: np.random.Generator) -> tuple[str, int, int]:
    """The line with the secret at start:end rewritten in another alphabet under another name or none; where it is then."""
    letters = ALPHABETS[rng.integers(len(ALPHABETS))]
    head = re.sub(r"""[\w.-]*["']?\s*[:=]?\s*["']?$""", "", line[:start], count=1)
    kind = rng.integers(4)
    value = "".join(letters[i] for i in rng.integers(len(letters), size=int(rng.integers(8 if kind else 16, 44))))  # short ones need a name
    name = NAMES[rng.integers(len(NAMES))] + ("=", ": ", " = ", ' = "', "='", ":")[rng.integers(6)] if kind else ""
    return head + name + value + line[end:], len(head + name), len(head + name + value)


def plain_value(line: str, start: int, end: int, rng: np.random.Generator) -> str:
    """The line with an everyday word of its own in place of the secret: a name alone makes none."""
    words = [w for w in re.findall(r"[^\W\d_]+", line[:start] + " " + line[end:])] or ["nothing"]
    return line[:start] + words[rng.integers(len(words))] + line[end:]


def harmless_line(line: str, start: int, end: int, words: list[str], rng: np.random.Generator) -> str:
    """The line with something harmless in place of the secret and of its name; nothing that a fixed pattern finds."""
    head = re.sub(r"""[\w.-]*["']?\s*[:=]?\s*["']?$""", "", line[:start], count=1)
    name = PLAIN_NAMES[rng.integers(len(PLAIN_NAMES))] + ("=", ": ", " = ", " ", " ", ":")[rng.integers(6)] if rng.integers(4) else ""
    made = head + name + harmless(words, rng) + line[end:]
    return made if not base_spans(made) else head + line[end:]


def harmless(words: list[str], rng: np.random.Generator) -> str:
    """What looks mixed and is no secret: an identifier, number, date, file, class, phone number or address, of given words."""
    word = lambda: words[rng.integers(len(words))] if words else "item"
    drawn = lambda letters, n: "".join(letters[i] for i in rng.integers(len(letters), size=n))
    hexes, mixed, digits = "0123456789abcdef", string.ascii_lowercase + string.digits, string.digits
    kind = rng.integers(14)
    if kind == 0:
        u = "-".join(drawn(hexes, n) for n in (8, 4, 4, 4, 12))
        return u.upper() if rng.random() < 0.3 else u
    if kind == 1:
        return drawn(digits, int(rng.integers(9, 17)))
    if kind == 2:
        return "-".join(drawn(digits, int(rng.integers(1, 6))) for _ in range(int(rng.integers(3, 6))))
    if kind == 11:
        return f"+{rng.integers(1, 99)} ({drawn(digits, 3)}) {drawn(digits, 3)}-{drawn(digits, 4)}"
    if kind == 12:
        return f"{word().lower()}.{word().lower()}{rng.integers(100)}@{word().lower()}.com"
    if kind in (3, 4, 13):
        date = f"{rng.integers(1970, 2035)}{rng.integers(1, 13):02d}{rng.integers(1, 29):02d}"
        return f"{word()[:4].upper()}{('', '_', '-')[rng.integers(3)]}{date}{('T' + drawn(digits, 6), '_' + drawn(digits, 4), '')[rng.integers(3)]}" + ("", "Z", ".jpg", ".log")[rng.integers(4)]
    if kind in (5, 6):
        return "".join(word().capitalize() for _ in range(int(rng.integers(2, 6)))) + ("", "", str(rng.integers(100)))[rng.integers(3)]
    if kind == 7:
        return ("_", "-")[rng.integers(2)].join(word().lower() for _ in range(int(rng.integers(2, 5)))) + (".txt", ".tar.gz", "", f"_v{rng.integers(9)}.{rng.integers(20)}")[rng.integers(4)]
    host = f"{word().lower()}.{('com', 'org', 'net', 'de', 'io')[rng.integers(5)]}"
    tail = ("/".join(word().lower() for _ in range(int(rng.integers(1, 4)))), drawn(mixed, int(rng.integers(8, 26))), f"{word().lower()}/{drawn(mixed, int(rng.integers(8, 20)))}")[rng.integers(3)]
    return ("https://", "http://", "www.", "")[rng.integers(4)] + f"{host}/{tail}"


def training_lines(text: str, rng: np.random.Generator, clean: float = 0.25, altered_times: int = 4, around: int = 200) -> list[tuple[np.ndarray, np.ndarray]]:
    """(classes, tags) of lines to learn from.

    The fixed patterns tag the values in a line. Each value is also learned `altered_times` over, rewritten so that no
    fixed pattern finds it, and as what is no secret once replaced by a plain word, and once less than that by something
    harmless(), under a name of its own or none: build and context decide, not the patterns. `clean` is the share of
    lines without a secret that are kept. Of a line, up to `around` characters on either side of the value are learned.
    """
    out = []

    def add(line: str, values: list[tuple[int, int]]) -> None:
        tokens = list(TOKEN.finditer(line))
        tags = np.full(len(tokens), OUT)
        for start, end in values:
            inside = [i for i, m in enumerate(tokens) if m.start() < end and m.end() > start]
            tags[inside] = INSIDE
            tags[inside[:1]] = BEGIN
        if tokens:
            out.append((np.array([token_class(m.group()) for m in tokens], np.int64), tags))

    at = 0
    found = [(ASSIGN.match(text, s).start(2) if kind == 0 else s, e) for s, e, kind in base_spans(text)]
    for line in text.split("\n"):
        values = sorted({(s - at, e - at) for s, e in found if at <= s and e <= at + len(line)})
        values = [v for i, v in enumerate(values) if not i or v[0] >= values[i - 1][1]]
        for s, e in values:
            lo = max(0, s - around)
            lo = line.find(" ", lo, s) + 1 or s if lo else 0  # cut at a space
            part = line[lo : e + around]
            inside = [(a - lo, b - lo) for a, b in values if a >= lo and b <= e + around]
            add(part, inside)
            if len(inside) == 1:
                for _ in range(altered_times):
                    other, a, b = altered(part, *inside[0], rng)
                    add(other, [(a, b)])
                add(plain_value(part, *inside[0], rng), [])
                words = re.findall(r"[^\W\d_]{3,12}", text[max(0, at - 2_000) : at + 2_000])
                for _ in range(altered_times - 1):
                    add(harmless_line(part, *inside[0], words, rng), [])
        if not values and rng.random() < clean:
            add(line[: 10 * around], [])
        at += len(line) + 1
    return out


def train(texts: list[str], epochs: int = 12, rate: float = 0.3, seed: int = 3, plain: list[str] = (), **options) -> Model:
    """Fit by stochastic gradient ascent on the log-likelihood of the tags of training_lines(). plain: texts without secrets
    beyond what the fixed patterns find; all lines of those without such count."""
    rng = np.random.default_rng(seed)
    parts, context = _tables()
    lines = [(classes, tags, file) for text in texts for file in (file_class(text),) for classes, tags in training_lines(text, rng, **options)]
    lines += [(classes, tags, file) for text in plain if not base_spans(text) for file in (file_class(text),) for classes, tags in training_lines(text, rng, clean=1.0)]
    emit, move = np.zeros((SLOTS, 3)), np.zeros((3, 3))
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(len(lines)):
            line, gold, file = lines[i]
            n = len(line)
            e = _emit(emit, parts, context, line, file)
            top, legal = e.max(), np.exp(move)
            legal[OUT, INSIDE] = 0
            x = np.exp(e - top)
            alpha, beta = np.zeros((n, 3)), np.ones((n, 3))
            alpha[0] = x[0] * [1, 0, 1]
            alpha[0] /= alpha[0].sum()
            for t in range(1, n):
                alpha[t] = alpha[t - 1] @ legal * x[t]
                alpha[t] /= alpha[t].sum()
            for t in range(n - 2, -1, -1):
                beta[t] = legal @ (x[t + 1] * beta[t + 1])
                beta[t] /= beta[t].sum()
            p = alpha * beta
            p /= p.sum(1, keepdims=True)
            wrong = -p
            wrong[np.arange(n), gold] += 1
            if np.abs(wrong).max() < 0.01:
                continue
            pair = alpha[:-1, :, None] * legal[None] * (x[1:] * beta[1:])[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            seen = np.zeros((3, 3))
            np.add.at(seen, (gold[:-1], gold[1:]), 1)
            scale = step / np.sqrt(n)
            move += scale * (seen - pair.sum(0))
            for k in range(parts.shape[1]):
                np.add.at(emit, parts[line, k], scale * wrong)
            c = np.concatenate([[0, 0], context[line], [0]])
            for slot, where in ((0, c[1:-2]), (1, c[:-3]), (2, c[3:])):
                np.add.at(emit, OWN + slot * CONTEXTS + where, scale * wrong)
            emit[OWN + 3 * CONTEXTS + file] += scale * wrong.sum(0)
    return Model(emit, move)


def _emit(emit: np.ndarray, parts: np.ndarray, context: np.ndarray, line: np.ndarray, file: int) -> np.ndarray:
    c = np.concatenate([[0, 0], context[line], [0]])
    e = emit[parts[line]].sum(1) + emit[OWN + c[1:-2]] + emit[OWN + CONTEXTS + c[:-3]] + emit[OWN + 2 * CONTEXTS + c[3:]]
    return e + emit[OWN + 3 * CONTEXTS + file]


class Tagger(dict):
    """token -> class, and the tables of one model."""

    def __init__(self, model: Model):
        self.model = model
        parts, self.context = _tables()
        own = model.emit[parts].sum(1)
        self.own = [own[:, tag] - own[:, OUT] for tag in (BEGIN, INSIDE)]
        # Against OUT throughout, tagged tokens in a row gain the lead of each and of their moves: into the first, on to each
        # further one, and out. With the way out counted to the first and every other move to the token it leads to, the
        # row gains nothing if no token does. Nothing leads into the first token of a line.
        move = model.move - model.move[OUT, OUT]
        out = max(0.0, float(move[:2, OUT].max()))
        on = float(move[:2, BEGIN].max())
        self.moves = max(float(move[OUT, BEGIN]) + out, on), float(move[:2, INSIDE].max())
        self.first = max(out, on)
        self.newline = token_class("\n")
        lead = lambda at, n: [model.emit[at : at + n, tag] - model.emit[at : at + n, OUT] for tag in (BEGIN, INSIDE)]
        self.around = [lead(OWN + k * CONTEXTS, CONTEXTS) for k in range(3)]
        self.files = lead(OWN + 3 * CONTEXTS, FILES)

    def __missing__(self, token: str) -> int:
        found = token_class(token)
        if len(token) <= SHORT:
            self[token] = found
        return found

    def leads(self, classes: np.ndarray, file: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every token, the most that it adds to a tagging's gain over OUT as BEGIN, and as INSIDE; contexts stop at line
        ends, as in decoding."""
        ends = classes == self.newline
        c = np.concatenate([[0, 0], np.where(ends, 0, self.context[classes]), [0]])
        after = np.concatenate([[False], ends[:-1]])
        second = np.where(after, 0, c[:-3])
        begin, inside = (self.own[k][classes] + self.around[0][k][c[1:-2]] + self.around[1][k][second] + self.around[2][k][c[3:]] + self.files[k][file] for k in (0, 1))
        into = np.where(after, self.first, self.moves[0])
        into[:1] = self.first
        return begin + into, inside + self.moves[1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of every run BEGIN INSIDE* in the best tags of each line."""
        if len(self) > REMEMBER:
            self.clear()
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        classes = np.fromiter(map(self.__getitem__, tokens), np.int32, count=len(tokens))
        file = file_class(text)
        begin, inside = self.leads(classes, file)
        maybe = np.flatnonzero((np.maximum(begin, inside) >= -1e-9) & (classes != self.newline))
        if not len(maybe):
            return []
        ends = np.append(np.flatnonzero(classes == self.newline), len(classes))
        matches, out = None, []
        for line in np.unique(np.searchsorted(ends, maybe)):
            a, b = (ends[line - 1] + 1 if line else 0), ends[line]
            row = top = -1e9  # the most that tagged tokens in a row gain, up to a token and anywhere
            for x, y in zip(begin[a:b].tolist(), inside[a:b].tolist(), strict=True):
                row = max(x, row + y, x + row)
                top = max(top, row)
            if top < -1e-9:
                continue
            matches = matches or list(TOKEN.finditer(text))
            tags = viterbi(_emit(self.model.emit, _tables()[0], self.context, classes[a:b], file), self.model.move)
            start = None
            for i, tag in enumerate([*tags, OUT]):
                if start is not None and tag != INSIDE:
                    out.append((matches[a + start].start(), matches[a + i - 1].end()))
                    start = None
                if tag == BEGIN:
                    start = i
        return out


def find(text: str, tagger: Tagger) -> tuple[list, list]:
    """(base spans, all spans): the field's spans are added where they don't touch a base span."""
    base = base_spans(text)
    extra, i, reached = [], 0, -1
    for start, end in tagger.spans(text):  # by start, as the base spans are
        while i < len(base) and base[i][0] <= start:
            reached = max(reached, base[i][1])
            i += 1
        if reached <= start and (i == len(base) or base[i][0] >= end):
            extra.append((start, end, 3))
    return base, sorted([*base, *extra], key=lambda s: (s[0], s[2]))


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = 2_000, longest: int = 20_000, plain: DataFrame | None = None) -> Model:
    """A model from a bounded sample: the `most` documents of smallest key hash with at most `longest` characters.

    It learns from training_lines() of them, and from up to `most` texts of plain(text), such as addresses of pages, that
    hold no secrets: those of smallest hash. All texts are scanned, whatever their length. No rows give a model that tags
    nothing.
    """
    harmless_texts = []
    if plain is not None:
        short = plain.filter(F.length("text").between(1, 1_000)).select("text").distinct()
        harmless_texts = sorted(r["text"] for r in short.orderBy(F.xxhash64("text"), "text").limit(most).collect())
    rows = docs.filter(F.length(text) <= longest).select(F.col(text).alias("text"), F.xxhash64(key).alias("_hash"), F.xxhash64(text).alias("_text"))
    picked = rows.select("_hash", "_text").distinct().orderBy("_hash", "_text").limit(most)  # hashes first: texts of the picked alone travel
    found = rows.join(F.broadcast(picked), ["_hash", "_text"]).dropDuplicates(["_hash", "_text"]).collect()
    return train([r["text"] for r in sorted(found, key=lambda r: (r["_hash"], r["_text"]))], plain=harmless_texts)


_taggers: dict[str, Tagger] = {}


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append n_assign, n_access, n_hex, base_spans, spans (kind:start:end by start, then kind, comma-joined) and redacted.

    redacted is the text with every span replaced by its kind in angle brackets; overlapping spans become
    one. Null texts count as empty; their redacted text stays null. Offsets are code points, ends exclusive.
    Texts are scanned whole. Columns of those names are replaced, others pass; no rows give no rows, repeated
    rows get equal answers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mark = xxhash.xxh64_hexdigest(model.emit.tobytes() + model.move.tobytes())
    show = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)

    def make(texts: list) -> dict[str, pa.Array]:
        if mark not in _taggers:
            _taggers.clear()
            _taggers[mark] = Tagger(shared.value)
        found = [find(t or "", _taggers[mark]) for t in texts]
        out = {f"n_{kind}": pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k, kind in enumerate(KINDS[:3])}
        out["base_spans"] = pa.array([show(base) for base, _ in found])
        out["spans"] = pa.array([show(spans) for _, spans in found])
        out["redacted"] = pa.array([t if t is None or not spans else redact(t, spans) for t, (_, spans) in zip(texts, found, strict=True)], pa.string())
        return out

    return add_columns(docs, text, make, "n_assign long, n_access long, n_hex long, base_spans string, spans string, redacted string")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with the union of spans replaced; an overlap takes its first span's kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], f"<{KINDS[kind]}>"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])
