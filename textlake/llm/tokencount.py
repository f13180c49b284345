"""Token counts of a unigram tokenizer, without building the tokens."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from textlake.llm.shared import SHORT, add_columns

#: Distinct segments whose counts a worker remembers before it starts afresh.
REMEMBER = 200_000
#: The mark that stands for a space in pieces.
SPACE = "▁"
#: How far below the worst piece an unknown character scores.
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    """Counts of the best segmentation over the pieces of a vocabulary, under their scores.

    Spaces become marks and one mark goes in front, as the tokenizer's own normalizer does. Aho-Corasick lists
    every piece that ends at a character; dynamic programming carries (best score, pieces) to that character.
    Ties follow the tokenizer: starts are tried from left to right and only a strictly better score replaces,
    so the longest last piece stays. A character that no single-character piece covers is also a node, scored
    UNKNOWN_PENALTY below the worst piece; it falls back to its UTF-8 bytes, so it counts as that many.
    No piece has a mark after another character, so a text splits before each run of marks without loss.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.matcher, self.single = ahocorasick.Automaton(), set()
        scores = []
        for i in range(model.get_piece_size()):
            if model.IsControl(i) or model.IsUnknown(i) or model.IsByte(i) or model.IsUnused(i):
                continue
            piece, score = model.id_to_piece(i), model.get_score(i)
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} spans a word boundary")
            self.matcher.add_word(piece, (len(piece), score))
            scores.append(score)
            if len(piece) == 1:
                self.single.add(piece)
        self.matcher.make_automaton()
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.split = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.known: dict[str, int] = {}

    def segment(self, text: str) -> int:
        """Pieces of the best path over one segment."""
        size = len(text)
        score, count = [0.0] + [None] * size, [0] * (size + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, found in self.matcher.iter(text):
            ends[end].append(found)
        for end in range(size):
            best, pieces, char = None, 0, text[end]
            if char not in self.single:
                ends[end].append((1, self.unknown))
            for length, own in sorted(ends[end], reverse=True):  # longest first: starts from left to right
                total = score[end + 1 - length] + own
                if best is None or total > best:
                    best, pieces = total, count[end + 1 - length] + 1
                    if length == 1 and char not in self.single:
                        pieces += len(char.encode("utf-8", "surrogatepass")) - 1
            score[end + 1], count[end + 1] = best, pieces
        return count[size]

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for piece in self.split.findall(SPACE + text.replace(" ", SPACE)):
            n = known.get(piece)
            if n is None:
                if len(known) >= REMEMBER:
                    known.clear()
                n = self.segment(piece)
                if len(piece) <= SHORT:
                    known[piece] = n
            total += n
        return total


@lru_cache(maxsize=4)
def counter(path: str) -> UnigramCounter:
    """One counter a worker process and vocabulary."""
    return UnigramCounter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Append n_tokens long: pieces of the best unigram segmentation. Null and empty texts have none.

    Texts are counted whole, whatever their length. A column n_tokens is replaced, others pass; no rows give
    no rows, repeated rows stay.

    path names a sentencepiece model whose pieces and scores are the vocabulary; every executor must be
    able to read it.
    """

    def make(texts: list) -> dict[str, pa.Array]:
        own = counter(path)
        return {"n_tokens": pa.array([own.count(t or "") for t in texts], pa.int64())}

    return add_columns(docs, text, make, "n_tokens long")
