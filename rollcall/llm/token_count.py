"""Counting a unigram tokenizer's pieces without making them.

An Aho-Corasick automaton over the vocabulary finds every piece that ends at each position; dynamic
programming carries the best score and the number of pieces. Ties are broken as the tokenizer does:
at each end the piece that starts first wins, and a later one only with a strictly better score. A
character that no piece matches costs the lowest score less UNKNOWN and then counts its UTF-8
bytes as pieces (byte fallback).

The vocabulary is that of a public SentencePiece file. Its scores are merge ranks, so the model's
log-probability of the piece with rank r is -ln(r + 1), rounded to a multiple of 2**-20: sums of
those are exact in double precision, so that the result doesn't depend on where a text is split.
Pieces hold word starts (spaces) only in front, so the best path breaks before every run of spaces;
it also breaks wherever no piece holds the two characters side by side, as between letters and
punctuation or around digits. Each distinct chunk between such breaks is solved once.

Nulls: a null text counts as empty, which has no pieces and score 0. Rows that repeat a doc_id are separate
rows. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

SPACE, UNKNOWN, GRAIN = "▁", 10.0, 1 << 20
_models: dict = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id. Control and byte pieces are there to keep ids; they never match text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    out, rank = [], 0
    for i in range(m.get_piece_size()):
        plain = not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))
        rank += plain
        out.append((m.id_to_piece(i), -round(math.log(rank + 1) * GRAIN) / GRAIN if plain else 0.0))
    return out


def character_classes(pieces: list[str], most: int = 4) -> list[str]:
    """Sets of characters such that no piece holds characters of two sets side by side, the largest
    first; those past `most` are one set. Characters that stand alone in every piece are left out."""
    up: dict[str, str] = {}

    def top(c: str) -> str:
        while up.setdefault(c, c) != c:
            up[c] = c = up[up[c]]
        return c

    for p in pieces:
        word = p.lstrip(SPACE)
        if len(p) > 1 and word:
            for c in word:
                up[top(c)] = top(word[0])
    sets: dict[str, list[str]] = {}
    for c in sorted(up):
        sets.setdefault(top(c), []).append(c)
    found = sorted(("".join(x) for x in sets.values()), key=lambda x: (-len(x), x))
    return found if len(found) <= most else [*found[: most - 1], "".join(found[most - 1 :])]


class Known(dict):
    """Solved chunks as complex(pieces, score), so that one sum adds up both; new ones are solved when asked for."""

    def __init__(self, counter: Counter):
        self.counter = counter

    def __missing__(self, c: str) -> complex:
        self[c] = x = self.counter.old.get(c) or self.counter.chunk(c)
        return x


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], most: int = 200_000):
        import ahocorasick

        self.automaton, self.most, self.known, self.old = ahocorasick.Automaton(), most, Known(self), {}
        plain = [(p, s) for p, s in pieces if s < 0]
        for p, s in plain:
            if SPACE in p.lstrip(SPACE):
                raise ValueError(f"a piece holds a space after other characters: {p!r}")
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        self.alone = frozenset(p for p, _ in plain if len(p) == 1)
        classes = [re.escape(x) for x in character_classes([p for p, _ in plain])]
        words = "|".join(f"{SPACE}*[{x}]+" for x in classes)
        self.chunks = re.compile((words and f"{words}|") + f"{SPACE}+|[^{SPACE}{''.join(classes)}]").findall

    def chunk(self, text: str) -> complex:
        n = len(text)
        best, count = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        if self.alone.issuperset(text):  # every position has a match; at each end the longest comes first
            for end, (length, score) in self.automaton.iter(text):
                end += 1
                x = best[end - length] + score
                if x > best[end]:
                    best[end], count[end] = x, count[end - length] + 1
            return complex(count[n], best[n])
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        for e in range(1, n + 1):
            for length, score in ends[e - 1]:
                x = best[e - length] + score
                if x > best[e]:
                    best[e], count[e] = x, count[e - length] + 1
            if text[e - 1] not in self.alone:
                x = best[e - 1] + self.unknown
                if x > best[e]:
                    best[e], count[e] = x, count[e - 1] + len(text[e - 1].encode("utf-8", "replace"))
        return complex(count[n], best[n])

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if len(self.known) > self.most:  # chunks not met since the last time this happened go
            self.old, self.known = self.known, Known(self)
        total = sum(map(self.known.__getitem__, self.chunks(SPACE + text.replace(" ", SPACE))))
        return int(total.real), total.imag


def counter(path: str) -> Counter:
    if path not in _models:
        _models[path] = Counter(vocabulary(path))
    return _models[path]


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, score (log-probability of the best segmentation) for every row."""

    def go(batches):
        import pyarrow as pa

        c = counter(model)
        for b in slices(batches):
            found = [c.count(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(go, "doc_id long, n_tokens long, score double")
