"""Harmonic packing of tokenised documents into sequences.

A document's ids, with the end id, lie whole in one sequence where they fit. What exceeds the capacity is
cut off as full sequences. The rest has a length in one of the reciprocal-capacity classes: class k holds lengths
from capacity/(k+1) (exclusive) to capacity/k, and its bins take exactly k documents each; the last of the CLASSES
holds all shorter ones. A bin with its k documents has a gap, which is closed by the documents that come
next: whole ones as long as they fit, then the first part of one that is cut. So a sequence costs one cut at most, and only the
sequences that a task leaves open at its end are put together anew, the last one as sequences of powers of two.
No sequence needs padding; each task fills its bins by itself, without a shuffle.

Nulls: a null text counts as empty (one piece, the end id alone). Rows that repeat a doc_id are
separate documents. Texts are read whole. An empty table gives an empty result. Further columns are
ignored.
"""

from __future__ import annotations

import re
from unicodedata import category, normalize
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

CAPACITY, END, CLASSES = 4096, 2, 64
_tokenizers: dict = {}


#: Punctuation that this tokenizer always splits from letters before it.
PUNCTUATION = '.,;:!?%*$&#|"()-'


#: One of some marks between a letter and white space: the tokenizer always parts it from the letter.
MARK = re.compile(r"([.,;:!?])(?<=[A-Za-zÀ-ÖØ-öø-ÿ][.,;:!?])(?=[ \n])")


#: Lower-case words that the tokenizer's normaliser leaves as they are.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


def spaced(text: str) -> str:
    """A text of the same ids with words and the mark behind them apart, and lines too: it has far fewer different chunks.
    Lower case too, as the tokenizer's own, where a text has Latin-1 only, which has no marks to be composed, and nothing like a special token."""
    if "<|" not in text and (text.isascii() or _latin(text)):
        text = text.lower()
    return MARK.sub(r" \1", text).replace("\n", " ")


def _latin(text: str) -> bool:
    try:
        return bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def ends_in_letter(word: str) -> bool:
    """The tokenizer's form of the word ends in a letter too, not in a mark, which would go with the punctuation behind it."""
    return word.isascii() or category(normalize("NFC", word).lower()[-1])[0] == "L"


class Words:
    """ids of a text by a word tokenizer: white space is dropped, and letters never share a token with the punctuation
    behind them. Each space-separated chunk is put together once, from its words and marks, and its ids kept. When
    `most` are held, those not met since the last time that happened go."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer, normalizers

        self.tokenizer, self.plain, self.most, self.known, self.old = Tokenizer.from_file(path), Tokenizer.from_file(path), most, {"": b""}, {}
        self.plain.normalizer = normalizers.Sequence([])
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(max(self.tokenizer.get_vocab_size(), 1), bool)
        self.ends[ends] = True

    def _add(self, chunks: list[str], tokenizer, letters: bool, size: int = 500) -> None:
        """Words of letters are encoded together: each ends with the first id that ends a word."""
        for part in (chunks[i : i + size] for i in range(0, len(chunks), size)):
            if letters:
                ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                at = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
                if len(at) == len(part):
                    data = ids.tobytes()
                    self.known.update(zip(part, [data[a:b] for a, b in zip([0, *at], at)]))
                    continue
            self.known.update(zip(part, [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]))

    def learn(self, chunks: set[str]) -> None:
        new = chunks.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known, self.old, new = {"": b""}, self.known, chunks - {""}
        known, old = self.known, self.old
        made, plain, letters, rest = {}, [], set(), set()
        for c in new:
            if c in old:
                known[c] = old[c]
            elif PLAIN.fullmatch(c):
                plain.append(c)
            elif c.isalpha():
                letters.add(c)
            else:
                parts = made[c] = []
                for line in c.split("\n"):
                    word = line.rstrip(PUNCTUATION)
                    parts += [word, line[len(word) :]] if word.isalpha() and ends_in_letter(word) else [line]
        for p in {p for ps in made.values() for p in ps}.difference(known, new - made.keys()):
            (letters if p.isalpha() else rest).add(p)
        self._add(plain, self.plain, True)
        self._add(list(letters), self.tokenizer, True)
        self._add(list(rest), self.tokenizer, False)
        for c, ps in made.items():
            known[c] = b"".join([known[p] for p in ps])

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids; the text's chunks must have been learned."""
        return self.joined(text.split(" "))

    def joined(self, chunks: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, chunks))


def words(path: str) -> Words:
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _tokenizers[path] = Words(path)
    return _tokenizers[path]


class Bin:
    """A sequence in the making: its pieces (document, start, length) and ids so far."""

    def __init__(self):
        self.pieces, self.used = [], 0

    def put(self, doc, start: int, length: int) -> None:
        self.pieces.append((doc, start, length))
        self.used += length


class Bins:
    """Open bins of one task, one a class, and one that is being closed. place() and rest() give finished ones."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES):
        self.capacity, self.classes, self.open, self.closing = capacity, classes, {}, None

    def place(self, doc, n: int) -> list[Bin]:
        done, at, full = [], 0, self.capacity
        if self.closing and n:
            at = min(full - self.closing.used, n)
            self.closing.put(doc, 0, at)
            if self.closing.used == full:
                done.append(self.closing)
                self.closing = None
        while n - at >= full:
            one = Bin()
            one.put(doc, at, full)
            done.append(one)
            at += full
        if at < n:
            k = min(full // (n - at), self.classes)
            held = self.open.setdefault(k, Bin())
            held.put(doc, at, n - at)
            if len(held.pieces) == k:
                del self.open[k]
                if held.used == full:
                    done.append(held)
                else:  # no other is being closed: this document would have gone there
                    self.closing = held
        return done

    def rest(self) -> list[Bin]:
        """All pieces of the open bins, one after the other, in full sequences and, at last, powers of two."""
        held = [p for b in [*([self.closing] if self.closing else []), *self.open.values()] for p in b.pieces]
        left, done, self.open, self.closing = sum(p[2] for p in held), [], {}, None
        size = self.capacity
        while held:
            while size > left:
                size //= 2
            now = Bin()
            while now.used < size:
                doc, start, length = held[0]
                take = min(length, size - now.used)
                now.put(doc, start, take)
                held[:1] = [(doc, start + take, length - take)] if take < length else []
            left -= size
            done.append(now)
        return done


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the piece's ids (binary, little-endian 32 bits). Sequence ids
    are unique, not consecutive: the task's number in the high bits."""
    last = np.asarray([end], "<u4").tobytes()

    def go(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        bins, sequence = Bins(capacity), TaskContext.get().partitionId() << 36
        vocabulary = words(tokenizer)
        names = [f.split()[0] for f in SCHEMA.split(", ")] + ["ids"] * with_ids
        kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids

        def rows(done):
            nonlocal sequence
            out = []
            for one in done:
                offset = 0
                for (id_, ids), start, length in one.pieces:
                    part = memoryview(ids)[4 * start : 4 * (start + length)]
                    out.append((id_, start, length, crc32(part), len(ids) // 4, sequence, offset, *([bytes(part)] if with_ids else [])))
                    offset += length
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

        for b in slices(batches, 64):  # their chunks are held as strings
            done, got = [], [spaced(t or "").split(" ") for t in b.column("text").to_pylist()]
            vocabulary.learn(set().union(*got))
            for id_, chunks in zip(b.column("doc_id").to_pylist(), got):
                ids = vocabulary.joined(chunks) + last
                done += bins.place((id_, ids), len(ids) // 4)
            if done:
                yield rows(done)
        if done := bins.rest():
            yield rows(done)

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(go, SCHEMA + ", ids binary" * with_ids)
