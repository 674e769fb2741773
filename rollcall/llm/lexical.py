"""Ranked lexical search by a scan of the documents with an Aho-Corasick automaton; documents have no index.

The terms of all items make one automaton. Each is guarded by a space on either side, and in a text every byte that
belongs to no term counts as a space, so only whole terms match. A task builds the automaton from the broadcast terms and runs
it over its texts: that gives each document's number of terms and how often it holds which of the items' terms, kept as two
short arrays. The documents that hold a term are then counted over these, which gives the weights; a second pass over them
scores: a block of documents times the matrix of how often each item holds a term. Each task hands on the best of its
documents for each item, and they are merged in two steps.

Scores are integers, exact: sums below 2^53 are made by products of doubles, which hold them exactly, larger ones by products of
64-bit integers. Items are dealt into blocks of about ITEMS items and CHARS characters, so what is broadcast stays small
however many there are; each block scans the documents anew.

Nulls: a null text has no terms, and neither has an item without text; such items, or those that no document shares a
term with, have no rows. Documents are rows: those that repeat a doc_id stay apart, those without one come last among
equal scores. Rows of the same item_id (null too) are one item with the terms of all its different texts. An empty table gives an empty
result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, slices, small_batches, texts

K = 20
#: Items and characters of a block, about; numbers in a block's matrix of documents; groups of tasks that merge first.
ITEMS, CHARS, CELLS, MERGE = 256, 1 << 20, 1 << 20, 64
#: Doubles hold whole numbers exactly below this.
EXACT = 2**53

#: Lower-cases A-Z and makes a space of every other byte below 128 that is neither letter nor digit.
SIGNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(SIGNS).split()


class Items:
    """The items of a block: their ids, their terms, and how often each holds a term."""

    def __init__(self, rows: list[tuple[int | None, list[str]]]):
        self.ids = [i for i, _ in rows]
        held = [Counter(t for x in sorted(set(own)) for t in terms(x.encode())) for _, own in rows]
        self.terms = sorted(set().union(*held)) if held else []
        place = {t: i for i, t in enumerate(self.terms)}
        self.times = [{place[t]: n for t, n in own.items()} for own in held]

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            found.add_word(f" {t.decode()} ", i)
        found.make_automaton()
        return found

    def matrix(self) -> np.ndarray:
        m = np.zeros((len(self.terms), len(self.ids)), np.int64)
        for j, own in enumerate(self.times):
            m[list(own), j] = list(own.values())
        return m


def _blocks(items: DataFrame):
    """Items, a block at a time; a block is collected only when it is asked for."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = items.select(F.col("item_id").cast("long"), text.alias("text")).distinct().groupBy("item_id").agg(F.collect_list("text").alias("texts"))
    rows = keep(rows, "items")
    n, chars = rows.agg(F.count("*"), F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda s, x: s + F.length(x)))).first()
    blocks = max(1, -(-n // ITEMS), -(-(chars or 0) // CHARS))
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        yield Items(sorted(((r.item_id, r.texts) for r in own), key=lambda r: (r[0] is None, r[0] or 0)))


def scan(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (terms of the document), term (places in items.terms) and tf of those it holds; documents without terms are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def go(batches):
        import pyarrow as pa

        find, place = shared.value.automaton(), itemgetter(1)
        for b in slices(batches):
            rows, n, ends, term, tf = [], [], [0], [], []
            for k, text in enumerate(texts(b)):
                norm = text.translate(SIGNS)
                words = len(norm.split())
                if not words:
                    continue
                held = Counter(map(place, find.iter(f" {norm.decode()} "))) if len(find) else {}
                rows.append(k)
                n.append(words)
                term += held.keys()
                tf += held.values()
                ends.append(len(term))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, to)) for x, to in ((term, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(go, "doc_id long, n long, term array<int>, tf array<long>")


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each element of a column of lists."""
    ends = column.offsets.to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(ends)), column.flatten().to_numpy(zero_copy_only=False)


def totals(hits: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N and L, and the documents that hold each of `size` terms."""

    def go(batches):
        import pyarrow as pa

        df, documents, words = np.zeros(size, np.int64), 0, 0
        for b in batches:
            df += np.bincount(_flat(b.column("term"))[1], minlength=size)
            documents += b.num_rows
            words += int(np.sum(b.column("n").to_numpy()))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]), pa.int64()), pa.array(np.append(df[at], [documents, words]), pa.int64())], ["term", "c"])

    sums = {r.term: r.c for r in hits.select("n", "term").mapInArrow(go, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).collect()}  # a row a term at most
    df = np.zeros(size, np.int64)
    for t, c in sums.items():
        if t >= 0:
            df[t] = c
    return sums.get(-1, 0), sums.get(-2, 0), df


def _lengths(n: np.ndarray, N: int, L: int) -> np.ndarray:
    """m = 75 + (25 n N) div L."""
    if int(n.max(initial=0)) * 25 * N < 2**63:
        return 75 + n * 25 * N // L
    return np.array([75 + int(x) * 25 * N // L for x in n], np.int64)


def _best(hits: DataFrame, items: Items, N: int, L: int, df: np.ndarray, k: int) -> DataFrame:
    """item (its place), doc_id, score: the k best of each task for each item."""
    w = np.array([math.floor(1000 * math.log((2 * N + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    shared = hits.sparkSession.sparkContext.broadcast((items, w))
    step, exact = max(1, CELLS // max(len(items.terms), 1)), EXACT

    def go(batches):
        import pyarrow as pa

        items, w = shared.value
        times = items.matrix()
        small = int((times * w[:, None]).sum(axis=0).max(initial=0)) * 1_000_000 < exact
        times = times.astype(np.float64) if small else times
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))]
        least = np.zeros(len(items.ids), np.int64)  # the k-th best score so far
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                row, term = _flat(part.column("term"))
                _, tf = _flat(part.column("tf"))
                m = _lengths(part.column("n").to_numpy(), N, L)[row]
                held = np.zeros((part.num_rows, len(items.terms)), times.dtype)
                held[row, term] = w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
                score = (held @ times).astype(np.int64)
                r, c = np.nonzero((score >= least) & (score > 0))
                ids = part.column("doc_id")
                none = np.asarray(ids.is_null())[r]
                best.append((c, ids.fill_null(0).to_numpy()[r], none, score[r, c]))
                if sum(len(x[0]) for x in best) > 4 * k * max(len(items.ids), 250):
                    best = [_first(best, k)]
                    at, count = np.unique(best[0][0], return_counts=True)
                    last = np.cumsum(count) - 1
                    least[at] = np.where(count == k, best[0][3][last], 0)
        c, ids, none, score = _first(best, k)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(ids, pa.int64(), mask=none), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return hits.mapInArrow(go, "item long, doc_id long, score long")


def _first(parts, k: int):
    """The k best of each item, best first, ties to the smaller doc_id, those without one last."""
    c, ids, none, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, none, -score, c))
    c, ids, none, score = c[order], ids[order], none[order], score[order]
    top = np.arange(len(c)) - np.searchsorted(c, c) < k
    return c[top], ids[top], none[top], score[top]


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents that score highest for each item, if above 0."""
    spark, found = docs.sparkSession, None
    for block in _blocks(items):
        hits = keep(scan(docs, block), "hits")
        N, L, df = totals(hits, len(block.terms))
        ranked = _ranked(_best(hits, block, N, L, df, k).withColumn("part", F.spark_partition_id() % MERGE), k)
        ids = _ids(spark, block)
        part = ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return found


def _ranked(best: DataFrame, k: int) -> DataFrame:
    """Merged by groups of tasks first, so that no task gets a row from each task."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _ids(spark: SparkSession, block: Items) -> DataFrame:
    return spark.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
