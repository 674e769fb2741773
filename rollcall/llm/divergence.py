"""Divergence of sources by three-dimensional cube partitioning.

Terms are counted by (lang, source), and each language keeps those that at least LEAST of its documents hold. The
sources of a language are dealt into blocks, and so are its terms; a task owns the cell of two blocks of sources and
one of terms. Every count is copied to the cells of its block of sources (with each other block) and its block of
terms, a cell adds up the divergences of its pairs over its terms, and the cells' sums are added along the terms.
Terms that neither of two sources holds all diverge alike: they are counted, not listed. A cell's size is bounded
by GROUPS and TERMS, whatever the number of documents, sources or terms.

All arithmetic is on integers, exact for up to 9e15 terms. A share is p = 1 + floor(10^9 (count + 1) / (N + V)), with N
terms and V different ones.

Nulls in text, lang or source count as ''. Every row is a document, also one that repeats another. A group without
terms has each term 0 times; a language without kept terms has divergences of 0. Sources and terms that tie are ranked
by their UTF-8 bytes. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, keep, slices, small_batches, texts

LEAST, TOP = 3, 200
#: Sources in a block and terms in a block, on average; entries that a task counts before it hands them on.
GROUPS, TERMS, ENTRIES = 64, 2048, 300_000

#: Lower-cases A-Z and makes a space of every other byte below 128 that is no letter.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, tf (occurrences), df (documents that hold it)."""
    rows = small_batches(docs).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast(to).alias(c) for c, to in (("text", "binary"), ("lang", "string"), ("source", "string"))])

    def go(batches):
        import pyarrow as pa

        held: dict = {}

        def out():
            for (lang, source), (tf, df) in held.items():
                names = list(tf)
                columns = [pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()),
                           pa.array(list(tf.values()), pa.int64()), pa.array([df[t] for t in names], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "tf", "df"])
            held.clear()

        for b in slices(batches):
            for text, lang, source in zip(texts(b), b.column("lang").to_pylist(), b.column("source").to_pylist()):
                found = terms(text)
                tf, df = held.setdefault((lang, source), (Counter(), Counter()))
                tf.update(found)
                df.update(set(found))
            if sum(len(tf) for tf, _ in held.values()) > ENTRIES:
                yield from out()
        yield from out()

    counted = rows.mapInArrow(go, "lang string, source string, term string, tf long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def share(count: str, of: str) -> Column:
    """1 + floor(10^9 (count + 1) / of) of two columns."""
    return F.expr(f"1 + (cast({count} + 1 AS DECIMAL(20)) * 1000000000) div ({of})")


def shares(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The same for arrays, where count < of: three steps of three digits each."""
    whole, rest = np.divmod(counts + 1, of)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + digits
    return whole + 1


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has few rows, else joined by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _cell(frame):
    """lang, a, b, value of one cell's pairs: rows without a term are the sources of its blocks."""
    import pandas as pd

    heads = frame[frame.term.isna()]
    rows = frame[frame.term.notna()]
    of, v = (heads.n + heads.v).to_numpy(), int(heads.v.iloc[0])
    block, source = heads.block.to_numpy(), heads.source.to_numpy()
    code, names = pd.factorize(rows.term)
    place = {s: i for i, s in enumerate(source)}
    counts = np.zeros((len(source), len(names)), np.int64)
    counts[rows.source.map(place).to_numpy(np.int64), code] = rows.tf.to_numpy()
    p = shares(counts, np.maximum(of, 1)[:, None])
    none = shares(np.zeros(len(source), np.int64), np.maximum(of, 1))
    i, j = frame.i.iloc[0], frame.j.iloc[0]
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    held, first = len(names), frame.t.iloc[0] == 0
    out = []
    for a in left:
        others = right[right > a] if i == j else right
        square, away = (p[others] - p[a]) ** 2, (none[others] - none[a]) ** 2
        # terms that are in no source of the cell: all but its own, counted once, in the first block of terms
        rest = v - held if first else -held
        for group, item, by, by_none in ((a, others, p[others], none[others]), (others, a, p[a], none[a])):
            value = (square // by).sum(axis=1) + rest * (away // by_none)
            out.append(pd.DataFrame({"a": source[group], "b": source[item], "value": value if v else np.zeros(len(others), np.int64)}))
    found = pd.concat(out) if out else pd.DataFrame({"a": source[:0], "b": source[:0], "value": np.zeros(0, np.int64)})
    found.insert(0, "lang", frame.lang.iloc[0])
    return found


def _pairs(held: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the divergence of every two sources of a language, each way."""
    sized = groups.groupBy("lang").agg(F.ceil(F.count("*") / GROUPS).cast("int").alias("gb"), F.greatest(F.lit(1), F.ceil(F.max("v") / TERMS)).cast("int").alias("tb"))
    of_lang = _small(keep(sized, "cube"))
    block = F.pmod(F.xxhash64("source"), F.col("gb")).cast("int").alias("block")
    other, none = F.explode(F.sequence(F.lit(0), F.col("gb") - 1)).alias("other"), F.lit(None)
    every = F.explode(F.sequence(F.lit(0), F.col("tb") - 1)).alias("t")
    heads = groups.join(of_lang, "lang").select("lang", "source", block, "n", "v", "gb", every).select("*", other)
    heads = heads.select("lang", "source", none.cast("string").alias("term"), none.cast("long").alias("tf"), "n", "v", "block", "other", "t")
    own = F.pmod(F.xxhash64("term"), F.col("tb")).cast("int").alias("t")
    rows = held.join(of_lang, "lang").select("lang", "source", "term", "tf", none.cast("long").alias("n"), none.cast("long").alias("v"), block, other, own)
    cells = heads.unionByName(rows).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    found = cells.groupBy("lang", "i", "j", "t").applyInPandas(_cell, "lang string, a string, b string, value long")
    return found.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: every other source of the language; part `term`: the terms
    that a source has more of than its language, the `top` of them that diverge most."""
    counts = keep(count_terms(docs), "counts")
    kept = keep(counts.groupBy("lang", "term").agg(F.sum("tf").alias("c"), F.sum("df").alias("d")).where(F.col("d") >= least).drop("d"), "kept")
    held = keep(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "tf", "c"), "held")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    n = held.groupBy("lang", "source").agg(F.sum("tf").alias("n"))
    langs = keep(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("c").alias("lang_n")), "languages")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*named).groupBy("lang", "source").agg(F.count("*").alias("documents"))
    groups = groups.join(n, ["lang", "source"], "left").join(_small(langs), "lang", "left").select("lang", "source", zero("n"), zero("v"), zero("lang_n"))
    groups = keep(groups, "groups")

    rows = held.join(_small(groups), ["lang", "source"])
    p, q = share("tf", "n + v"), share("c", "lang_n + v")
    rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    by_term = rows.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    parts = [(_pairs(held.drop("c"), groups), "pair", None), (by_term, "term", top)]
    ranked = [t.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most if most else F.lit(True)).withColumn("part", F.lit(name)) for t, name, most in parts]
    return reduce(DataFrame.unionByName, ranked).select("lang", "source", "part", "item", "value", "rank")
