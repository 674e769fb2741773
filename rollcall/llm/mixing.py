"""Mixing sources to target weights by the cube method.

The sources, by code point and null last, weigh 1, 2, 3, 1, ... and share all words; a target stops
at LIMIT times its source's words and the excess is shared again. Every document of a source has
the same expected number of copies, target / source size: its whole part is certain, the fraction
is an inclusion probability. The flight phase moves the probabilities of a block of documents along
the null space of two constraints (words and documents) until two at most are fractional; those
left of all blocks form new blocks, until a source has one block, whose last two are landed on the
side that leaves the word total nearest; up to four other units of it may change sides for that. Blocks hold about BLOCK documents each, so a large source
is spread over many tasks, and the order within a block is a hash of the row's content, so that reruns agree. Only
where more than a block's rows are equal in id, source and text does the hash take in their number, to spread them.

Nulls: a null text has size 0, a null source is a source. Rows that repeat a doc_id are separate
rows; one of size 0 takes nothing. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_row, drop, join_unique, keep, n_words, numbered

WEIGHTS, LIMIT, BLOCK = (1, 2, 3), 3, 2000


def _source_key(c):
    """Not null, and different for null and for every string."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c))


def targets(sources: DataFrame) -> DataFrame:
    """source_key, n, source_size, target, fraction from (source_key, n, source_size).

    The rank of a source comes from range-partitioned rows and the (few) partitions' row counts; the
    level at which the words are shared comes from sums over all sources, again until no further
    source reaches its limit.
    """
    ranged = keep(sources.withColumn("last", F.col("source_key") == "-").repartitionByRange("last", "source_key").withColumn("part", F.spark_partition_id()), "sources")
    before, at = {}, 0
    for part, n in sorted(ranged.groupBy("part").count().collect()):
        before[part], at = at, at + n
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("part").orderBy("last", "source_key")) - 1
    start = F.coalesce(*[F.when(F.col("part") == p, F.lit(b)) for p, b in before.items()], F.lit(0)) if before else F.lit(0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((rank + start) % len(WEIGHTS) + 1).cast("int"))
    rows = keep(ranged.withColumn("weight", weight), "weights")
    limit = F.col("source_size") * float(LIMIT)
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        capped = F.col("weight") * level >= limit if full >= 0 else F.lit(False)
        held, n, free = rows.agg(F.sum(F.when(capped, limit)), F.count_if(capped), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == full or not free:
            break
        level, full = (total - (held or 0.0)) / free, n
    target = F.least(F.col("weight") * level, limit)
    drop(ranged)
    return rows.select("source_key", "n", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def fly(p: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """Flight phase: probabilities moved, three units at a time, so that sum(p) and sum(p * size) stay.
    Of the two ends of a move one is drawn so that each probability keeps its expected value."""
    draw = iter(np.random.default_rng(seed).random(3 * len(p) + 3).tolist())
    p = p.astype(float).tolist()
    w = size.astype(float).tolist()
    eps = 1e-9
    live = []
    for k in range(len(p)):
        if p[k] <= eps or p[k] >= 1 - eps:
            p[k] = float(round(p[k]))
            continue
        live.append(k)
        if len(live) < 3:
            continue
        i, j, _ = live
        # u with u_i + u_j + u_k = 0 and u_i w_i + u_j w_j + u_k w_k = 0
        u = (w[j] - w[k], w[k] - w[i], w[i] - w[j])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[x]) / v if v > 0 else p[x] / -v for x, v in zip(live, u) if v)
        down = min(p[x] / v if v > 0 else (1 - p[x]) / -v for x, v in zip(live, u) if v)
        step = up if next(draw) * (up + down) < down else -down
        for x, v in zip(live, u):
            p[x] += step * v
            if p[x] <= eps or p[x] >= 1 - eps:
                p[x] = float(round(p[x]))
        live = [x for x in live if 0 < p[x] < 1]
    return np.array(p)


def _block(frame, last: bool):
    f = frame.sort_values(["h", "doc_id", "size", "rid"], kind="stable")
    p, size = f.p.to_numpy(), f["size"].to_numpy()
    out = fly(p, size, int(f.h.iloc[0]) & 0x7FFFFFFF)
    if last:
        open_ = np.flatnonzero((out > 0) & (out < 1))
        want = float((out[open_] * size[open_]).sum())
        choices = [[b >> i & 1 for i in range(len(open_))] for b in range(1 << len(open_))]
        best = min(choices, key=lambda c: (abs(float(np.dot(c, size[open_])) - want), sum(c)))
        out[open_] = best
        # what the landing is off is made up by other units of this block, as long as one unit's change helps
        off = want - float(np.dot(best, size[open_]))
        free = np.flatnonzero((p > 0) & (p < 1) & (size > 0))
        for _ in range(4 if len(free) else 0):
            change = np.where(out[free] > 0.5, -1.0, 1.0) * size[free]
            k = int(np.abs(off - change).argmin())
            if abs(off - change[k]) >= abs(off):
                break
            off -= change[k]
            out[free[k]] = 1 - out[free[k]]
    return f.assign(p=out)


def _mover(columns: list[str], last: bool):
    def go(frame):
        return _block(frame[columns], last)

    return go


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, rid (its number, if docs are numbered)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rid = F.col("__row") if "__row" in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long"), n_words(text).alias("size"), _source_key(F.col("source")).alias("source_key"), F.xxhash64(text).alias("text_hash"), rid.alias("rid"))
    rows = keep(rows.withColumn("h", F.xxhash64(F.lit("mix"), "doc_id", "size", "text_hash")).drop("text_hash"), "sizes")
    goal = keep(targets(rows.groupBy("source_key").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))), "targets")
    total = rows.count()
    many = keep(rows.groupBy("h", "source_key").count().where(F.col("count") > block).select("h", "source_key", F.lit(True).alias("many")), "many")
    if not many.isEmpty():
        rows = rows.join(many, ["h", "source_key"], "left").withColumn("h", F.when(F.col("many"), F.xxhash64("h", "rid")).otherwise(F.col("h"))).drop("many")
    joined = join_unique(rows, goal, "source_key", "n", total)
    joined = joined.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    columns = ["doc_id", "size", "source_key", "rid", "source_size", "target", "whole", "h", "p"]
    done, now, most = [], joined, goal.agg(F.max("n")).first()[0] or 0
    while True:
        blocks = F.ceil(F.col("n") / block)
        schema = "doc_id long, size long, source_key string, rid long, source_size long, target double, whole long, h long, p double"
        last = most <= block
        part = F.pmod(F.xxhash64("h", F.lit(len(done))), blocks).alias("part")
        moved = keep(now.select(*columns, part).groupBy("source_key", "part").applyInPandas(_mover(columns, last), schema), "flight")
        if last:
            done.append(moved)
            break
        done.append(moved.where("p = 0 or p = 1"))
        left = moved.where("p > 0 and p < 1")
        n = keep(left.groupBy("source_key").agg(F.count("*").alias("n")), "left")
        most = n.agg(F.max("n")).first()[0] or 0
        now = join_unique(left, n, "source_key", "n", left.count())
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = (F.col("whole") + F.col("p").cast("long")).alias("copies")
    return out.select("doc_id", "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"), "rid")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The input's rows, each as often as the mix takes that row."""
    rows = numbered(docs)
    taken = keep(mix(rows).where("copies > 0").select(F.col("rid").alias("__row"), F.col("copies").cast("int").alias("__copies")), "taken")
    return by_row(rows, taken).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)
