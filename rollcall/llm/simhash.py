"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints come from one pass over the texts. Equal fingerprints are one node. Bits that tend to
agree are put in the same partition; every partition i gets a threshold t_i, the t_i adding up to
(radius - partitions + 1), so that two fingerprints within the radius differ by t_i bits at most in
some partition i. A dynamic programme picks the thresholds, for every number of partitions, from
the candidate counts that the histograms of the partitions' values predict. Fingerprints are then
dealt out by partition value (all values within t_i), and each bucket is verified on full
fingerprints. A bucket gives a spanning forest of its links, not all pairs: components need no
more. Buckets with more than 1/1000 of all fingerprints are dealt out again by a second pigeonhole
over the other bits; they are fewer than 1000 a partition, so their list is broadcast.

Nulls: a null text counts as empty; a text without words has fingerprint zero. Rows with equal or
null doc_id are separate rows; component_id is the smallest non-null doc_id reachable (null if there
is none). An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_row, drop, join_unique, keep, numbered, row_hash, runs, slices, small_batches, texts

SEED, SHINGLE, RADIUS = 42, 3, 3
ONE = np.uint64(1)


def fingerprint(text: bytes) -> int:
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and exactly the white space of the contract
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _print_batches(batches):
    import pyarrow as pa

    for b in slices(batches):
        h = np.array([fingerprint(t) for t in texts(b)], np.uint64)
        rest = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*map(b.column, rest), pa.array(h.view(np.int64))], [*rest, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); of numbered rows also their number and hash."""
    more = [F.col("__row"), row_hash(docs).alias("h")] if "__row" in docs.columns else []
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), *more, F.col("text").cast("binary"))
    return rows.mapInArrow(_print_batches, "doc_id long, " + "__row long, h long, " * bool(more) + "fp long")


# -- the plan: partitions of bits, thresholds


def _bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and the 64 x 64 counts of bits set together: 4096 sums, whatever the table's size."""

    def gram(frames):
        import pandas as pd

        total, n = np.zeros((64, 64)), 0
        for f in frames:
            bits = np.unpackbits(f.fp.to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for i in range(0, len(bits), 65536):
                total += bits[i : i + 65536].T @ bits[i : i + 65536]
            n += len(bits)
        yield pd.DataFrame({"i": np.arange(4097), "v": np.append(total.ravel(), n)})

    rows = prints.select("fp").mapInPandas(gram, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(4097)
    for i, x in rows:
        v[i] = x
    return int(v[-1]), v[:-1].reshape(64, 64)


def correlated_partitions(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """m groups of 64/m bits: each starts with the lowest bit left and takes the bits that correlate most with it."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    corr = np.abs(cov / np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-9)))
    left, groups = list(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (round(float(corr[b, group].mean()), 6), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & ONE) << np.uint64(i)
    return out


def _neighbourhood(width: int, t: int) -> int:
    return sum(int(np.prod([width - j for j in range(i)]) / np.prod(range(1, i + 1))) for i in range(t + 1))


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds from -1 up, one a partition, adding up to `total`, with the least sum of costs[i][t + 1]."""
    best = {0: (0.0, [])}
    for c in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, ts) in best.items():
            for t in range(-1, len(c) - 1):
                new = (cost + c[t + 1], [*ts, t])
                if s + t not in nxt or new < nxt[s + t]:
                    nxt[s + t] = new
        best = nxt
    return best[total][1]


def _same_value(prints: DataFrame, groups: list[list[int]], n: int, bins: int = 1 << 12) -> list[float]:
    """For each group of bits, the chance that two rows agree on it, from histograms of all rows over
    hashed values; what the hashing adds (1/bins) is taken off again."""

    def histogram(frames):
        import pandas as pd

        h = np.zeros((len(groups), bins), np.int64)
        for f in frames:
            fp = f.fp.to_numpy().view(np.uint64)
            for i, bits in enumerate(groups):
                v = (gather(fp, bits) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
                h[i] += np.bincount(v.astype(np.int64), minlength=bins)
        yield pd.DataFrame({"g": np.repeat(np.arange(len(groups)), bins), "bin": np.tile(np.arange(bins), len(groups)), "c": h.ravel()}).query("c > 0")

    rows = prints.select("fp").mapInPandas(histogram, "g int, bin int, c long").groupBy("g", "bin").agg(F.sum("c").cast("double").alias("c"))
    pairs = dict(rows.groupBy("g").agg(F.sum(F.col("c") * (F.col("c") - 1))).collect())
    seen = [pairs.get(g, 0.0) / max(n * (n - 1.0), 1.0) for g in range(len(groups))]
    return [min(1.0, max((x - 1 / bins) / (1 - 1 / bins), 2.0 ** -len(g))) for x, g in zip(seen, groups)]


def plan(prints: DataFrame, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions that are probed: for each number of partitions the cheapest
    thresholds, and of these plans the cheapest. A row dealt out costs as much as `row` comparisons."""
    row = 8.0
    n, together = _bit_statistics(prints)
    splits = [correlated_partitions(n, together, m) for m in range(2, radius + 2)]
    same = iter(_same_value(prints, [g for groups in splits for g in groups], n))
    options = []
    for groups in splits:
        costs = []
        for bits in groups:
            p = next(same)
            near = [_neighbourhood(len(bits), t) for t in range(radius)]
            costs.append([0.0, *(row * n * k + n * n / 2 * min(1.0, p * k) for k in near)])
        ts = allocate(costs, radius - len(groups) + 1)
        options.append((sum(c[t + 1] for c, t in zip(costs, ts)), [(b, t) for b, t in zip(groups, ts) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


# -- probing and verification


def _forest(fp: np.ndarray, radius: int, least: int = 2048) -> np.ndarray:
    """Links (pairs of places) that connect what links within one bucket of distinct fingerprints connect. Small buckets: a
    spanning forest by breadth-first search over what isn't reached yet. In large ones the bits that vary are dealt into
    radius + 1 groups, of which two fingerprints within the radius share one, and each group's values are solved alone."""
    if len(fp) > least:
        varies = int(np.bitwise_or.reduce(fp) ^ np.bitwise_and.reduce(fp))
        bits, edges = [b for b in range(64) if varies >> b & 1], []
        for g in range(radius + 1):
            value = gather(fp, bits[g :: radius + 1])
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(order)]):
                if b - a > 1:
                    edges.append(order[a:b][_search(fp[order[a:b]], radius)])
        return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
    return _search(fp, radius)


def _search(fp: np.ndarray, radius: int) -> np.ndarray:
    edges, rest = [], np.arange(len(fp))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]) <= radius
            if near.any():
                got = rest[near]
                edges.append(np.column_stack([np.full(len(got), at), got]))
                queue += list(got)
                rest = rest[~near]
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def _verify(radius: int):
    def go(frames):
        import pandas as pd

        for f in runs(frames, "key"):
            key, fp, probe = f.key.to_numpy(), f.fp.to_numpy().view(np.uint64), f.own.to_numpy()
            a, b = [], []
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            small = np.repeat(sizes <= 16, sizes)
            for lag in range(1, min(16, int(sizes.max(initial=0)))):
                hit = np.flatnonzero(small[lag:] & (key[lag:] == key[:-lag]) & (probe[lag:] | probe[:-lag]) & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= radius))
                a.append(fp[hit])
                b.append(fp[hit + lag])
            for s, k in zip(starts[sizes > 16], sizes[sizes > 16]):
                edges = _forest(fp[s : s + k], radius)
                a.append(fp[s : s + k][edges[:, 0]])
                b.append(fp[s : s + k][edges[:, 1]])
            if a:
                a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).query("a != b").drop_duplicates()

    return go


def _gathered(bits: list[int]):
    """The given bits of fp, side by side; runs of neighbouring bits move together."""
    out, i = F.lit(0).cast("long"), 0
    while i < len(bits):
        j = i
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        mask = (1 << (j - i + 1)) - 1
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", bits[i]).bitwiseAND(F.lit(mask)), i))
        i = j + 1
    return out


def _flips(width: int, t: int) -> list[int]:
    from itertools import combinations

    return [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)]


def links(prints: DataFrame, radius: int = RADIUS, parts: int = 1000) -> DataFrame:
    """a < b: links between distinct fingerprints that connect whatever the radius connects. prints: distinct fp."""
    n = prints.count()
    found = None
    probed = plan(prints, radius)
    for i, (bits, t) in enumerate(probed):
        value = _gathered(bits)
        rows = prints.withColumn("value", value)
        hot = F.broadcast(rows.groupBy("value").count().where(F.col("count") * parts > max(n, parts * 64)).select("value"))
        flips = F.array(*[F.lit(x).cast("long") for x in _flips(len(bits), t)])
        dealt = rows.select("fp", "value", F.explode(flips).alias("flip")).select(
            "fp", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), (F.col("flip") == 0).alias("own"))
        cold = dealt.join(hot, "value", "left_anti").withColumn("sub", F.lit(-1)).withColumn("subvalue", F.lit(0).cast("long"))
        # within a hot bucket, the other bits may differ by `radius` bits: radius + 1 further partitions, one of which agrees
        others = [b for b in range(64) if b not in bits]
        subs = F.array(*[
            F.struct(F.lit(s).alias("sub"), _gathered(others[s :: radius + 1]).alias("subvalue")) for s in range(radius + 1)])
        warm = dealt.join(hot, "value").select("fp", "value", "own", F.inline(subs))
        both = cold.select("fp", "value", "own", "sub", "subvalue").unionByName(warm)
        both = both.select(F.xxhash64(F.lit(i), "value", "sub", "subvalue").alias("key"), "fp", "own")
        found = both if found is None else found.unionByName(both)
    # a collision of keys only adds comparisons
    dealt = found.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInPandas(_verify(radius), "a long, b long")


#: Above so many edges, the nodes of a giant component are joined by a broadcast instead of a shuffle by node.
EDGES = 1_000_000


def _join(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    return left.join(right, key) if total <= EDGES else join_unique(left, right, key, count, total)


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of edges(a < b): alternating large and
    small stars; each round is written to the shared folder."""
    now = keep(edges.select("a", "b").distinct(), "edges")
    while True:
        total = 2 * now.count()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = _join(both, least, "a", "n", total).where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = _join(large, least, "b", "n", total).select("m", F.explode(F.array("a", "b")).alias("b"))
        new = keep(small.where("m < b").select(F.col("m").alias("a"), "b").distinct(), "edges")
        same = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first() == now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        drop(now)
        now = new
        if same:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _labelled(rows: DataFrame, radius: int) -> DataFrame:
    """fp, n (rows that have it), root (of its component), component_id."""
    nodes = keep(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    label = keep(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "roots")
    least = label.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    return keep(_join(label, least, "root", "nodes", label.count()).select("fp", "n", "root", "component_id"), "labels")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    rows = keep(fingerprints(docs), "prints")
    found = join_unique(rows, _labelled(rows, radius), "fp", "n", rows.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that with the smallest doc_id (null last), of equal ones the
    smallest hash of the whole row, then the first. Rows that repeat a doc_id with other text are rows of their own."""
    rows = numbered(docs)
    prints = keep(fingerprints(rows), "prints")
    found = join_unique(prints, _labelled(prints, RADIUS), "fp", "n", prints.count())
    first = found.groupBy("root").agg(F.min_by("__row", F.struct(F.col("doc_id").isNull(), "doc_id", "h", "__row")).alias("__row"))
    gone = keep(prints.select("__row").join(first.select("__row"), "__row", "left_anti"), "gone")
    return by_row(rows, gone, "left_anti").select(docs.columns)
