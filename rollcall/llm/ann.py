"""Approximate nearest neighbours (largest inner product) by a hierarchical k-means tree.

The tree is fitted on a sample of at most SAMPLE vectors; every vector is then assigned to a leaf.
A query descends best bin first: a priority queue holds the branches not taken, by the inner
product of query and centre, and gives the order in which leaves are visited. How many leaves are
visited is calibrated: for CALIBRATION queries the exact neighbours are found by brute force, and
visits are widened until the wanted share of them lies in visited leaves. Leaves that lie side by side
are put into groups of bounded size, and larger leaves are cut into several; queries are dealt into blocks, and
each block meets each group on its own. A query is copied once for each group that it visits, with the
leaves it visits there, and one list of k comes back from each, so copies grow with groups and not with leaves.

Scores are sums over components in order, in double precision, so equal vectors have equal scores.
Nulls: vectors that are null, zero, or hold null or non-finite components take no part, nor do
those of another length than the most frequent one or those without a vec_id. Rows that repeat a
vec_id are separate candidates, except that a query never finds its own vec_id; each of them is a query of its own, with a list of its
own under the common query_id. Fewer candidates
than k: all that are found; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, runs

K, LEAF, MAX_LEAVES, SAMPLE, CALIBRATION, RECALL, CHUNK = 20, 512, 4096, 12_000, 96, 0.96, 16_384
#: Groups of leaves, about, where a group may be smaller than CHUNK; copies of queries that go to their groups at a time; tasks that blocks and groups meet in, at most.
GROUPS, SENT, TASKS = 32, 5_000, 512


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part."""
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes[0] if sizes else 0))


class Tree:
    """centres[i] and children[i] (empty: leaf number leaf[i]) by node."""

    def __init__(self, x: np.ndarray, leaves: int, branch: int = 8, seed: int = 7):
        rng, k = np.random.default_rng(seed), min(branch, leaves)
        self.centres, self.children, n = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [[]], 1
        open_ = [(-len(x), 0, np.arange(len(x)))]
        while open_ and n + k - 1 <= leaves:  # split the largest leaf
            _, node, own = heapq.heappop(open_)
            for centre, members in self._split(x[own], k, rng):
                self.centres.append(centre)
                self.children.append([])
                self.children[node].append(len(self.centres) - 1)
                heapq.heappush(open_, (-len(members), len(self.centres) - 1, own[members]))
            n += max(0, len(self.children[node]) - 1)
        self.centres = np.array(self.centres)
        leafs = [i for i, c in enumerate(self.children) if not c]
        self.leaf = {node: k for k, node in enumerate(leafs)}
        self.leaves = len(leafs)

    @staticmethod
    def _split(x, k, rng):
        distinct = np.unique(x, axis=0)
        if len(distinct) < k or k < 2:
            return []
        c = distinct[rng.choice(len(distinct), k, replace=False)]
        for _ in range(8):
            near = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
            c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
        near = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        return [(c[i], np.flatnonzero(near == i)) for i in range(k) if (near == i).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        moving = np.arange(len(x))
        while len(moving):
            nxt = []
            for node in np.unique(at[moving]):
                own = moving[at[moving] == node]
                kids = self.children[node]
                if kids:
                    c = self.centres[kids]
                    at[own] = np.array(kids)[((c**2).sum(axis=1) - 2 * x[own] @ c.T).argmin(axis=1)]
                    nxt.append(own)
            moving = np.concatenate(nxt) if nxt else np.array([], np.int64)
        return np.array([self.leaf[int(a)] for a in at], np.int64)

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order."""
        near = (self.centres @ q).tolist()
        queue, out = [(-near[0], 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for c in self.children[node]:
                    heapq.heappush(queue, (-near[c], c))
            else:
                out.append(self.leaf[node])
        return out


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products, added up component by component."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        out += q[:, j, None] * x[None, :, j]
    return out


def nearest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, seen: np.ndarray | None = None, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, candidate's row, score) of the k best of x for every query, best first, ties to smaller ids,
    without the query's own id. seen: whether a query visits a leaf, and at: the leaf of each candidate, by number there.

    One matrix product finds, for every query, the candidates that rounding could still put among the
    k best; only their scores are then added up component by component, and decide.
    """
    out, d = [], q.shape[1]
    step, some = max(1, 500_000 // max(len(ids), 1)), max(1, 1_000_000 // d)
    with np.errstate(over="ignore", invalid="ignore"):
        longest = np.sqrt((x**2).sum(axis=1).max(initial=0.0))
        for i in range(0, len(q), step):
            own = ids[None, :] == qid[i : i + step, None]
            if seen is not None:
                own |= ~seen[i : i + step, at]
            rough = np.where(own, -np.inf, q[i : i + step] @ x.T)
            if len(ids) > k:
                # twice what the two ways of adding can differ by, on both sides
                slack = 4 * (d + 2) * np.finfo(float).eps * longest * np.sqrt((q[i : i + step] ** 2).sum(axis=1)) + np.finfo(float).tiny * d
                kth = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
                own |= rough < (kth - slack)[:, None]
            r, c = np.nonzero(~own)
            s = [np.cumsum(q[i + r[j : j + some]] * x[c[j : j + some]], axis=1)[:, -1] for j in range(0, len(r), some)]
            s = np.concatenate(s) if s else np.zeros(0)
            order = np.lexsort((ids[c], -s, r))
            r, c, s = r[order], c[order], s[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            best = place < k
            out.append((i + r[best], c[best], s[best]))
    return tuple(np.concatenate(y) for y in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _matrix(column) -> np.ndarray:
    rows = column.tolist()
    return np.concatenate(rows).astype(np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks of queries by a mixed hash of their numbers."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def _grouped(sizes: dict[int, int], leaves: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first group of each leaf, groups that the leaf is dealt over, number of groups): neighbouring leaves share a group of at most so many rows."""
    first, parts, group, held = np.zeros(leaves, np.int64), np.ones(leaves, np.int64), 0, 0
    for leaf in range(leaves):
        size = sizes.get(leaf, 0)
        if held and held + size > most:
            group, held = group + 1, 0
        first[leaf], parts[leaf], held = group, max(1, -(-size // most)), held + size
        if parts[leaf] > 1:
            group, held = group + int(parts[leaf]), 0
    return first, parts, group + 1


def _to_groups(tree: Tree, visits: int, first: np.ndarray, parts: np.ndarray, groups: int, blocks: int):
    """Frames of queries to a row for each query and group that it visits, with the leaves that it visits there; about SENT rows at a time."""

    def sent(f):
        import pandas as pd

        out = []
        for row, q, block, v in zip(f.row, f.vec_id, _block(f.vec_id.to_numpy(), blocks), f.v):
            own = np.array(tree.visits(np.asarray(v), visits), np.int32)
            n = parts[own]
            own, group = np.repeat(own, n), np.repeat(first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            order = np.argsort(group, kind="stable")
            there, cut = np.unique(group[order], return_index=True)
            out += [(block * groups + g, row, q, v, some) for g, some in zip(there, np.split(own[order], cut[1:]))]
        return pd.DataFrame(out, columns=["cell", "row", "query_id", "v", "leaves"])

    def go(frames):
        step = max(1, SENT // groups)
        for f in frames:
            yield from (sent(f.iloc[i : i + step]) for i in range(0, len(f), step))

    return go


def _visited(wanted, leaves: np.ndarray) -> np.ndarray:
    """Whether each query's list of leaves holds each of the sorted leaves."""
    flat, owner = np.concatenate(wanted.tolist()), np.repeat(np.arange(len(wanted)), wanted.str.len())
    place = np.minimum(np.searchsorted(leaves, flat), len(leaves) - 1)
    there = leaves[place] == flat
    out = np.zeros((len(wanted), len(leaves)), bool)
    out[owner[there], place[there]] = True
    return out


def search(vectors: DataFrame, every: int = 20, k: int = K, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every`, the k nearest found. chunk: rows of a
    group of leaves, and about so many queries, that a task holds at most."""
    rows = keep(valid(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    hashed = F.pmod(F.xxhash64("vec_id", F.lit("ann")), F.lit(1_000_000))
    some = rows.where(hashed < 1_000_000 * SAMPLE // max(n, 1)).sort("vec_id", "v").limit(2 * SAMPLE)  # ids that repeat are sampled together
    x = _matrix(some.select("v").toPandas().v)
    leaves = min(MAX_LEAVES, max(1, n // LEAF))
    tree = Tree(x if len(x) else np.zeros((0, 1)), leaves)

    def assign(frames):
        for f in frames:
            yield f.assign(leaf=tree.assign(_matrix(f.v)).astype(np.int32) if len(f) else np.array([], np.int32))

    index = keep(rows.mapInPandas(assign, "vec_id long, v array<double>, row long, leaf int"), "index")
    queries = rows.where(F.col("vec_id") % every == 0)
    visits = _calibrate(tree, index, queries, k, recall)
    first, parts, groups = _grouped(dict(index.groupBy("leaf").count().collect()), tree.leaves, max(1, min(chunk, -(-n // GROUPS))))  # one row a leaf
    blocks = max(1, -(-queries.count() // chunk))

    probes = queries.mapInPandas(_to_groups(tree, visits, first, parts, groups, blocks), "cell int, row long, query_id long, v array<double>, leaves array<int>")
    start, pieces = F.get(F.lit(first.tolist()), F.col("leaf")), F.get(F.lit(parts.tolist()), F.col("leaf"))
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = index.select("*", (start + F.pmod(F.xxhash64("row"), pieces)).alias("group"), block.alias("block")).select("vec_id", "v", "leaf", (F.col("block") * groups + F.col("group")).cast("int").alias("cell"))

    def scan(probe, own):
        import pandas as pd

        if not len(probe) or not len(own):
            return pd.DataFrame(columns=["row", "query_id", "ids", "scores"])
        qid, ids = probe.query_id.to_numpy(), own.vec_id.to_numpy()
        leaves, at = np.unique(own.leaf.to_numpy(), return_inverse=True)
        r, c, s = nearest(_matrix(probe.v), qid, _matrix(own.v), ids, k, _visited(probe.leaves, leaves), at)
        ends = np.searchsorted(r, np.arange(1, len(qid)))
        return pd.DataFrame({"row": probe.row.to_numpy(), "query_id": qid, "ids": np.split(ids[c], ends), "scores": np.split(s, ends)})

    by_cell = [t.repartitionById(min(groups * blocks, TASKS), "cell").groupBy("cell") for t in (probes, dealt)]
    found = by_cell[0].cogroup(by_cell[1]).applyInPandas(scan, "row long, query_id long, ids array<long>, scores array<double>")

    def merge(frames):
        import pandas as pd

        for f in runs(frames, "row"):
            out = []
            for _, part in f.groupby("row", sort=False):
                q = part.query_id.iloc[0]
                ids, s = np.concatenate(part.ids.tolist()), np.concatenate(part.scores.tolist())
                order = np.lexsort((ids, -s))[:k]
                out.append(pd.DataFrame({"query_id": q, "rank": np.arange(1, len(order) + 1, dtype=np.int32), "vec_id": ids[order].astype(np.int64), "score": s[order].astype(float)}))
            yield pd.concat(out)

    return found.repartition("row").sortWithinPartitions("row").mapInPandas(merge, "query_id long, rank int, vec_id long, score double")


def _calibrate(tree: Tree, index: DataFrame, queries: DataFrame, k: int, recall: float) -> int:
    """The number of leaves after whose visit the wanted share of the sampled queries' exact neighbours is seen."""
    n = queries.count()
    hashed = F.pmod(F.xxhash64("vec_id", F.lit("calibrate")), F.lit(1_000_000))
    sample = queries.where(hashed <= 1_000_000 * CALIBRATION // max(n, 1)).sort("vec_id", "v").limit(2 * CALIBRATION).toPandas()
    if not len(sample):
        return tree.leaves
    q, qid = _matrix(sample.v), sample.vec_id.to_numpy()

    def brute(frames):
        import pandas as pd

        best = [(np.array([], np.int64), np.array([], np.int64), np.array([]), np.array([], np.int32))]
        for f in frames:
            for i in range(0, len(f), 8192):
                part = f.iloc[i : i + 8192]
                r, c, s = nearest(q, qid, _matrix(part.v), part.vec_id.to_numpy(), k)
                best.append((r, part.vec_id.to_numpy()[c], s, part.leaf.to_numpy()[c]))
                r, a, s, leaf = (np.concatenate(y) for y in zip(*best))
                order = np.lexsort((a, -s, r))
                order = order[np.arange(len(r)) - np.searchsorted(r[order], r[order]) < k]
                best = [(r[order], a[order], s[order], leaf[order])]
        yield pd.DataFrame(dict(zip(["r", "id", "s", "leaf"], best[0])))

    found = index.mapInPandas(brute, "r int, id long, s double, leaf int").toPandas()
    found = found.sort_values(["r", "s", "id"], ascending=[True, False, True]).groupby("r").head(k)
    need = []
    for r, part in found.groupby("r"):
        place = {leaf: i + 1 for i, leaf in enumerate(tree.visits(q[r], tree.leaves))}
        need += [place[x] for x in part.leaf]
    need = np.sort(need)
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) if len(need) else tree.leaves
