"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass over the whole texts computes STATISTICS per document. The trees are fitted on at most
`most` labelled rows (a hash picks them when there are more): values are binned at quantiles, and
each level's gradient histograms come from one bincount. The fitted trees are flat arrays; scoring
walks all trees of a batch of documents level by level in numpy.

Nulls: a null text counts as empty and is scored like any other; a null doc_id is not held out and
never matches a label. Null labels are ignored; without labels every score is 0.5. Rows that repeat a
doc_id are separate rows; labels that do count once, with their mean. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, keep, slices, small_batches, texts

STATISTICS = (
    "log_bytes", "log_words", "upper", "lower", "digit", "space", "newline", "not_ascii", "comma_stop", "bang", "hash_percent_star_dollar_amp",
    "bar", "slash_angle", "quote", "other_sign", "byte_entropy", "mean_word", "distinct_words", "top_word", "distinct_pairs", "short_words",
    "once_words", "log_lines", "distinct_lines", "mean_line", "words_per_stop")
THRESHOLD, MOST = 0.3, 40_000
_of = lambda s: np.frombuffer(s, np.uint8)


def statistics(text: bytes) -> list[float]:
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    per = 1.0 / max(n, 1)
    words = text.split()
    c = Counter(words)
    nw = len(words)
    pw = 1.0 / max(nw, 1)
    lines = text.split(b"\n")
    p = hist[hist > 0] * per
    stops = int(hist[_of(b".!?")].sum())
    alnum = np.r_[48:58, 65:91, 97:123]
    named = _of(b" \n\t\r,.;:?!#%*$&|</>\\\"'`")
    short = sum(k for w, k in c.items() if len(w) <= 3)
    return [
        np.log1p(n), np.log1p(nw), hist[65:91].sum() * per, hist[97:123].sum() * per, hist[48:58].sum() * per, hist[32] * per, hist[10] * per,
        hist[128:].sum() * per, hist[_of(b",.;:?")].sum() * per, hist[33] * per, hist[_of(b"#%*$&")].sum() * per, hist[124] * per,
        hist[_of(b"</>\\")].sum() * per, hist[_of(b"\"'`")].sum() * per, (hist[33:127].sum() - hist[alnum].sum() - hist[named[4:]].sum()) * per,
        float(-(p * np.log(p)).sum()) if n else 0.0, sum(len(w) * k for w, k in c.items()) * pw, len(c) * pw, max(c.values(), default=0) * pw,
        len(set(zip(words, words[1:]))) * pw, short * pw, sum(k == 1 for k in c.values()) * pw, np.log1p(len(lines)), len(set(lines)) / len(lines),
        np.log1p(n / len(lines)), np.log1p(nw / (stops + 1))]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of the STATISTICS)."""

    def go(batches):
        import pyarrow as pa

        for b in slices(batches):
            x = np.array([statistics(t) for t in texts(b)], np.float32).reshape(b.num_rows, -1)
            flat = pa.array(x.ravel(), pa.float32())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(STATISTICS)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), rows], ["doc_id", "x"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(go, "doc_id long, x array<float>")


class Trees:
    """Complete binary trees of one depth as arrays [tree, node]; the children of node i are 2i+1 and 2i+2."""

    def __init__(self, prior: float, depth: int):
        self.prior, self.depth, self.feature, self.cut, self.leaf = prior, depth, [], [], []

    def flatten(self) -> Trees:
        n = (1 << self.depth) - 1
        self.feature = np.array(self.feature, np.int32).reshape(-1, n)
        self.cut = np.array(self.cut, np.float32).reshape(-1, n)
        self.leaf = np.array(self.leaf, np.float64).reshape(-1, n + 1)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(x), len(self.feature)), np.int32)
        tree = np.arange(len(self.feature))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
        z = self.prior + self.leaf[tree, at - ((1 << self.depth) - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, smooth: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss. x: rows by statistics; y: 0 or 1."""
    n, d = x.shape
    base = (y.sum() + 0.5) / (n + 1.0) if n else 0.5
    model = Trees(float(np.log(base / (1 - base))), depth)
    if n == 0 or y.min() == y.max():
        return model.flatten()
    cuts = np.quantile(x, np.arange(1, bins) / bins, axis=0).astype(np.float32)
    code = np.stack([np.searchsorted(cuts[:, j], x[:, j], side="left") for j in range(d)], axis=1)  # code > b means x > cuts[b]
    offset = code + np.arange(d) * bins
    z = np.full(n, model.prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros((1 << depth) - 1, np.int32), np.full((1 << depth) - 1, np.inf, np.float32)
        for level in range(depth):
            k = 1 << level
            where = (node[:, None] * (d * bins) + offset).ravel()
            G, H = (np.bincount(where, np.repeat(v, d), k * d * bins).reshape(k, d, bins).cumsum(axis=2) for v in (g, h))
            all_g, all_h = G[:, :1, -1:], H[:, :1, -1:]
            gain = G**2 / (H + smooth) + (all_g - G) ** 2 / (all_h - H + smooth) - all_g**2 / (all_h + smooth)
            gain[(H < 1) | (all_h - H < 1)] = 0
            gain[:, :, -1] = 0
            best = gain.reshape(k, -1).argmax(axis=1)
            f, b = best // bins, best % bins
            ok = gain.reshape(k, -1)[np.arange(k), best] > 1e-6
            feature[k - 1 : 2 * k - 1] = np.where(ok, f, 0)
            cut[k - 1 : 2 * k - 1] = np.where(ok, cuts[np.minimum(b, bins - 2), f], np.inf)
            b = np.where(ok, b, bins)
            node = 2 * node + (code[np.arange(n), f[node]] > b[node])
        size = 1 << depth
        leaf = -rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + smooth)
        z += leaf[node]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
    return model.flatten()


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Learns from labelled rows whose crc32 of the
    doc_id is not a multiple of `folds`; at most about `most` of them."""
    x = keep(document_statistics(docs), "statistics")
    out = F.coalesce(crc_mod(F.col("doc_id"), folds) == 0, F.lit(False))
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("y")).where("y in (0, 1)").groupBy("id").agg(F.avg("y").alias("y"))
    train = x.where(~out).join(marked, F.col("doc_id") == F.col("id")).select("doc_id", "x", "y")
    n = train.count()
    share = 1_000_000 * most // max(n, 1)
    # by id and content, and never more than twice `most`: rows that repeat an id, or are equal, are picked together
    rows = train.where(F.pmod(F.xxhash64("doc_id", "x", F.lit("fit")), F.lit(1_000_000)) < share).sort("doc_id", "y", "x").limit(2 * most).toPandas()
    got = np.array(rows.x.tolist(), np.float32).reshape(len(rows), len(STATISTICS))
    model = fit(got, rows.y.to_numpy(float))

    def go(batches):
        import pyarrow as pa

        for b in slices(batches, 4096):
            v = np.asarray(b.column("x").flatten(), np.float32).reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(v), pa.float64())], ["doc_id", "score"])

    scored = x.mapInArrow(go, "doc_id long, score double")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
