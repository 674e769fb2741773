"""Language-model scoring by a gated recurrent network.

Counting: words of all training documents are counted by a grouped sum; N, V and the add-one base
score come from there. The FREQUENT most frequent words go to the tasks as a dictionary of bounded
size; all other words of a document are joined with the counts by a shuffle. A second pass over the texts
stores every document as symbols of two bytes, and training and scoring read those.

Model: a token's class comes from a softmax over the GRU's state. The WORDS most frequent words and
the end lie in classes of SLOTS words, each with a softmax of its own; every other word lies in one
of ENDINGS classes by a hash of its last three bytes, and within the class has the share of its
count plus one (a word never seen counts 0). The network is trained on all training documents, in rounds: each
task runs truncated backpropagation in numpy on its own documents from the round's weights, and the tasks'
weights are averaged by tokens. A round takes 1/ROUNDS of the documents; tables of fewer than EPOCHS *
TRAIN_TOKENS tokens are gone through again, EPOCHS times at most. Classes' and words' biases start from the
counts of all training documents. The weights, and so the scores, depend on how rows lie in partitions. Scoring fills
lanes with whole documents one after the other; the state is carried across windows and set to zero where a document
starts, so a text of any length is scored whole.

Nulls: a null text counts as empty, which is the end token alone; a null doc_id is not held out. Rows
that repeat a doc_id are separate rows. Without training documents every count is 0. An empty table
gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, keep, slices, small_batches

END = b""  # no word is empty
WORDS, SLOTS, ENDINGS, HIDDEN = 1024, 64, 32, 24
FREQUENT, TRAIN_TOKENS, EPOCHS, ROUNDS = 150_000, 400_000, 3, 4
#: Tokens of documents that a task trains on and scores at a time, lanes of training, and weights in a row of their sums.
HELD, SCORED, LANES, CHUNK = 600_000, 2_500_000, 128, 2048
#: Training goes through longer documents in pieces of so many tokens, side by side; the state starts anew in each.
PIECE = 2048


def ending(word: bytes) -> int:
    """The class of a word's last three bytes."""
    h = 0
    for x in word[:-4:-1]:
        h = h * 257 + x + 1
    return h * 2654435761 % (1 << 32) * ENDINGS >> 32


def endings(words) -> np.ndarray:
    """ending() of the words of an Arrow array; none is empty."""
    if not len(words):
        return np.zeros(0, np.int64)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    h, size = np.zeros(len(words), np.uint64), np.diff(at)
    for i in range(1, 4):
        x = data[np.maximum(at[1:] - i, 0)].astype(np.uint64)
        h = np.where(size >= i, h * np.uint64(257) + x + np.uint64(1), h)
    return (h * np.uint64(2654435761) % np.uint64(1 << 32) * np.uint64(ENDINGS) >> np.uint64(32)).astype(np.int64)


def words_of(column):
    """The lower-cased words of a binary Arrow column, one after the other, and the row of each. Arrow's white space is the contract's."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null(b"").view(pa.string())))
    flat, row = pc.list_flatten(lists).view(pa.binary()), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), row.filter(full).to_numpy()


def count_words(docs: DataFrame, most: int = 4_000_000) -> DataFrame:
    """word (binary), c over all texts, the end of each included. A task hands on what it has counted every `most` words."""

    def go(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def out():
            c = pc.value_counts(pa.chunked_array(held, pa.binary()))
            return pa.RecordBatch.from_arrays([c.field("values"), c.field("counts")], ["word", "c"])

        held, size, ends = [], 0, 0
        for b in slices(batches, 1024):
            held.append(words_of(b.column("text"))[0])
            size += len(held[-1])
            ends += b.num_rows
            if size > most:
                yield out()
                held, size = [], 0
        if size:
            yield out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["word", "c"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(go, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """Frequent words: number by word, and by number the count, the class and the place in the class."""

    def __init__(self, words: list[bytes], counts: list[int], rare_mass: np.ndarray, total: int, distinct: int):
        keep_ = [END, *(w for w in words if w != END)]
        c = dict(zip(words, counts))
        self.words = keep_
        self.count = np.array([c.get(w, 0) for w in keep_], np.int64)
        self.total, self.distinct = total, distinct
        self.known = min(len(keep_), WORDS)
        self.groups = -(-self.known // SLOTS)
        self.classes = self.groups + ENDINGS
        mass = rare_mass.astype(float).copy()  # of all words outside the model's vocabulary: count + 1
        for i in range(1, self.known):
            mass[ending(keep_[i])] -= self.count[i] + 1
        self.log_mass = np.log10(np.maximum(mass, 0) + 1)
        self.log_count = np.log10(self.count + 1.0)
        self.mass = mass

    def symbols(self, n: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Known words' numbers, then one symbol for each class of endings; n: numbers, -1 for words that aren't frequent."""
        return np.where((n >= 0) & (n < self.known), n, self.known + end).astype(np.int16)


class Network:
    """The first two thirds of the gates' inputs are the update and the reset gate, the last is the candidate."""

    def __init__(self, symbols: int, classes: int, groups: int, seed: int = 3):
        r, h = np.random.default_rng(seed), HIDDEN
        normal = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {"E": normal(symbols, 3 * h), "U": normal(h, 3 * h), "b": np.zeros(3 * h, np.float32), "C": normal(h, classes) * 0.1, "c": np.zeros(classes, np.float32), "W": normal(groups, h, SLOTS) * 0.1, "w": np.zeros((groups, SLOTS), np.float32)}
        self.groups = groups

    def bias(self, lexicon: Lexicon) -> None:
        c = np.bincount(np.arange(lexicon.known) // SLOTS, lexicon.count[: lexicon.known] + 1.0, lexicon.classes)
        c[lexicon.groups :] += np.maximum(lexicon.mass, 0) + 1
        self.p["c"][:] = np.log(c / c.sum())
        w = np.full(self.groups * SLOTS, -30.0)
        w[: lexicon.known] = np.log(lexicon.count[: lexicon.known] + 1.0)
        w = w.reshape(self.groups, SLOTS)
        self.p["w"][:] = w - w.max(axis=1, keepdims=True)

    def states(self, x, keep_, h, trace=None):
        """States after each of the steps of x (steps by lanes); keep_ is 0 where a document starts. trace takes, for all
        steps, the state before, gates, candidate and the candidate's part of the state."""
        k = HIDDEN
        half = np.where(np.arange(3 * k) < 2 * k, 0.5, 1.0).astype(self.p["U"].dtype)  # sigmoid(v) = (1 + tanh(v / 2)) / 2
        u_all = self.p["U"] * half
        gates = ((self.p["E"] + self.p["b"]) * half)[x]
        out = np.empty((*x.shape, k), gates.dtype)
        if trace is not None:
            trace += [np.empty((*x.shape, m), gates.dtype) for m in (k, 2 * k, k, k)]
        for t in range(len(x)):
            h = h * keep_[t, :, None]
            u = h @ u_all
            zr = np.add(gates[t, :, : 2 * k], u[:, : 2 * k], out=trace[1][t] if trace else None)
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            n = np.multiply(zr[:, k:], u[:, 2 * k :], out=trace[2][t] if trace else None)
            n += gates[t, :, 2 * k :]
            np.tanh(n, out=n)
            if trace:
                trace[0][t], trace[3][t] = h, u[:, 2 * k :]
            h = np.subtract(h, n, out=out[t])
            h *= zr[:, :k]
            h += n
        return out, h.copy()

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def with_flat(self, v: np.ndarray) -> Network:
        """A network of the same shape with these weights."""
        out, at = object.__new__(Network), 0
        out.groups, out.p = self.groups, {}
        for k in sorted(self.p):
            out.p[k] = v[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size
        return out

    def _by_group(self, cls):
        """Places of the words in classes of words, by class, and where each class ends among them."""
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(self.groups + 1))
        return order[ends[0] : ends[-1]], (ends - ends[0]).tolist()

    def log_p(self, h, cls, slot):
        """ln p(class) + ln p(slot | class), the latter 0 for classes of endings. Logits stay far from what exp() can't take."""
        a = h @ self.p["C"] + self.p["c"]
        out = a[np.arange(len(a)), cls] - np.log(np.exp(a, out=a).sum(axis=1))
        place, ends = self._by_group(cls)
        own, s = h[place], slot[place]
        part = np.empty(len(place), out.dtype)
        for g in range(self.groups):
            i, j = ends[g], ends[g + 1]
            if i < j:
                a = own[i:j] @ self.p["W"][g] + self.p["w"][g]
                part[i:j] = a[np.arange(j - i), s[i:j]] - np.log(np.exp(a, out=a).sum(axis=1))
        out[place] += part
        return out

    def gradient(self, x, keep_, cls, slot, h0, on=None):
        """Loss, gradient and last state; steps that `on` leaves out have no loss."""
        p, k, trace = self.p, HIDDEN, []
        hs, last = self.states(x, keep_, h0, trace)
        flat, c, s = hs.reshape(-1, k), cls.ravel(), slot.ravel()
        g = {}
        at = np.arange(x.size) if on is None else np.flatnonzero(on.ravel())
        if len(at) < x.size:
            flat, c, s = flat[at], c[at], s[at]
        n, rows = max(len(at), 1), np.arange(len(at))
        d = flat @ p["C"]
        d += p["c"]
        loss = -float(d[rows, c].sum(dtype=np.float64))
        np.exp(d, out=d)
        mass = d.sum(axis=1)
        loss += float(np.log(mass).sum(dtype=np.float64))
        d *= (1 / (n * mass))[:, None]
        d[rows, c] -= 1 / n
        g["C"], g["c"], dh = flat.T @ d, d.sum(axis=0), d @ p["C"].T
        g["W"], g["w"] = np.zeros_like(p["W"]), np.zeros_like(p["w"])
        place, ends = self._by_group(c)
        own, s, more = flat[place], s[place], np.empty((len(place), k), flat.dtype)
        for j in range(self.groups):
            a, b = ends[j], ends[j + 1]
            if a < b:
                d = own[a:b] @ p["W"][j]
                d += p["w"][j]
                loss -= float(d[np.arange(b - a), s[a:b]].sum(dtype=np.float64))
                np.exp(d, out=d)
                mass = d.sum(axis=1)
                loss += float(np.log(mass).sum(dtype=np.float64))
                d *= (1 / (n * mass))[:, None]
                d[np.arange(b - a), s[a:b]] -= 1 / n
                g["W"][j], g["w"][j] = own[a:b].T @ d, d.sum(axis=0)
                more[a:b] = d @ p["W"][j].T
        dh[place] += more
        if len(at) < x.size:
            full = np.zeros((x.size, k), dh.dtype)
            full[at] = dh
            dh = full
        dh = dh.reshape(*x.shape, k)
        # what doesn't depend on later steps is found for all steps at once
        before, zr, cand, un = trace
        z, r = zr[..., :k], zr[..., k:]
        to_n, to_z, to_r = (1 - z) * (1 - cand * cand), (before - cand) * z * (1 - z), un * r * (1 - r)
        da, du, carry = np.empty((*x.shape, 3 * k), dh.dtype), np.empty((*x.shape, 3 * k), dh.dtype), np.zeros_like(h0)
        back = p["U"].T
        for t in range(len(x) - 1, -1, -1):
            dt = dh[t]
            dt += carry
            dn = np.multiply(dt, to_n[t], out=da[t, :, 2 * k :])
            np.multiply(dt, to_z[t], out=du[t, :, :k])
            np.multiply(dn, to_r[t], out=du[t, :, k : 2 * k])
            np.multiply(dn, r[t], out=du[t, :, 2 * k :])
            carry = du[t] @ back
            carry += dt * z[t]
            carry *= keep_[t, :, None]
        da[..., : 2 * k] = du[..., : 2 * k]
        g["U"] = before.reshape(-1, k).T @ du.reshape(-1, 3 * k)
        flat = da.reshape(-1, 3 * k)
        g["b"] = flat.sum(axis=0)
        order = np.argsort(x.ravel(), kind="stable")
        ids, start = np.unique(x.ravel()[order], return_index=True)
        g["E"] = np.zeros_like(p["E"])
        g["E"][ids] = np.add.reduceat(flat[order], start, axis=0)
        return loss, g, last

    def train(self, streams, lanes: int = 32, steps: int = 32, epochs: int = EPOCHS, rate: float = 0.01, adam=None) -> None:
        """Truncated backpropagation over windows of `steps`, with Adam. streams: (x, cls, slot) by document.
        The rate falls over the epochs; with adam (from an earlier call, or empty) it stays and the moments go on."""
        x, keep_, cls, slot, doc = lay_out(streams, lanes)
        falls = adam is None
        adam = {} if falls else adam
        if not adam:
            adam |= {"i": 0, "m": {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}}
        total, j = epochs * max(1, -(-len(x) // steps)), 0
        for _ in range(epochs):
            h = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in range(0, len(x), steps):
                live = int((doc[t] >= 0).sum())  # lanes end in the order of their numbers, the last one first
                w = np.s_[t : t + steps, :live]
                on = doc[w] >= 0
                _, g, h = self.gradient(x[w], keep_[w], cls[w], slot[w], h[:live], None if on.all() else on)
                adam["i"] += 1
                j += 1
                i = adam["i"]
                norm = np.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
                lr = np.float32((rate * (1 - 0.9 * j / total) if falls else rate) * np.sqrt(1 - 0.999**i) / (1 - 0.9**i))
                clip = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
                for k, v in g.items():
                    v *= clip
                    a, b = adam["m"][k]
                    a *= 0.9
                    a += 0.1 * v
                    v *= v
                    b *= 0.999
                    b += 0.001 * v
                    np.sqrt(b, out=v)
                    v += 1e-6
                    np.divide(a, v, out=v)
                    v *= lr
                    self.p[k] -= v


def lay_out(streams, lanes: int):
    """Documents, one after the other, in lanes of about equal length, the longest first: x, keep, class, slot, document
    (steps by lanes; class 0 and document -1 where a lane has ended)."""
    lanes = max(1, min(lanes, len(streams)))
    load = [(0, j, []) for j in range(lanes)]
    for i in sorted(range(len(streams)), key=lambda i: (-len(streams[i][0]), i)):
        n, j, own = load[0]
        own.append(i)
        heapq.heapreplace(load, (n + len(streams[i][0]), j, own))
    load.sort(key=lambda y: (-y[0], y[1]))
    length = load[0][0]
    x, cls, slot = (np.zeros((lanes, length), t) for t in (np.int32, np.int16, np.int16))
    doc, keep_ = np.full((lanes, length), -1, np.int32), np.ones((lanes, length), np.float32)
    for j, (n, _, own) in enumerate(load):
        if not n:
            continue
        for to, part in zip((x, cls, slot), range(3)):
            to[j, :n] = np.concatenate([streams[i][part] for i in own])
        size = [len(streams[i][0]) for i in own]
        doc[j, :n] = np.repeat(own, size)
        keep_[j, np.cumsum([0, *size[:-1]])] = 0
    return tuple(np.ascontiguousarray(y.T) for y in (x, keep_, cls, slot, doc))


def score_streams(net: Network, streams, window: int = 64, lanes: int = 256) -> np.ndarray:
    """ln p of each document."""
    out = np.zeros(len(streams) + 1)
    size = [len(s[0]) for s in streams]
    x, keep_, cls, slot, doc = lay_out(streams, int(np.clip(sum(size) // max(1, max(size)), 16, lanes)))
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    for t in range(0, len(x), window):
        live = int((doc[t] >= 0).sum())
        w = np.s_[t : t + window, :live]
        hs, h = net.states(x[w], keep_[w], h[:live])
        d, c, s, hs = doc[w].ravel(), cls[w].ravel(), slot[w].ravel(), hs.reshape(-1, HIDDEN)
        if (d < 0).any():
            on = np.flatnonzero(d >= 0)
            d, c, s, hs = d[on], c[on], s[on], hs[on]
        out += np.bincount(d, net.log_p(hs, c, s), len(out))
    return out[:-1]


def stream(symbols: np.ndarray, known: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A document's input symbols, classes and slots from its stored symbols: known words, then classes of endings."""
    word = symbols < known
    cls = np.where(word, symbols // SLOTS, symbols - known + groups).astype(np.int16)
    x = np.empty(len(symbols), np.int32)
    x[0] = 0
    np.add(symbols[:-1], 1, out=x[1:])
    return x, cls, np.where(word, symbols % SLOTS, 0).astype(np.int16)


def _stored(batch) -> list[np.ndarray]:
    return [np.frombuffer(y, np.int16) for y in batch.column("symbols").to_pylist()]


ENCODED = "rid long, doc_id long, held_out boolean, round int, n_tokens long, known long, base double, inside double, rare array<binary>, symbols binary"


def encode(docs: DataFrame, held_out, shared, parts: int) -> DataFrame:
    """One pass over the texts: what the counts say of each document, its words that aren't frequent, and its symbols (two
    bytes a token), from which training and scoring start. shared: broadcast lexicon; `round` is a hash of the row, below `parts`."""

    def go(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        lex, row = shared.value, TaskContext.get().partitionId() << 36
        frequent = pa.array(lex.words, pa.binary())
        for b in slices(batches, 1024):
            rows = b.num_rows
            flat, doc = words_of(b.column("text"))
            n, end = pc.fill_null(pc.index_in(flat, value_set=frequent), -1).to_numpy(), endings(flat)
            add = lambda v, on: np.bincount(doc[on], v, rows).astype(float)  # noqa: B023, E731
            seen, far, rare = n >= 0, (n < 0) | (n >= lex.known), n < 0
            known = np.bincount(doc, seen & (lex.count[n] > 0), rows).astype(np.int64) + int(lex.count[0] > 0)
            base = add(lex.log_count[n[seen]], seen) + lex.log_count[0]
            # within a class of endings: count + 1 over the class's sum; the counts of words that aren't frequent follow by the join
            inside = add(lex.log_count[n[seen & far]], seen & far) - add(lex.log_mass[end[far]], far)
            size = np.bincount(doc, minlength=rows) + 1
            symbols = np.zeros(size.sum(), np.int16)  # the end is number 0
            symbols[np.arange(len(doc)) + doc] = lex.symbols(n, end)
            ends = np.r_[0, np.cumsum(size)].astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(doc[rare], minlength=rows))].astype(np.int32)), flat.filter(pa.array(rare)))
            packed = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(2 * ends), pa.py_buffer(symbols)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + rows)), b.column("doc_id"), b.column("held_out"), b.column("round"), pa.array(size.astype(np.int64)), pa.array(known), pa.array(base), pa.array(inside), others, packed],
                [f.split()[0] for f in ENCODED.split(", ")])
            row += rows

    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("round")
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), held_out.alias("held_out"), part, F.col("text").cast("binary"))
    return keep(rows.mapInArrow(go, ENCODED), "encoded")


def _train_task(known: int, weights, lanes: int, rate: float):
    """Batches of documents to the weights after training on them, times their tokens: k (chunk), n (tokens), v."""

    def go(batches):
        import pyarrow as pa

        net = weights.value.with_flat(weights.value.flat())  # a worker keeps the broadcast one for its next task
        adam, held, size, seen = {}, [], 0, 0
        for b in slices(batches):
            for symbols in _stored(b):
                whole = stream(symbols, known, net.groups)
                held += [tuple(y[i : i + PIECE] for y in whole) for i in range(0, len(symbols), PIECE)]
                size += len(symbols)
                if size >= HELD:
                    net.train(held, lanes, epochs=1, rate=rate, adam=adam)
                    held, size, seen = [], 0, seen + size
        if held:
            net.train(held, lanes, epochs=1, rate=rate, adam=adam)
            seen += size
        if seen:
            v = net.flat().astype(np.float64) * seen
            parts = [v[i : i + CHUNK].tobytes() for i in range(0, len(v), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["k", "n", "v"])

    return go


def _add_up(batches):
    import pyarrow as pa

    n, v = Counter(), {}
    for b in batches:
        for k, c, x in zip(*(b.column(i).to_pylist() for i in range(3))):
            n[k] += c
            v[k] = v.get(k, 0) + np.frombuffer(x)
    if v:
        yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.int32()), pa.array([n[k] for k in v], pa.int64()), pa.array([x.tobytes() for x in v.values()], pa.binary())], ["k", "n", "v"])


def rounds(total: int) -> tuple[int, int]:
    """Epochs, and rounds of an epoch, for so many training tokens."""
    epochs = int(np.clip(-(-EPOCHS * TRAIN_TOKENS // max(total, 1)), 1, EPOCHS))
    return epochs, max(1, ROUNDS // epochs)


def train_rounds(encoded: DataFrame, net: Network, known: int, total: int) -> tuple[Network, int]:
    """The network after training on the symbols of all rows, and the tokens trained on. `round` of a row: its round in an epoch."""
    epochs, parts = rounds(total)
    seen, schema, sc = 0, "k int, n long, v binary", encoded.sparkSession.sparkContext
    for r in range(epochs * parts):
        weights = sc.broadcast(net)
        rows = encoded.where(F.col("round") == r % parts).select("symbols")
        sums = rows.mapInArrow(_train_task(known, weights, 32 if epochs > 1 else LANES, 0.01 * (1 - 0.9 * r / (epochs * parts))), schema)
        got = sorted(sums.repartition("k").mapInArrow(_add_up, schema).collect())  # as many rows as there are chunks of weights
        if got:
            net = net.with_flat(np.concatenate([np.frombuffer(v) / n for _, n, v in got]))
            seen += got[0].n
        weights.unpersist()
    return net, seen


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    out = F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False))
    counts = keep(count_words(small_batches(docs).select("doc_id", "text").where(~out)), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    # words by order of magnitude (a few rows), to find the least count that FREQUENT words at most reach
    level = F.floor(8 * F.log2("c"))
    least, at = 1 << 62, 0
    for k, n, c in counts.groupBy(level.alias("k")).agg(F.count("*"), F.min("c")).orderBy(F.desc("k")).collect():
        at += n
        if at > FREQUENT:
            break
        least = c
    common = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "word").collect()

    def masses(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        sums = np.zeros(ENDINGS, np.int64)
        for b in batches:
            b = b.filter(pc.greater(pc.binary_length(b.column("word")), 0))
            sums += np.bincount(endings(b.column("word")), b.column("c").to_numpy() + 1, ENDINGS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS)), pa.array(sums)], ["k", "s"])

    mass = np.zeros(ENDINGS, np.int64)
    for k, s in counts.mapInArrow(masses, "k long, s long").groupBy("k").agg(F.sum("s")).collect():
        mass[k] = s
    lexicon = Lexicon([bytes(r.word) for r in common], [r.c for r in common], mass, total, distinct)
    net = Network(1 + lexicon.known + ENDINGS, lexicon.classes, lexicon.groups)
    net.bias(lexicon)
    sc, known = docs.sparkSession.sparkContext, lexicon.known
    rows = encode(docs, out, sc.broadcast(lexicon), rounds(total)[1])  # FREQUENT words at most
    net, _ = train_rounds(rows.where(~F.col("held_out")), net, known, total)
    weights = sc.broadcast(net)
    columns = ["rid", "doc_id", "held_out", "n_tokens", "known", "base"]

    def go(batches):
        import pyarrow as pa

        def done():
            part = score_streams(model, streams) / np.log(10) + np.concatenate([h.column("inside").to_numpy() for h in held_])
            yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([h.column(c) for h in held_]) for c in columns), pa.array(part)], [*columns, "part"])

        model = weights.value
        streams, held_, size = [], [], 0
        for b in slices(batches):
            held_.append(b)
            for symbols in _stored(b):
                streams.append(stream(symbols, known, model.groups))
                size += len(symbols)
            if size >= SCORED:
                yield from done()
                streams, held_, size = [], [], 0
        if streams:
            yield from done()

    scored = rows.select(*columns, "inside", "symbols").mapInArrow(go, "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, part double")
    rare = rows.select("rid", F.explode("rare").alias("word"))
    found = rare.join(counts.where(F.col("c") < least), "word").groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("*").alias("found"))
    # words without a count add log10(0 + 1) = 0
    all_ = scored.join(found, "rid", "left")
    more = F.coalesce("more", F.lit(0.0))
    per = float(np.log10(total + distinct + 1))
    return all_.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * per).alias("base_score"), (F.col("part") + more).alias("score"))
