"""Identification over template vectors.

Scores are inner products in double precision, or whatever a customer's own matcher gives (X1): `matcher` is a function of two numpy
matrices (probes by components, templates by components) to the matrix of scores; `score_fn` is a function of two array columns to a
Column, or a pandas_udf of two series of vectors to doubles, or of two data frames with a column a component (what Spark makes of structs), which it
tells from the hint of the first argument and which it may not write into. A null or NaN score is no candidate. Ranks and thresholds
look at the raw score; the output is rounded to `digits`. Vectors that are null, empty, or hold null or
non-finite components take no part; vectors of different lengths never meet.

Vectors are compared block against block, one matrix product each, and only the best k of each block go
on, so no pair is ever a row. Up to PROBES probes (counted first) are sent to all tasks and the gallery
is scanned where it lies, or dealt out evenly if that makes more than PAIRS pairs; more probes, and the gallery, are dealt out in blocks of
bounded size, a task for each pair of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import get_type_hints

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

DIGITS = 4
#: Probes that are sent to all tasks at most, templates in a block, and scores that are held at a time.
PROBES, TEMPLATES, SCORES = 10_000, 16_384, 4_000_000
#: Pairs that a task scores, about, where the gallery is dealt out for shared probes, and pairs of blocks at least where both are.
PAIRS, TASKS = 16_000_000, 32
#: Buckets of J2 hold about so many templates, and no fewer planes are used than this.
BUCKET, LEAST_PLANES = 4096, 6
PRIME = 1_000_003

#: Templates in an array that a score expression goes through, and components that are columns of their own there at most.
ARRAY, WIDE = 256, 100
#: Arrays whose k-th score for a probe is found before all others are gone through, step by step.
FIRST = (1, 16)

#: Copies of rows that go to their buckets at a time.
SENT = 5_000

Matcher = Callable[[np.ndarray, np.ndarray], np.ndarray]
Expression = Callable[[Column, Column], Column]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def valid(df: DataFrame) -> DataFrame:
    v = F.col("vector")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.withColumn("vector", v.cast("array<double>")).where(F.coalesce(fine, F.lit(False)))


def _by_length(vectors) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length: (rows, matrix)."""
    size = np.array([len(v) for v in vectors], np.int64)
    return {int(d): (at, np.stack([np.asarray(vectors[i], np.float64) for i in at])) for d in np.unique(size) for at in [np.flatnonzero(size == d)]}


def best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, matcher: Matcher | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of the k best for each row of q, best first, ties to the smaller id.

    Without a matcher one product finds what rounding could still put among the best, and only those
    are added up component by component, so that equal vectors have equal scores wherever they lie."""
    out, step = [], max(1, SCORES // max(len(x), 1))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        s = part @ x.T if matcher is None else _scored(matcher, part, x)
        slack = 0.0
        if matcher is None:
            slack = 8 * (q.shape[1] + 2) * np.finfo(float).eps * np.sqrt((part**2).sum(axis=1) * (x**2).sum(axis=1).max(initial=0.0))[:, None]
        kth = np.partition(s, len(x) - k, axis=1)[:, len(x) - k, None] if len(x) > k else np.full((len(part), 1), -np.inf)
        r, c = np.nonzero((s >= kth - slack) & (s > -np.inf))
        v = _added(part, x, r, c) if matcher is None else s[r, c]
        out.append(_first(i + r, c, v, ids[c], k))
    return tuple(np.concatenate(y) for y in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _scored(matcher: Matcher, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    s = np.asarray(matcher(q, x), np.float64)
    return np.where(np.isnan(s), -np.inf, s)


def _added(q, x, r, c, some: int = 20_000) -> np.ndarray:
    parts = [np.cumsum(q[r[j : j + some]] * x[c[j : j + some]], axis=1)[:, -1] for j in range(0, len(r), some)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _first(r, c, s, ids, k):
    order = np.lexsort((ids, -s, r))
    r, c, s = r[order], c[order], s[order]
    top = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[top], c[top], s[top]


FOUND = "probe_id long, template_id long, subject_id long, score double"


def _frame(probe_id, template_id, subject_id, score):
    import pandas as pd

    return pd.DataFrame({"probe_id": probe_id, "template_id": template_id, "subject_id": subject_id, "score": score})


def _match(probe, own, k: int, matcher: Matcher | None):
    """The k best of the frame `own` for every row of the frame `probe`."""
    import pandas as pd

    held, templates = [], _by_length(own.vector.to_numpy())
    for d, (at, q) in _by_length(probe.vector.to_numpy()).items():
        if d in templates:
            rows, x = templates[d]
            ids = own.template_id.to_numpy()[rows]
            r, c, s = best_of(q, x, ids, k, matcher)
            held.append(_frame(probe.probe_id.to_numpy()[at[r]], ids[c], own.subject_id.to_numpy()[rows[c]], s))
    return pd.concat(held) if held else _frame(*[np.zeros(0, np.int64)] * 3, np.zeros(0))


def _scan(shared, k: int, matcher: Matcher | None):
    """Batches of a gallery to the k best for each shared probe, over all batches of the task."""

    def go(frames):
        probes, best = shared.value, {}
        for f in frames:
            for d, (rows, x) in _by_length(f.vector.to_numpy()).items():
                if d not in probes:
                    continue
                _, q = probes[d]
                r, c, s = best_of(q, x, f.template_id.to_numpy()[rows], k, matcher)
                new = (r, f.template_id.to_numpy()[rows[c]], f.subject_id.to_numpy(np.float64, na_value=np.nan)[rows[c]], s)
                r, ids, subject, s = (np.concatenate(y) for y in zip(best[d], new)) if d in best else new
                r, c, s = _first(r, np.arange(len(r)), s, ids, k)
                best[d] = r, ids[c], subject[c], s
        for d, (r, ids, subject, s) in best.items():
            out = _frame(probes[d][0][r], ids, subject, s)
            yield out.assign(subject_id=out.subject_id.astype("Int64"))

    return go


def _own_score(score_fn, matcher: Matcher | None) -> tuple[Expression | None, Matcher | None]:
    """A pandas_udf of two series, or of two data frames, becomes a matcher, one probe at a time; everything else is an expression."""
    if score_fn is None or matcher is not None:
        return None, matcher
    if not hasattr(score_fn, "evalType"):
        return score_fn, None
    if score_fn.evalType != PythonEvalType.SQL_SCALAR_PANDAS_UDF:
        raise ValueError("score_fn is to be a pandas_udf of two series or data frames to a series")
    series = score_fn.func
    if _takes_frames(series):
        return None, _framed(series)

    def scored(q, x):
        import pandas as pd

        templates = pd.Series(list(x))
        return np.array([np.asarray(series(pd.Series([one] * len(x)), templates), np.float64) for one in q]).reshape(len(q), len(x))

    return None, scored


def _takes_frames(function) -> bool:
    import pandas as pd

    try:
        return next(iter(get_type_hints(function).values()), None) is pd.DataFrame
    except (NameError, TypeError):  # hints that can't be read, as in pandas_udf itself
        return False


def _framed(function) -> Matcher:
    """A function of two frames as a matcher: frames are views of the matrices, the probe's of its one row."""

    def scored(q, x):
        import pandas as pd

        x = x.view()
        x.flags.writeable = False
        templates = pd.DataFrame(x)
        return np.array([np.asarray(function(pd.DataFrame(np.broadcast_to(one, x.shape)), templates), np.float64) for one in q]).reshape(len(q), len(x))

    return scored


def product(size: int) -> Expression:
    """dot() for vectors of `size` components as a Column that Spark compiles, for score_fn; with lambdas, as in dot(), a pair takes far longer."""

    def score(a: Column, b: Column) -> Column:
        s = F.lit(0.0)
        for i in range(size):
            s = s + F.get(a, F.lit(i)) * F.get(b, F.lit(i))
        return s

    return score


def _spread(d: int, name: str) -> list[Column]:
    """The components of a vector of length d as columns that are never null, which compiled code reads best; of a long one the array."""
    return [F.coalesce(F.get("vector", F.lit(i)), F.lit(0.0)).alias(f"{name}{i}") for i in range(d)] if d <= WIDE else [F.col("vector").alias(f"{name}0")]


def _vector(d: int, name: str) -> Column:
    return F.array(*[F.col(f"{name}{i}") for i in range(d)]) if d <= WIDE else F.col(f"{name}0")


def _arrays(g: DataFrame, d: int, *key: str, parts: int = 1, tasks: int = 1) -> DataFrame:
    """The templates of length d in arrays of about ARRAY, by key; without a key in so many arrays, which are dealt out evenly to the tasks."""
    g = g.where(F.size("vector") == d)
    h = F.xxhash64("template_id", F.lit("array"))
    if key:
        sized = g.join(g.groupBy(*key).agg(F.count("*").alias("n")), list(key)).withColumn("part", F.pmod(h, F.greatest(F.lit(1), F.ceil(F.col("n") / ARRAY))))
    else:
        sized = g.withColumn("part", F.pmod(h, F.lit(parts)).cast("int")).repartitionById(tasks, "part")
    return sized.groupBy(*key, "part").agg(F.collect_list(F.struct("template_id", "subject_id", *_spread(d, "g"))).alias("templates"))


def _scores(rows: DataFrame, d: int, score: Expression, least: Column) -> DataFrame:
    """Scores of each row's probe, the struct p, with each template of its array. A pair is a row only between two steps of one task: those below `least` go no further.

    The loop over an array is compiled by the JVM if its method is short and has few arguments: so the probe is one struct, and the score is
    evaluated once, as Spark moves no filter below a select with the task's number."""
    s = F.nanvl(score(_vector(d, "p.p"), _vector(d, "g")).cast("double"), F.lit(None).cast("double"))
    pairs = rows.select(*[c for c in rows.columns if c != "templates"], F.inline("templates"))
    scored = pairs.select("probe_id", "template_id", "subject_id", s.alias("score"), least.alias("least"), F.spark_partition_id().alias("task"))
    return scored.where((F.col("score") >= F.col("least")) & (F.col("task") >= 0)).select("probe_id", "template_id", "subject_id", "score")


def _by_expression(p: DataFrame, g: DataFrame, k: int, score: Expression, *key: str) -> DataFrame:
    """The k best for each probe, and others that may be as good. Without a key up to 10 * PROBES probes are sent to all tasks, more are dealt out
    by blocks, and the k-th score of each probe in a few arrays, which is found first, keeps nearly all pairs from going on."""
    out, conf, lowest = None, p.sparkSession.conf, F.lit(float("-inf"))
    # Spark compiles no step with more fields than this, and a pair has two vectors
    conf.set("spark.sql.codegen.maxFields", max(int(conf.get("spark.sql.codegen.maxFields")), 2 * WIDE + 20))
    for d in sorted(r[0] for r in p.select(F.size("vector")).distinct().collect()):
        q = p.where(F.size("vector") == d).select("probe_id", *key, F.struct(*_spread(d, "p")).alias("p"))
        if key:
            found = _scores(q.join(_arrays(g, d, *key), list(key)), d, score, lowest)
        else:
            n_q, n_g = q.count(), g.where(F.size("vector") == d).count()
            parts, n = max(1, -(-n_g // ARRAY)), -(-n_q // (10 * PROBES))
            arrays, q = _arrays(g, d, parts=parts, tasks=min(parts, max(TASKS, -(-n_q * n_g // PAIRS)))), q.withColumn("least", lowest)
            for few in FIRST:
                if few > 1 and few >= parts:
                    break
                some = _scores(q.crossJoin(F.broadcast(arrays.where(F.col("part") < few))), d, score, F.col("least"))
                known = some.groupBy("probe_id").agg(F.get(F.sort_array(F.collect_list("score"), False), F.lit(k - 1)).alias("known"))
                q = q.join(known, "probe_id", "left").select("probe_id", "p", F.coalesce("known", "least").alias("least"))
            if n <= 1:
                rows = arrays.crossJoin(F.broadcast(q))
            else:
                rows = q.withColumn("pb", F.pmod(F.xxhash64("probe_id"), F.lit(n))).join(arrays.withColumn("pb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))), "pb")
            found = _scores(rows, d, score, F.col("least"))
        out = found if out is None else out.unionByName(found)
    return p.sparkSession.createDataFrame([], FOUND) if out is None else out


def _best(probes: DataFrame, gallery: DataFrame, k: int, matcher: Matcher | None, score_fn=None) -> DataFrame:
    """probe_id, template_id, subject_id, score, rank of the k best templates of each probe."""
    score, matcher = _own_score(score_fn, matcher)
    p = valid(probes.select(F.col("probe_id").cast("long"), "vector"))
    kind = gallery.schema["subject_id"].dataType
    g = valid(gallery.select(F.col("template_id").cast("long"), F.col("subject_id").cast("long"), "vector"))
    if score:
        return _top(_by_expression(p, g, k, score), k).withColumn("subject_id", F.col("subject_id").cast(kind))
    few = p.limit(PROBES + 1).toPandas()
    if len(few) <= PROBES:
        ids = few.probe_id.to_numpy()
        shared = p.sparkSession.sparkContext.broadcast({d: (ids[at], q) for d, (at, q) in _by_length(few.vector.to_numpy()).items()})
        if (tasks := -(-len(few) * g.count() // PAIRS)) > 1:
            g = g.repartition(tasks, "template_id")
        found = g.mapInPandas(_scan(shared, k, matcher), FOUND)
    else:
        n_p, n_g = (max(1, -(-t.count() // size)) for t, size in ((p, PROBES), (g, TEMPLATES)))
        n_g = max(n_g, TASKS // n_p)
        p = p.withColumn("pb", F.pmod(F.xxhash64("probe_id"), F.lit(n_p)).cast("int")).withColumn("gb", F.explode(F.sequence(F.lit(0), F.lit(n_g - 1))))
        g = g.withColumn("gb", F.pmod(F.xxhash64("template_id"), F.lit(n_g)).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(n_p - 1))))
        p, g = (t.withColumn("cell", F.col("pb") * n_g + F.col("gb")).drop("pb", "gb").repartitionById(n_p * n_g, "cell").groupBy("cell") for t in (p, g))
        found = p.cogroup(g).applyInPandas(lambda a, b: _match(a, b, k, matcher), FOUND)
    return _top(found, k).withColumn("subject_id", F.col("subject_id").cast(kind))


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each probe among its few rows from each block."""
    if k == 1:
        one = found.groupBy("probe_id").agg(F.max_by(F.struct("template_id", "subject_id", "score"), F.struct("score", -F.col("template_id"))).alias("b"))
        return one.select("probe_id", "b.*", F.lit(1).alias("rank"))
    w = Window.partitionBy("probe_id").orderBy(F.desc("score"), "template_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def identify(probes: DataFrame, gallery: DataFrame, threshold: float, matcher: Matcher | None = None, digits: int = DIGITS, score_fn: Expression | None = None) -> DataFrame:
    """J1. probe_id, outcome (MATCH or RETRY), subject_id, template_id, score, reason; ties to the lowest template_id."""
    return _answer(probes, _best(probes, gallery, 1, matcher, score_fn), threshold, digits)


def _answer(probes: DataFrame, best: DataFrame, threshold: float, digits: int) -> DataFrame:
    ok = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return probes.select("probe_id").join(best, "probe_id", "left").select(
        "probe_id", F.when(ok, "MATCH").otherwise("RETRY").alias("outcome"), F.when(ok, F.col("subject_id")).alias("subject_id"), F.when(ok, F.col("template_id")).alias("template_id"),
        F.coalesce(F.round("score", digits), F.lit(0.0)).alias("score"), F.when(F.col("score").isNull(), "NO_CANDIDATE").when(~ok, "LOW_SCORE").alias("reason"))


def candidates(probes: DataFrame, gallery: DataFrame, k: int, matcher: Matcher | None = None, digits: int = DIGITS, score_fn: Expression | None = None) -> DataFrame:
    """T1. The k best templates of each probe, ties to the lowest template_id."""
    return _best(probes, gallery, k, matcher, score_fn).withColumn("score", F.round("score", digits)).select("probe_id", "template_id", "subject_id", "score", "rank")


# -- buckets of random hyperplanes


def blocking(templates: int, similarity: float = 0.8, recall: float = 0.9) -> tuple[int, int]:
    """(planes, tables) for a gallery of so many templates: buckets of about BUCKET rows, and as many tables as a pair of
    that cosine needs to share a bucket in one of them with the given probability."""
    planes = max(LEAST_PLANES, math.ceil(math.log2(max(templates, 1) / BUCKET)))
    together = (1 - math.acos(similarity) / math.pi) ** planes
    return planes, math.ceil(math.log(1 - recall) / math.log(1 - together))


def hyperplanes(count: int, size: int) -> np.ndarray:
    """Normals with components 1 or -1, by a cubic congruence of their number, so that SQL can state them."""
    n = np.arange(1, count * size + 1, dtype=np.int64)
    m = n % PRIME
    h = (m * m % PRIME * m + 7 * m * m + 31 * m) % PRIME
    return np.where(2 * h >= PRIME, 1.0, -1.0).reshape(count, size)


def _in_buckets(rows: DataFrame, planes: int, tables: int) -> DataFrame:
    """Every row once for each table, with t and its bucket: the signs of `planes` products."""

    def go(frames):
        import pandas as pd

        step = max(1, SENT // tables)
        for f in (f.iloc[i : i + step] for f in frames for i in range(0, len(f), step)):
            for d, (at, x) in _by_length(f.vector.to_numpy()).items():
                signs = (x @ hyperplanes(planes * tables, d).T > 0).reshape(len(x), tables, planes)
                bucket = signs @ (1 << np.arange(planes, dtype=np.int64))
                out = f.iloc[np.repeat(at, tables)]
                yield out.assign(t=np.tile(np.arange(tables, dtype=np.int32), len(at)), bucket=bucket.ravel()) if len(out) else pd.DataFrame()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(go, f"{kinds}, t int, bucket long")


def _by_bucket(matcher: Matcher | None):
    """Rows sorted by key, a bucket's templates (side 0, of bounded number) before its probes, to the best for each probe."""

    def go(frames):
        import pandas as pd

        now, held = None, []
        for f in frames:
            key, side = f.key.to_numpy(), f.side.to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (side[1:] != side[:-1])) + 1
            out = []
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(f)]):
                if key[a] != now:
                    now, held = key[a], []
                part = f.iloc[a:b]
                if side[a] == 0:
                    held = [*held, part.copy()]  # a slice would keep the whole batch
                elif held:
                    held = [pd.concat(held)] if len(held) > 1 else held
                    out.append(_match(part.rename(columns={"id": "probe_id"}), held[0].rename(columns={"id": "template_id"}), 1, matcher))
            if out:
                yield pd.concat(out)

    return go


def identify_blocked(probes: DataFrame, gallery: DataFrame, threshold: float, planes: int = LEAST_PLANES, tables: int = 9, matcher: Matcher | None = None, digits: int = DIGITS, score_fn: Expression | None = None) -> DataFrame:
    """J2. The answer of J1 over candidates that share a bucket with the probe in some table; compare with J1 for recall.
    Buckets of more than TEMPLATES templates are dealt out in chunks, each of which meets all probes of the bucket."""
    score, matcher = _own_score(score_fn, matcher)
    kind = gallery.schema["subject_id"].dataType
    p = _in_buckets(valid(probes.select(F.col("probe_id").cast("long"), "vector")), planes, tables)
    g = _in_buckets(valid(gallery.select(F.col("template_id").cast("long"), F.col("subject_id").cast("long"), "vector")), planes, tables)
    hot = g.groupBy("t", "bucket").agg(F.ceil(F.count("*") / TEMPLATES).alias("chunks")).where("chunks > 1")
    chunks = F.expr("coalesce(chunks, 1)")
    every, own = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)), F.pmod(F.xxhash64("template_id"), chunks).cast("long")
    none, key = F.lit(None).cast("long").alias("subject_id"), F.xxhash64("t", "bucket", "chunk", F.size("vector")).alias("key")  # a collision only adds comparisons
    p = p.join(hot, ["t", "bucket"], "left").select("probe_id", "vector", "t", "bucket", every.alias("chunk")).select(key, F.lit(1).alias("side"), F.col("probe_id").alias("id"), none, "vector")
    g = g.join(hot, ["t", "bucket"], "left").select("template_id", "subject_id", "vector", "t", "bucket", own.alias("chunk")).select(key, F.lit(0).alias("side"), F.col("template_id").alias("id"), "subject_id", "vector")
    if score:
        templates = g.select("key", F.col("id").alias("template_id"), "subject_id", "vector")
        found = _by_expression(p.select("key", F.col("id").alias("probe_id"), "vector"), templates, 1, score, "key")
        return _answer(probes, _top(found, 1).withColumn("subject_id", F.col("subject_id").cast(kind)), threshold, digits)
    found = g.unionByName(p).repartition("key").sortWithinPartitions("key", "side").mapInPandas(_by_bucket(matcher), FOUND)
    return _answer(probes, _top(found, 1).withColumn("subject_id", F.col("subject_id").cast(kind)), threshold, digits)


def duplicate_fingers(prints: DataFrame, thresholds: float | DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """J3. For each print, the OR of the finger bits of earlier prints of its session that score at least the threshold (0: none). A session
    stores few prints. One threshold for all, or thresholds (security_level, threshold) with the level of each session in
    sessions (session_id, security_level); where a session has no level, or its level no threshold, nothing counts as a duplicate."""
    a = prints.select("session_id", "print_id", F.col("vector").alias("v"))
    b = prints.select("session_id", F.col("print_id").alias("other"), "finger_bit", F.col("vector").alias("w"))
    if isinstance(thresholds, DataFrame):
        if sessions is None:
            raise ValueError("thresholds by level need the sessions' levels")
        levels = thresholds.select("security_level", F.col("threshold").cast("double").alias("least"))
        a = a.join(sessions.select("session_id", "security_level").join(levels, "security_level").select("session_id", "least"), "session_id")
    else:
        a = a.withColumn("least", F.lit(float(thresholds)))
    hit = a.join(b, "session_id").where("other < print_id").where(dot(F.col("v"), F.col("w")) >= F.col("least"))
    mask = hit.groupBy("session_id", "print_id").agg(F.bit_or("finger_bit").alias("m"))
    return prints.select("session_id", "print_id").join(mask, ["session_id", "print_id"], "left").select("session_id", "print_id", F.coalesce("m", F.lit(0)).alias("matched_mask"))


def _pairs_of(frame, threshold: float, matcher: Matcher | None, digits: int, both):
    """template_a < template_b, score of the pairs of a frame whose two rows lie in blocks that `both` allows."""
    import pandas as pd

    out = []
    for _, (at, x) in _by_length(frame.vector.to_numpy()).items():
        ids, subject, block = (frame[c].to_numpy()[at] for c in ("template_id", "subject_id", "block"))
        for i in range(0, len(x), step := max(1, SCORES // max(len(x), 1))):
            s = x[i : i + step] @ x.T if matcher is None else _scored(matcher, x[i : i + step], x)
            ok = (ids[i : i + step, None] < ids) & (subject[i : i + step, None] != subject) & both(block[i : i + step, None], block)
            r, c = np.nonzero(ok & (s >= threshold - 1e-9))
            v = _added(x[i : i + step], x, r, c) if matcher is None else s[r, c]
            keep = v >= threshold
            out.append(pd.DataFrame({"template_a": ids[i + r[keep]], "template_b": ids[c[keep]], "score": v[keep].round(digits)}))
    return pd.concat(out) if out else pd.DataFrame({"template_a": np.zeros(0, np.int64), "template_b": np.zeros(0, np.int64), "score": np.zeros(0)})


def cross_subject_duplicates(gallery: DataFrame, threshold: float, planes: int = 0, tables: int = 1, matcher: Matcher | None = None, digits: int = DIGITS) -> DataFrame:
    """J4. Pairs of templates of different subjects with score >= threshold, each once.

    planes = 0 scores all pairs: templates are dealt into blocks, and each pair of blocks is one group. planes > 0
    compares within buckets only (for large galleries; recall below 1), large buckets again by pairs of blocks."""
    g = valid(gallery.select(F.col("template_id").cast("long"), F.col("subject_id").cast("long"), "vector")).where("subject_id is not null")
    size, keys = TEMPLATES // 2, ["i", "j"]
    if planes:
        keys = ["t", "bucket", *keys]
        g = _in_buckets(g, planes, tables)
        blocks = g.groupBy("t", "bucket").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks")).where("blocks > 1")
        g = g.join(blocks, ["t", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        g = g.withColumn("blocks", F.greatest(F.lit(1), F.ceil(g.agg(F.count("*")).scalar() / size)).cast("int"))
    g = g.withColumn("block", F.pmod(F.xxhash64("template_id"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    g = g.select("*", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def score(frame):
        # within one block every pair counts, between two blocks only those of one block and the other
        one = frame.i.iloc[0] == frame.j.iloc[0]
        return _pairs_of(frame, threshold, matcher, digits, (lambda a, b: a == b) if one else (lambda a, b: a != b))

    s = g.groupBy(*keys).applyInPandas(score, "template_a long, template_b long, score double")
    return s.distinct() if planes else s
