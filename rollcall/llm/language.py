"""Language identification by Bayesian evidence fusion.

Text: log-likelihoods of hashed byte trigrams under one model a language, counted over all labelled rows. A-Z
are lower-cased, digits count as spaces, and a space stands at both ends, so that short texts have trigrams too.
Declaration: the lang attribute of markup, weighed by how often each declared language goes with each
language of the text. Address: priors of hosts, shrunk to those of their domain, these to those of
the address suffix, these to the overall shares; all are grouped sums of the texts' own posteriors,
and a row's own part is taken out of its host's sum. The posterior is the product of all three.

A row is rejected (lang null, accepted false) if its text has no letters, if no language makes a quarter of
its trigrams likelier than noise would, or if none gets half of the posterior. Nulls: a null text counts as empty; without
declaration, address or host that evidence is left out. Every label with a trigram in its rows is
modelled, by GRAMS numbers, which the driver and each task hold; without any, every row is rejected. Rows that repeat an id
are separate rows. Markup that isn't closed is read as text. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_row, join_unique, keep, numbered, slices, small_batches, texts

GRAMS, TEMPER, SHRINK, LEAST, FIT = 1 << 15, 0.3, 8.0, 0.5, 0.25
#: Numbers in a table of hosts or of declarations (rows times languages) that is broadcast at most.
BROADCAST = 2_000_000
#: Languages that a task counts before it hands them on.
COUNTED = 256


#: Lower-cases A-Z and makes digits spaces.
FOLD = bytes(32 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def grams(text: bytes) -> np.ndarray:
    """Hashed trigrams that hold a letter (a byte of 64 or more)."""
    a = np.frombuffer(b" " + text.translate(FOLD) + b" ", np.uint8)
    x, y, z = a[:-2], a[1:-1], a[2:]
    own = (x | y | z) >= 64
    h = (x.astype(np.int32) * 7919 + y.astype(np.int32) * 271 + z) * 40503
    return ((h >> 3) & (GRAMS - 1))[own]


def _has_letters(text: bytes) -> bool:
    return any(map(str.isalpha, text[:4096].decode("utf-8", "ignore"))) or any(map(str.isalpha, text.decode("utf-8", "ignore")))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, share: np.ndarray):
        self.langs = langs
        n = counts.sum(axis=1, keepdims=True) if len(langs) else np.zeros((0, 1))
        self.log_p = np.ascontiguousarray(np.log((counts + 0.02) / (n + 0.02 * GRAMS)).T, np.float32) if len(langs) else np.zeros((GRAMS, 0), np.float32)
        self.share = share

    def likelihood(self, text: bytes) -> np.ndarray:
        """Mean log-likelihood of a trigram in each language, their number (0: no letters), and the largest
        share of them that a language makes likelier than noise does."""
        g = grams(text)
        if not len(g) or not len(self.langs) or not _has_letters(text):
            return np.zeros(len(self.langs) + 2)
        p = self.log_p[g]
        return np.append(p.mean(axis=0, dtype=np.float64), [len(g), (p > -np.log(GRAMS)).mean(axis=0).max()])


def train(rows: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Trigram counts of all rows with a label."""
    rows = small_batches(rows).select(F.col(text).cast("binary").alias("text"), F.col(label).cast("string").alias("lang")).where("lang is not null and text is not null")
    n = dict(rows.groupBy("lang").count().collect())

    def go(batches):
        import pyarrow as pa

        def out():
            for lang, h in held.items():
                at = np.flatnonzero(h)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(h[at], pa.int64())], ["lang", "gram", "c"])
            held.clear()

        held: dict = {}
        for b in slices(batches):
            for t, lang in zip(texts(b), b.column("lang").to_pylist()):
                if lang not in held:
                    if len(held) == COUNTED:
                        yield from out()
                    held[lang] = np.zeros(GRAMS, np.int64)
                held[lang] += np.bincount(grams(t), minlength=GRAMS)
        yield from out()

    def whole(frame):  # one language: GRAMS rows at most
        import pandas as pd

        h = np.zeros(GRAMS)
        h[frame.gram.to_numpy()] = frame.c.to_numpy()
        return pd.DataFrame({"lang": frame.lang.iloc[:1], "c": [h.tobytes()]})

    sums = rows.mapInArrow(go, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    found = sums.groupBy("lang").applyInPandas(whole, "lang string, c binary").collect() if n else []  # GRAMS numbers a language
    langs = sorted(r.lang for r in found)
    counts = np.zeros((len(langs), GRAMS))
    place = {x: i for i, x in enumerate(langs)}
    for r in found:
        counts[place[r.lang]] = np.frombuffer(r.c)
    share = np.array([n[x] for x in langs], float)
    return Model(langs, counts, share / max(share.sum(), 1))


def declared_language(html: Column) -> Column:
    """The lang attribute of the first html tag that has one, without region; null if there is none. A tag ends where the next one begins, so
    that every tag is gone through once."""
    lang = r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})"
    told = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<html\b[^<>]*"), F.lit(0)), lambda tag: F.nullif(F.lower(F.regexp_extract(tag, lang, 1)), F.lit("")))
    return F.try_element_at(F.filter(told, lambda x: x.isNotNull()), F.lit(1))


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once, however often the body and the lambdas in it use it."""
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, y: s + y)


def softmax(a: Column) -> Column:
    shares = lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s))
    return let(a, lambda v: let(F.array_max(v), lambda m: let(F.transform(v, lambda x: F.exp(x - m)), shares)))


def shrunk(own: Column, above: Column) -> Column:
    """Shares of `own`, drawn to those above it as if SHRINK of these had been seen."""
    return let(own, lambda v: let(total(v) + SHRINK, lambda n: F.zip_with(v, above, lambda a, b: (a + SHRINK * b) / n)))


def vector_sum(arrays: Column) -> Column:
    """Aggregate: the sum of arrays of doubles, element by element."""
    return vector_to_array(Summarizer.sum(array_to_vector(arrays)))


def visible_text(html: Column) -> Column:
    """A page without comments, scripts, styles and tags. Openings without an end are no markup; the page is gone
    through once for each kind: it is cut at the openings, so that no search for an end runs past the next opening."""
    for opening, end in ((r"<!--", "-->"), (r"(?i)<script\b", r"(?i)</script\s*>"), (r"(?i)<style\b", r"(?i)</style\s*>")):
        parts = F.split(html, opening)
        rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: _after(x, end))
        html = F.when(F.size(parts) > 1, F.concat(F.element_at(parts, 1), F.array_join(rest, ""))).otherwise(html)
    return F.regexp_replace(html, r"<[^<>]*>", " ")


def _after(part: Column, end: str) -> Column:
    """What stands behind the first end in a part; all of it if there is no end."""
    found = F.split(part, end, 2)
    return F.concat(F.lit(" "), F.when(F.size(found) > 1, F.element_at(found, 2)).otherwise(part))


def identify(rows: DataFrame, model: Model, text: Column, *, declared: Column | None = None, url: Column | None = None, host: Column | None = None, carry: list[Column] = ()) -> DataFrame:
    """The carried columns, then lang, posterior, text_lang, declared, accepted for every row."""
    L = len(model.langs)
    null = F.lit(None).cast("string")
    name = host.cast("string") if host is not None else F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit("")) if url is not None else null
    carried = [c.alias(f"_{i}") for i, c in enumerate(carry)]

    base = small_batches(rows).select(*carried, text.cast("binary").alias("_text"), (declared if declared is not None else null).alias("declared"), name.alias("_host"))
    # the likelihoods are needed twice, for the priors and for the posteriors
    kept = keep(base.withColumn("_ll", _likelihood(model, rows.sparkSession)(F.col("_text"))).drop("_text"), "likelihoods")

    ll = F.slice("_ll", 1, max(L, 1))
    n = F.element_at("_ll", L + 1)
    log_share = F.array(*[F.lit(float(np.log(max(x, 1e-12)))) for x in model.share]) if L else F.array(F.lit(0.0))
    raw = F.transform(ll, lambda x: x * n * TEMPER)

    q = kept.withColumn("_q", softmax(F.zip_with(raw, log_share, lambda a, b: a + b))).withColumn("_on", n > 0)
    if not L:
        return kept.select(*[F.col(f"_{i}") for i in range(len(carried))], null.alias("lang"), F.lit(0.0).alias("posterior"), null.alias("text_lang"), "declared", F.lit(False).alias("accepted"))
    sums = vector_sum(F.when(F.col("_on"), F.col("_q")).otherwise(F.array_repeat(F.lit(0.0), L)))
    key = F.coalesce(F.concat(F.lit("+"), F.col("_host")), F.lit("-"))
    q = q.withColumn("_key", key)

    hosts = keep(q.groupBy("_key").agg(F.count("*").alias("n"), sums.alias("s")), "hosts")
    address = F.split(F.substring("_key", 2, 1 << 20), r"\.")
    dotted = F.size(address) > 1
    hosts = hosts.withColumn("domain", F.when(dotted, F.concat_ws(".", F.slice(address, -2, 2))).otherwise(F.lit(""))).withColumn("suffix", F.when(dotted, F.element_at(address, -1)).otherwise(F.lit("")))
    up = lambda t, k: t.groupBy(k).agg(vector_sum(F.col("s")).alias(f"{k}_s"), F.count("*").alias(f"{k}_n"))
    summed = hosts.groupBy().agg(vector_sum(F.col("s"))).first() if not hosts.isEmpty() else None
    overall = summed[0] if summed else [0.0] * L
    all_rows = sum(overall) or 1.0
    top = F.array(*[F.lit((x + 1.0 / L) / (all_rows + 1.0)) for x in overall])
    few = hosts.count() * L <= BROADCAST
    above = hosts
    for k in ("suffix", "domain"):  # neither has more rows than hosts
        sums_ = up(hosts, k)
        above = above.join(F.broadcast(sums_.drop(f"{k}_n")), k) if few else join_unique(above, sums_, k, f"{k}_n", hosts.count()).drop(f"{k}_n")
    above = above.withColumn("above", shrunk(F.col("domain_s"), shrunk(F.col("suffix_s"), top))).select("_key", "n", "s", "above")

    # how often a declared language goes with a language of the text
    pairs = q.where("declared is not null and _on").groupBy("declared").agg(F.count("*").alias("k"), sums.alias("c"))
    pairs = keep(pairs, "declared")
    codes = pairs.count()
    weight = F.zip_with("c", F.array(*[F.lit(float(x + 0.5 * max(1, codes))) for x in overall]), lambda a, b: F.log((a + 0.5) / b))
    weights = pairs.select("declared", "k", weight.alias("_told"))
    if codes * L <= BROADCAST:
        q = q.join(F.broadcast(weights.drop("k")), "declared", "left")
    else:
        said = int(pairs.agg(F.sum("k")).first()[0] or 0)
        q = join_unique(q.where("declared is not null"), weights, "declared", "k", said).drop("k").unionByName(q.where("declared is null"), allowMissingColumns=True)

    if few:
        joined = q.join(F.broadcast(above), "_key")
    else:
        joined = join_unique(q, above, "_key", "n", int(hosts.agg(F.sum("n")).first()[0] or 0))
    own = F.when(F.col("_on"), F.zip_with("s", "_q", lambda a, b: F.greatest(a - b, F.lit(0.0)))).otherwise(F.col("s"))
    prior = F.transform(shrunk(own, F.col("above")), lambda x: F.log(x + 1e-9))
    flat = F.array(*[F.lit(0.0)] * L)
    told = F.coalesce(F.col("_told"), flat)
    post = softmax(F.zip_with(F.zip_with(raw, prior, lambda a, b: a + b), told, lambda a, b: a + b))
    names = F.array(*map(F.lit, model.langs))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    joined = joined.withColumn("_p", F.when(F.col("_on"), post)).withColumn("posterior", F.coalesce(F.array_max("_p"), F.lit(0.0)))
    joined = joined.withColumn("accepted", F.col("_on") & (F.col("posterior") >= LEAST) & (F.element_at("_ll", L + 2) >= FIT))
    return joined.select(
        *[F.col(f"_{i}") for i in range(len(carried))], F.when(F.col("accepted"), best(F.col("_p"))).alias("lang"), "posterior",
        F.when(F.col("_on"), best(F.col("_q"))).alias("text_lang"), "declared", "accepted")


def _likelihood(model: Model, spark):
    from collections.abc import Iterator

    import pandas as pd

    shared = spark.sparkContext.broadcast(model)

    def go(frames):
        for s in frames:
            yield pd.Series([shared.value.likelihood(t or b"") for t in s])

    go.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.Series]}

    return F.pandas_udf(go, "array<double>")


def identify_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, lang, posterior, text_lang, declared, accepted: documents, whose source is the host."""
    model = model or train(docs)
    found = identify(docs, model, F.col("text"), declared=declared_language(F.col("text")), host=F.col("source"), carry=[F.col("doc_id").cast("long")])
    return found.withColumnRenamed("_0", "doc_id")


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, lang, posterior, text_lang, declared, accepted: web pages."""
    html = F.col("html")
    found = identify(pages, model, visible_text(html), declared=declared_language(html), url=F.col("url"), carry=[F.col("page_id").cast("long")])
    return found.withColumnRenamed("_0", "page_id")


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The input's rows that are not rejected."""
    rows = numbered(docs)
    found = identify(rows, train(rows), F.col("text"), declared=declared_language(F.col("text")), host=F.col("source"), carry=[F.col("__row")])
    gone = keep(found.where(~F.col("accepted")).select(F.col("_0").alias("__row")), "gone")
    return by_row(rows, gone, "left_anti").select(docs.columns)
