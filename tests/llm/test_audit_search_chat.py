"""Divergence of sources, lexical search and chat formatting: against plain versions, their SQL, and on odd tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollcall.llm import chat, divergence, lexical, queries

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, value LONG, `rank` STRING, term INT, n DOUBLE"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 0.5) for r in rows], DOCS)


ODD = [(1, "The cat, the CAT2 and éa", "en", "a"), (2, "the cat sat", "en", "b"), (2, "the cat sat", "en", "b"), (3, None, "en", "c"), (None, "the dog; the dog", "en", None), (4, "", None, None), (5, "the\x00the İé İé", None, "a"),
       (6, "le chat le chien", "fr", "a"), (7, "le chat " * 3000, "fr", "b"), (8, "le chat noir", "fr", "c"), (9, "le", "fr", "c"), (10, "le chat " * 3000, "fr", "b"), (11, "seul", "xx", "z"), (12, "chat " * 40, "fr", "")]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", ["op11_divergence", "op12_lexical_search", "op13_chat_format"])
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want, got = c.execute(queries.ORACLE[name]).fetchdf(), queries.QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    rows = lambda t: sorted(map(str, t[sorted(want.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


# -- divergence


def slow_audit(rows, least=3, top=200):
    count, df = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang or "", source or ""].update(found)
        df[lang or ""].update(set(found))
    out = []
    for lang in {k for k, _ in count}:
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=str.encode)
        groups = {s: c for (k, s), c in count.items() if k == lang}
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: p_of(c) for s, c in groups.items()}, p_of(sum(groups.values(), Counter()))
        for s in groups:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize(("groups", "terms", "rows"), [(64, 2048, 10**6), (1, 1, 10**6), (2, 2, 0)])
def test_divergence(spark, monkeypatch, groups, terms, rows):
    """Blocks of any size, and joins by shuffles, give the plain version's rows."""
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", rows)
    got = divergence.audit(documents(spark, ODD))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == slow_audit(ODD)
    assert sorted(map(tuple, divergence.audit(documents(spark, ODD), least=1, top=2).collect())) == slow_audit(ODD, 1, 2)


def test_divergence_of_nothing(spark):
    assert divergence.audit(documents(spark, []).where("false")).count() == 0
    got = divergence.audit(documents(spark, [(1, None, None, None), (2, "!", None, "b")])).collect()
    assert [(r.source, r.part, r.item, r.value) for r in sorted(got)] == [("", "pair", "b", 0), ("b", "pair", "", 0)]


def test_shares_are_exact():
    of = np.array([1, 7, 10**13 + 7, 9 * 10**15])
    for c in (0, 3, 6, 10**13, 9 * 10**15 - 1):
        some = of[of > c]
        assert divergence.shares(np.full(len(some), c), some).tolist() == [1 + 10**9 * (c + 1) // int(d) for d in some]


def test_large_counts_in_columns(spark):
    got = spark.sql(f"SELECT {10**16} AS c, {3 * 10**16} AS n, 5L AS v").select(divergence.share("c", "n + v")).first()[0]
    assert got == 1 + 10**9 * (10**16 + 1) // (3 * 10**16 + 5)


# -- lexical search


def slow_search(docs, items, k=20):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(find(t))) for i, t in docs if find(t)]
    N, L = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    of = defaultdict(set)
    for i, t in items:
        of[i].add(t or "")
    out = []
    for item, some in of.items():
        own, scored = Counter(t for x in some for t in find(x)), []
        for doc, c in held:
            m = 75 + 25 * sum(c.values()) * N // L
            scored.append((sum(n * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in own.items() if c[t]), doc))
        scored = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, doc, s) for r, (s, doc) in enumerate(scored[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "The cat and the cat2"), (2, "chat noir, le chat"), (3, None), (4, "nothing here"), (5, "!"), (None, "dog"), (6, "the"), (6, "the"), (6, "éa İé"), (7, "le chat " * 500)]


@pytest.mark.parametrize(("items", "cells", "exact"), [(256, 1 << 20, 2**53), (1, 3, 2**53), (3, 1 << 20, 1)])
def test_lexical_search(spark, monkeypatch, items, cells, exact):
    """Blocks of items, of documents, and products of integers give the plain version's rows."""
    monkeypatch.setattr(lexical, "ITEMS", items)
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "EXACT", exact)
    bench = spark.createDataFrame([(i, t, 9, "x") for i, t in ITEMS], "item_id LONG, text STRING, doc_id LONG, score STRING")
    for k in (20, 2):
        got = lexical.search(documents(spark, ODD), bench, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == slow_search([r[:2] for r in ODD], ITEMS, k)


def test_lexical_ties_over_tasks(spark):
    """Many equal documents in many tasks: the smallest ids win."""
    docs = spark.range(3000, numPartitions=40).select((2999 - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "a b").otherwise("b").alias("text"))
    bench = spark.createDataFrame([(1, "a")], "item_id LONG, text STRING")
    assert [r.doc_id for r in lexical.search(docs, bench).orderBy("rank").collect()] == sorted(2999 - i for i in range(0, 3000, 3))[:20]


def test_lexical_nothing(spark):
    docs, bench = documents(spark, ODD), spark.createDataFrame(ITEMS, "item_id LONG, text STRING")
    assert lexical.search(docs.where("false"), bench).count() == lexical.search(docs, bench.where("false")).count() == 0
    assert lexical.search(docs.where("text = '' OR text IS NULL"), bench).count() == 0


def test_lengths_beyond_64_bits():
    n, N, L = np.array([3, 10**9], np.int64), 10**12, 10**14
    assert lexical._lengths(n, N, L).tolist() == [75 + 25 * int(x) * N // L for x in n]


# -- chat

CHAT = "conv_id LONG, turn LONG, role STRING, text STRING, state INT, chunk STRING, place INT"
SAID = [(1, 0, "system", "be <s>kind</s>"), (1, 1, "user", "hi\\"), (1, 2, "assistant", "\\<|end|>\n[INST] \\\\</s>"), (1, 3, "user", None), (1, 4, "assistant", ""), (2, 0, "assistant", "first"), (2, 1, "user", "x"),
        (3, 5, "user", "b"), (3, 5, "user", "a"), (3, 5, "user", "a"), (3, None, None, "no role"), (4, 0, "to<|end|>ol\n", "<|named|>"), (None, 0, "user", "lost"), (None, 1, "assistant", "found"), (5, 0, "user", "word " * 20000)]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CHAT)


def slow_chat(rows):
    allowed = {("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in of.items():
        turns = [x[2:] for x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        known = lambda r: r if r in ("system", "user", "assistant") else None
        states = ["start"]
        valid = True
        for r, _ in turns:
            valid &= (states[-1], r) in allowed
            states.append(known(r) or states[-1])
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), valid, states[-1] == "assistant")
    return out


@pytest.mark.parametrize("chunk", [10**6, 2, 1])
def test_chat(spark, chunk):
    """Digests read back from the formatted text, also of conversations cut into chunks."""
    rows = SAID + [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i} </s>") for i in range(200)]
    got = chat.digests(conversations(spark, rows), chunk=chunk).collect()
    assert {r.conv_id: tuple(r)[1:5] + (r.valid, r.complete) for r in got} == slow_chat(rows) and len(got) == len(slow_chat(rows))
    turns = chat.format_turns(conversations(spark, rows), chunk=chunk).collect()
    assert len(turns) == len(rows)
    text = defaultdict(str)
    for r in sorted(turns, key=lambda r: (str(r.conv_id), r.chunk, r.place)):
        text[r.conv_id] += "".join(s.text for s in r.segments)
        assert not any(c in s.text for s in (r.segments[1],) for c in chat.Template().controls())
    assert {r.conv_id: r.formatted_chars for r in got} == {k: len(v) for k, v in text.items()}
    assert all(v.startswith("<|begin|>") and v.count("<|begin|>") == 1 for v in text.values())
    assert [(r.place + 1, r.in_order) for r in sorted(turns, key=lambda r: (r.chunk, r.place)) if r.conv_id == 2] == [(1, False), (2, True)] or chunk < 2


def test_large_conversations_are_shared(spark):
    """No task formats more turns of a conversation than a chunk holds."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "x") for i in range(3000)]
    turns = chat.format_turns(conversations(spark, rows), chunk=500)
    sizes = [r["count"] for r in turns.groupBy("chunk").count().collect()]
    assert max(sizes) <= 500 and sum(sizes) == 3000 and turns.where("NOT in_order").count() == 0


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "<|end|>"]), st.text(st.sampled_from(list("\\<|/s>end[]INST\n a"))))))
def test_round_trip(turns):
    machine = chat.Machine(chat.Template())
    text = "".join(s for i, (role, said) in enumerate(turns) for s, _ in machine.segments(role, said, i == 0))
    assert list(machine.read(text)) == turns
    for _, said in turns:
        assert not any(c in machine.escape(said) for c in machine.t.controls())


def test_own_template(spark):
    """Other roles, rules and marks; overlapping control strings."""
    t = chat.Template(begin="<<B>>", roles={"q": ("#Q#", False), "a": ("#A#", True), "tool": ("#T#", False)}, end="#END#", foreign=("aa", "aba"), rules={("start", "q"): "q", ("q", "a"): "a", ("a", "tool"): "call", ("call", "a"): "a"}, ends=("a", "call"))
    rows = [(1, 0, "q", "aaaa"), (1, 1, "a", "ababa"), (1, 2, "tool", "#END#"), (1, 3, "a", "aa"), (2, 0, "a", "x")]
    got = {r.conv_id: r for r in chat.digests(conversations(spark, rows), t).collect()}
    assert (got[1].valid, got[1].complete, got[1].loss_chars) == (True, True, 7) and not got[2].valid
    assert got[1].loss_sha256 == hashlib.sha256(b"ababaaa").hexdigest()
    for bad in ({"end": "x"}, {"end": "\\n"}, {"other": "#Q#"}):
        with pytest.raises(ValueError):
            chat.Machine(chat.Template(roles=t.roles, **bad))


def test_no_conversations(spark):
    empty = conversations(spark, SAID).where("false")
    assert chat.digests(empty).count() == chat.format_turns(empty).count() == 0
