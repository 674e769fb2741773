"""Every registered query against its SQL at the smallest scale."""

import re
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rollcall.operators import matching
from rollcall.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def rows(frame, columns):
    def text(v):
        if v is None or v != v:
            return None
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    values = frame[columns].astype(object)
    return sorted(tuple(map(str, map(text, r))) for r in values.where(values.notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLE[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", ["r1_stream_latest_complete", "r2_stream_changes", "r7_stream_identify", "r8_stream_kv", "r9_stream_gate"])
def test_streams_over_folders(spark, duck, tmp_path, name):
    """A table may be a folder of files, none of which has the table's name."""
    for t in ("events", "embeddings", "documents"):
        spark.read.parquet(f"{DATA}/{t}.parquet").repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), duck.execute(registry.ORACLE[name]).fetchdf()
    assert len(got) and rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def test_blocked_recall(spark):
    """J2 finds what J1 finds on the same probes, over a fifth of the pairs."""
    probes, gallery = registry._noisy(spark, DATA)
    exact = {r.probe_id: r for r in matching.identify(probes, gallery, 0.5).collect()}
    near = registry.QUERIES["j2_identify_blocked"](spark, DATA).collect()
    assert len(near) == len(exact)
    assert sum(r.template_id == exact[r.probe_id].template_id for r in near) >= 0.9 * len(near)
    a, b = (matching._in_buckets(matching.valid(t), *matching.blocking(1)).select(c, "t", "bucket") for t, c in ((probes, "probe_id"), (gallery, "template_id")))
    pairs = a.join(b, ["t", "bucket"]).select("probe_id", "template_id").distinct().count()
    assert pairs <= 0.2 * probes.count() * gallery.count()


@pytest.mark.parametrize("block", [7, 64])
def test_blocks_of_any_size(spark, monkeypatch, block):
    """More probes than are sent to all tasks, galleries of many blocks and buckets of many chunks give the same rows."""
    names = ("j1_identify", "t1_candidates", "j4_cross_subject", "j2_identify_blocked")
    want = {n: sorted(map(str, registry.QUERIES[n](spark, DATA).collect())) for n in names}
    for k, v in {"PROBES": 5, "TEMPLATES": block, "SCORES": 50}.items():
        monkeypatch.setattr(matching, k, v)
    for n in names:
        assert sorted(map(str, registry.QUERIES[n](spark, DATA).collect())) == want[n]


def test_copies_go_out_in_small_batches(spark, monkeypatch):
    """A batch of rows isn't copied for all tables at once; the copies are the same."""
    class Rows:
        schema = matching.valid(registry._probes(spark, DATA)[1].select("template_id", "vector")).schema

        def mapInPandas(self, go, kinds):
            return list(go([pd.DataFrame({"template_id": range(60), "vector": [[float(i), 1.0, -2.0] for i in range(60)]})]))

    whole = pd.concat(matching._in_buckets(Rows(), 6, 9))
    monkeypatch.setattr(matching, "SENT", 45)
    parts = matching._in_buckets(Rows(), 6, 9)
    assert max(map(len, parts)) == 45
    assert sorted(map(str, pd.concat(parts).to_numpy().tolist())) == sorted(map(str, whole.to_numpy().tolist()))


def test_own_scores(spark):
    """A Column and a pandas_udf give what the default gives on dot, in J1, J2 and T1."""
    p, g = registry._probes(spark, DATA)
    noisy = registry._noisy(spark, DATA)[0]
    runs = [lambda **x: matching.identify(p, g, 0.35, **x), lambda **x: matching.identify_blocked(noisy, g, 0.5, **x), lambda **x: matching.candidates(p, g, 7, **x)]
    for run in runs:
        want = sorted(map(str, run().collect()))
        assert sorted(map(str, run(score_fn=matching.dot).collect())) == want
        assert sorted(map(str, run(score_fn=F.pandas_udf(registry._series_dot, "double")).collect())) == want


def test_score_of_frames(spark):
    """A pandas_udf of two data frames gives what the default gives; it may not write into what it is given."""
    p, g = registry._probes(spark, DATA)
    odd = spark.createDataFrame([(-1, [1.0]), (-2, [1.0, 2.0]), (-3, None)], "template_id LONG, vector ARRAY<DOUBLE>").withColumn("subject_id", F.lit(1))
    p = p.select("probe_id", "vector").union(odd.select("template_id", "vector"))
    g = g.select("template_id", "subject_id", "vector").unionByName(odd)
    frames = F.pandas_udf(registry._frames_dot, "double")
    for run in (lambda **x: matching.identify(p, g, 0.35, **x), lambda **x: matching.candidates(p, g, 7, **x)):
        assert sorted(map(str, run(score_fn=frames).collect())) == sorted(map(str, run().collect()))
    noisy = registry._noisy(spark, DATA)[0]
    assert sorted(map(str, matching.identify_blocked(noisy, g, 0.5, score_fn=frames).collect())) == sorted(map(str, matching.identify_blocked(noisy, g, 0.5).collect()))

    def writes(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        b.to_numpy()[:] = 0.0
        return b[0]

    _, matcher = matching._own_score(F.pandas_udf(writes, "double"), None)
    with pytest.raises(ValueError, match="read-only"):
        matcher(np.ones((1, 2)), np.ones((3, 2)))


def test_scan_is_dealt_out(spark, monkeypatch):
    """A gallery in one file is scored by many tasks if there are many pairs, and each pair of blocks by a task of its own."""
    p, g = registry._probes(spark, DATA)
    want, n = sorted(map(str, matching.candidates(p, g, 5).collect())), (p.count(), g.count())
    top, tasks = matching._top, []
    monkeypatch.setattr(matching, "_top", lambda found, k: tasks.append(found.select(F.spark_partition_id()).distinct().count()) or top(found, k))
    monkeypatch.setattr(matching, "PAIRS", n[0] * n[1] // 10)
    assert sorted(map(str, matching.candidates(p, g, 5).collect())) == want
    monkeypatch.setattr(matching, "PROBES", n[0] // 3)
    monkeypatch.setattr(matching, "TEMPLATES", n[1] // 4)
    assert sorted(map(str, matching.candidates(p, g, 5).collect())) == want
    assert tasks[0] > 7 and tasks[1] > 7, tasks


def test_expression_is_compiled(spark):
    """The loop over an array of templates is in a compiled step, in a method that the JVM compiles too: under 8,000 bytes and with few arguments."""
    p, g = registry._probes(spark, DATA)
    df = matching.identify(p, g, 0.35, score_fn=matching.product(64))
    assert sorted(map(str, df.collect())) == sorted(map(str, matching.identify(p, g, 0.35).collect()))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    steps = re.split(r"(?=== Subtree )", df._jdf.queryExecution().explainString(mode))
    found = [(int(re.search(r"maxMethodCodeSize:(\d+)", x)[1]), len(args[1].split(","))) for x in steps if (args := re.search(r"void generate_doConsume_0\(([^)]*)\)", x))]
    assert found and min(found)[0] < 8000 and max(n for _, n in found) < 20, found


def test_scores_that_are_null(spark):
    p = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "probe_id LONG, vector ARRAY<DOUBLE>")
    g = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [2.0]), (3, 3, [3.0])], "template_id LONG, subject_id INT, vector ARRAY<DOUBLE>")
    own = lambda a, b: F.when(b[0] == 2, F.lit(None)).when(b[0] == 3, F.lit(float("nan"))).otherwise(-F.abs(a[0] - b[0]))
    got = {r.probe_id: (r.template_id, r.reason) for r in matching.identify(p, g, -0.5, score_fn=own).collect()}
    assert got == {1: (1, None), 2: (None, "NO_CANDIDATE")}

    def nan(a: pd.Series, b: pd.Series) -> pd.Series:
        return b.map(lambda y: float("nan") if y[0] < 3 else 1.0)

    assert [r.template_id for r in matching.candidates(p, g, 3, score_fn=F.pandas_udf(nan, "double")).collect()] == [3]
