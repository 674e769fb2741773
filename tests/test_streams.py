"""Streams over several micro-batches: late rows, expiry, timers, restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall.operators import devices
from rollcall.sources import keyed
from rollcall.streaming import events as st

EVENT = "device_id LONG, ts TIMESTAMP, seq LONG, kind STRING"


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute, seconds=second)


class Feed:
    """A stream whose rows come file by file; each is run through with what came before it in the checkpoint."""

    def __init__(self, spark, folder, schema=EVENT):
        self.spark, self.path, self.folder, self.schema, self.n = spark, str(folder / "in"), str(folder / "run"), schema, 0

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.parquet(f"{self.path}/{self.n}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)

    def run(self, make, mode="append", *rows):
        if rows:
            self.put(*rows)
        return sorted(map(tuple, st.run_available(make(self.stream()), mode, folder=self.folder).collect()))


def naive(minute):
    return at(minute).replace(tzinfo=None)


def test_sessions_end_at_the_watermark(spark, tmp_path):
    f = Feed(spark, tmp_path)
    make = lambda s: st.stream_sessions(s, "10 minutes", "5 minutes")
    first = f.run(make, "append", (1, at(0), 1, "a"), (1, at(8), 2, "a"), (2, at(40), 3, "a"))
    assert first == [(1, naive(0), naive(18), 2)]  # the watermark stands at 35; the other session is open
    # of these, the first one's session would have ended at 15, the second one's at 38 is still open
    second = f.run(make, "append", (1, at(5), 4, "late"), (1, at(28), 5, "in time"), (2, at(90), 6, "a"))
    assert second == [(1, naive(0), naive(18), 2), (1, naive(28), naive(38), 1), (2, naive(40), naive(50), 1)]


def test_error_counts_end_at_the_watermark(spark, tmp_path):
    f = Feed(spark, tmp_path)
    make = lambda s: st.stream_error_counts(s, "10 minutes", "5 minutes")
    assert f.run(make, "append", (1, at(1), 1, "Error"), (1, at(9), 2, "Error"), (1, at(12), 3, "Error"), (9, at(26), 4, "Error"), (9, at(99), 8, "Ready")) == [(1, naive(0), 2), (1, naive(10), 1)]
    assert f.run(make, "append", (1, at(3), 5, "Error"), (1, at(24), 6, "Error"), (1, at(60), 7, "Error")) == [(1, naive(0), 2), (1, naive(10), 1), (1, naive(20), 1), (9, naive(20), 1)]


def test_debounce_by_timers(spark, tmp_path):
    """Timers fire in later batches; an event that comes late, but in time, still silences the one before it."""
    f = Feed(spark, tmp_path)
    make = lambda s: st.stream_debounce(s, 60_000, "5 minutes")
    ids = lambda rows: sorted(r[2] for r in rows)
    assert ids(f.run(make, "append", (1, at(0), 1, "a"), (1, at(0, 30), 2, "a"), (1, at(10), 3, "a"), (2, at(3), 4, "b"))) == [2, 4]
    assert ids(f.run(make, "append", (1, at(10, 59), 5, "a"), (3, at(30), 6, "c"))) == [2, 4, 5]
    assert ids(f.run(make, "append", (1, at(1), 7, "late"), (4, at(50), 8, "d"))) == [2, 4, 5, 6]
    rows = [(1, at(0), 1, "a"), (1, at(0, 30), 2, "a"), (1, at(10), 3, "a"), (2, at(3), 4, "b"), (1, at(10, 59), 5, "a"), (3, at(30), 6, "c"), (4, at(50), 8, "d")]
    assert ids(map(tuple, devices.debounce(spark.createDataFrame(rows, EVENT).select("device_id", "ts", "seq", "kind"), 60_000).collect())) == [2, 4, 5, 6, 8]


def test_debounce_by_bucket(spark, tmp_path):
    """Devices that share a bucket, one without an id among them, don't silence each other; state is one call a bucket, not a device."""
    f = Feed(spark, tmp_path)
    make = lambda s: st.stream_debounce(s, 60_000, "5 minutes", 1)
    ids = lambda rows: sorted(r[2] for r in rows)
    f.put((1, at(0), 1, "a"), (2, at(0, 30), 2, None), (None, at(0, 10), 3, "a"), (1, at(0, 59), 4, "a"), (3, at(1), 5, "b"), (3, at(2), 6, "b"))
    assert ids(st.run_available(make(f.stream()), "append", folder=f.folder).collect()) == []
    f.put((9, at(30), 7, "z"))
    assert [(r.device_id, r.seq, r.kind) for r in st.run_available(make(f.stream()), "append", folder=f.folder).orderBy("seq").collect()] == [
        (2, 2, None), (None, 3, "a"), (1, 4, "a"), (3, 5, "b"), (3, 6, "b")]


def test_batch_ids_expire(spark, tmp_path):
    f = Feed(spark, tmp_path, "batch_id LONG, ts TIMESTAMP")
    make = lambda s: st.stream_enrollments(s, "10 minutes")
    assert [r[0] for r in f.run(make, "append", (1, at(0)), (1, at(0)), (2, at(12)))] == [1, 2]
    assert [r[0] for r in f.run(make, "append", (1, at(11)), (3, at(40)))] == [1, 2, 3]  # the watermark stands at 2, 1 is remembered until 10
    assert [r[0] for r in f.run(make, "append", (1, at(41)), (3, at(42)), (2, at(5)))] == [1, 1, 2, 3]  # 1 is new again, the last one is late


class Stop(Exception):
    pass


def test_latest_state_after_a_restart(spark, tmp_path, monkeypatch):
    """Stopped after a micro-batch was applied, but before the stream knew: the same table as W1."""
    f, table = Feed(spark, tmp_path), str(tmp_path / "table")
    rows = [(i % 7, at(i * 13 % 50), i, f"k{i}") for i in range(60)]
    f.put(*rows[:30])
    st.keep_latest(f.stream(), table, f.folder, 4)
    f.put(*rows[30:])
    real = keyed.upsert

    def stop(*x):
        real(*x)
        raise Stop

    with monkeypatch.context() as m:
        m.setattr(keyed, "upsert", stop)
        with pytest.raises(Exception, match="Stop"):
            st.keep_latest(f.stream(), table, f.folder, 4)
    st.keep_latest(f.stream(), table, f.folder, 4)
    f.put((3, at(99), 99, "last"))
    st.keep_latest(f.stream(), table, f.folder, 4)
    got = keyed.read_keyed(spark, table, EVENT).select("device_id", "ts", "seq", "kind")
    want = devices.latest_state(spark.createDataFrame([*rows, (3, at(99), 99, "last")], EVENT))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("device_id", "ts", "seq", "kind").collect()))
    assert len(keyed._manifests(keyed.Folder(spark, table))) == 3


def test_check_ins_after_a_restart(spark, tmp_path, monkeypatch):
    f = Feed(spark, tmp_path, "probe_id LONG, ts TIMESTAMP, vector ARRAY<DOUBLE>")
    gallery = spark.createDataFrame([(5, 50, [1.0, 0.0]), (6, 60, [0.0, 1.0])], "template_id LONG, subject_id INT, vector ARRAY<DOUBLE>")
    f.put((1, at(0), [0.9, 0.0]), (2, at(1), [0.0, 0.8]), (3, at(2), [0.1, 0.1]))
    assert sorted(r[0] for r in st.check_in(f.stream(), gallery, 0.5, f.folder).collect()) == [1, 2]
    f.put((4, at(3), [1.0, 0.0]))
    real = st.drain

    def stop(stream, mode, folder, sink):
        def stopped(batch, number):
            sink(batch, number)
            raise Stop

        real(stream, mode, folder, stopped)

    with monkeypatch.context() as m:
        m.setattr(st, "drain", stop)
        with pytest.raises(Exception, match="Stop"):
            st.check_in(f.stream(), gallery, 0.5, f.folder)
    got = st.check_in(f.stream(), gallery, 0.5, f.folder)
    assert sorted((r.probe_id, r.subject_id) for r in got.collect()) == [(1, 50), (2, 60), (4, 50)]


def test_rejects_of_a_stream(spark, tmp_path):
    f = Feed(spark, tmp_path, "id LONG, reason STRING")
    f.put((1, None), (2, "BAD"))
    f.put((3, "BAD"), (4, "WORSE"), (5, None))
    dead = str(tmp_path / "dead")
    assert sorted(r.id for r in st.run_available(f.stream(), "append", rejects=dead, folder=f.folder).collect()) == [1, 5]
    bad = spark.read.parquet(dead).groupBy("reason").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert {r.reason: r.ids for r in bad} == {"BAD": [2, 3], "WORSE": [4]}
