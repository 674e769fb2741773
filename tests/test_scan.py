"""Scans by chunks against plain windows, and leaves against a plain test of every day."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators import attendance, devices, enrollment, prefs, scan

KINDS = ["Attached", "Detached", "Default", "Platen", "Process", "Acquired", "Result", "Error", "Initialize", "Ready", None]


@pytest.fixture(scope="module")
def log(spark):
    """One device with most rows, several small ones, one without a name; many rows at the same time."""
    r, start = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(r.choice([1, 1, 1, 1, 2, 3, None]), start + dt.timedelta(milliseconds=r.randrange(200_000) // 500 * 500), i, r.choice(KINDS), r.choice([None, *range(0, 101, 10)]), f"x{i % 3}") for i in range(900)]
    return spark.createDataFrame(rows, "device_id LONG, ts TIMESTAMP, seq LONG, kind STRING, progress INT, other STRING")


SCANS = {
    "W2": lambda x, n: devices.distinct_until_changed(x, ["kind", "other"], chunk=n),
    "W3": lambda x, n: devices.device_sessions(x, chunk=n),
    "W4": lambda x, n: devices.capture_cycles(x, chunk=n),
    "W5": lambda x, n: devices.init_progress(x, chunk=n),
    "W6": lambda x, n: devices.debounce(x, 700, chunk=n),
    "W8": lambda x, n: prefs.token_intervals(x.select(F.col("device_id").alias("ns"), F.col("other").alias("key"), "ts", "seq", (F.col("seq") % 3 == 0).alias("deleted")), "x1", chunk=n),
    "W9": lambda x, n: enrollment.finger_slots(x.select(F.col("device_id").alias("session_id"), (F.col("seq") % 2).alias("finger_bit"), F.xxhash64("seq").alias("seq"), F.when(F.col("kind") < "E", "add").otherwise("remove").alias("op"), (F.col("seq") % 5 == 0).alias("force")), chunk=n)[0],
    "J10": lambda x, n: devices.combine_latest(x.where("seq % 2 = 0"), x.where("seq % 2 = 1"), chunk=n),
}


@pytest.mark.parametrize("name", SCANS)
@pytest.mark.parametrize("chunk", [200, 3])
def test_chunks_give_the_windows_rows(log, name, chunk):
    rows = lambda n: sorted(map(str, SCANS[name](log, n).collect()))
    assert rows(chunk) == rows(10**9)


def test_no_task_above_its_chunk(log):
    quiet, busy = scan.split_busy(log, "device_id", ("ts", "seq"), 200)
    assert {r.device_id for r in busy.select("device_id").distinct().collect()} == {1}
    assert quiet.count() + busy.count() == log.count()
    sizes = busy.groupBy("device_id", "_chunk").agg(F.count("*").alias("n"), F.min(F.struct("ts", "seq")).alias("a"), F.max(F.struct("ts", "seq")).alias("z")).orderBy("_chunk").collect()
    assert max(r.n for r in sizes) <= 200 and len(sizes) > 2
    assert all(one.z < two.a for one, two in zip(sizes, sizes[1:]))
    assert scan.split_busy(log, "device_id", ("ts", "seq"), 900)[1] is None


def test_leaves(spark):
    r, base = random.Random(4), dt.date(2024, 1, 1)
    day = lambda n: base + dt.timedelta(n)
    leaves = [("a", day(5), day(3)), ("a", day(-20000), None), ("b", day(10), day(10)), ("b", day(-60), day(3650)), ("c", None, day(-100)), ("d", None, None), (None, day(0), day(9)), ("e", day(63), day(64)), ("f", day(-1500), day(-1))]
    leaves += [(r.choice("ghij"), day(a := r.randrange(-200, 200)), day(a + r.randrange(-10, 120))) for _ in range(60)]
    leaves[1] = ("k", day(50), None)
    days = [(s, day(n), i) for i, (s, n) in enumerate((s, n) for s in "abcdefghijkz" for n in [*range(-210, 330, 3), 3650, 3651, -1501])] + [("a", None, -1), (None, day(3), -2), ("g", day(0), -3), ("g", day(0), -3)]
    covered = lambda s, d: d is not None and s is not None and any(x == s and (a is None or a <= d) and (z is None or d <= z) for x, a, z in leaves)
    got = attendance.exeat_overlap(spark.createDataFrame(days, "subject_id STRING, day DATE, bin INT"), spark.createDataFrame(leaves, "subject_id STRING, start_day DATE, end_day DATE"))
    assert got.columns == ["subject_id", "day", "bin", "covered"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((*x, covered(x[0], x[1]))) for x in days)
