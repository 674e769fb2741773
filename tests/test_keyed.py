"""The keyed table: only touched buckets are written, versions expire, writes that break off leave no trace."""

import json

import pytest

from rollcall.sources import keyed

SCHEMA = "k INT, ts INT, v STRING"


def rows(spark, *x):
    return spark.createDataFrame(list(x), SCHEMA)


def put(spark, path, batch, *x, **how):
    return keyed.upsert(rows(spark, *x), path, batch, ("k",), ("ts",), buckets=8, **how)


def table(spark, path, version=None):
    return sorted(map(tuple, keyed.read_keyed(spark, path, SCHEMA, version).collect()), key=str)


def test_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path)
    assert table(spark, path) == []
    first = put(spark, path, "a", *[(k, 1, "a") for k in range(100)], (None, 1, "a"))
    assert first == list(range(8))
    one = put(spark, path, "b 1/x", (7, 2, "b"), (7, 3, "c"), (7, 0, "old"))
    assert len(one) == 1
    before, after = (json.loads((tmp_path / "manifests" / f"0000000{v}.json").read_text())["folders"] for v in (0, 1))
    assert {b for b in after if after[b] != before[b]} == {str(one[0])}
    assert table(spark, path) == sorted([(k, 1, "a") for k in range(100) if k != 7] + [(7, 3, "c"), (None, 1, "a")], key=str)
    assert table(spark, path, 0) == sorted([(k, 1, "a") for k in range(100)] + [(None, 1, "a")], key=str)
    assert put(spark, path, "a", (7, 9, "again")) == put(spark, path, "none") == []
    assert put(spark, path, "late", (7, 1, "late")) == one and (7, 3, "c") in table(spark, path)
    with pytest.raises(ValueError):
        keyed.upsert(rows(spark, (1, 1, "x")), path, "z", ("v",), ("ts",))


def test_versions_expire(spark, tmp_path):
    path = str(tmp_path)
    for i in range(6):
        put(spark, path, str(i), (1, i, f"v{i}"), (2 + i, i, "own"), keep=2)
    assert sorted(p.name for p in (tmp_path / "manifests").glob("*.json")) == ["00000004.json", "00000005.json"]
    named = {f for v in (4, 5) for f in json.loads((tmp_path / "manifests" / f"0000000{v}.json").read_text())["folders"].values()}
    assert {str(p.relative_to(tmp_path)) for p in tmp_path.glob("data/*/_bucket=*")} == named
    assert table(spark, path) == sorted([(1, 5, "v5"), *[(2 + i, i, "own") for i in range(6)]], key=str)


@pytest.mark.parametrize("broken", ["_commit", "_expire"])
def test_broken_writes(spark, tmp_path, monkeypatch, broken):
    """Before the swap the old version stays, and the batch is applied on the next try; after it, it isn't applied twice."""
    path = str(tmp_path)
    put(spark, path, "a", (1, 1, "a"))

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(keyed, broken, stop)
        with pytest.raises(KeyboardInterrupt):
            put(spark, path, "b", (1, 2, "b"))
    assert table(spark, path) == [(1, 1, "a") if broken == "_commit" else (1, 2, "b")]
    assert bool(put(spark, path, "b", (1, 2, "b"))) == (broken == "_commit")
    put(spark, path, "c", (3, 1, "c"))
    assert table(spark, path) == [(1, 2, "b"), (3, 1, "c")]
    named = {f.split("/")[1] for p in (tmp_path / "manifests").glob("*.json") for f in json.loads(p.read_text())["folders"].values()}
    assert {p.name for p in (tmp_path / "data").iterdir()} <= named


def test_mark_is_made_up_for(spark, tmp_path):
    """Stopped between the swap and the mark: the manifest's own batch counts as applied."""
    path = str(tmp_path)
    put(spark, path, "a", (1, 1, "a"))
    (tmp_path / "applied" / "a").unlink()
    assert put(spark, path, "a", (1, 9, "twice")) == [] and table(spark, path) == [(1, 1, "a")]


def test_second_writer_fails(spark, tmp_path):
    folder = keyed.Folder(spark, str(tmp_path))
    keyed._commit(folder, 0, {"folders": {}})
    with pytest.raises(RuntimeError):
        keyed._commit(folder, 0, {"folders": {}})
