"""Helpers that the training-data operators share.

Every operator first selects the columns it needs, so further columns of the input, whatever
they are called, never reach a join or an output.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as every contract of this package defines them.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="spark-llm-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


_run: dict[str, str] = {}


class _Kept(threading.local):
    """What this thread has kept: runs side by side in one driver don't delete each other's tables."""

    def __init__(self):
        self.tables: list[tuple[SparkSession, str]] = []


_kept = _Kept()


def run_folder(spark: SparkSession) -> str:
    """One folder under the shared one for all tables of this driver; it goes when the driver ends."""
    top = shared_folder(spark)
    if top not in _run:
        _run[top] = f"{top}/llm-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _run[top])
    return _run[top]


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session has ended already: the folder stays for whoever clears the shared one
        pass


def keep(df: DataFrame, name: str, *, sort: list[str] | None = None, options: dict | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}-{name}"
    if sort:
        df = df.sortWithinPartitions(*sort)
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    _kept.tables.append((spark, path))
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that keep() wrote, once nothing reads them any more."""
    for t in tables:
        _delete(t.sparkSession, t.kept_at)


def mark() -> int:
    return len(_kept.tables)


def release_but(table: DataFrame, since: int) -> None:
    """Delete the tables that this thread kept since mark(), except `table`, which keep() made of them."""
    for spark, path in _kept.tables[since:]:
        if path != table.kept_at:
            _delete(spark, path)
    _kept.tables[since:] = [(table.sparkSession, table.kept_at)]


def numbered(docs: DataFrame) -> DataFrame:
    """The rows, stored, with a number of their own in `__row`: decisions are joined back by it, so rows that
    repeat an id or are equal in all columns stay apart. Texts are stored in zstd, which takes less disk than the default."""
    return keep(docs.withColumn("__row", F.monotonically_increasing_id()), "rows", options={"compression": "zstd"})


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns but the number: it orders rows that are alike otherwise the same way in every run."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != "__row"])


#: Decisions on fewer rows than this are broadcast to where the texts lie (16 bytes each).
BROADCAST_ROWS = 1_000_000


def by_row(rows: DataFrame, decided: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with `decided`, which has `__row` once. Texts are shuffled only if there are too many decisions to broadcast."""
    few = decided.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(decided) if few else decided, "__row", how)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null stays null."""
    return F.crc32(c.cast("string").cast("binary")) % n


def join_unique(left: DataFrame, right: DataFrame, key: str, count: str, total: int, parts: int = 1000) -> DataFrame:
    """left ⟕ right, where right has one row per key and `count`, the rows that left has of it.

    Keys with more than 1/parts of all rows (fewer than `parts` of them, whatever the data) are
    broadcast, so that they need no shuffle; the other keys go through a shuffle that has no key
    above that share. Keys must not be null.
    """
    hot = F.broadcast(right.where(F.col(count) * parts > total))
    cold = right.where(F.col(count) * parts <= total)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key, "left"), allowMissingColumns=True)


def runs(frames, key: str):
    """Whole runs of equal keys from an iterator of pandas frames sorted by key: yields frames that
    start and end at key boundaries, so that groups never span two of them."""
    import pandas as pd

    held = []
    for f in frames:
        if not len(f):
            continue
        k = f[key].to_numpy()
        if held and held[-1][key].iloc[-1] != k[-1]:
            cut = int((k == k[-1]).argmax())
            yield pd.concat([*held, f.iloc[:cut]], ignore_index=True)
            held = [f.iloc[cut:]]
        elif not held and k[0] != k[-1]:
            cut = int((k == k[-1]).argmax())
            yield f.iloc[:cut].reset_index(drop=True)
            held = [f.iloc[cut:]]
        else:
            held.append(f)
    if held:
        yield pd.concat(held, ignore_index=True)


def small_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """Texts are long: fewer rows go to Python at a time than by default. Applies to the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return df


def slices(batches, rows: int = 512):
    """Arrow batches of few rows, so that little of a batch is held as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def texts(batch, name: str = "text") -> list[bytes]:
    """A binary column of an Arrow batch; null counts as empty."""
    return [x or b"" for x in batch.column(name).to_pylist()]
