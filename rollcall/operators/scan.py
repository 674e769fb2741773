"""Ordered scans over keys of any size.

A window holds all rows of a key in one task. Keys of more than CHUNK rows are therefore cut into chunks: their rows
are dealt out by ranges of (key, order), so that every chunk holds neighbouring rows and several tasks share a key.
A scan then runs in each chunk by itself, and what it needs to know of the chunks before (or after) it comes from one
summary row a chunk. Keys without that many rows are scanned by plain windows, in the same code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import fresh_folder

#: Rows of a key that one task scans at most.
CHUNK = 2_000_000


def last_known(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def split_busy(df: DataFrame, key: str, order: tuple[str, ...], chunk: int | None = CHUNK) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys of up to `chunk` rows, and those of the other keys with `_chunk`, or None if there are none.

    Counting the rows of each key is a job of its own; with None as chunk nothing is counted or cut. Chunks are stored, since ranges are found by sampling and must not be
    found twice; rows that are equal in key and order share a chunk."""
    if chunk is None:
        return df, None
    sizes = df.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > chunk)
    if sizes.isEmpty():
        return df, None
    spark, path = df.sparkSession, fresh_folder(df.sparkSession, "busy")
    sizes.write.parquet(f"{path}/keys")
    busy = spark.read.schema(sizes.schema).parquet(f"{path}/keys")  # fewer rows than one for each `chunk` rows of df
    total = busy.agg(F.sum("_rows")).first()[0]
    named = F.broadcast(busy.select(F.col(key).alias("_key")))
    same = F.col(key).eqNullSafe(F.col("_key"))
    # half a chunk on average, so that uneven samples don't make one larger than a chunk
    rows = df.join(named, same, "left_semi").repartitionByRange(-(-2 * total // chunk), key, *order).withColumn("_chunk", F.spark_partition_id())
    rows.write.parquet(f"{path}/rows")
    return df.join(named, same, "left_anti"), spark.read.schema(rows.schema).parquet(f"{path}/rows")


class Scan:
    """The partition of a scan: a key, or a chunk of one."""

    def __init__(self, key: str, order: tuple[str, ...], chunked: bool):
        self.key, self.chunked = key, chunked
        self.keys = [key, "_chunk"] if chunked else [key]
        self.window = Window.partitionBy(*self.keys).orderBy(*order)
        self.so_far = self.window.rowsBetween(Window.unboundedPreceding, 0)
        self.before = self.window.rowsBetween(Window.unboundedPreceding, -1)

    def first(self) -> Column:
        """The partition's first row; another chunk may come before it."""
        return F.row_number().over(self.window) == 1

    def carry(self, rows: DataFrame, after: bool = False, **sums: tuple[Column, Callable[[Column], Column]]) -> DataFrame:
        """Adds what the chunks before (or after) a row's chunk come to: an aggregate of each chunk, and how to put those of several
        chunks together, in order. Null where there is no such chunk."""
        kinds = {name: rows.agg(of.alias(name)).schema[name].dataType for name, (of, _) in sums.items()}
        if not self.chunked:
            return rows.withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.items()})
        there = (1, Window.unboundedFollowing) if after else (Window.unboundedPreceding, -1)
        chunks = Window.partitionBy(self.key).orderBy("_chunk").rowsBetween(*there)
        each = rows.groupBy(*self.keys).agg(*[of.alias(name) for name, (of, _) in sums.items()])
        each = each.select(F.col(self.key).alias("_key"), F.col("_chunk").alias("_of"), *[put(F.col(name)).over(chunks).alias(name) for name, (_, put) in sums.items()])
        # a chunk a row: fewer than two for each chunk of rows
        return rows.join(F.broadcast(each), F.col(self.key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_of"))).drop("_key", "_of")


def scanned(df: DataFrame, work: Callable[[DataFrame, Scan], DataFrame], key: str = "device_id", order: tuple[str, ...] = ("ts", "seq"), chunk: int | None = CHUNK) -> DataFrame:
    """work(rows, scan) over whole keys, and over the chunks of keys that have more than `chunk` rows."""
    quiet, busy = split_busy(df, key, order, chunk)
    out = work(quiet, Scan(key, order, False))
    return out if busy is None else out.unionByName(work(busy, Scan(key, order, True)))
