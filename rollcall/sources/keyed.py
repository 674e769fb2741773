"""Keyed tables that are changed by parts (SNK1, and the sink of R1).

A table has a fixed number of buckets, by a hash of the key. A batch is reduced to one row a key, merged with the buckets that its
keys fall in, and only those are written anew, into a folder of their own; all other buckets stay where they are. A
manifest names the folder of every bucket and the batch that made it. It is written beside the last one and takes its place
by a rename, which is the only step that readers see: a write that breaks off before it leaves the table as it was, and what it
left behind goes with the next batch. Manifests but the last KEEP, and folders that only those name, are deleted.

    <path>/manifests/00000007.json   {"buckets": 256, "keys": [...], "batch": "...", "folders": {"12": "data/7-<id>/_bucket=12"}}
    <path>/data/7-<id>/_bucket=12/   rows of bucket 12
    <path>/applied/<batch>           a mark for every batch that was applied

A batch id is applied once, whatever its rows. One writer at a time: of two, the second one's rename fails. Null keys are keys.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table, and versions that stay readable.
BUCKETS, KEEP = 256, 3


class Folder:
    """Files of a table, through the file system that its path belongs to."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._io = path.rstrip("/"), spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._at(f"{self.path}/{name}")

    def names(self, name: str) -> list[str]:
        at = self._path(name)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def has(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def rename(self, old: str, new: str) -> None:
        if self.has(new) or not self._fs.rename(self._path(old), self._path(new)):
            raise RuntimeError(f"{new} is there already: another writer was faster")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def _manifests(folder: Folder) -> list[int]:
    return [int(x[:-5]) for x in folder.names("manifests") if x.endswith(".json")]


def _manifest(folder: Folder, version: int) -> dict:
    return json.loads(folder.read(f"manifests/{version:08d}.json"))


def _mark(batch_id: str) -> str:
    return f"applied/{quote(str(batch_id), safe='')}"


def read_keyed(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The rows of the last version, or of an older one that is still kept."""
    folder = Folder(spark, path)
    there = _manifests(folder)
    if not there:
        return spark.createDataFrame([], schema)
    folders = _manifest(folder, max(there) if version is None else version)["folders"].values()
    return spark.read.schema(schema).parquet(*[f"{folder.path}/{x}" for x in folders]) if folders else spark.createDataFrame([], schema)


def latest(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row a key, the greatest in `order`; equal ones by their other columns."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("s")).select(*keys, "s.*").select(df.columns)


def upsert(df: DataFrame, path: str, batch_id: str, keys: tuple[str, ...], order: tuple[str, ...], buckets: int = BUCKETS, keep: int = KEEP) -> list[int]:
    """Applies a batch and returns the buckets that were written: none if the batch was applied before or has no rows."""
    spark, folder = df.sparkSession, Folder(df.sparkSession, path)
    there = _manifests(folder)
    last = max(there, default=-1)
    now = _manifest(folder, last) if there else {"buckets": buckets, "keys": list(keys), "batch": None, "folders": {}}
    if now["keys"] != list(keys):
        raise ValueError(f"the table's keys are {now['keys']}")
    if now["batch"] is not None:
        folder.write(_mark(now["batch"]), "")  # it may have broken off just before
    if folder.has(_mark(batch_id)):
        return []
    used = {f.split("/")[1] for v in there for f in _manifest(folder, v)["folders"].values()}
    for left in set(folder.names("data")) - used:
        folder.delete(f"data/{left}")

    bucket = F.pmod(F.xxhash64(*keys), F.lit(now["buckets"])).cast("int")
    new = f"data/{last + 1}-{uuid.uuid4().hex}"
    part = latest(df, keys, order).withColumn("_bucket", bucket)
    part.write.parquet(f"{folder.path}/{new}/batch")
    part = spark.read.schema(part.schema).parquet(f"{folder.path}/{new}/batch")
    touched = sorted(r[0] for r in part.select("_bucket").distinct().collect())  # as many as there are buckets at most
    old = [f"{folder.path}/{now['folders'][str(b)]}" for b in touched if str(b) in now["folders"]]
    if old:
        part = part.unionByName(spark.read.schema(df.schema).parquet(*old).withColumn("_bucket", bucket))
    if touched:
        # a bucket is merged where it is written: one shuffle
        rows = part.repartition(len(touched), "_bucket")
        latest(rows, ("_bucket", *keys), order).write.partitionBy("_bucket").mode("append").parquet(f"{folder.path}/{new}")
    folder.delete(f"{new}/batch")
    folders = now["folders"] | {str(b): f"{new}/_bucket={b}" for b in touched}
    _commit(folder, last + 1, now | {"batch": str(batch_id), "folders": folders})
    folder.write(_mark(batch_id), "")
    _expire(folder, keep)
    return touched


def _commit(folder: Folder, version: int, manifest: dict) -> None:
    name = f"manifests/{version:08d}.json"
    folder.write(f"{name}.new", json.dumps(manifest))
    folder.rename(f"{name}.new", name)


def _expire(folder: Folder, keep: int) -> None:
    """Deletes all manifests but the last, and the folders that no other one names."""
    there = _manifests(folder)
    old, kept = there[:-keep], there[-keep:]
    if old:
        live = {f for v in kept for f in _manifest(folder, v)["folders"].values()}
        for v in old:
            for f in set(_manifest(folder, v)["folders"].values()) - live:
                folder.delete(f)
            folder.delete(f"manifests/{v:08d}.json")
