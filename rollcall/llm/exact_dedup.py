"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Flush: each task is a memtable; it sorts the digests of its rows and writes them as one run. Filters:
every run marks the digest of each of its rows at one of `bits` positions (16 a row or more); where
two rows or more have marked a position, the filters say "maybe". Compaction merges only the entries
that are maybes, into one row a digest: the entry that stays and the number of entries; all others are
unique and need no merge. The entry that stays has the largest doc_id; of equal ones that with the smallest
hash of the whole row, then the first. Hits, that is rows whose digest occurs more than once, are found
again in the texts by a second filter over the merged level and verified byte by byte: they are grouped by
digest and text. Digests with several texts, if any, are split by text.

Filters are broadcast, up to FILTER_BYTES; for tables that need larger ones every entry is merged, and hits are
found by a shuffle. Nulls: a null text counts as empty, a null doc_id as smaller than every other. Of rows that
repeat both doc_id and text one is kept. An empty table gives an empty result. Further columns take part
in the hash of the row only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, by_row, drop, join_unique, keep, numbered, row_hash

#: The largest filter that is broadcast, and positions a marked digest.
FILTER_BYTES, SPARSE = 64 << 20, 16


def _normalised(docs: DataFrame, hex_digits: int) -> DataFrame:
    """digest, doc_id, norm, text_sha256, h, rid."""
    rid = F.col("__row") if "__row" in docs.columns else F.monotonically_increasing_id()
    rows = docs.select("doc_id", ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("norm"), row_hash(docs).alias("h"), rid.alias("rid"))
    rows = rows.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    return rows.withColumn("digest", F.substring("text_sha256", 1, hex_digits))


def flush(docs: DataFrame, hex_digits: int = 64) -> DataFrame:
    """Sorted runs, one a task: digest, doc_id, h (hash of the row), rid (number of the row), text_sha256."""
    return keep(_normalised(docs, hex_digits).select("digest", "doc_id", "h", "rid", "text_sha256"), "runs", sort=["digest"])


def compact(runs: DataFrame) -> DataFrame:
    """One row per digest: digest, first (the entry that stays), group_size."""
    first = F.max(F.struct(F.col("doc_id"), F.bitwise_not("h").alias("least"), (-F.col("rid")).alias("back"))).alias("first")
    return keep(runs.groupBy("digest").agg(first, F.count("*").alias("group_size")), "level", sort=["digest"])


def filter_bits(n: int) -> int | None:
    """Positions of a filter of n digests, a power of two; None if it can't be broadcast."""
    bits = 1 << max(15, (SPARSE * max(n, 1) - 1).bit_length())
    return bits if bits <= 8 * FILTER_BYTES else None


def _position(bits: int):
    return F.pmod(F.xxhash64("digest"), F.lit(bits))


def _bitmaps(positions: DataFrame) -> DataFrame:
    """bucket, map (32768 bits) of the given `p`."""
    return positions.groupBy(F.shiftright("p", 15).alias("bucket")).agg(F.expr("bitmap_construct_agg(p & 32767)").alias("map"))


def _probe(rows: DataFrame, maps: DataFrame, bits: int) -> DataFrame:
    """Adds `maybe`: the filter has the row's digest."""
    rows = rows.withColumn("p", _position(bits))
    rows = rows.join(F.broadcast(maps), F.shiftright(rows.p, 15) == maps.bucket, "left")
    byte = F.expr("cast(conv(hex(substring(map, cast((p & 32767) div 8 + 1 as int), 1)), 16, 10) as long)")
    return rows.withColumn("maybe", F.coalesce(F.getbit(byte, (F.col("p") % 8).cast("int")) == 1, F.lit(False))).drop("p", "bucket", "map")


def probed(runs: DataFrame) -> DataFrame:
    """The runs' entries with `maybe`: another entry, of this run or another, may have the same digest."""
    bits = filter_bits(runs.count())
    if bits is None:
        return runs.withColumn("maybe", F.lit(True))
    marked = runs.groupBy(_position(bits).alias("p")).count().where("count > 1")
    return _probe(runs, keep(_bitmaps(marked), "filter"), bits)


def _hits(docs: DataFrame, repeated: DataFrame, hex_digits: int) -> DataFrame:
    """Rows that share a digest (and a few others that the filter lets through): digest, norm."""
    rows, bits = _normalised(docs, hex_digits).select("digest", "norm"), filter_bits(repeated.count())
    if bits is None:
        return rows.join(repeated, "digest", "left_semi")
    return _probe(rows, _bitmaps(repeated.select(_position(bits).alias("p"))), bits).where("maybe")


def dedup(docs: DataFrame, hex_digits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; hex_digits shortens the index's
    digests (tests use it to provoke collisions)."""
    return _entries(docs, hex_digits).drop("rid")


def _entries(docs: DataFrame, hex_digits: int = 64) -> DataFrame:
    runs = flush(docs, hex_digits)
    marked = probed(runs)
    level = compact(marked.where("maybe"))
    variants = _hits(docs, level.where("group_size > 1").select("digest"), hex_digits).groupBy("digest", "norm").agg(F.count("*").alias("n"))
    clash = keep(variants.groupBy("digest").agg(F.count("*").alias("k")).where("k > 1").select("digest"), "clash")
    if not clash.isEmpty():
        # digests of several texts are replaced by the digest of the whole text, and the index built anew
        if hex_digits >= 64:
            raise ValueError("two texts share a SHA-256 digest")
        runs = keep(runs.join(clash.withColumn("several", F.lit(True)), "digest", "left").withColumn(
            "digest", F.when(F.col("several"), F.col("text_sha256")).otherwise(F.col("digest"))).drop("several"), "runs")
        marked = probed(runs)
        level = compact(marked.where("maybe"))
    drop(clash)
    total = level.agg(F.sum("group_size")).first()[0] or 0
    merged = join_unique(marked.where("maybe").drop("maybe"), level, "digest", "group_size", total)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "rid"]
    merged = merged.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == -F.col("first.back")).alias("kept"), "text_sha256", "rid")
    alone = marked.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "rid")
    return merged.select(columns).unionByName(alone)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The input's rows that dedup() keeps, with all their columns."""
    rows = numbered(docs)
    gone = keep(_entries(rows).where(~F.col("kept")).select(F.col("rid").alias("__row")), "gone")
    return by_row(rows, gone, "left_anti").select(docs.columns)
