"""Enrollment batches, finger slots and gallery synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import CHUNK, Scan, scanned


def enrollment_outcomes(batches: DataFrame, captures: DataFrame, min_quality: int) -> DataFrame:
    """A2. One bad capture rejects the batch, then one of low quality; no capture is EMPTY."""
    c = captures.groupBy("batch_id").agg(F.count("*").alias("n_captures"), F.count_if("shape_ok").alias("n_valid"), F.min("quality").alias("min_quality"))
    n = F.coalesce("n_captures", F.lit(0))
    reason = F.when(n == 0, "EMPTY").when(F.col("n_valid") < n, "BAD_CAPTURE").when(F.col("min_quality") < min_quality, "LOW_QUALITY")
    return batches.join(c, "batch_id", "left").select(
        "batch_id", "subject_id", n.alias("n_captures"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"), "min_quality", F.when(reason.isNull(), "ACCEPTED").otherwise("REJECTED").alias("outcome"), reason.alias("reason"))


def finger_slots(ops: DataFrame, chunk: int | None = CHUNK) -> tuple[DataFrame, DataFrame]:
    """W9. Replay of add and remove: each operation's result, and each session's final mask. An add on an
    occupied slot fails with ALREADY_USED unless forced; the slot stays occupied either way. Slots with more than `chunk`
    operations are replayed by chunks."""

    def work(x: DataFrame, s: Scan) -> DataFrame:
        # occupied before an operation: the one before it was an add (a failed add leaves it occupied)
        x = s.carry(x, _before=(F.max_by("op", "seq"), F.last))
        used = F.coalesce(F.when(s.first(), F.col("_before")).otherwise(F.lag("op").over(s.window)) == "add", F.lit(False))
        return x.withColumn("result", F.when((F.col("op") == "add") & used & ~F.col("force"), "ALREADY_USED").otherwise("OK")).select(*ops.columns, "result")

    x = scanned(ops.withColumn("_slot", F.struct("session_id", "finger_bit")), work, "_slot", ("seq",), chunk)
    last = ops.groupBy("session_id", "finger_bit").agg(F.max_by("op", "seq").alias("op"))
    mask = last.groupBy("session_id").agg(F.coalesce(F.bit_or(F.when(F.col("op") == "add", F.col("finger_bit"))), F.lit(0)).alias("mask"))
    return x, mask


def reconcile(device: DataFrame, server: DataFrame, key: str = "template_id") -> DataFrame:
    """J5. ONLY_DEVICE, ONLY_SERVER, STALE (the newer version wins) or SAME for each key."""
    x = device.select(key, F.col("version").alias("device_version")).join(server.select(key, F.col("version").alias("server_version")), key, "full")
    state = F.when(F.col("server_version").isNull(), "ONLY_DEVICE").when(F.col("device_version").isNull(), "ONLY_SERVER").when(F.col("device_version") == F.col("server_version"), "SAME").otherwise("STALE")
    return x.withColumn("state", state).withColumn("winner", F.when(F.coalesce("device_version", F.lit(-1)) >= F.coalesce("server_version", F.lit(-1)), "device").otherwise("server"))


def sync_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """U3. Rows added and removed between two versions, repeats counted."""
    return new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))
