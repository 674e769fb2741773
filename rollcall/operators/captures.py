"""Capture checks, decoding and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import COMMAND_FAILED, FAMILIES, FINGER_BITS, HANDS, PAIRS, STATUS_NAMES, lookup


def check_capture_shape(df: DataFrame, width: int = 400, height: int = 500, length: Column | None = None) -> DataFrame:
    """P1. Adds `reason`: dimensions are tested before the byte length; null when the contract holds."""
    n = length if length is not None else F.octet_length("data")
    bad = ~F.coalesce((F.col("width") == width) & (F.col("height") == height), F.lit(False))
    return df.withColumn("reason", F.when(bad, "BAD_DIMENSIONS").when(~F.coalesce(n == width * height, F.lit(False)), "BAD_LENGTH"))


def decode_codes(df: DataFrame, col: str, table: dict, policy: str, default: str | None = None, out: str | None = None) -> DataFrame:
    """P2. policy 'default' maps unknown codes to `default`; 'reject' gives null and a reason."""
    out, value = out or f"{col}_name", lookup(F.col(col), table)
    if policy == "default":
        return df.withColumn(out, F.coalesce(value, F.lit(default)))
    if policy != "reject":
        raise ValueError(policy)
    return df.withColumn(out, value).withColumn(f"{out}_reason", F.when(F.col(out).isNull(), "UNKNOWN_CODE"))


def decode_quality_array(df: DataFrame, col: str, table: dict, out: str = "qualities") -> DataFrame:
    """P3. One unknown code suppresses the whole array."""
    ok = F.forall(col, lambda c: F.coalesce(lookup(c, table).isNotNull(), F.lit(False)))
    return df.withColumn(out, F.when(ok, F.transform(col, lambda c: lookup(c, table))))


def classify_status(df: DataFrame, code_col: str) -> DataFrame:
    """P4. severity, effective_code (an unknown code counts as COMMAND_FAILED), its name, and family."""
    raw = F.col(code_col)
    code = F.when(raw.isin(list(STATUS_NAMES)), raw).otherwise(F.lit(COMMAND_FAILED))
    family = F.coalesce(*[F.when(F.col("effective_code").between(lo, hi), F.lit(name)) for lo, hi, name in FAMILIES])
    severity = F.when(F.col("effective_code") == 0, "OK").when(F.col("effective_code") < 0, "ERROR").otherwise("WARNING")
    return df.withColumn("effective_code", F.when(raw.isNotNull(), code)).withColumn("severity", F.when(raw.isNotNull(), severity)).withColumn("family", family).withColumn("status_name", lookup(F.col("effective_code").cast("int"), STATUS_NAMES))


def decode_finger_mask(df: DataFrame, col: str) -> DataFrame:
    """P5. Sorted finger names, their number, flags of hands and thumbs (any finger of them) and of pairs (both fingers)."""
    m = F.col(col)
    names = F.array_sort(F.filter(F.array(*[F.when(m.bitwiseAND(b) != 0, F.lit(n)) for b, n in FINGER_BITS.items()]), lambda x: x.isNotNull()))
    flags = {n: m.bitwiseAND(b) != 0 for n, b in HANDS.items()} | {n: m.bitwiseAND(b) == b for n, b in PAIRS.items()}
    return df.withColumns({"fingers": names, "n_fingers": F.bit_count(m.bitwiseAND(1023)), **flags})


def encode_finger_mask(df: DataFrame, col: str, out: str = "mask") -> DataFrame:
    """P5. Mask of an array of finger names; unknown names add nothing."""
    bit = lambda x: F.coalesce(lookup(x, {n: b for b, n in FINGER_BITS.items()}), F.lit(0))
    return df.withColumn(out, F.aggregate(col, F.lit(0), lambda s, x: s.bitwiseOR(bit(x))))


def capture_option_mask(df: DataFrame, options_col: str, forced: int = 7) -> DataFrame:
    """P6. OR of the options, and the mask in effect once the forced flags are added."""
    return df.withColumn("mask", F.aggregate(options_col, F.lit(0), lambda a, b: a.bitwiseOR(b))).withColumn("effective_mask", F.col("mask").bitwiseOR(F.lit(forced)))


def flatten_segments(df: DataFrame, images: str = "images", positions: str = "positions", count: str = "finger_count") -> DataFrame:
    """P16. One row per segment, with ordinal; a mismatch of counts is reported, missing sides are null."""
    bad = (F.size(images) != F.size(positions)) | (F.size(positions) != F.col(count))
    rest = [c for c in df.columns if c not in (images, positions, count)]
    return df.select(*rest, bad.alias("count_mismatch"), F.posexplode_outer(F.arrays_zip(F.col(images).alias("image"), F.col(positions).alias("position"))).alias("ordinal", "s")).select(
        *rest, "count_mismatch", "ordinal", F.col("s.image").alias("image"), F.col("s.position").alias("position"))


def acquisition_gate(df: DataFrame, min_quality: int, min_liveness: int) -> DataFrame:
    """P17. Adds `reason`: NOT_FINAL, LOW_QUALITY or LOW_LIVENESS, in that order; null when accepted."""
    low = lambda c, n: ~F.coalesce(F.col(c) >= n, F.lit(False))
    return df.withColumn("reason", F.when(~F.coalesce("is_final", F.lit(False)), "NOT_FINAL").when(low("quality", min_quality), "LOW_QUALITY").when(low("liveness", min_liveness), "LOW_LIVENESS"))


def duplicate_captures(df: DataFrame) -> DataFrame:
    """A1. Captures of equal size and content: digests are grouped, payloads never shuffled."""
    g = df.select("width", "height", F.sha2("data", 256).alias("digest"), F.octet_length("data").alias("n_bytes"), "capture_id")
    return g.groupBy("width", "height", "digest", "n_bytes").agg(F.count("*").alias("n"), F.min("capture_id").alias("first_id")).where("n > 1")


def quality_report(df: DataFrame, keys: list[str], table: dict, code: str = "quality_code", nfiq: str | None = None) -> DataFrame:
    """A3. Counts by quality state, share of GOOD among known states, and NFIQ histogram and mean."""
    name = lookup(F.col(code), table)
    out = [F.count_if(name == n).alias("n_" + n.lower()) for n in table.values()]
    out += [F.count_if(name.isNull()).alias("n_unknown"), F.round(F.count_if(name == "GOOD") / F.nullif(F.count(name), F.lit(0)), 6).alias("good_rate")]
    if nfiq:
        out += [F.count_if(F.col(nfiq) == i).alias(f"nfiq_{i}") for i in range(1, 6)] + [F.round(F.avg(nfiq), 6).alias("nfiq_mean")]
    return df.groupBy(*keys).agg(*out)
