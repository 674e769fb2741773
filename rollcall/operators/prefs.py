"""Preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import CHUNK, Scan, scanned

TYPES = {"string": "string", "int": "int", "long": "bigint", "boolean": "boolean", "float": "float", "double": "double"}


def decode_kv(df: DataFrame, json_schema: str | None = None) -> DataFrame:
    """P13. `decoded` (as text of the typed value) and `reason` BAD_VALUE; other tags are JSON of the schema."""
    typed = F.coalesce(*[F.when(F.col("type_tag") == tag, F.expr(f"cast(try_cast(value AS {t}) AS string)")) for tag, t in TYPES.items()],
                       F.when(~F.col("type_tag").isin(list(TYPES)), F.to_json(F.from_json("value", json_schema)) if json_schema else F.col("value")))
    return df.withColumn("decoded", typed).withColumn("reason", F.when(F.col("value").isNotNull() & F.col("decoded").isNull(), "BAD_VALUE"))


def kv_snapshot(log: DataFrame, as_of=None) -> DataFrame:
    """W7. Last write per (ns, key) up to a time; a tombstone drops the key."""
    x = log if as_of is None else log.where(F.col("ts") <= F.lit(as_of).cast("timestamp"))
    rest = [c for c in x.columns if c not in ("ns", "key")]
    return x.groupBy("ns", "key").agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("s")).select("ns", "key", "s.*").where("not deleted")


def token_intervals(log: DataFrame, key: str = "token", chunk: int | None = CHUNK) -> DataFrame:
    """W8. Validity of each written token: until the next write or removal. Namespaces of more than `chunk` rows are scanned by chunks."""

    def work(x: DataFrame, s: Scan) -> DataFrame:
        x = s.carry(x, after=True, _next=(F.min("ts"), F.min))
        x = x.withColumn("valid_to", F.coalesce(F.lead("ts").over(s.window), "_next")).where("not deleted")
        return x.select("ns", "seq", F.col("ts").alias("valid_from"), "valid_to")

    return scanned(log.where(F.col("key") == key), work, "ns", ("ts", "seq"), chunk)


def resolve_locale(users: DataFrame, prefs: DataFrame, supported: DataFrame, fallback: str = "en") -> DataFrame:
    """J9. Stored preference (not validated again), else the supported system language, else the fallback."""
    x = users.join(prefs.select("user_id", F.col("locale").alias("stored")), "user_id", "left").join(supported.select(F.col("code").alias("found")).distinct(), F.col("language") == F.col("found"), "left")
    return x.select("user_id", F.coalesce("stored", "found", F.lit(fallback)).alias("locale"), F.when(F.col("stored").isNotNull(), "STORED").when(F.col("found").isNotNull(), "SYSTEM").otherwise("FALLBACK").alias("origin"))
