"""Device event log (U1, P14, P15, W1-W6, J6, J7, J10, A4, A5, A7, A8). Order is (ts, seq).

W2-W6 and J10 scan a device's rows in order; devices of more than `chunk` rows are scanned by chunks (see scan), with the same rows
as a result. Whether there are any is a job when the plan is made; chunk=None leaves it out and scans whole devices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import PROPERTY_EXTRA, PROPERTY_LISTS, PROPERTY_RANGES
from .captures import classify_status
from .scan import CHUNK, Scan, last_known, scanned

VENDOR = 0x113F


ORDER = ("ts", "seq")


def _latest(*cols: Column | str) -> Column:
    """The columns' values in the last row, as a struct."""
    return F.max_by(F.struct(*cols), F.struct(*ORDER))


def _last_not_null(c: str) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*ORDER)))


def union_channels(*channels: DataFrame) -> DataFrame:
    """U1. One tagged log of several channels; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), channels)


def only_kind(df: DataFrame, kind: str, columns: list[str] | None = None) -> DataFrame:
    """P14. One case of the tagged log and its columns; the filter reaches the scan."""
    out = df.where(F.col("kind") == kind)
    return out.select(*columns) if columns else out


def console_state(df: DataFrame) -> DataFrame:
    """P15. Attached and Initialize are usable, Detached is idle, Ready shows as loading; only while the session is SUCCESS."""
    usable, s = F.col("kind").isin("Attached", "Initialize"), F.col("session_state")
    state = F.when(s == "ERROR", "ERROR").when(s == "LOADING", "LOADING").when(s != "SUCCESS", "DEFAULT").when(
        F.col("kind") == "Error", "ERROR").when(usable, "SUCCESS").when(F.col("kind") == "Ready", "LOADING").otherwise("DEFAULT")
    return df.withColumn("state", state).withColumn("usable_device", F.when(state == "SUCCESS", F.col("device_id")))


def latest_state(df: DataFrame, key: str = "device_id", default: tuple[DataFrame, str] | None = None) -> DataFrame:
    """W1. The last row of each key; keys of `default` without rows get its kind."""
    rest = [c for c in df.columns if c != key]
    out = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("s")).select(key, "s.*")
    if default:
        keys, kind = default
        out = keys.select(key).distinct().join(out, key, "left").withColumn("kind", F.coalesce("kind", F.lit(kind)))
    return out


def distinct_until_changed(df: DataFrame, cols: list[str], key: str = "device_id", chunk: int | None = CHUNK) -> DataFrame:
    """W2. Rows that differ, null-safe, from the row before them; the first one stays."""

    def work(x: DataFrame, s: Scan) -> DataFrame:
        x = s.carry(x, _before=(_latest(*cols), F.last)).withColumn("_first", s.first())
        before = lambda c: F.when(F.col("_first"), F.col("_before")[c]).otherwise(F.lag(c).over(s.window))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(before(c)) for c in cols])
        return x.withColumn("_same", same & (~F.col("_first") | F.col("_before").isNotNull())).where(~F.col("_same")).select(df.columns)

    return scanned(df, work, key, ORDER, chunk)


def device_sessions(df: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """W3. From Attached to the next Detached; a repeated Attached opens nothing; the last may stay open."""
    flag = F.when(F.col("kind") == "Attached", 1).when(F.col("kind") == "Detached", 0)

    def work(x: DataFrame, s: Scan) -> DataFrame:
        x = s.carry(x, _flag=(_last_not_null("flag"), last_known))
        before = F.coalesce(F.last("flag", ignorenulls=True).over(s.before), "_flag", F.lit(0))
        x = x.withColumn("attached", before).withColumn("opens", F.when((F.col("flag") == 1) & (F.col("attached") == 0), 1).otherwise(0))
        x = s.carry(x.drop("_flag"), _opened=(F.sum("opens"), F.sum))
        x = x.withColumn("session", F.sum("opens").over(s.so_far) + F.coalesce("_opened", F.lit(0)))
        closes = (F.col("flag") == 0) & (F.col("attached") == 1)
        return x.where((F.col("attached") == 1) | (F.col("opens") == 1)).select("device_id", "session", "ts", "kind", closes.alias("closes"))

    x = scanned(df.select("device_id", *ORDER, "kind", flag.alias("flag")), work, "device_id", ORDER, chunk)
    return x.groupBy("device_id", "session").agg(
        F.min("ts").alias("opened"), F.max(F.when(F.col("closes"), F.col("ts"))).alias("closed"), F.count_if(F.col("kind") == "Error").alias("n_errors")
    ).withColumn("duration_us", F.unix_micros("closed") - F.unix_micros("opened"))


def capture_cycles(df: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """W4. A cycle opens at each Default; first platen, process, acquired and result times; COMPLETED, ERROR or ABANDONED."""
    opens = F.sum(F.when(F.col("kind") == "Default", 1).otherwise(0))

    def work(x: DataFrame, s: Scan) -> DataFrame:
        x = s.carry(x, _cycles=(opens, F.sum))
        return x.withColumn("cycle", opens.over(s.so_far) + F.coalesce("_cycles", F.lit(0))).where("cycle > 0").select("device_id", "cycle", "ts", "kind")

    x = scanned(df.select("device_id", *ORDER, "kind"), work, "device_id", ORDER, chunk)
    first = {k.lower(): F.min(F.when(F.col("kind") == k, F.col("ts"))).alias(k.lower()) for k in ("Platen", "Process", "Acquired", "Result")}
    out = x.groupBy("device_id", "cycle").agg(F.min("ts").alias("opened"), *first.values(), F.count_if(F.col("kind") == "Error").alias("n_errors"))
    return out.withColumn("outcome", F.when(F.col("n_errors") > 0, "ERROR").when(F.col("result").isNotNull(), "COMPLETED").otherwise("ABANDONED")).withColumn(
        "latency_us", F.unix_micros("result") - F.unix_micros("opened"))


def init_progress(df: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """W5. Running maximum of Initialize progress, completion and regressions."""

    def work(x: DataFrame, s: Scan) -> DataFrame:
        x = s.carry(x, _best=(F.max("progress"), F.max), _last=(_latest("progress"), F.last))
        before = F.when(s.first(), F.col("_last")["progress"]).otherwise(F.lag("progress").over(s.window))
        x = x.withColumn("best", F.greatest(F.max("progress").over(s.so_far), "_best")).withColumn("completed", F.col("best") >= 100)
        return x.withColumn("regressed", F.coalesce(F.col("progress") < before, F.lit(False))).select(*df.columns, "best", "completed", "regressed")

    return scanned(only_kind(df, "Initialize"), work, "device_id", ORDER, chunk)


def debounce(df: DataFrame, ms: int, key: str = "device_id", chunk: int | None = CHUNK) -> DataFrame:
    """W6. Events without another one of their key within ms after them; the last one stays."""

    def work(x: DataFrame, s: Scan) -> DataFrame:
        x = s.carry(x, after=True, _next=(F.min("ts"), F.min))
        gap = F.unix_micros(F.coalesce(F.lead("ts").over(s.window), "_next")) - F.unix_micros("ts")
        return x.withColumn("_gap", gap).where(F.coalesce(F.col("_gap") >= ms * 1000, F.lit(True))).select(df.columns)

    return scanned(df, work, key, ORDER, chunk)


def combine_latest(a: DataFrame, b: DataFrame, key: str = "device_id", chunk: int | None = CHUNK) -> DataFrame:
    """J10. At each event of either stream, the latest kind of both. Rows before both have spoken are left out."""
    u = a.select(key, *ORDER, F.col("kind").alias("a_kind")).unionByName(b.select(key, *ORDER, F.col("kind").alias("b_kind")), allowMissingColumns=True)

    def work(x: DataFrame, s: Scan) -> DataFrame:
        x = s.carry(x, _a=(_last_not_null("a_kind"), last_known), _b=(_last_not_null("b_kind"), last_known))
        both = [F.coalesce(F.last(c, ignorenulls=True).over(s.so_far), before).alias(c) for c, before in (("a_kind", "_a"), ("b_kind", "_b"))]
        return x.select(key, *ORDER, *both).where("a_kind is not null and b_kind is not null")

    return scanned(u, work, key, ORDER, chunk).withColumn("ready_to_scan", (F.col("a_kind") == "Platen") & F.col("b_kind").isin("Initialize", "Ready"))


def error_breakdown(df: DataFrame) -> DataFrame:
    """A4. Errors by device, severity and family, with their share of the device."""
    x = classify_status(only_kind(df, "Error"), "status_code").groupBy("device_id", "severity", "family").agg(F.count("*").alias("n"))
    return x.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("device_id")), 6))


def retry_outcomes(attempts: DataFrame, keys: list[str], cap: int = 3, locked: int = -6) -> DataFrame:
    """A5. Attempts up to the first success or other failure, `cap` at most: CLOSED, FAILED or EXHAUSTED. A sequence
    that ends on a locked resource before the cap counts as FAILED."""
    w = Window.partitionBy(*keys).orderBy("ts", "seq")
    x = attempts.withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap)
    end = F.min(F.when(F.col("status_code") != locked, F.col("k")))
    out = x.groupBy(*keys).agg(end.alias("end"), F.max("k").alias("last"), F.min_by("status_code", F.when(F.col("status_code") != locked, F.col("k"))).alias("code"))
    return out.select(*keys, F.coalesce("end", "last").alias("attempts"), F.when(F.col("code") == 0, "CLOSED").when(F.col("end").isNull() & (F.col("last") >= cap), "EXHAUSTED").otherwise("FAILED").alias("outcome"))


def accessible_devices(devices: DataFrame, permissions: DataFrame) -> DataFrame:
    """J6. Devices of the vendor with a permission."""
    return devices.where(F.col("vendor_id") == VENDOR).join(permissions.select("device_id"), "device_id", "left_semi")


def blocked_devices(devices: DataFrame, permissions: DataFrame) -> DataFrame:
    """J7. Devices of the vendor without permission; without any device of the vendor one DEVICE_NOT_FOUND row."""
    own = devices.where(F.col("vendor_id") == VENDOR)
    denied = own.join(permissions.select("device_id"), "device_id", "left_anti").select("device_id", F.lit("PERMISSION_DENIED").alias("error"))
    none = own.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("long").alias("device_id"), F.lit("DEVICE_NOT_FOUND").alias("error"))
    return denied.unionByName(none)


def fleet_inventory(devices: DataFrame) -> DataFrame:
    """A7. Devices by product, interface (if given), firmware and opened flag."""
    keys = [c for c in ("product", "interface_type", "fw_version", "is_opened") if c in devices.columns]
    return devices.groupBy(*keys).agg(F.count("*").alias("n"))


def audit_properties(readings: DataFrame, rules: dict = PROPERTY_RANGES, extra: dict = PROPERTY_EXTRA, lists: dict = PROPERTY_LISTS) -> DataFrame:
    """A8. `verdict` of each reading: UNKNOWN property, NOT_NUMERIC, OUT_OF_RANGE or OK. Values of `lists` are several
    numbers; another count of them is OUT_OF_RANGE."""
    name, v = F.col("property"), F.expr("try_cast(value AS BIGINT)")
    many = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("bigint"))
    listed = name.isin(list(lists))
    ok: Column = F.lit(False)
    for p, (lo, hi) in rules.items():
        ok = ok | ((name == p) & (v.between(lo, hi) | v.isin(list(extra.get(p, ())) or [lo])))
    for p, (lo, hi, n) in lists.items():
        ok = ok | ((name == p) & (F.size(many) == n) & F.forall(many, lambda x: x.between(lo, hi)))
    numeric = F.when(listed, F.forall(many, lambda x: x.isNotNull())).otherwise(v.isNotNull())
    return readings.withColumn("verdict", F.when(~F.coalesce(name.isin([*rules, *lists]), F.lit(False)), "UNKNOWN").when(~F.coalesce(numeric, F.lit(False)), "NOT_NUMERIC").when(ok, "OK").otherwise("OUT_OF_RANGE"))


def property_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("property", "verdict").agg(F.count("*").alias("n"))
