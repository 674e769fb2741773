"""The operators as queries over the given tables, each with its SQL. Times leave as microseconds."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import accounts, attendance, captures, devices, enrollment, matching, prefs
from ..sources import keyed, tables
from ..streaming import events as st
from . import fixtures as fx

QUERIES: dict = {}
ORACLE: dict = {}


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text, times as microseconds, dates as text."""
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        out.append((F.unix_micros(c) if kind == "timestamp" else c.cast("string") if kind == "date" else F.array_join(c, ",") if kind == "array" else c).alias(f.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None, **ctes: str):
    """Registers a query; the fixtures named become CTEs of its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, d: flat(f(spark, d))
        if oracle:
            head = ", ".join(f"{k} AS ({v})" for k, v in ctes.items())
            text = re.sub(r"count_if\(((?:[^()]|\([^()]*\))*)\)", r"count(CASE WHEN \1 THEN 1 END)", f"WITH {head} {oracle}" if head else oracle)
            ORACLE[name] = fx.sql(text, "duckdb")
        return f

    return add


def case(col: str, table: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + " END"


def log(spark, d):
    return fx.load(spark, d, fx.F3)


DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
W = "PARTITION BY device_id ORDER BY ts, seq"

# -- sources and sinks


@query("src1_templates", "SELECT vec_id AS template_id, label AS subject_id, len(embedding) AS dims FROM embeddings")
def _(s, d):
    t = fx.table(s, d, "embeddings").select(F.col("vec_id").alias("template_id"), F.col("label").alias("subject_id"), F.col("embedding").alias("vector"))
    path = tables.fresh_folder(s, "templates")
    t.write.parquet(path)
    return tables.read_templates(s, path).select("template_id", "subject_id", F.size("vector").cast("long").alias("dims"))


@query("src1_captures", "SELECT capture_id, width, height, strlen(data)::INT AS n_bytes FROM f1", f1=fx.F1)
def _(s, d):
    path = tables.fresh_folder(s, "captures")
    fx.captures(s, d).select("capture_id", "width", "height", "data", "quality").write.parquet(path)
    return tables.read_captures(s, path).select("capture_id", "width", "height", F.octet_length("data").alias("n_bytes"))


@query("src2_event_log", "SELECT user_id, event_type, count(*) AS n, max(epoch_us(ts)) AS last_ts FROM events GROUP BY ALL")
def _(s, d):
    return tables.read_events(s, f"{d}/events.parquet").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query("src3_kv_log", "SELECT ns, count(*) AS n, count_if(deleted) AS n_deleted FROM f6 GROUP BY ns", f6=fx.F6)
def _(s, d):
    path = tables.fresh_folder(s, "kv")
    fx.load(s, d, fx.F6).write.parquet(path)
    return tables.read_kv_log(s, path).groupBy("ns").agg(F.count("*").alias("n"), F.count_if("deleted").alias("n_deleted"))


@query("snk1_gallery", """SELECT subject_id, finger_bit, max(template_id) AS template_id FROM f2 GROUP BY ALL""", f2=fx.F2)
def _(s, d):
    t = fx.load(s, d, fx.F2).select("subject_id", "finger_bit", "template_id")
    path = tables.fresh_folder(s, "gallery")
    for batch, part in (("a", t.where("template_id % 2 = 0")), ("b/1", t.where("template_id % 2 = 1")), ("a", t.where("template_id % 2 = 0"))):
        out = tables.upsert_gallery(part, path, batch, order=("template_id",))
    return out


P1 = "CASE WHEN width <> 400 OR height <> 500 THEN 'BAD_DIMENSIONS' WHEN byte_len <> 200000 THEN 'BAD_LENGTH' END"


@query("snk2_rejects", f"SELECT reason, count(*) AS n FROM (SELECT {P1} AS reason FROM f1) WHERE reason IS NOT NULL GROUP BY ALL", f1=fx.F1)
def _(s, d):
    _, bad = tables.split_rejects(captures.check_capture_shape(fx.captures(s, d), length=F.col("byte_len")))
    path = tables.fresh_folder(s, "rejects")
    for batch in ("1", "2", "2"):  # the repeated batch changes nothing
        tables.write_rejects(bad.where(f"capture_id % 2 = {batch} % 2").select("capture_id", "reason"), path, batch)
    return s.read.parquet(path).groupBy("reason").agg(F.count("*").alias("n"))


# -- projections and decoding


@query("p1_capture_bytes", "SELECT capture_id, CASE WHEN height <> 500 OR width < 400 THEN 'BAD_DIMENSIONS' WHEN strlen(data) <> width * 500 THEN 'BAD_LENGTH' END AS reason FROM f1", f1=fx.F1)
def _(s, d):
    """The payload's own bytes: captures of 400 columns against that contract, wider ones against 500 columns."""
    x = fx.captures(s, d)
    small, wide = x.where("width = 400"), x.where("width <> 400")
    return captures.check_capture_shape(small).unionByName(captures.check_capture_shape(wide, width=500)).select("capture_id", "reason")


@query("p1_capture_contract", f"SELECT capture_id, {P1} AS reason FROM f1", f1=fx.F1)
def _(s, d):
    return captures.check_capture_shape(fx.captures(s, d), length=F.col("byte_len")).select("capture_id", "reason")


@query("p2_decode_codes", f"""SELECT seq, coalesce({case('quality_code', codes.IMAGE_FORMAT)}, 'UNKNOWN') AS format, {case('quality_code', codes.FINGER_QUALITY)} AS quality,
    CASE WHEN {case('quality_code', codes.FINGER_QUALITY)} IS NULL THEN 'UNKNOWN_CODE' END AS quality_reason FROM f3""", f3=fx.F3)
def _(s, d):
    x = captures.decode_codes(log(s, d), "quality_code", codes.IMAGE_FORMAT, "default", "UNKNOWN", "format")
    return captures.decode_codes(x, "quality_code", codes.FINGER_QUALITY, "reject", out="quality").select("seq", "format", "quality", "quality_reason")


# Fixed values, written out apart from the operator's tables so that a mistake in either shows.
WIRE = {
    "image_type": """0 TYPE_NONE, 1 ROLL_SINGLE_FINGER, 2 FLAT_SINGLE_FINGER, 3 FLAT_TWO_FINGERS, 4 FLAT_FOUR_FINGERS, 5 FLAT_THREE_FINGERS""",
    "image_format": """0 GRAY, 1 RGB24, 2 RGB32, 3 UNKNOWN""",
    "resolution": """500 RESOLUTION_500, 1000 RESOLUTION_1000""",
    "finger_count": """0 FINGER_COUNT_OK, 1 TOO_MANY_FINGERS, 2 TOO_FEW_FINGERS, 3 NON_FINGER""",
    "finger_quality": """0 FINGER_NOT_PRESENT, 1 GOOD, 2 FAIR, 3 POOR, 4 INVALID_AREA_TOP, 5 INVALID_AREA_LEFT, 6 INVALID_AREA_RIGHT, 7 INVALID_AREA_BOTTOM""",
    "platen": """0 CLEARD, 1 HAS_FINGERS""",
    "rolling": """0 NOT_PRESENT, 1 TAKE_ACQUISITION, 2 COMPLETE_ACQUISITION, 3 RESULT_IMAGE""",
    "event_type": """1 COMMUNICATION_BROKEN, 2 PREVIEW_IMAGE_AVAILABLE, 3 ACQUISITION_BEGUN, 4 ACQUISITION_COMPLETED, 5 RESULT_IMAGE_AVAILABLE, 6 FINGER_QUALITY_CHANGED, 7 FINGER_COUNT_CHANGED, 9
        PLATEN_STATE_CHANGED, 11 WARNING_RECEIVED, 12 RESULT_IMAGE_EXTENDED_AVAILABLE, 13 KEYBUTTON""",
    "stored_format": """0 NO_BIT_PACKING, 1 BIT_PACKED, 2 WSQ, 3 JPEG_LOSSY, 4 JPEG2000_LOSSY, 5 JPEG2000_LOSSLESS, 6 PNG""",
    "impression_type": """0 LIVE_SCAN_PLAIN, 1 LIVE_SCAN_ROLLED, 2 NONLIVE_SCAN_PLAIN, 3 NONLIVE_SCAN_ROLLED, 4 LATENT_IMPRESSION, 5 LATENT_TRACING, 6 LATENT_PHOTO, 7 LATENT_LIFT, 8 LIVE_SCAN_SWIPE, 9
        LIVE_SCAN_VERTICAL_ROLL, 10 LIVE_SCAN_PALM, 11 NONLIVE_SCAN_PALM, 12 LATENT_PALM_IMPRESSION, 13 LATENT_PALM_TRACING, 14 LATENT_PALM_PHOTO, 15 LATENT_PALM_LIFT, 24
        LIVE_SCAN_OPTICAL_CONTRCTLESS_PLAIN, 28 OTHER, 29 UNKNOWN""",
    "finger_position": """0 UNKNOWN, 1 RIGHT_THUMB, 2 RIGHT_INDEX_FINGER, 3 RIGHT_MIDDLE_FINGER, 4 RIGHT_RING_FINGER, 5 RIGHT_LITTLE_FINGER, 6 LEFT_THUMB, 7 LEFT_INDEX_FINGER, 8 LEFT_MIDDLE_FINGER, 9
        LEFT_RING_FINGER, 10 LEFT_LITTLE_FINGER, 13 PLAIN_RIGHT_FOUR_FINGERS, 14 PLAIN_LEFT_FOUR_FINGERS, 15 PLAIN_THUMBS, 20 UNKNOWN_PALM, 21 RIGHT_FULL_PALM, 22 RIGHT_WRITERS_PALM, 23
        LEFT_FULL_PALM, 24 LEFT_WRITERS_PALM, 25 RIGHT_LOWER_PALM, 26 RIGHT_UPPER_PALM, 27 LEFT_LOWER_PALM, 28 LEFT_UPPER_PALM, 29 RIGHT_OTHER, 30 LEFT_OTHER, 31 RIGHT_INTERDIGITAL, 32
        RIGHT_THENAR, 33 RIGHT_HYPOTHENAR, 34 LEFT_INTERDIGITAL, 35 LEFT_THENAR, 36 LEFT_HYPOTHENAR, 40 RIGHT_INDEX_AND_MIDDLE, 41 RIGHT_MIDDLE_AND_RING, 42 RIGHT_RING_AND_LITTLE, 43
        LEFT_INDEX_AND_MIDDLE, 44 LEFT_MIDDLE_AND_RING, 45 LEFT_RING_AND_LITTLE, 46 RIGHT_INDEX_AND_LEFT_INDEX, 47 RIGHT_INDEX_AND_MIDDLE_AND_RING, 48 RIGHT_MIDDLE_AND_RING_AND_LITTLE, 49
        LEFT_INDEX_AND_MIDDLE_AND_RING, 50 LEFT_MIDDLE_AND_RING_AND_LITTLE""",
    "capture_tech": """0 UNKNOWN_OR_UNSPECIFIED, 1 WHITE_LIGHT_OPTICAL_TIR, 2 WHITE_LIGHT_OPTICAL_DIRECT_VIEW_ON_PLATEN, 3 WHITE_LIGHT_OPTICAL_TOUCHLESS, 4 MONOCHROMATIC_VISIBLE_OPTICAL_TIR, 5
        MONOCHROMATIC_VISIBLE_OPTICAL_DIRECT_VIEW_ON_PLATEN, 6 MONOCHROMATIC_VISIBLE_OPTICAL_TOUCHLESS, 7 MONOCHROMATIC_IR_OPTICAL_TIR, 8 MONOCHROMATIC_IR_OPTICAL_DIRECT_VIEW_ON_PLATEN, 9
        MONOCHROMATIC_IR_OPTICAL_TOUCHLESS, 10 MULTISPECTRAL_OPTICAL_TIR, 11 MULTISPECTRAL_OPTICAL_DIRECT_VIEW_ON_PLATEN, 12 MULTISPECTRAL_OPTICAL_TOUCHLESS, 13 ELECTRO_LUMINESCENT, 14
        SEMICONDUCTOR_CAPACITIVE, 15 SEMICONDUCTOR_RF, 16 SEMICONDUCTOR_THEMAL, 17 PRESSURE_SENSITIVE, 18 ULTRASOUND, 19 MECHANICAL, 20 GLASS_FIBER""",
}


def written(col: str, names: str) -> str:
    """CASE of a text of codes and names."""
    return f"CASE {col} " + " ".join("WHEN {} THEN '{}'".format(*x.split()) for x in names.split(",")) + " END"


TABLES = ("IMAGE_TYPE", "IMAGE_FORMAT", "RESOLUTION", "FINGER_COUNT", "FINGER_QUALITY", "PLATEN", "ROLLING", "EVENT_TYPE", "STORED_FORMAT", "IMPRESSION_TYPE", "FINGER_POSITION", "CAPTURE_TECH")
DEFAULTS = {"IMAGE_TYPE": "TYPE_NONE", "IMAGE_FORMAT": "UNKNOWN"}
RAW = "CASE WHEN seq % 3 = 0 THEN 500 * CAST(seq % 4 AS INT) ELSE CAST(seq % 53 AS INT) END"


@query("p2_all_tables", "SELECT seq, " + ", ".join(f"coalesce({written('raw', WIRE[t.lower()])}, '{DEFAULTS.get(t, '-')}') AS {t.lower()}" for t in TABLES) + f" FROM (SELECT seq, {RAW} AS raw FROM f3)", f3=fx.F3)
def _(s, d):
    x = log(s, d).select("seq", F.expr(RAW).alias("raw"))
    for t in TABLES:
        x = captures.decode_codes(x, "raw", getattr(codes, t), *(("default", DEFAULTS[t]) if t in DEFAULTS else ("reject",)), out=t.lower())
    return x.select("seq", *[F.coalesce(t.lower(), F.lit("-")).alias(t.lower()) for t in TABLES])


@query("p3_quality_array", f"""SELECT seq, CASE WHEN list_contains(quality_codes, 8) THEN NULL ELSE array_to_string(list_transform(quality_codes, lambda q: {case('q', codes.FINGER_QUALITY)}), ',') END AS qualities FROM f3""", f3=fx.F3)
def _(s, d):
    return captures.decode_quality_array(log(s, d), "quality_codes", codes.FINGER_QUALITY).select("seq", "qualities")


# Fixed values, written out apart from the operator's table so that a mistake in either shows.
DEFINED = """0 STATUS_OK, -1 INVALID_PARAM_VALUE, -2 MEM_ALLOC, -3 NOT_SUPPORTED, -4 FILE_OPEN, -5 FILE_READ, -6 RESOURCE_LOCKED, -7 MISSING_RESOURCE, -8 INVALID_ACCESS_POINTER, -9
        THREAD_CREATE, -10 COMMAND_FAILED, -11 LIBRARY_UNLOAD_FAILED, -100 CHANNEL_IO_COMMAND_FAILED, -101 CHANNEL_IO_READ_FAILED, -102 CHANNEL_IO_WRITE_FAILED, -103
        CHANNEL_IO_READ_TIMEOUT, -104 CHANNEL_IO_WRITE_TIMEOUT, -105 CHANNEL_IO_UNEXPECTED_FAILED, -106 CHANNEL_IO_INVALID_HANDLE, -107 CHANNEL_IO_WRONG_PIPE_INDEX, -200 DEVICE_IO, -201
        DEVICE_NOT_FOUND, -202 DEVICE_NOT_MATCHED, -203 DEVICE_ACTIVE, -204 DEVICE_NOT_INITIALIZED, -205 DEVICE_INVALID_STATE, -206 DEVICE_BUSY, -207 DEVICE_NOT_SUPPORTED_FEATURE, -208
        INVALID_LICENSE, -209 USB20_REQUIRED, -210 DEVICE_ENABLED_POWER_SAVE_MODE, -211 DEVICE_NEED_UPDATE_FIRMWARE, -212 DEVICE_NEED_CALIBRATE_TOF, -213 DEVICE_INVALID_CALIBRATION_DATA,
        -299 DEVICE_NOT_ACCESSIBLE, -300 CAPTURE_COMMAND_FAILED, -301 CAPTURE_STOP, -302 CAPTURE_TIMEOUT, -303 CAPTURE_STILL_RUNNING, -304 CAPTURE_NOT_RUNNING, -305 CAPTURE_INVALID_MODE,
        -306 CAPTURE_ALGORITHM, -307 CAPTURE_ROLLING, -308 CAPTURE_ROLLING_TIMEOUT, -500 NBIS_NFIQ_FAILED, -501 NBIS_WSQ_ENCODE_FAILED, -502 NBIS_WSQ_DECODE_FAILED, -600
        DUPLICATE_EXTRACTION_FAILED, -601 DUPLICATE_ALREADY_USED, -602 DUPLICATE_SEGMENTATION_FAILED, -603 DUPLICATE_MATCHING_FAILED, 100 CHANNEL_IO_FRAME_MISSING, 101
        CHANNEL_IO_CAMERA_WRONG, 102 CHANNEL_IO_SLEEP_STATUS, 200 OUTDATED_FIRMWARE, 201 ALREADY_INITIALIZED, 202 API_DEPRECATED, 203 ALREADY_ENHANCED_IMAGE, 300 BGET_IMAGE, 301
        ROLLING_NOT_RUNNING, 302 NO_FINGER, 303 INCORRECT_FINGERS, 304 ROLLING_SMEAR, 305 ROLLING_SHIFTED_HORIZONTALLY, 306 ROLLING_SHIFTED_VERTICALLY, 307
        ROLLING_SHIFTED_HORIZONTALLY_VERTICALLY, 400 EMPTY_IBSM_RESULT_IMAGE, 512 QUALITY_INVALID_AREA, 513 QUALITY_INVALID_AREA_HORIZONTALLY, 514 QUALITY_INVALID_AREA_VERTICALLY, 515
        QUALITY_INVALID_AREA_HORIZONTALLY_VERTICALLY, 600 INVALID_BRIGHTNESS_FINGERS, 601 WET_FINGERS, 602 MULTIPLE_FINGERS_DURING_ROLL"""
EFFECTIVE = f"CASE WHEN {written('status_code', DEFINED)} IS NOT NULL THEN status_code ELSE -10 END"
FAMILY = """CASE WHEN effective_code < 0 THEN CASE WHEN effective_code >= -11 THEN 'general' WHEN effective_code > -200 THEN 'channel' WHEN effective_code > -300 THEN 'device' WHEN effective_code > -400 THEN 'capture'
    WHEN effective_code > -500 THEN 'client' WHEN effective_code > -600 THEN 'codec' ELSE 'duplicate' END WHEN effective_code BETWEEN 100 AND 199 THEN 'trace' WHEN effective_code BETWEEN 200 AND 299 THEN 'api'
    WHEN effective_code BETWEEN 300 AND 399 THEN 'acquisition' WHEN effective_code BETWEEN 400 AND 499 THEN 'image' WHEN effective_code BETWEEN 512 AND 515 THEN 'area' WHEN effective_code >= 600 THEN 'finger' END"""
SEVERITY = "CASE WHEN effective_code = 0 THEN 'OK' WHEN effective_code < 0 THEN 'ERROR' ELSE 'WARNING' END"
STATUS = f"SELECT device_id, seq, effective_code, {written('effective_code', DEFINED)} AS status_name, {SEVERITY} AS severity, {FAMILY} AS family FROM (SELECT *, {EFFECTIVE} AS effective_code FROM f3 WHERE kind = 'Error')"


@query("p4_status", STATUS, f3=fx.F3)
def _(s, d):
    return captures.classify_status(devices.only_kind(log(s, d), "Error"), "status_code").select("device_id", "seq", "effective_code", "status_name", "severity", "family")


MASK = "CAST((finger_bit * (1 + template_id % 7) + session_id) % 1024 AS INT)"


@query("p5_finger_mask", "SELECT template_id, mask, bit_count(mask)::INT AS n_fingers, mask & 48 <> 0 AS thumbs, mask & 12 = 12 AS left_middle_index, mask & 768 = 768 AS right_ring_little, array_to_string(list_sort(list_filter(["
       + ", ".join(f"CASE WHEN mask & {b} <> 0 THEN '{n}' END" for b, n in codes.FINGER_BITS.items()) + f"], lambda x: x IS NOT NULL)), ',') AS fingers FROM (SELECT template_id, {MASK} AS mask FROM f2)", f2=fx.F2)
def _(s, d):
    m = fx.load(s, d, fx.F2).select("template_id", F.expr(MASK).alias("m"))
    return captures.encode_finger_mask(captures.decode_finger_mask(m, "m"), "fingers").select("template_id", "mask", "n_fingers", "thumbs", "left_middle_index", "right_ring_little", "fingers")


@query("p6_option_mask", "SELECT seq, option_bits AS mask, option_bits | 7 AS effective_mask FROM f3", f3=fx.F3)
def _(s, d):
    opts = F.filter(F.array(*[F.when(F.col("option_bits").bitwiseAND(b) != 0, F.lit(b)) for b in (1, 2, 4)]), lambda x: x.isNotNull())
    return captures.capture_option_mask(log(s, d).withColumn("options", opts), "options").select("seq", "mask", "effective_mask")


@query("p7_accounts", "SELECT id, full_name AS name, username, email, token FROM f4", f4=fx.F4)
def _(s, d):
    return accounts.project_accounts(fx.users(s, d))


@query("p8_login", """SELECT id, concat_ws(',', CASE WHEN token IS NULL THEN 'token' END, CASE WHEN email IS NULL THEN 'user.email' END, CASE WHEN c_custkey % 7 = 0 THEN 'user.status' END, CASE WHEN c_custkey % 11 = 0 THEN 'user.grants.access_mode' END) AS missing,
    token IS NULL OR email IS NULL OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 AS rejected, CASE WHEN can_enrol THEN 2 ELSE 1 END AS n_capabilities FROM f4""", f4=fx.F4)
def _(s, d):
    u = fx.users(s, d)
    made = F.lit("2024-01-01")
    grants = F.transform("grants", lambda g: g.withField("access_mode", F.when(F.col("c_custkey") % 11 != 0, g["access_mode"])))
    user = F.struct("id", "full_name", "email", "username", F.lit("student").alias("category"), F.lit("rw").alias("access_mode"), F.when(F.col("c_custkey") % 7 != 0, F.lit("active")).alias("status"), grants.alias("grants"),
                    made.alias("created_at"), made.alias("updated_at"), F.when(F.col("c_custkey") % 2 == 0, F.lit("x")).alias("unknown_key"))
    j = u.select("id", F.to_json(F.struct("token", "idle_expires_at", "absolute_expires_at", user.alias("user"))).alias("json"))
    return accounts.parse_login(j, "json").select("id", "missing", "rejected", F.size(F.col("login.user.grants")[0]["capabilities"]).alias("n_capabilities"))


BIZ = "status IN (400, 401, 409) AND event_id % 3 = 0"
OUTCOME = f"CASE WHEN {BIZ} THEN 'BUSINESS' WHEN status BETWEEN 400 AND 499 THEN 'AUTHORIZATION' WHEN status BETWEEN 500 AND 599 THEN 'NETWORK' ELSE 'SUCCESS' END"


@query("p9_response", f"SELECT event_id, {OUTCOME} AS outcome FROM f5", f5=fx.F5)
def _(s, d):
    return accounts.classify_response(fx.load(s, d, fx.F5)).select("event_id", "outcome")


@query("p10_business_error", f"SELECT event_id, CASE WHEN {BIZ} THEN 'E' || (event_id % 7) END AS code, CASE WHEN {BIZ} THEN 'm' END AS message FROM f5", f5=fx.F5)
def _(s, d):
    return accounts.extract_business_error(fx.load(s, d, fx.F5)).select("event_id", "code", "message")


@query("p11_token_state", "SELECT id, CASE WHEN token IS NULL THEN 'ABSENT' WHEN trim(token) = '' THEN 'BLANK' ELSE 'PRESENT' END AS token_state, coalesce(trim(token) <> '', false) AS authenticated_strict, token IS NOT NULL AS authenticated_lenient FROM f4", f4=fx.F4)
def _(s, d):
    return accounts.token_state(fx.users(s, d)).select("id", "token_state", "authenticated_strict", "authenticated_lenient")


@query("p12_expiry", "SELECT id, CASE WHEN absolute_expires_at::TIMESTAMP <= TIMESTAMP '2024-01-04' THEN 'ABSOLUTE_EXPIRED' WHEN idle_expires_at::TIMESTAMP <= TIMESTAMP '2024-01-04' THEN 'IDLE_EXPIRED' ELSE 'LIVE' END AS expiry FROM f4", f4=fx.F4)
def _(s, d):
    return accounts.session_expiry(fx.users(s, d), "2024-01-04 00:00:00").select("id", "expiry")


@query("p13_typed_preferences", """SELECT seq, CASE type_tag WHEN 'string' THEN value WHEN 'int' THEN TRY_CAST(value AS INT)::VARCHAR WHEN 'long' THEN TRY_CAST(value AS BIGINT)::VARCHAR
    WHEN 'boolean' THEN CASE WHEN value IN ('true', '1') THEN 'true' WHEN value = '0' THEN 'false' END WHEN 'float' THEN TRY_CAST(value AS FLOAT)::VARCHAR WHEN 'double' THEN TRY_CAST(value AS DOUBLE)::VARCHAR ELSE replace(value, ' ', '') END AS decoded FROM f6""", f6=fx.F6)
def _(s, d):
    return prefs.decode_kv(fx.load(s, d, fx.F6), "k BIGINT").select("seq", "decoded")


@query("p14_only_kind", "SELECT device_id, seq, progress FROM f3 WHERE kind = 'Initialize'", f3=fx.F3)
def _(s, d):
    return devices.only_kind(log(s, d), "Initialize", ["device_id", "seq", "progress"])


SESSION = "CASE seq % 5 WHEN 0 THEN 'LOADING' WHEN 1 THEN 'ERROR' ELSE 'SUCCESS' END"


@query("p15_console_state", f"""SELECT seq, state, CASE WHEN state = 'SUCCESS' THEN device_id END AS usable_device FROM (SELECT *, CASE WHEN ss <> 'SUCCESS' THEN ss WHEN kind = 'Error' THEN 'ERROR'
    WHEN kind IN ('Attached', 'Initialize') THEN 'SUCCESS' WHEN kind = 'Ready' THEN 'LOADING' ELSE 'DEFAULT' END AS state FROM (SELECT *, {SESSION} AS ss FROM f3))""", f3=fx.F3)
def _(s, d):
    return devices.console_state(log(s, d).withColumn("session_state", F.expr(SESSION))).select("seq", "state", "usable_device")


@query("p16_segments", """SELECT template_id, subject_id <> 4 OR template_id % 5 = 0 AS count_mismatch, i AS ordinal, CASE WHEN i < 3 OR template_id % 5 <> 0 THEN template_id * 10 + i END AS image, trunc(vector[i * 8 + 1]::DOUBLE * 1000)::INT AS x1
    FROM (SELECT *, unnest(range(0, 4))::INT AS i FROM f2)""", f2=fx.F2)
def _(s, d):
    v = fx.load(s, d, fx.F2)
    pos = F.array(*[F.struct(*[(F.col("vector")[8 * i + j].cast("double") * 1000).cast("int").alias(n) for j, n in enumerate(("x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4"))]) for i in range(4)])
    images = F.array(*[F.col("template_id") * 10 + i for i in range(4)])  # one image short in every fifth
    x = v.select("template_id", "subject_id", F.when(F.col("template_id") % 5 == 0, F.slice(images, 1, 3)).otherwise(images).alias("images"), pos.alias("positions"), F.col("subject_id").alias("finger_count"))
    return captures.flatten_segments(x).select("template_id", "count_mismatch", "ordinal", "image", F.col("position.x1").alias("x1"))


GATE = "CASE WHEN NOT is_final THEN 'NOT_FINAL' WHEN quality < 30 THEN 'LOW_QUALITY' WHEN liveness < 20 THEN 'LOW_LIVENESS' END"


@query("p17_gate", f"SELECT capture_id, {GATE} AS reason FROM f1", f1=fx.F1)
def _(s, d):
    return captures.acquisition_gate(fx.captures(s, d), 30, 20).select("capture_id", "reason")


# -- joins


def _probes(s, d):
    t = fx.load(s, d, fx.F2)
    return t.where("probe_id % 10 = 0"), t.where("template_id % 10 <> 0")


BEST = f"SELECT p.probe_id, g.template_id, g.subject_id, {DOT.format('p.vector', 'g.vector')} AS score, row_number() OVER (PARTITION BY p.probe_id ORDER BY {DOT.format('p.vector', 'g.vector')} DESC, g.template_id) AS rank FROM f2 p JOIN f2 g ON p.probe_id % 10 = 0 AND g.template_id % 10 <> 0"


def answer(best: str, probes: str, threshold: float) -> str:
    """SQL of J1's answer from the best template of each probe."""
    ok = f"coalesce(score >= {threshold}, false)"
    return f"""SELECT p.probe_id, CASE WHEN {ok} THEN 'MATCH' ELSE 'RETRY' END AS outcome, CASE WHEN {ok} THEN subject_id END AS subject_id, CASE WHEN {ok} THEN template_id END AS template_id,
    coalesce(round(score, 4), 0) AS score, CASE WHEN score IS NULL THEN 'NO_CANDIDATE' WHEN NOT {ok} THEN 'LOW_SCORE' END AS reason FROM ({probes}) p LEFT JOIN (SELECT * FROM ({best}) WHERE rank = 1) b ON b.probe_id = p.probe_id"""


J1 = answer(BEST, "SELECT probe_id FROM f2 WHERE probe_id % 10 = 0", 0.35)


@query("j1_identify", J1, f2=fx.F2)
def _(s, d):
    return matching.identify(*_probes(s, d), 0.35)


PLANES, TABLES_J2 = matching.blocking(1)
# the hyperplanes' rule, and the buckets that follow from it
J2_PLANES = f"""SELECT t, b, list(CASE WHEN 2 * h >= {matching.PRIME} THEN 1.0 ELSE -1.0 END ORDER BY j) AS w FROM (SELECT t, b, j, (m * m % {matching.PRIME} * m + 7 * m * m + 31 * m) % {matching.PRIME} AS h FROM (
    SELECT t, b, j, ((t * {PLANES} + b) * 64 + j + 1) % {matching.PRIME} AS m FROM range({TABLES_J2}) x(t), range({PLANES}) y(b), range(64) z(j))) GROUP BY t, b"""
J2_BUCKETS = "SELECT id, t, sum(CASE WHEN list_dot_product(vector::DOUBLE[], w::DOUBLE[]) > 0 THEN 1 << b ELSE 0 END) AS bucket FROM {0}, planes GROUP BY id, t"
J2_BEST = f"""SELECT probe_id, template_id, subject_id, score, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, template_id) AS rank FROM (SELECT p.probe_id, g.template_id, g.subject_id, {DOT.format('p.vector', 'g.vector')} AS score
    FROM (SELECT DISTINCT p.id AS a, g.id AS b FROM pb p JOIN gb g ON p.t = g.t AND p.bucket = g.bucket) x JOIN noisy p ON p.probe_id = a JOIN f2 g ON g.template_id = b)"""


def _noisy(s, d):
    return fx.load(s, d, fx.F2_NOISY), fx.load(s, d, fx.F2).where("template_id % 10 <> 0")


@query("j2_identify_blocked", answer(J2_BEST, "SELECT probe_id FROM noisy", 0.5), f2=fx.F2, noisy=fx.F2_NOISY, planes=J2_PLANES,
       pb=J2_BUCKETS.format("(SELECT probe_id AS id, vector FROM noisy)"), gb=J2_BUCKETS.format("(SELECT template_id AS id, vector FROM f2 WHERE template_id % 10 <> 0)"))
def _(s, d):
    """Probes are noisy captures, as a matcher meets them; the SQL holds while blocking() keeps its least number of planes."""
    probes, gallery = _noisy(s, d)
    return matching.identify_blocked(probes, gallery, 0.5, *matching.blocking(gallery.count()))


@query("j3_duplicate_fingers", f"""SELECT p.session_id, p.print_id, coalesce(bit_or(CASE WHEN {DOT.format('p.vector', 'o.vector')} >= CASE p.session_id % 4 WHEN 0 THEN 0.05 WHEN 1 THEN 0.1 WHEN 2 THEN 0.2 END THEN o.finger_bit END), 0)::INT AS matched_mask
    FROM f2 p LEFT JOIN f2 o ON p.session_id = o.session_id AND o.print_id < p.print_id GROUP BY ALL""", f2=fx.F2)
def _(s, d):
    """Sessions of four levels, the last of which has no threshold."""
    prints = fx.load(s, d, fx.F2)
    sessions = prints.select("session_id", F.expr("CAST(session_id % 4 AS INT)").alias("security_level")).distinct()
    return matching.duplicate_fingers(prints, s.createDataFrame([(0, 0.05), (1, 0.1), (2, 0.2)], "security_level INT, threshold DOUBLE"), sessions)


@query("j4_cross_subject", f"SELECT a.template_id AS template_a, b.template_id AS template_b, round({DOT.format('a.vector', 'b.vector')}, 4) AS score FROM f2 a JOIN f2 b ON a.template_id < b.template_id AND a.subject_id <> b.subject_id WHERE {DOT.format('a.vector', 'b.vector')} >= 0.4", f2=fx.F2)
def _(s, d):
    return matching.cross_subject_duplicates(fx.load(s, d, fx.F2).select("template_id", "subject_id", "vector"), 0.4)


COPIES = ("SELECT template_id, 1 + template_id % 3 AS version FROM f2 WHERE template_id % 4 <> 0", "SELECT template_id, 1 + template_id % 2 AS version FROM f2 WHERE template_id % 4 <> 1")


@query("j5_reconcile", f"""SELECT coalesce(a.template_id, b.template_id) AS template_id, a.version AS device_version, b.version AS server_version,
    CASE WHEN b.version IS NULL THEN 'ONLY_DEVICE' WHEN a.version IS NULL THEN 'ONLY_SERVER' WHEN a.version = b.version THEN 'SAME' ELSE 'STALE' END AS state,
    CASE WHEN coalesce(a.version, -1) >= coalesce(b.version, -1) THEN 'device' ELSE 'server' END AS winner FROM ({COPIES[0]}) a FULL JOIN ({COPIES[1]}) b ON a.template_id = b.template_id""", f2=fx.F2)
def _(s, d):
    t = fx.load(s, d, fx.F2).select("template_id")
    a, b = t.where("template_id % 4 <> 0").withColumn("version", F.expr("1 + template_id % 3")), t.where("template_id % 4 <> 1").withColumn("version", F.expr("1 + template_id % 2"))
    return enrollment.reconcile(a, b)


def _devices(s, d):
    t = fx.load(s, d, fx.F7)
    return t.drop("permitted"), t.where("permitted").select("device_id")


@query("j6_accessible", "SELECT device_id, vendor_id, product, fw_version, is_opened FROM f7 WHERE vendor_id = 4415 AND permitted", f7=fx.F7)
def _(s, d):
    return devices.accessible_devices(*_devices(s, d))


@query("j7_blocked", "SELECT device_id, 'PERMISSION_DENIED' AS error FROM f7 WHERE vendor_id = 4415 AND NOT permitted", f7=fx.F7)
def _(s, d):
    return devices.blocked_devices(*_devices(s, d))


@query("j8_authorize", """SELECT u.id AS user_id, n.n_nationkey::VARCHAR AS site_id, 'enrol' AS capability, u.can_enrol AND (CASE WHEN u.scope_kind = 'organization' THEN u.organization_id = n.n_regionkey::VARCHAR ELSE u.site_id = n.n_nationkey::VARCHAR END) AS allowed
    FROM f4 u JOIN nation n ON n.n_nationkey % 5 = u.c_custkey % 5""", f4=fx.F4)
def _(s, d):
    u, n = fx.users(s, d), fx.table(s, d, "nation")
    sites = n.select(F.col("n_regionkey").cast("string").alias("organization_id"), F.col("n_nationkey").cast("string").alias("site_id"))
    req = u.join(n, F.col("n_nationkey") % 5 == F.col("c_custkey") % 5).select(F.col("id").alias("user_id"), F.col("n_nationkey").cast("string").alias("site_id"), F.lit("enrol").alias("capability"))
    return accounts.authorize(req, u, sites)


@query("j9_locale", "SELECT user_id, coalesce(locale, CASE WHEN language IN ('en', 'de', 'fr') THEN language END, 'en') AS locale, CASE WHEN locale IS NOT NULL THEN 'STORED' WHEN language IN ('en', 'de', 'fr') THEN 'SYSTEM' ELSE 'FALLBACK' END AS origin FROM f6l", f6l=fx.F6_LOCALES)
def _(s, d):
    t = fx.load(s, d, fx.F6_LOCALES)
    return prefs.resolve_locale(t.select("user_id", "language"), t.where("locale is not null").select("user_id", "locale"), s.createDataFrame([("en",), ("de",), ("fr",)], "code string"))


A_KINDS, B_KINDS = "'Default', 'Platen', 'Process', 'Acquired'", "'Attached', 'Detached', 'Initialize', 'Ready'"


@query("j10_combine_latest", f"""SELECT device_id, seq, $us(ts) AS ts, a_kind, b_kind, a_kind = 'Platen' AND b_kind IN ('Initialize', 'Ready') AS ready_to_scan FROM (
    SELECT device_id, seq, ts, last_value(CASE WHEN kind IN ({A_KINDS}) THEN kind END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS a_kind,
    last_value(CASE WHEN kind IN ({B_KINDS}) THEN kind END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS b_kind FROM f3 WHERE kind IN ({A_KINDS}, {B_KINDS})) WHERE a_kind IS NOT NULL AND b_kind IS NOT NULL""", f3=fx.F3)
def _(s, d):
    x = log(s, d)
    return devices.combine_latest(x.where(f"kind IN ({A_KINDS})"), x.where(f"kind IN ({B_KINDS})"))


def _roster(s, d):
    return attendance.roster(fx.load(s, d, fx.F8_STUDENTS), fx.load(s, d, fx.F8_STAFF))


ROSTER = "SELECT subject_id, min(category) AS category FROM (SELECT *, 'student' AS category FROM st UNION ALL SELECT *, 'staff' FROM sf) GROUP BY subject_id"
R = {"st": fx.F8_STUDENTS, "sf": fx.F8_STAFF, "roster": ROSTER, "ci": fx.F8_CHECKINS}
ABSENT = "SELECT r.subject_id, r.category, c.day FROM roster r, (SELECT DISTINCT ts::DATE AS day FROM events) c WHERE NOT EXISTS (SELECT 1 FROM ci WHERE ci.subject_id = r.subject_id AND ci.ts::DATE = c.day)"


def _absent(s, d):
    cal = fx.table(s, d, "events").select(F.to_date("ts").alias("day")).distinct()
    return attendance.absentees(_roster(s, d), cal, fx.load(s, d, fx.F8_CHECKINS))


@query("j11_absentees", f"SELECT subject_id, category, day::VARCHAR AS day FROM ({ABSENT})", **R)
def _(s, d):
    return _absent(s, d).select("subject_id", "category", "day")


@query("j12_exeat", "SELECT a.subject_id, a.day::VARCHAR AS day, EXISTS (SELECT 1 FROM f9 WHERE f9.subject_id = a.subject_id AND a.day >= f9.start_day AND (f9.end_day IS NULL OR a.day <= f9.end_day)) AS covered FROM absent a", **R, f9=fx.F9, absent=ABSENT)
def _(s, d):
    return attendance.exeat_overlap(_absent(s, d).select("subject_id", "day"), fx.load(s, d, fx.F9)).select("subject_id", "day", "covered")


# -- aggregations


@query("a1_duplicate_captures", "SELECT width, height, sha256(data) AS digest, strlen(data)::INT AS n_bytes, count(*) AS n, min(capture_id) AS first_id FROM f1 GROUP BY width, height, data HAVING n > 1", f1=fx.F1)
def _(s, d):
    return captures.duplicate_captures(fx.captures(s, d))


A2 = """SELECT b.batch_id, any_value(b.subject_id) AS subject_id, count(c.batch_id) AS n_captures, count_if(c.shape_ok) AS n_valid, min(c.quality) AS min_quality FROM b LEFT JOIN c ON b.batch_id = c.batch_id GROUP BY b.batch_id"""
A2_REASON = "CASE WHEN n_captures = 0 THEN 'EMPTY' WHEN n_valid < n_captures THEN 'BAD_CAPTURE' WHEN min_quality < 20 THEN 'LOW_QUALITY' END"


@query("a2_enrollment_outcomes", f"SELECT batch_id, subject_id, n_captures, n_valid, min_quality, CASE WHEN {A2_REASON} IS NULL THEN 'ACCEPTED' ELSE 'REJECTED' END AS outcome, {A2_REASON} AS reason FROM ({A2})", b=fx.F10_BATCHES, c=fx.F10_CAPTURES)
def _(s, d):
    return enrollment.enrollment_outcomes(fx.load(s, d, fx.F10_BATCHES), fx.load(s, d, fx.F10_CAPTURES), 20)


Q = case("quality_code", codes.FINGER_QUALITY)


@query("a3_quality_report", "SELECT device_id, " + ", ".join(f"count_if(quality_code = {k}) AS n_{v.lower()}" for k, v in codes.FINGER_QUALITY.items()) + f""", count_if({Q} IS NULL) AS n_unknown,
    round(count_if(quality_code = 1) / nullif(count({Q}), 0), 6) AS good_rate, """ + ", ".join(f"count_if(1 + quality_code % 5 = {i}) AS nfiq_{i}" for i in range(1, 6)) + ", round(avg(1 + quality_code % 5), 6) AS nfiq_mean FROM f3 GROUP BY device_id", f3=fx.F3)
def _(s, d):
    return captures.quality_report(log(s, d).withColumn("nfiq", F.expr("1 + quality_code % 5")), ["device_id"], codes.FINGER_QUALITY, nfiq="nfiq")


@query("a4_error_breakdown", f"SELECT *, round(n / sum(n) OVER (PARTITION BY device_id), 6) AS share FROM (SELECT device_id, severity, family, count(*) AS n FROM ({STATUS}) GROUP BY ALL)", f3=fx.F3)
def _(s, d):
    return devices.error_breakdown(log(s, d))


ATTEMPTS = "SELECT device_id, ts, seq, CAST(ts AS DATE) AS day, CASE seq % 3 WHEN 0 THEN -6 WHEN 1 THEN status_code ELSE 0 END AS status_code FROM f3 WHERE kind = 'Error'"


@query("a5_retry", f"""SELECT device_id, day::VARCHAR AS day, coalesce(min(CASE WHEN status_code <> -6 THEN k END), max(k))::INT AS attempts,
    CASE WHEN arg_min(status_code, k) FILTER (status_code <> -6) = 0 THEN 'CLOSED' WHEN count_if(status_code <> -6) = 0 AND max(k) >= 3 THEN 'EXHAUSTED' ELSE 'FAILED' END AS outcome
    FROM (SELECT *, row_number() OVER (PARTITION BY device_id, day ORDER BY ts, seq) AS k FROM ({ATTEMPTS})) WHERE k <= 3 GROUP BY device_id, day""", f3=fx.F3)
def _(s, d):
    x = log(s, d).where("kind = 'Error'").withColumn("day", F.to_date("ts")).withColumn("status_code", F.expr("CASE seq % 3 WHEN 0 THEN -6 WHEN 1 THEN status_code ELSE 0 END"))
    return devices.retry_outcomes(x, ["device_id", "day"])


@query("a6_api_summary", f"""SELECT n.*, round(1 - n_success / n, 6) AS error_rate, top_codes FROM (SELECT path, count(*) AS n, count_if(o = 'SUCCESS') AS n_success, count_if(o = 'BUSINESS') AS n_business, count_if(o = 'AUTHORIZATION') AS n_authorization,
    count_if(o = 'NETWORK') AS n_network FROM (SELECT path, {OUTCOME} AS o FROM f5) GROUP BY path) n LEFT JOIN (SELECT path, string_agg(code, ',' ORDER BY r) AS top_codes FROM (SELECT path, code, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, code) AS r
    FROM (SELECT path, 'E' || (event_id % 7) AS code FROM f5 WHERE {BIZ}) GROUP BY path, code) WHERE r <= 2 GROUP BY path) c ON n.path = c.path""", f5=fx.F5)
def _(s, d):
    return accounts.api_summary(fx.load(s, d, fx.F5), 2)


@query("a7_fleet", "SELECT product, fw_version, is_opened, count(*) AS n FROM f7 GROUP BY ALL", f7=fx.F7)
def _(s, d):
    return devices.fleet_inventory(_devices(s, d)[0])


# Fixed values, written out apart from the operator's rules.
A8 = """SELECT reading_id, property, CASE WHEN property = 'SOMETHING_ELSE' THEN 'UNKNOWN' WHEN value = 'n/a' THEN 'NOT_NUMERIC' WHEN CASE property WHEN 'IGNORE_FINGER_TIME' THEN value::INT BETWEEN 2000 AND 10000 WHEN 'RETRY_WRONG_COMMUNICATION' THEN value::INT BETWEEN 1 AND 120
    WHEN 'CAPTURE_TIMEOUT' THEN value::INT = -1 OR value::INT BETWEEN 10 AND 3600 WHEN 'ROLL_MIN_WIDTH' THEN value::INT BETWEEN 10 AND 30 WHEN 'MIN_CAPTURE_TIME_IN_SUPER_DRY_MODE' THEN value::INT BETWEEN 600 AND 3000
    ELSE len(string_split(value, ' ')) = 5 AND list_min(list_transform(string_split(value, ' '), lambda x: x::INT)) >= 10 AND list_max(list_transform(string_split(value, ' '), lambda x: x::INT)) <= 1000 END THEN 'OK' ELSE 'OUT_OF_RANGE' END AS verdict FROM f7r"""


@query("a8_properties", A8, f7r=fx.F7_READINGS)
def _(s, d):
    return devices.audit_properties(fx.load(s, d, fx.F7_READINGS)).select("reading_id", "property", "verdict")


@query("a8_property_counts", f"SELECT property, verdict, count(*) AS n FROM ({A8}) GROUP BY ALL", f7r=fx.F7_READINGS)
def _(s, d):
    return devices.property_counts(devices.audit_properties(fx.load(s, d, fx.F7_READINGS)))


DAILY = "SELECT c.subject_id, ts::DATE AS day, min(ts) AS first_in, max(ts) AS last_in, count(*) AS n, any_value(category) AS category FROM ci c LEFT JOIN roster r ON r.subject_id = c.subject_id GROUP BY c.subject_id, ts::DATE"


@query("a9_attendance", f"SELECT subject_id, day::VARCHAR AS day, $us(first_in) AS first_in, $us(last_in) AS last_in, n, category FROM ({DAILY})", **R)
def _(s, d):
    return attendance.attendance_daily(fx.load(s, d, fx.F8_CHECKINS), _roster(s, d))


@query("a9_by_category", f"SELECT category, day::VARCHAR AS day, count(*) AS n_present, sum(n)::BIGINT AS n_checkins FROM ({DAILY}) WHERE category IS NOT NULL GROUP BY category, day", **R)
def _(s, d):
    return attendance.attendance_by_category(attendance.attendance_daily(fx.load(s, d, fx.F8_CHECKINS), _roster(s, d)))


@query("a10_capabilities", """SELECT organization_id, site_id, capability, count(DISTINCT id) AS n_users FROM (SELECT *, 'checkin' AS capability FROM f4 UNION ALL SELECT *, 'enrol' FROM f4 WHERE can_enrol) GROUP BY ALL""", f4=fx.F4)
def _(s, d):
    return accounts.capability_census(fx.users(s, d))


# -- windows

LATEST = "SELECT device_id, seq, $us(ts) AS ts, kind FROM f3 QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, seq DESC) = 1"
CHANGED = f"SELECT device_id, seq, $us(ts) AS ts, kind FROM f3 QUALIFY row_number() OVER ({W}) = 1 OR kind IS DISTINCT FROM lag(kind) OVER ({W})"


@query("w1_latest_state", LATEST, f3=fx.F3)
def _(s, d):
    return devices.latest_state(log(s, d).select("device_id", "seq", "ts", "kind"))


@query("w1_latest_or_default", f"SELECT c_custkey AS device_id, coalesce(kind, 'Default') AS kind FROM customer LEFT JOIN ({LATEST}) ON c_custkey = device_id", f3=fx.F3)
def _(s, d):
    keys = fx.table(s, d, "customer").select(F.col("c_custkey").alias("device_id"))
    return devices.latest_state(log(s, d).select("device_id", "seq", "ts", "kind"), default=(keys, "Default")).select("device_id", "kind")


@query("w2_changes", CHANGED, f3=fx.F3)
def _(s, d):
    return devices.distinct_until_changed(log(s, d).select("device_id", "seq", "ts", "kind"), ["kind"])


@query("w3_sessions", f"""SELECT device_id, session, $us(min(ts)) AS opened, $us(max(CASE WHEN flag = 0 AND before = 1 THEN ts END)) AS closed, count_if(kind = 'Error') AS n_errors,
    $us(max(CASE WHEN flag = 0 AND before = 1 THEN ts END)) - $us(min(ts)) AS duration_us FROM (
    SELECT *, sum(CASE WHEN flag = 1 AND before = 0 THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
    SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT *, CASE kind WHEN 'Attached' THEN 1 WHEN 'Detached' THEN 0 END AS flag FROM f3)))
    WHERE before = 1 OR (flag = 1 AND before = 0) GROUP BY device_id, session""", f3=fx.F3)
def _(s, d):
    return devices.device_sessions(log(s, d))


FIRST = ", ".join(f"min(CASE WHEN kind = '{k}' THEN ts END) AS {k.lower()}" for k in ("Platen", "Process", "Acquired", "Result"))


@query("w4_cycles", f"""SELECT device_id, cycle, $us(opened) AS opened, $us(platen) AS platen, $us(process) AS process, $us(acquired) AS acquired, $us(result) AS result, n_errors,
    CASE WHEN n_errors > 0 THEN 'ERROR' WHEN result IS NOT NULL THEN 'COMPLETED' ELSE 'ABANDONED' END AS outcome, $us(result) - $us(opened) AS latency_us FROM (
    SELECT device_id, cycle, min(ts) AS opened, {FIRST}, count_if(kind = 'Error') AS n_errors FROM (
    SELECT *, sum(CASE WHEN kind = 'Default' THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING)::BIGINT AS cycle FROM f3) WHERE cycle > 0 GROUP BY device_id, cycle)""", f3=fx.F3)
def _(s, d):
    return devices.capture_cycles(log(s, d))


@query("w5_progress", f"""SELECT device_id, seq, progress, max(progress) OVER ({W} ROWS UNBOUNDED PRECEDING) AS best, max(progress) OVER ({W} ROWS UNBOUNDED PRECEDING) >= 100 AS completed,
    coalesce(progress < lag(progress) OVER ({W}), false) AS regressed FROM f3 WHERE kind = 'Initialize'""", f3=fx.F3)
def _(s, d):
    return devices.init_progress(log(s, d)).select("device_id", "seq", "progress", "best", "completed", "regressed")


@query("w6_debounce", f"SELECT device_id, seq, $us(ts) AS ts, kind FROM f3 QUALIFY coalesce($us(lead(ts) OVER ({W})) - $us(ts) >= 3600000000, true)", f3=fx.F3)
def _(s, d):
    return devices.debounce(log(s, d).select("device_id", "seq", "ts", "kind"), 3_600_000)


@query("w7_snapshot", "SELECT ns, key, seq, $us(ts) AS ts, type_tag, value, deleted FROM (SELECT * FROM f6 WHERE ts <= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY ns, key ORDER BY ts DESC, seq DESC) = 1) WHERE NOT deleted", f6=fx.F6)
def _(s, d):
    return prefs.kv_snapshot(fx.load(s, d, fx.F6), "2024-01-20 00:00:00")


@query("w8_tokens", "SELECT ns, seq, $us(ts) AS valid_from, $us(nxt) AS valid_to FROM (SELECT *, lead(ts) OVER (PARTITION BY ns ORDER BY ts, seq) AS nxt FROM f6 WHERE key = 'signup') WHERE NOT deleted", f6=fx.F6)
def _(s, d):
    return prefs.token_intervals(fx.load(s, d, fx.F6), "signup")


@query("w9_slots", """SELECT session_id, finger_bit, seq, op, force, CASE WHEN op = 'add' AND NOT force AND lag(op) OVER (PARTITION BY session_id, finger_bit ORDER BY seq) = 'add' THEN 'ALREADY_USED' ELSE 'OK' END AS result FROM f10""", f10=fx.F10_SLOTS)
def _(s, d):
    return enrollment.finger_slots(fx.load(s, d, fx.F10_SLOTS))[0]


@query("w9_masks", """SELECT session_id, coalesce(bit_or(CASE WHEN op = 'add' THEN finger_bit END), 0)::INT AS mask FROM (SELECT session_id, finger_bit, arg_max(op, seq) AS op FROM f10 GROUP BY ALL) GROUP BY session_id""", f10=fx.F10_SLOTS)
def _(s, d):
    return enrollment.finger_slots(fx.load(s, d, fx.F10_SLOTS))[1]


# -- top-k, sets


T1 = f"SELECT probe_id, template_id, subject_id, round(score, 4) AS score, rank::INT AS rank FROM ({BEST}) WHERE rank <= 5"


@query("t1_candidates", T1, f2=fx.F2)
def _(s, d):
    return matching.candidates(*_probes(s, d), 5)


@query("t2_history", "SELECT subject_id, seq, $us(ts) AS ts FROM ci WHERE subject_id = 'C7' ORDER BY ts DESC, seq DESC LIMIT 10 OFFSET 5", ci=fx.F8_CHECKINS)
def _(s, d):
    return attendance.attendance_history(fx.load(s, d, fx.F8_CHECKINS), "C7", 10, 5)


@query("u1_union_channels", "SELECT device_id, seq, kind, CASE WHEN kind = 'Initialize' THEN progress END AS progress, CASE WHEN kind = 'Error' THEN status_code END AS status_code FROM f3 WHERE kind IN ('Initialize', 'Error', 'Result')", f3=fx.F3)
def _(s, d):
    x = log(s, d)
    return devices.union_channels(devices.only_kind(x, "Initialize", ["device_id", "seq", "kind", "progress"]), devices.only_kind(x, "Error", ["device_id", "seq", "kind", "status_code"]), devices.only_kind(x, "Result", ["device_id", "seq", "kind"]))


@query("u2_roster", "SELECT * FROM roster", **R)
def _(s, d):
    return _roster(s, d)


@query("u3_sync_delta", f"SELECT *, 'added' AS change FROM (({COPIES[1]}) EXCEPT ALL ({COPIES[0]})) UNION ALL SELECT *, 'removed' FROM (({COPIES[0]}) EXCEPT ALL ({COPIES[1]}))", f2=fx.F2)
def _(s, d):
    t = fx.load(s, d, fx.F2).select("template_id")
    return enrollment.sync_delta(t.where("template_id % 4 <> 0").withColumn("version", F.expr("1 + template_id % 3")), t.where("template_id % 4 <> 1").withColumn("version", F.expr("1 + template_id % 2")))


# -- streams


def _stream(s, d, text, name="events"):
    """A fixture over a streamed table, which is a file or a folder of files. The pattern matches that one name: a stream takes a
    single file by a pattern only."""
    schema = fx.table(s, d, name).schema
    s.readStream.schema(schema).parquet(f"{d}/{name}[.]parquet").createOrReplaceTempView(name)
    return s.sql(fx.sql(text, "spark"))


# the rows come in three parts by time, of which the last one also brings late rows of the first
LATE = "seq % 50 = 7 AND ts < TIMESTAMP '2024-01-11'"
ARRIVAL = f"CASE WHEN {LATE} THEN 2 WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END"


def _arriving(s, rows, arrival, n, run):
    """Runs a stream over rows that come in n parts, each by a restart from the checkpoint: run(stream, folder), its last result."""
    path = tables.fresh_folder(s, "arrivals")
    for k in range(n):
        rows.where(f"({arrival}) = {k}").write.parquet(f"{path}/in/{k}")
        out = run(s.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{path}/in"), f"{path}/run")
    return out


def _resumed(make):
    return lambda stream, folder: st.run_available(make(stream), "append", folder=folder)


@query("r1_stream_latest", LATEST, f3=fx.F3)
def _(s, d):
    """Update mode into a keyed table, which the stream goes on with after each restart."""
    rows, table = log(s, d).select("device_id", "ts", "seq", "kind"), tables.fresh_folder(s, "latest")
    _arriving(s, rows, ARRIVAL, 3, lambda stream, folder: st.keep_latest(stream, table, folder, 16))
    return keyed.read_keyed(s, table, rows.schema)


@query("r1_stream_latest_complete", LATEST, f3=fx.F3)
def _(s, d):
    return st.run_available(st.stream_latest_state(_stream(s, d, fx.F3)), "complete")


@query("r2_stream_changes", CHANGED, f3=fx.F3)
def _(s, d):
    return st.run_available(st.stream_changes(_stream(s, d, fx.F3)), "append")


# a batch is sent again at once, after 20 days or after 1100; it is remembered for 30
SENT_ARRIVAL = "CASE WHEN ts < TIMESTAMP '1997-01-01' THEN 0 WHEN ts < TIMESTAMP '1999-01-01' THEN 1 WHEN ts < TIMESTAMP '2001-01-01' THEN 2 WHEN ts < TIMESTAMP '2003-01-01' THEN 3 ELSE 4 END"


@query("r3_stream_enrollments", "SELECT o_orderkey AS batch_id, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS applied FROM orders")
def _(s, d):
    out = _arriving(s, fx.load(s, d, fx.F10_SENT), SENT_ARRIVAL, 5, _resumed(lambda x: st.stream_enrollments(x, "30 days").select("batch_id")))
    return out.groupBy("batch_id").agg(F.count("*").cast("int").alias("applied"))


@query("r4_stream_sessions", f"""SELECT device_id, $us(a) AS start, z AS "end", n FROM (SELECT device_id, min(ts) AS a, $us(max(ts)) + 21600000000 AS z, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap >= 21600000000 OR gap IS NULL THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS k
    FROM (SELECT *, $us(ts) - lag($us(ts)) OVER ({W}) AS gap FROM f3 WHERE NOT ({LATE}))) GROUP BY device_id, k) WHERE z <= (SELECT max($us(ts)) $div 1000 * 1000 - 86400000000 FROM f3)""", f3=fx.F3)
def _(s, d):
    return _arriving(s, log(s, d).select("device_id", "ts", "seq", "kind"), ARRIVAL, 3, _resumed(lambda x: st.stream_sessions(x, "6 hours", "1 day")))


@query("r5_stream_debounce", f"""SELECT device_id, seq, $us(ts) AS ts, kind FROM (SELECT * FROM f3 WHERE NOT ({LATE}) QUALIFY coalesce($us(lead(ts) OVER ({W})) - $us(ts) >= 3600000000, true)) WHERE $us(ts) $div 1000 + 3600000 <= (SELECT max($us(ts)) $div 1000 - 60000 FROM f3)""", f3=fx.F3)
def _(s, d):
    return _arriving(s, log(s, d).select("device_id", "ts", "seq", "kind"), ARRIVAL, 3, _resumed(lambda x: st.stream_debounce(x, 3_600_000, "1 minute")))


@query("r6_stream_errors", f"""SELECT device_id, start, n FROM (SELECT device_id, $us(date_trunc('day', ts)) AS start, count(*) AS n FROM f3 WHERE kind = 'Error' AND NOT ({LATE}) GROUP BY ALL)
    WHERE start + 86400000000 <= (SELECT max($us(ts)) $div 1000 * 1000 - 86400000000 FROM f3 WHERE kind = 'Error')""", f3=fx.F3)
def _(s, d):
    return _arriving(s, log(s, d).select("device_id", "ts", "seq", "kind"), ARRIVAL, 3, _resumed(lambda x: st.stream_error_counts(x, "1 day", "1 day")))


@query("r7_stream_identify", J1, f2=fx.F2)
def _(s, d):
    _, gallery = _probes(s, d)
    return st.stream_identify(_stream(s, d, fx.F2, "embeddings").where("probe_id % 10 = 0"), gallery, 0.35)


@query("r7_check_ins", f"SELECT probe_id, subject_id, score FROM ({J1}) WHERE outcome = 'MATCH'", f2=fx.F2)
def _(s, d):
    """Check-ins by a stream that is stopped and started again."""
    probes, gallery = _probes(s, d)
    probes = probes.select("probe_id", F.lit("2024-01-01 08:00:00").cast("timestamp").alias("ts"), "vector")
    return _arriving(s, probes, "probe_id % 20 DIV 10", 2, lambda stream, folder: st.check_in(stream, gallery, 0.35, folder)).select("probe_id", "subject_id", "score")


KV_START = "TIMESTAMP '2024-01-10'"


@query("r8_stream_kv", f"""SELECT ns AS device_id, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS ts, value FROM cur UNION ALL SELECT ns, seq, $us(ts), value FROM (SELECT ns, seq, ts, value, lag(value, 1, first) OVER (PARTITION BY ns ORDER BY ts, seq) AS before
    FROM (SELECT f6.ns, seq, ts, CASE WHEN NOT deleted THEN f6.value END AS value, cur.value AS first FROM f6 LEFT JOIN cur ON cur.ns = f6.ns WHERE key = 'view' AND ts > {KV_START})) WHERE value IS DISTINCT FROM before""",
       f6=fx.F6, cur=f"SELECT ns, value FROM (SELECT * FROM f6 WHERE key = 'view' AND ts <= {KV_START} QUALIFY row_number() OVER (PARTITION BY ns ORDER BY ts DESC, seq DESC) = 1) WHERE NOT deleted")
def _(s, d):
    current = prefs.kv_snapshot(fx.load(s, d, fx.F6).where("key = 'view'"), "2024-01-10 00:00:00").select("ns", "value")
    path = tables.fresh_folder(s, "current")  # _stream takes the view's name over
    current.write.parquet(path)
    return st.observe_kv(_stream(s, d, fx.F6).where(f"ts > {KV_START}"), "view", s.read.parquet(path))


@query("r9_stream_gate", f"SELECT capture_id FROM (SELECT capture_id, coalesce({P1}, {GATE}) AS reason FROM f1) WHERE reason IS NULL", f1=fx.F1)
def _(s, d):
    x = st.stream_capture_gate(_stream(s, d, fx.F1, "documents").drop("data"), 30, 20).select("capture_id", "reason")
    return st.run_available(x, "append", rejects=tables.fresh_folder(s, "dead-letters"))


@query("r9_stream_rejects", f"SELECT reason, count(*) AS n FROM (SELECT coalesce({P1}, {GATE}) AS reason FROM f1) WHERE reason IS NOT NULL GROUP BY reason", f1=fx.F1)
def _(s, d):
    dead = tables.fresh_folder(s, "dead-letters")
    rows = fx.captures(s, d).drop("data")
    _arriving(s, rows, "capture_id % 2", 2, lambda stream, folder: st.run_available(st.stream_capture_gate(stream, 30, 20).select("capture_id", "reason"), "append", rejects=dead, folder=folder))
    return s.read.parquet(dead).groupBy("reason").agg(F.count("*").alias("n"))


@query("x1_custom_score", J1, f2=fx.F2)
def _(s, d):
    """A customer's matcher: a function of a matrix of probes and one of templates."""
    import numpy as np

    return matching.identify(*_probes(s, d), 0.35, matcher=lambda q, x: np.einsum("ik,jk->ij", q, x))


@query("x1_expression", J1, f2=fx.F2)
def _(s, d):
    """A customer's matcher as a Column, with the 64 components written out."""
    return matching.identify(*_probes(s, d), 0.35, score_fn=matching.product(64))


@query("x1_pandas_score", T1, f2=fx.F2)
def _(s, d):
    """A customer's matcher as a pandas_udf of two data frames, a column a component."""
    return matching.candidates(*_probes(s, d), 5, score_fn=F.pandas_udf(_frames_dot, "double"))


def _frames_dot(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    return pd.Series(np.einsum("ij,ij->i", a.to_numpy(), b.to_numpy()))


def _series_dot(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float(x @ y) for x, y in zip(a, b)])
