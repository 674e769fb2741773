"""Inputs of the queries, derived from the given tables. Each is SQL that Spark and DuckDB both read, but
for a few functions written as $name( and put in per dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIALECTS = {
    "spark": {"$us(": "unix_micros(", "$arr(": "array(", "$div": "div", "$zip(p.embedding, g.embedding)": "zip_with(p.embedding, g.embedding, (x, y) -> 0.6D * x + 0.8D * y)"},
    "duckdb": {"$us(": "epoch_us(", "$arr(": "list_value(", "$div": "//", "$zip(p.embedding, g.embedding)": "list_transform(list_zip(p.embedding, g.embedding), lambda x: 0.6::DOUBLE * x[1] + 0.8::DOUBLE * x[2])"},
}

F3 = """
SELECT user_id AS device_id, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
  CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'Attached' ELSE 'Detached' END
    WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'Default' ELSE 'Platen' END
    WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'Process' WHEN event_id % 4 = 1 THEN 'Initialize' ELSE 'Ready' END
    WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'Acquired' ELSE 'Result' END
    ELSE 'Error' END AS kind,
  CASE WHEN event_type = 'click' AND event_id % 4 = 1 THEN least(100, CAST(floor(value) AS INT)) END AS progress,
  CASE WHEN event_type = 'error' THEN CASE event_id % 14 WHEN 0 THEN -1 WHEN 1 THEN -6 WHEN 2 THEN -100 WHEN 3 THEN -201 WHEN 4 THEN -300
    WHEN 5 THEN -603 WHEN 6 THEN 200 WHEN 7 THEN 302 WHEN 8 THEN 601 WHEN 9 THEN 515 WHEN 10 THEN -400 WHEN 11 THEN -503 WHEN 12 THEN -502 ELSE -9999 END END AS status_code,
  CAST(event_id % 9 AS INT) AS quality_code,
  $arr(CAST(event_id % 9 AS INT), CAST((event_id * 7) % 9 AS INT)) AS quality_codes,
  CAST(event_id % 8 AS INT) AS option_bits
FROM events"""
F1 = """
SELECT doc_id AS capture_id, CASE WHEN doc_id % 11 = 0 THEN 500 ELSE 400 END AS width, 500 AS height, text AS data,
  CASE WHEN doc_id % 7 = 0 THEN n_chars ELSE 200000 END AS byte_len, CAST(doc_id % 100 AS INT) AS quality,
  CAST((doc_id * 37) % 101 AS INT) AS liveness, doc_id % 13 <> 0 AS is_final
FROM documents"""
F2 = """
SELECT vec_id AS template_id, vec_id AS probe_id, vec_id AS print_id, label AS subject_id, embedding AS vector, vec_id $div 10 AS session_id,
  CAST(power(2, vec_id % 10) AS INT) AS finger_bit FROM embeddings"""
# probes that are noisy captures of the template after theirs: a cosine of about 0.8
F2_NOISY = """
SELECT p.vec_id AS probe_id, $zip(p.embedding, g.embedding) AS vector FROM embeddings p JOIN embeddings g ON p.vec_id % 10 = 0 AND g.vec_id = p.vec_id + 1"""
F4 = """
SELECT CAST(c_custkey AS STRING) AS id, c_name AS full_name, lower(c_name) AS username,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat(lower(c_name), '@example.org') END AS email,
  CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat('t', CAST(c_custkey AS STRING)) END AS token,
  concat('2024-01-0', CAST(1 + c_custkey % 5 AS STRING), ' 00:00:00') AS idle_expires_at,
  concat('2024-01-0', CAST(1 + c_custkey % 9 AS STRING), ' 00:00:00') AS absolute_expires_at,
  CASE WHEN c_custkey % 5 = 0 THEN 'organization' ELSE 'site' END AS scope_kind, CAST(n_regionkey AS STRING) AS organization_id,
  CAST(c_nationkey AS STRING) AS site_id, c_mktsegment = 'BUILDING' AS can_enrol, c_custkey
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
F5 = """
SELECT event_id, concat('/v1/', event_type) AS path,
  CASE event_id % 10 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 302 WHEN 3 THEN 400 WHEN 4 THEN 401 WHEN 5 THEN 403 WHEN 6 THEN 409 WHEN 7 THEN 500 WHEN 8 THEN 503 ELSE 200 END AS status,
  CASE event_id % 3 WHEN 0 THEN concat('{"code":"E', CAST(event_id % 7 AS STRING), '","message":"m"}') WHEN 1 THEN '{"code":"E0"}' ELSE 'not json' END AS body
FROM events"""
F6 = """
SELECT user_id AS ns, event_type AS key, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
  CASE event_id % 7 WHEN 0 THEN 'string' WHEN 1 THEN 'int' WHEN 2 THEN 'long' WHEN 3 THEN 'boolean' WHEN 4 THEN 'float' WHEN 5 THEN 'double' ELSE 'json' END AS type_tag,
  CASE WHEN event_id % 7 = 6 THEN props WHEN event_id % 2 = 0 THEN CAST(CAST(floor(value) AS INT) AS STRING) WHEN event_id % 7 = 3 THEN 'true' ELSE 'x' END AS value,
  event_id % 5 = 0 AS deleted
FROM events"""
F6_LOCALES = "SELECT doc_id AS user_id, lang AS language, CASE WHEN doc_id % 4 = 0 THEN 'fr' END AS locale FROM documents"
F7 = """
SELECT s_suppkey AS device_id, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 4415 END AS vendor_id, concat('P', CAST(s_nationkey % 4 AS STRING)) AS product,
  concat('fw', CAST(s_suppkey % 5 AS STRING)) AS fw_version, s_suppkey % 2 = 0 AS is_opened, s_suppkey % 4 <> 0 AS permitted
FROM supplier"""
F7_READINGS = """
SELECT p_partkey AS reading_id, CASE p_partkey % 6 WHEN 0 THEN 'IGNORE_FINGER_TIME' WHEN 1 THEN 'RETRY_WRONG_COMMUNICATION' WHEN 2 THEN 'CAPTURE_TIMEOUT'
    WHEN 3 THEN 'ROLL_MIN_WIDTH' WHEN 4 THEN CASE WHEN p_partkey % 4 = 0 THEN 'MIN_CAPTURE_TIME_IN_SUPER_DRY_MODE' ELSE 'WET_FINGER_DETECT_LEVEL_THRESHOLD' END ELSE 'SOMETHING_ELSE' END AS property,
  CASE WHEN p_partkey % 17 = 0 THEN 'n/a' WHEN p_partkey % 12 = 10 THEN concat('50 100 150 200', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(' ', CAST(p_size * 40 AS STRING)) END) ELSE CAST(p_size * 100 AS STRING) END AS value
FROM part"""
F8_CHECKINS = """
SELECT concat(CASE WHEN event_id % 4 = 0 THEN 'S' ELSE 'C' END, CAST(user_id AS STRING)) AS subject_id, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq
FROM events WHERE event_type IN ('click', 'view')"""
F8_STUDENTS = "SELECT concat('C', CAST(c_custkey AS STRING)) AS subject_id FROM customer"
F8_STAFF = "SELECT concat('S', CAST(s_suppkey AS STRING)) AS subject_id FROM supplier"
# leaves of -2 to 6 days, some of ten years and some without an end
F9 = """
SELECT concat('C', CAST(user_id AS STRING)) AS subject_id, CAST(ts AS DATE) AS start_day, CASE WHEN event_id % 97 = 0 THEN NULL
  ELSE CAST(CAST(ts AS DATE) + CAST(CASE WHEN event_id % 53 = 0 THEN 3650 ELSE event_id % 9 - 2 END AS INT) * INTERVAL '1' DAY AS DATE) END AS end_day
FROM events WHERE event_type = 'purchase'"""
F10_BATCHES = "SELECT o_orderkey AS batch_id, o_custkey AS subject_id FROM orders"
F10_CAPTURES = "SELECT l_orderkey AS batch_id, CAST(l_quantity AS INT) * 2 AS quality, l_returnflag <> 'R' OR l_linestatus <> 'F' AS shape_ok FROM lineitem"
# enrollment batches with those that are sent again: at once, after 20 days, after 1100 days
F10_SENT = """
SELECT o_orderkey AS batch_id, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders
UNION ALL SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '20' DAY FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1100' DAY FROM orders WHERE o_orderkey % 7 = 0"""
F10_SLOTS = """
SELECT vec_id $div 10 AS session_id, CAST(power(2, (vec_id * 3 + round) % 4) AS INT) AS finger_bit, round * 1000000 + vec_id AS seq,
  CASE WHEN (vec_id + round) % 3 = 0 THEN 'remove' ELSE 'add' END AS op, vec_id % 5 = 0 AS force
FROM embeddings, (SELECT 0 AS round UNION ALL SELECT 1 UNION ALL SELECT 2) AS rounds"""


def sql(text: str, dialect: str) -> str:
    for k, v in DIALECTS[dialect].items():
        text = text.replace(k, v)
    return text


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def load(spark: SparkSession, d: str, text: str) -> DataFrame:
    """The fixture over the tables of a folder."""
    import re

    for name in set(re.findall(r"(?:FROM|JOIN) (\w+)", text)) - {"rounds"}:
        table(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(sql(text, "spark"))


def captures(spark, d):
    return load(spark, d, F1).withColumn("data", F.col("data").cast("binary"))


def users(spark, d):
    caps = F.when(F.col("can_enrol"), F.array(F.lit("enrol"), F.lit("checkin"))).otherwise(F.array(F.lit("checkin")))
    grant = F.struct(F.lit("g").alias("id"), "scope_kind", "organization_id", "site_id", F.lit("rw").alias("access_mode"), caps.alias("capabilities"))
    return load(spark, d, F4).withColumn("grants", F.array(grant))
