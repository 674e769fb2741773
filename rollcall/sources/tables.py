"""Sources and sinks (SRC1-SRC3, SNK1, SNK2)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import keyed

CAPTURE = "capture_id BIGINT, width INT, height INT, data BINARY"
TEMPLATE = "template_id BIGINT, subject_id INT, vector ARRAY<FLOAT>"
EVENT = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
KV = "ns BIGINT, key STRING, type_tag STRING, value STRING, deleted BOOLEAN, ts TIMESTAMP, seq BIGINT"
_own: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir; a temporary one only in local mode without that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-rollcall-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        top = "file://" + _own[0]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _read(spark: SparkSession, path: str, schema: str | T.StructType, streaming: bool = False, glob: str | None = None) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """SRC1. The schema is enforced, not inferred."""
    return _read(spark, path, CAPTURE)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """SRC1."""
    return _read(spark, path, TEMPLATE)


def read_events(spark: SparkSession, path: str, streaming: bool = False, glob: str | None = None) -> DataFrame:
    """SRC2. Batch or stream; ts becomes a TIMESTAMP, which watermarks need."""
    return _read(spark, path, EVENT, streaming, glob).withColumn("ts", F.col("ts").cast("timestamp"))


def read_kv_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC3."""
    return _read(spark, path, KV)


def split_rejects(df: DataFrame, reason_col: str = "reason") -> tuple[DataFrame, DataFrame]:
    """SNK2. Accepted rows and rejected ones."""
    return df.where(F.col(reason_col).isNull()).drop(reason_col), df.where(F.col(reason_col).isNotNull())


def write_rejects(df: DataFrame, path: str, batch_id: str, reason_col: str = "reason") -> None:
    """SNK2. Rejects of one batch, by reason; the same batch again replaces its own rows only."""
    df.write.mode("overwrite").partitionBy(reason_col).parquet(f"{path}/batch={quote(str(batch_id), safe='')}")


def upsert_gallery(df: DataFrame, path: str, batch_id: str, keys: tuple[str, ...] = ("subject_id", "finger_bit"), order: tuple[str, ...] = ("batch_id",), buckets: int = keyed.BUCKETS) -> DataFrame:
    """SNK1. Adds a batch to the gallery and returns the gallery: the latest row of each key. A batch whose id is there already is
    not applied again; a batch rewrites the buckets of its own keys only (see keyed)."""
    keyed.upsert(df, path, batch_id, keys, order, buckets)
    return keyed.read_keyed(df.sparkSession, path, df.schema)
