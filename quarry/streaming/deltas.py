"""Structured Streaming over delta logs and run events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELTA = "id string, server string, kind string, source_hash string, created_at timestamp, summary string"
EVENT = "run_id string, at timestamp, phase string, heartbeat boolean"


def stream_deltas(spark: SparkSession, path: str, schema: str = DELTA, files_per_trigger: int = 8) -> DataFrame:
    """Append-only JSON lines as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def latest_deltas(stream: DataFrame, key: str = "server", at: str = "created_at") -> DataFrame:
    """Latest record per key, kept as state."""
    rest = [c for c in stream.columns if c != key]
    out = stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("r"))
    return out.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def stream_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Event lines as records; lines that do not parse are dropped."""
    rows = spark.readStream.text(path).select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.where("r IS NOT NULL AND r._bad IS NULL").select("r.*").drop("_bad")


def run_events(stream: DataFrame) -> DataFrame:
    """Per run: events, heartbeats and the latest phase."""
    return stream.groupBy("run_id").agg(F.count("*").alias("n_events"), F.count_if("heartbeat").alias("n_heartbeats"), F.max_by("phase", "at").alias("phase"), F.max("at").alias("last_at"))


def dedup_deltas(stream: DataFrame, delay: str = "1 hour", key: str = "id", at: str = "created_at") -> DataFrame:
    """First record of each id within the delay. The watermark bounds the state; the delay is a parameter."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
