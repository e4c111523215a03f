"""Schemas of the logical tables, and adapters that read the event table as hits or states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _S, _L = T.DoubleType(), T.StringType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PCM_CHUNKS = _struct(track_id=_L, chunk_idx=_L, start_sample=_L, sr=T.IntegerType(), samples=T.ArrayType(T.FloatType()))
FRAMES = _struct(track_id=_L, frame_idx=_L, t=_D, mag=T.ArrayType(_D))
HITS = _struct(event_id=_L, track_id=_L, type=_S, us=_L, time=_D, confidence=_D, velocity=_D)
PEAKS = _struct(track_id=_L, time=_D, amplitude=_D, confidence=_D, type=_S)
INTERVALS = _struct(track_id=_L, start_time=_D, end_time=_D, confidence=_D, type=_S, components=T.ArrayType(_S))
STATES = _struct(event_id=_L, track_id=_L, time=_D, mode_index=_L, phase=_D, amplitude=_D, frequency=_D)
TRACKS = _struct(track_id=_L, embedding=T.ArrayType(T.FloatType()), added=T.TimestampType(), updated=T.TimestampType(), metadata=T.MapType(_S, _S))
JOBS = _struct(id=_S, status=_S, created_at=T.TimestampType(), completed_at=T.TimestampType(), progress=_D)

#: Event times count from here.
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_hits(events: DataFrame) -> DataFrame:
    """Event rows as drum hits: the type plays the drum class, the user the track."""
    # both ends are cast alike, so the session's time zone does not matter
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))
    return events.select(
        "event_id", F.col("user_id").alias("track_id"), F.col("event_type").alias("type"), us.alias("us"), (us / 1e6).alias("time"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"), F.col("value").alias("velocity"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hits(table(spark, sf_dir, "events"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as a state trajectory of eight modes."""
    h = hits(spark, sf_dir)
    return h.select(
        "event_id", "track_id", "time", (F.col("track_id") % 8).alias("mode_index"), F.col("velocity").alias("amplitude"),
        (2 * F.pi() * F.col("confidence")).alias("phase"), (40.0 + F.col("track_id")).alias("frequency"),
        (F.col("confidence") * 100).cast("long").alias("k"),
    )


def long_metrics(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide numeric columns as rows (keys, metric, value)."""
    return df.unpivot(keys, columns, "metric", "value")
