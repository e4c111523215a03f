"""Synthetic signals, generated by Spark: rows (i, x)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sine(spark: SparkSession, freq: float, duration: float, sr: int = 8000, amp: float = 1.0, phase: float = 0.0) -> DataFrame:
    i = F.col("id")
    return spark.range(int(duration * sr)).select(i.alias("i"), (amp * F.sin(2 * math.pi * freq * i / sr + phase)).alias("x"))


def multimode(spark: SparkSession, freqs: list[float], duration: float, sr: int = 8000, amps: list[float] | None = None, phases: list[float] | None = None) -> DataFrame:
    """Sum of sines; amplitudes 1/(k+1) and phases 0 unless given."""
    amps = amps or [1 / (k + 1) for k in range(len(freqs))]
    phases = phases or [0.0] * len(freqs)
    i, x = F.col("id"), F.lit(0.0)
    for f, a, p in zip(freqs, amps, phases, strict=True):
        x = x + a * F.sin(2 * math.pi * f * i / sr + p)
    return spark.range(int(duration * sr)).select(i.alias("i"), x.alias("x"))


# fixed values: sixteenths of a bar on which each drum sounds
BREAK = {"kick": (0, 4, 5, 8, 12), "snare": (2, 6, 10, 14), "hihat": (1, 3, 7, 9, 11, 13, 15)}


def break_pattern(spark: SparkSession, bars: int = 2, bpm: float = 136.7, sr: int = 8000, seed: int = 7) -> DataFrame:
    """A drum break: decaying tone (kick) and noise (snare, hi-hat) at their sixteenths, scaled to a peak of 1."""
    step = 60 / bpm / 4
    rows = [(kind, bar * 16 * step + k * step) for bar in range(bars) for kind, ks in BREAK.items() for k in ks]
    onsets = spark.createDataFrame(rows, "kind string, onset double")  # a few dozen rows
    length = F.when(F.col("kind") == "kick", 0.15).when(F.col("kind") == "snare", 0.1).otherwise(0.04)
    t = spark.range(int(bars * 16 * step * sr)).withColumn("t", F.col("id") / sr)
    hit = t.join(F.broadcast(onsets.withColumn("length", length)), (F.col("t") >= F.col("onset")) & (F.col("t") < F.col("onset") + F.col("length")), "left")
    dt = F.col("t") - F.col("onset")
    tone = F.sin(2 * math.pi * 60 * dt) * F.exp(-20 * dt)
    # hashed, so that every run makes the same noise
    noise = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) / (1 << 19) - 1) * F.exp(-30 * dt) * F.when(F.col("kind") == "snare", 0.8).otherwise(0.4)
    x = hit.groupBy("id").agg(F.sum(F.coalesce(F.when(F.col("kind") == "kick", tone).otherwise(noise), F.lit(0.0))).alias("x"))
    top = x.agg(F.max(F.abs("x")).alias("top"))  # one row
    return x.crossJoin(F.broadcast(top)).select(F.col("id").alias("i"), (F.col("x") / F.col("top")).alias("x"))


def to_chunks(samples: DataFrame, size: int, sr: int, track_id: int = 0) -> DataFrame:
    """Rows (i, x) as pcm chunks of ``size`` samples."""
    c = samples.groupBy(F.floor(F.col("i") / size).alias("chunk_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"].cast("float")).alias("samples"))
    return c.select(F.lit(track_id).cast("long").alias("track_id"), "chunk_idx", (F.col("chunk_idx") * size).alias("start_sample"), F.lit(sr).alias("sr"), "samples")
