"""Projections, filters and flags over event and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_slice(df: DataFrame, start: float, end: float, max_items: int | None = None) -> DataFrame:
    """Events with start <= time <= end, in time order; at most ``max_items`` of them."""
    out = df.where(F.col("time").between(start, end))
    return out if max_items is None else out.orderBy("time", "event_id").limit(max_items)


def by_type(df: DataFrame, event_type: str, limit: int = 1000) -> DataFrame:
    """The first events of one type."""
    return df.where(F.col("type") == event_type).orderBy("time", "event_id").limit(limit)


def extract_metrics(docs: DataFrame) -> DataFrame:
    """Scalar metrics of result documents (struct column ``result``), long: file, metric, value.

    ``quality`` values keep their name behind ``quality_``, scalar ``features`` behind ``feature_``.
    """
    r = F.col("result")
    fixed = {"duration": r["duration"], "sample_rate": r["sample_rate"], "channels": r["channels"], "bpm": r["tempo"]["bpm"], "key_confidence": r["key"]["confidence"]}
    scalars = F.map_from_arrays(F.array(*map(F.lit, fixed)), F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in fixed.values()]))
    named = lambda m, prefix: F.coalesce(F.transform_keys(m, lambda k, _: F.concat(F.lit(prefix), k)), F.create_map().cast("map<string,double>"))
    every = F.map_concat(scalars, named(r["quality"], "quality_"), named(r["features"], "feature_"))
    return docs.select("file", F.explode(every).alias("metric", "value"))


def extract_labels(docs: DataFrame) -> DataFrame:
    """Text metrics of result documents with "" where absent."""
    r = F.col("result")
    text = lambda c: F.coalesce(c, F.lit(""))
    return docs.select("file", text(r["tempo"]["label"]).alias("tempo_label"), text(r["key"]["key"]).alias("key"), text(r["key"]["scale"]).alias("scale"))


def extract_batch_metrics(docs: DataFrame) -> DataFrame:
    """Mix-level scalars and the sizes of its lists."""
    r = F.col("result")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return docs.select("file", F.coalesce(r["tempo"]["bpm"], F.lit(0.0)).alias("bpm"), size(r["segments"]).alias("segments"), size(r["transitions"]).alias("transitions"))


def route(key: Column) -> Column:
    """Where a result key belongs: features, annotation or analysis."""
    key = F.lower(key)
    return F.when(key.rlike("bpm|tempo|beat|rhythm|spectral"), "features").when(key.rlike("segment|peak|transition"), "annotation").otherwise("analysis")


def sanitize(c: Column) -> Column:
    """NaN to 0, infinity to 1, minus infinity to 0."""
    return F.when(F.isnan(c), 0.0).when(c == float("inf"), 1.0).when(c == float("-inf"), 0.0).otherwise(c)


#: Limits of normal values by the part of a parameter's name before the first underscore.
EXTREME_LIMITS = {"velocity": 1e6, "size": 1e3}
DEFAULT_LIMIT = 1e6


def extreme_flag(long: DataFrame) -> DataFrame:
    """Rows (param, value) with ``category`` and ``measure``: NaN and 0, Extreme and log10, Normal and the value."""
    prefix = F.substring_index("param", "_", 1)
    limit = F.lit(DEFAULT_LIMIT)
    for name, value in EXTREME_LIMITS.items():
        limit = F.when(prefix == name, value).otherwise(limit)
    v = F.col("value")
    big = F.abs(v) > limit
    return long.withColumn("category", F.when(F.isnan(v), "NaN").when(big, "Extreme").otherwise("Normal")).withColumn(
        "measure", F.when(F.isnan(v), 0.0).when(big, F.log10(F.abs(v))).otherwise(v)
    )


def nan_census(long: DataFrame) -> DataFrame:
    """Per parameter the number of NaN and of valid values."""
    bad = F.isnan("value").cast("long")
    return long.groupBy("param").agg(F.sum(bad).alias("n_nan"), F.sum(1 - bad).alias("n_valid"))


def anomalies(long: DataFrame, limit: float = 1e6) -> DataFrame:
    """Rows that are NaN or beyond the limit, with the reason."""
    reason = F.when(F.isnan("value"), "NaN").when(F.abs("value") > limit, "extreme")
    return long.withColumn("reason", reason).where("reason IS NOT NULL")


def anomaly_score(long: DataFrame, extra: DataFrame) -> DataFrame:
    """Score per document of rows (id, family, value) in the families entropy and droplet, and of (id, duration, samples); at most 1."""
    v, entropy = F.col("value"), F.col("family") == "entropy"
    pick = lambda a, b: F.when(entropy, a).otherwise(b)
    points = (
        F.when(F.isnan(v), 0.2)
        .when(F.abs(v) > 1e6, pick(0.3, 0.25))
        .when(F.abs(v) > pick(1e4, 1e3), pick(0.1, 0.05))
        .otherwise(0.0)
    )
    size = F.when((F.col("duration") > 1000) | (F.col("samples") > 50e6), 0.1).otherwise(0.0)
    return long.groupBy("id").agg(F.sum(points).alias("points")).join(extra, "id").select("id", F.least(F.lit(1.0), F.col("points") + size).alias("score"))


def log_signs(long: DataFrame) -> DataFrame:
    """Sign (1 for zero) and log10 of the size (0 for zero)."""
    v = F.col("value")
    return long.select("*", F.when(v >= 0, 1).otherwise(-1).alias("sign"), F.when(v == 0, 0.0).otherwise(F.log10(F.abs(v))).alias("log_abs"))


def derived_rates(df: DataFrame) -> DataFrame:
    """Entropy per MB, second and sample, samples a second, and the size estimate in MB."""
    mb = F.col("samples") * 32 / (8 * 1024 * 1024)
    per = lambda c, x: F.when(x > 0, c / x).otherwise(0.0)
    e = F.col("entropy")
    return df.select(
        "id", mb.alias("mb"), per(e, mb).alias("entropy_per_mb"), per(e, F.col("duration")).alias("entropy_per_second"),
        per(e, F.col("samples")).alias("entropy_per_sample"), per(F.col("samples"), F.col("duration")).alias("samples_per_second"),
    )


def filter_confidence(df: DataFrame, least: float) -> DataFrame:
    return df.where(F.col("confidence") >= least)


def filter_interval(df: DataFrame, low: float = 0.05, high: float = 2.0) -> DataFrame:
    """Rows whose ``dt`` is strictly between the bounds."""
    return df.where((F.col("dt") > low) & (F.col("dt") < high))
