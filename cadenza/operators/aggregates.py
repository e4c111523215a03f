"""Aggregations over hits, metrics, peaks, transitions and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import quantiles, same


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over the rows where both are known; null where one of them doesn't vary, by its extremes: parts of a
    mean that merge may leave a spread of some rounding. ``corr`` divides by zero there, which is an error in ANSI mode."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y)))


def hit_stats_by_type(hits: DataFrame) -> DataFrame:
    """Per type: hits, share in percent, mean confidence and velocity. One shuffle; the share is over the few aggregated rows."""
    by = hits.groupBy("type").agg(F.count(F.lit(1)).alias("hits"), F.avg("confidence").alias("avg_confidence"), F.avg("velocity").alias("avg_velocity"))
    return by.withColumn("pct", 100.0 * F.col("hits") / F.sum("hits").over(Window.partitionBy(F.lit(0))))


def count_by_type(hits: DataFrame, top: int = 10) -> DataFrame:
    """Counts by type, the largest ``top`` by name and the rest as Other."""
    by = hits.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    ranked = by.withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "type")))
    return ranked.groupBy(F.when(F.col("rn") > top, "Other").otherwise(F.col("type")).alias("type")).agg(F.sum("n").alias("n"))


def time_span(hits: DataFrame) -> DataFrame:
    return hits.agg(
        F.min("time").alias("first"), F.max("time").alias("last"), (F.max("time") - F.min("time")).alias("duration"),
        F.avg("confidence").alias("avg_confidence"), F.avg("velocity").alias("avg_velocity"),
    )


def density_histogram(hits: DataFrame, least_width: float = 5.0, parts: int = 100) -> DataFrame:
    """Hits per bin of width max(least_width, duration/parts) from the first hit; the last bin holds its right edge; empty bins count 0."""
    span = hits.agg(F.min("time").alias("lo"), F.max("time").alias("hi"))  # one row
    span = span.withColumn("w", F.greatest(F.lit(least_width), (F.col("hi") - F.col("lo")) / parts))
    span = span.withColumn("n_bins", F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / F.col("w") - 1e-9)).cast("int"))
    n = hits.crossJoin(F.broadcast(span)).groupBy(F.least(F.floor((F.col("time") - F.col("lo")) / F.col("w")), F.col("n_bins") - 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = span.select(F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"), "lo", "w")
    return bins.join(n, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("start"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def density_heatmap(hits: DataFrame, bins: int = 50) -> DataFrame:
    """Per type and bin the hits over the type's largest bin."""
    span = hits.agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    cell = F.least(F.floor((F.col("time") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    n = hits.crossJoin(F.broadcast(span)).groupBy("type", cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("level", F.col("n") / F.max("n").over(Window.partitionBy("type")))


def compare_metrics(long: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """Per metric (and group): mean, median, sample std, min, max, range, count of rows (metric, value). The median is exact, by
    distributed selection; a metric without values has null for it."""
    keys = ["metric", *(group_by or [])]
    found = long.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), (F.max("value") - F.min("value")).alias("range"), F.count("value").alias("n"),
    )
    both = same(found, quantiles(long, keys, (0.5,)), keys, "left")
    return both.select(*keys, "mean", F.col("q")[0].alias("median"), "std", "min", "max", "range", "n")


def feature_stats(long: DataFrame) -> DataFrame:
    """Per feature: count, min, max, mean, population variance and std, share of zeros, size in MB of doubles."""
    return long.groupBy("metric").agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.var_pop("value").alias("var"), F.stddev_pop("value").alias("std"), F.avg((F.col("value") == 0).cast("double")).alias("sparsity"),
        (F.count("value") * 8 / 1048576).alias("size_mb"),
    )


def segment_rollup(frames: DataFrame, key: str = "track_id", vec: str = "vec") -> DataFrame:
    """Per track and vector index: mean, population std, max and min over its rows."""
    return frames.select(key, F.posexplode(vec).alias("idx", "x")).groupBy(key, "idx").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.max("x").alias("max"), F.min("x").alias("min")
    )


def rollup_vectors(rolled: DataFrame, key: str = "track_id") -> DataFrame:
    """The rolled-up means of a track as one array again; a vector's width bounds the group."""
    return rolled.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "mean"))), lambda s: s["mean"]).alias("mean"))


def weighted_mean(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Weighted mean per key; the plain mean where the weights add up to nothing."""
    w = F.sum(F.col(weight))
    return df.groupBy(key).agg(F.when(w == 0, F.avg(value)).otherwise(F.sum(F.col(value) * F.col(weight)) / F.nullif(w, F.lit(0.0))).alias("value"))


def combine_batches(parts: DataFrame, key: str = "track_id") -> DataFrame:
    """Batches of (key, batch, items, number, label) into one row: lists in batch order, the mean number, the first label.

    A key's batches are the segments of one track, so the collected lists are bounded by a track.
    """
    return parts.groupBy(key).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("batch", "items"))), lambda s: s["items"])).alias("items"),
        F.avg("number").alias("number"), F.min_by("label", "batch").alias("label"),
    )


def background_rollup(long: DataFrame) -> DataFrame:
    """Mean and population std of every scene feature."""
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def peak_statistics(peaks: DataFrame, key: str = "track_id") -> DataFrame:
    """Per track: peaks, density over its span, mean confidence."""
    span = F.max("time") - F.min("time")
    return peaks.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.when(span > 0, F.count(F.lit(1)) / span).otherwise(0.0).alias("density"), F.avg("confidence").alias("avg_confidence"))


def peaks_by_type(peaks: DataFrame, key: str = "track_id") -> DataFrame:
    return peaks.groupBy(key, "type").agg(F.count(F.lit(1)).alias("n"))


def band_activity(df: DataFrame, key: str = "band", value: str = "level", active: float = 0.1) -> DataFrame:
    """Mean, population std, maximum and active share per band."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("max"), F.avg((F.col(value) > active).cast("double")).alias("active"))


def transition_summary(transitions: DataFrame) -> DataFrame:
    """Count and mean length per transition type."""
    return transitions.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("end_time") - F.col("start_time")).alias("avg_length"))


def cluster_stats(segments: DataFrame) -> DataFrame:
    """Segments, mean duration and mean confidence per cluster."""
    return segments.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("end_time") - F.col("start_time")).alias("avg_duration"), F.avg("confidence").alias("avg_confidence"))


def batch_summary(tasks: DataFrame, config: str = "config", status: str = "status", seconds: str = "seconds") -> DataFrame:
    """Totals by configuration and over all (null configuration) in one pass."""
    ok, failed = (F.sum((F.col(status) == s).cast("long")) for s in ("success", "failed"))
    return tasks.rollup(config).agg(
        F.count(F.lit(1)).alias("total"), ok.alias("success"), failed.alias("failed"), F.sum(seconds).alias("total_time"), (100.0 * ok / F.count(F.lit(1))).alias("success_pct")
    )


def emotion_stats(long: DataFrame) -> DataFrame:
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("std"))


def beat_statistics(beats: DataFrame, hits: DataFrame, key: str = "track_id") -> DataFrame:
    """Per track: beats, mean interval, and hits per second up to the last beat."""
    b = beats.groupBy(key).agg(F.count(F.lit(1)).alias("beats"), F.min("time").alias("_a"), F.max("time").alias("_z"))
    h = hits.groupBy(key).agg(F.count(F.lit(1)).alias("_h"))
    out = b.join(h, key, "left")
    return out.select(
        key, "beats", F.when(F.col("beats") > 1, (F.col("_z") - F.col("_a")) / (F.col("beats") - 1)).otherwise(0.0).alias("avg_interval"),
        F.when(F.col("_z") > 0, F.coalesce("_h", F.lit(0)) / F.col("_z")).otherwise(0.0).alias("hit_density"),
    )


def average_predictions(scores: DataFrame, threshold: float = 0.6, top_k: int = 5, key: str = "track_id") -> DataFrame:
    """Mean score per label over a track's batches, at least the threshold, the best ``top_k``. Means count to nine decimals, so
    that the order of summation decides nothing."""
    mean = scores.groupBy(key, "label").agg(F.avg("score").alias("score")).where(F.round("score", 9) >= threshold)
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "label")
    return mean.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


COMPONENT_GROUPS = {"kick": "rhythm", "snare": "rhythm", "hihat": "rhythm", "subbass": "bass", "reese": "bass", "ambi": "ambient", "fx": "ambient", "synth": "ambient"}


def component_balance(components: DataFrame, groups: dict[str, str] = COMPONENT_GROUPS, key: str = "track_id") -> DataFrame:
    """Energy share of each component group on a track."""
    name = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[F.col("type")]
    e = components.withColumn("grp", name).where("grp IS NOT NULL").groupBy(key, "grp").agg(F.sum("energy").alias("_e"))
    total = F.sum("_e").over(Window.partitionBy(key))
    return e.select(key, "grp", F.when(total > 0, F.col("_e") / total).otherwise(0.0).alias("share"))


def energy_distribution(components: DataFrame, key: str = "track_id", top: int = 3) -> DataFrame:
    """Energy share per component type and whether it is among the track's ``top``."""
    e = components.groupBy(key, "type").agg(F.sum("energy").alias("_e"))
    total = F.sum("_e").over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_e"), "type"))
    return e.select(key, "type", (F.col("_e") / total).alias("share"), (rank <= top).alias("dominant"))


def transformation_counts(df: DataFrame, column: str = "transforms") -> DataFrame:
    """How often each kind of transformation occurs in the arrays."""
    return df.select(F.explode(column).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def list_complexity(n_active: Column, n_transforms: Column, n: Column) -> Column:
    return F.when(n > 0, (n_active + n_transforms) / (2 * n)).otherwise(0.0)


def distribution_moments(long: DataFrame) -> DataFrame:
    """Mean, std, extremes, skewness, excess kurtosis (population) and quartiles per metric, the quartiles by distributed selection."""
    found = long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"),
    )
    both = same(found, quantiles(long, ["metric"], (0.25, 0.5, 0.75)), ["metric"], "left")
    q1, median, q3 = (F.col("q")[i] for i in range(3))
    return both.withColumns({"q1": q1, "median": median, "q3": q3, "iqr": q3 - q1}).drop("q")


def log_summary(long: DataFrame, key: str = "id") -> DataFrame:
    """Mean, median, population std and count of log10 over a document's positive values."""
    v = F.log10("value")
    return long.where(F.col("value") > 0).groupBy(key).agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_pop(v).alias("std"), F.count(F.lit(1)).alias("n"))


def grouped_feature_vector(long: DataFrame, audio: DataFrame) -> DataFrame:
    """One row per document from rows (id, family, value): moments of sizes by family, joined to (id, duration, samples, sr)."""
    v = F.abs("value")
    e, dr = F.when(F.col("family") == "entropy", v), F.when(F.col("family") == "droplet", v)
    by = long.groupBy("id").agg(
        F.avg(e).alias("e_mean"), F.stddev_pop(e).alias("e_std"), F.max(e).alias("e_max"), F.count(e).alias("e_count"),
        F.avg(dr).alias("d_mean"), F.stddev_pop(dr).alias("d_std"), F.max(dr).alias("d_max"),
    )
    return by.join(audio.select("id", "duration", (F.col("samples") / 1e6).alias("msamples"), (F.col("sr") / 1e3).alias("khz")), "id")
