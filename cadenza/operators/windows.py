"""Ordered operators: intervals between hits, smoothing, peaks, merging and interpolation.

Every window is partitioned by a track (or track and type), so one long track is the
largest unit; put a segment into the key where tracks are unbounded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carry import neighbours
from .folds import picked
from .peaks import greedy_by_height, non_max_by_priority, peak_positions, prominences  # noqa: F401
from .selection import with_aggregate


def _order(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def intervals(df: DataFrame, keys: list[str], us: str = "us", tie: str = "event_id") -> DataFrame:
    """``d_us``: microseconds since the row before with the same keys; null for the first."""
    return df.withColumn("d_us", F.col(us) - F.lag(us).over(_order(keys, us, tie)))


def moving_mean_std(df: DataFrame, keys: list[str], order: list[str], value: str, window: int) -> DataFrame:
    """Local mean, local deviation (root mean square of residuals from each row's own local mean) and the value above the adaptive threshold."""
    frame = _order(keys, *order).rowsBetween(-(window // 2), window - window // 2 - 1)
    out = df.withColumn("local_mean", F.avg(value).over(frame)).withColumn("_r", F.pow(F.col(value) - F.col("local_mean"), 2))
    out = out.withColumn("local_std", F.sqrt(F.avg("_r").over(frame))).drop("_r")
    return out.withColumn("above", F.greatest(F.lit(0.0), F.col(value) - (F.col("local_mean") + 2 * F.col("local_std"))))


SAVGOL_7_3 = (-2, 3, 6, 7, 6, 3, -2)


def savgol(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Seven-point cubic smoothing; the three rows at either end keep their value."""
    w = _order(keys, *order)
    terms = [c * (F.lag(value, 3 - k).over(w) if k < 3 else F.col(value) if k == 3 else F.lead(value, k - 3).over(w)) for k, c in enumerate(SAVGOL_7_3)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn("smooth", F.coalesce(total / 21, F.col(value)))


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, k: int = 11) -> DataFrame:
    """Centred mean over k rows with zeros beyond the ends."""
    half = k // 2
    return df.withColumn("average", F.sum(value).over(_order(keys, *order).rowsBetween(-half, half)) / k)


def local_maxima(df: DataFrame, keys: list[str], order: list[str], value: str, height: float | None = None) -> DataFrame:
    """Rows above both neighbours; of a level top the middle row. The ends are no maxima."""
    w = _order(keys, *order)
    step = df.withColumn("_new", F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)).withColumn("_pos", F.row_number().over(w))
    runs = step.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = Window.partitionBy(*keys, "_run")
    runs = runs.withColumn("_a", F.min("_pos").over(one)).withColumn("_z", F.max("_pos").over(one))
    runs = runs.where(F.col("_pos") == F.floor((F.col("_a") + F.col("_z")) / 2))  # one row for each run
    v = _order(keys, "_run")
    top = runs.withColumn("_p", F.lag(value).over(v)).withColumn("_n", F.lead(value).over(v)).where((F.col(value) > F.col("_p")) & (F.col(value) > F.col("_n")))
    if height is not None:
        top = top.where(F.col(value) >= height)
    return top.drop("_new", "_pos", "_run", "_a", "_z", "_p", "_n")


def positive_flux(frames: DataFrame, keys: list[str], order: str = "frame_idx", mag: str = "mag") -> DataFrame:
    """Sum over bins of the rise since the frame before, and the same over its track's largest."""
    w = _order(keys, order)
    prev = F.lag(mag).over(w)
    rise = F.aggregate(F.zip_with(mag, "_prev", lambda a, b: F.greatest(F.lit(0.0), a - b)), F.lit(0.0), lambda s, x: s + x)
    out = frames.withColumn("_prev", prev).withColumn("flux", F.when(F.col("_prev").isNull(), 0.0).otherwise(rise)).drop("_prev")
    top = F.max("flux").over(Window.partitionBy(*keys))
    return out.withColumn("flux_norm", F.when(top > 0, F.col("flux") / top).otherwise(0.0))


def rise_onsets(env: DataFrame, keys: list[str], threshold: float, order: str = "idx", value: str = "env", hop: int = 512, sr: int = 44100) -> DataFrame:
    """Frames whose envelope rises by more than the threshold, with their time."""
    out = env.withColumn("rise", F.col(value) - F.lag(value).over(_order(keys, order))).where(F.col("rise") > threshold)
    return out.withColumn("time", F.col(order) * hop / sr)


def merge_intervals(df: DataFrame, key: str = "track_id") -> DataFrame:
    """Overlapping or touching intervals merge: extremes, greatest confidence, the common type or ``blend``, and the components of all."""
    w = _order([key], "start_time", "end_time")
    before = F.max("end_time").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = df.withColumn("_m", before).withColumn("_new", (F.col("_m").isNull() | (F.col("start_time") > F.col("_m"))).cast("int"))
    islands = islands.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "island").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.max("confidence").alias("confidence"),
        F.when(F.min("type") == F.max("type"), F.min("type")).otherwise("blend").alias("type"),
        F.array_sort(F.collect_set("type")).alias("components"), F.count(F.lit(1)).alias("n"),
    )


def sessions(df: DataFrame, keys: list[str], position: str, reach: float, *tie: str, strict: bool = False) -> DataFrame:
    """``df`` with ``_session``, a number that grows where a row lies ``reach`` or more behind the one before (more than it, with
    ``strict``). A rule whose effect ends there folds each session for itself, so that a series need not fit one task."""
    w = _order(keys, position, *tie)
    gap = F.col(position) - F.lag(position).over(w)
    new = (gap > reach if strict else gap >= reach).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("_session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def suppress_close(peaks: DataFrame, min_dist: float = 0.1, key: str = "track_id") -> DataFrame:
    """Peaks in time order; one within ``min_dist`` of the kept one replaces it if more confident, else goes.

    A fold over sessions of peaks that lie closer than ``min_dist``, whose state is the kept peak alone.
    """

    def pick(begins: np.ndarray, time: np.ndarray, confidence: np.ndarray) -> list[int]:
        first, t, c = set(begins.tolist()), time.tolist(), confidence.tolist()
        kept: list[int] = []
        for i in range(len(t)):
            if i in first or t[i] - t[kept[-1]] >= min_dist:
                kept.append(i)
            elif c[i] > c[kept[-1]]:
                kept[-1] = i
        return kept

    parts = sessions(peaks, [key], "time", min_dist, "event_id")
    return picked(parts, [key, "_session"], ["time", "event_id"], ["time", "confidence"], pick, peaks.columns)


def rolling_max_peaks(df: DataFrame, keys: list[str], order: list[str], value: str, around: int = 20, delta: float = 0.5) -> DataFrame:
    """Rows that are the greatest of their neighbourhood and at least its mean plus ``delta``; apply ``wait_between`` for a waiting time."""
    w = _order(keys, *order).rowsBetween(-around, around)
    out = df.withColumn("_max", F.max(value).over(w)).withColumn("_avg", F.avg(value).over(w))
    return out.where((F.col(value) == F.col("_max")) & (F.col(value) >= F.col("_avg") + delta)).drop("_max", "_avg")


def wait_between(peaks: DataFrame, position: str, wait: float = 20, key: str = "track_id") -> DataFrame:
    """Peaks in order of position, each more than ``wait`` after the last one that was kept. A fold over sessions of peaks within
    ``wait`` of each other, whose state is one position."""

    def pick(begins: np.ndarray, at: np.ndarray) -> list[int]:
        first, kept, last = set(begins.tolist()), [], None
        for i, p in enumerate(at.tolist()):
            if i in first or p > last + wait:
                kept.append(i)
                last = p
        return kept

    parts = sessions(peaks, [key], position, wait, strict=True)
    return picked(parts, [key, "_session"], [position], [position], pick, peaks.columns)


def min_max(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value scaled to 0..1 within its keys; a constant series stays as it is."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("scaled", F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(F.col(value)))


def max_abs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value over its series' greatest size; silence stays as it is."""
    top = F.max(F.abs(value)).over(Window.partitionBy(*keys))
    return df.withColumn("scaled", F.when(top > 0, F.col(value) / top).otherwise(F.col(value)))


def normalised_time(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("position", F.percent_rank().over(_order(keys, *order)))


def outliers_z(long: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Rows (metric, value) more than ``threshold`` population deviations from their metric's mean; NaN rows go first.

    Moments are aggregated and joined back, so no metric has to fit one task.
    """
    valid = long.where(~F.isnan("value"))
    m = valid.groupBy("metric").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = (F.col("value") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    return with_aggregate(valid, m, ["metric"]).withColumn("z", z).where(F.abs("z") > threshold).drop("_m", "_s")


def state_delta(states: DataFrame, keys: list[str], order: list[str], entropy: str = "s_total") -> DataFrame:
    """Change of total entropy since the mode's state before; irreversible if it grew."""
    out = states.withColumn("delta", F.col(entropy) - F.lag(entropy).over(_order(keys, *order)))
    return out.where("delta IS NOT NULL").withColumn("irreversible", F.col("delta") > 0)


def unwrap_phase(df: DataFrame, keys: list[str], order: list[str], phase: str = "phase") -> DataFrame:
    """Phase without jumps of more than pi: multiples of 2 pi are added; a jump of exactly pi stays."""
    w, tau = _order(keys, *order), 2 * np.pi
    d = F.col(phase) - F.lag(phase).over(w)
    turns = F.ceil((F.abs(d) - np.pi) / tau - 1e-9)
    fix = F.when(F.abs(d) > np.pi + 1e-9, -F.signum(d) * tau * turns).otherwise(0.0)
    out = df.withColumn("_fix", F.coalesce(fix, F.lit(0.0)))
    return out.withColumn("unwrapped", F.col(phase) + F.sum("_fix").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fix")


def gradient(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Central differences, one-sided at the ends; null for a single row."""
    w = _order(keys, *order)
    nxt, prv = F.lead(value).over(w), F.lag(value).over(w)
    return df.withColumn("gradient", F.coalesce((nxt - prv) / 2, nxt - F.col(value), F.col(value) - prv))


def grid_deviation(df: DataFrame, bpm: float, keys: list[str], order: list[str], us: str = "us") -> DataFrame:
    """Microseconds between each onset and its place on a grid of sixteenths from the series' first onset number."""
    n = F.row_number().over(_order(keys, *order)) - 1
    return df.withColumn("grid_us", n * (60e6 / (4 * bpm))).withColumn("deviation_us", F.col(us) - F.col("grid_us"))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation of two arrays of equal length; null where one is constant."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    n = F.size(a).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y.cast("double"))
    prod = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    num = n * prod(a, b) - total(a) * total(b)
    den = F.sqrt((n * prod(a, a) - total(a) * total(a)) * (n * prod(b, b) - total(b) * total(b)))
    return F.when(den > 0, num / den)


def repetition_pairs(frames: DataFrame, key: str = "track_id", order: str = "frame_idx", vec: str = "samples", least: float = 0.8) -> DataFrame:
    """Frames whose absolute correlation with the next frame exceeds ``least``."""
    out = frames.withColumn("_next", F.lead(vec).over(_order([key], order))).where("_next IS NOT NULL")
    return out.withColumn("r", F.abs(pearson(vec, "_next"))).where(F.col("r") > least).select(key, order, "r")


def interpolate(series: DataFrame, targets: DataFrame, keys: list[str], value: str, time: str = "time", block: float = 60.0) -> DataFrame:
    """``value`` of each series at its target times, linear between neighbours and constant outside, by a block-carry scan over
    blocks of ``block`` units of time. Values at one time count in order of value: the last before, the first after."""
    near = neighbours(targets.select(*keys, time), series, keys, time, block, (value,))
    a, b = F.col("_before"), F.col("_after")
    gap = b[time] - a[time]
    blend = a[value] + (b[value] - a[value]) * (F.col(time) - a[time]) / gap
    return near.select(*keys, time, F.when(a.isNull(), b[value]).when(b.isNull() | (gap == 0), a[value]).otherwise(blend).alias(value))


def segments_between(transitions: DataFrame, durations: DataFrame, min_len: float, key: str = "track_id") -> DataFrame:
    """What disjoint transitions leave of each track, pieces of at least ``min_len``, numbered, with the transitions around them."""
    w = _order([key], "start_time")
    t = transitions.select(key, "start_time", "end_time").withColumn("_from", F.coalesce(F.lag("end_time").over(w), F.lit(0.0))).withColumn("_in", F.lag("start_time").over(w))
    gaps = t.select(key, F.col("_from").alias("a"), F.col("start_time").alias("b"), F.col("_in").alias("in_start"), F.col("start_time").alias("out_start"))
    last = transitions.groupBy(key).agg(F.max("end_time").alias("_end"), F.max("start_time").alias("_last"))
    tail = durations.join(last, key, "left").select(key, F.coalesce("_end", F.lit(0.0)).alias("a"), F.col("duration").alias("b"), F.col("_last").alias("in_start"), F.lit(None).cast("double").alias("out_start"))
    return gaps.unionByName(tail).where(F.col("b") - F.col("a") >= min_len).select(key, F.col("a").alias("start_time"), F.col("b").alias("end_time"), "in_start", "out_start")
