"""Rhythm, groove and pattern operators over hits, beats and grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import folded, numbers, picked
from .joins import events_in_intervals
from .windows import intervals

TR = "track_id"


def timing_stats(hits: DataFrame, keys: list[str], low: float = 0.05, high: float = 2.0, unit: float = 1e6) -> DataFrame:
    """Intervals between the bounds (in units): mean, median, std, tempo and consistency per key; call it with and without the type."""
    dt = F.col("d_us") / unit
    x = intervals(hits, keys).withColumn("dt", dt).where((F.col("dt") > low) & (F.col("dt") < high))
    med, avg, sd = F.percentile("dt", F.lit(0.5)), F.avg("dt"), F.stddev_pop("dt")
    return x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), avg.alias("mean"), med.alias("median"), sd.alias("std"),
        F.round(60 / med, 1).alias("tempo"), F.round(1 - F.least(F.lit(1.0), sd / avg), 2).alias("consistency"),
    )


def tempo_estimate(beats: DataFrame, keys: list[str], high: float = 2.0, fold: bool = False, unit: float = 1e6) -> DataFrame:
    """60 over the median interval below ``high``; 0 with fewer than two beats. ``fold`` moves it by octaves into 60..200."""
    x = intervals(beats, keys).withColumn("dt", F.col("d_us") / unit)
    by = x.groupBy(*keys).agg(F.percentile(F.when(F.col("dt") < high, F.col("dt")), F.lit(0.5)).alias("_m"))
    t = F.coalesce(60 / F.nullif(F.col("_m"), F.lit(0.0)), F.lit(0.0))
    if fold:
        up, down = F.pow(F.lit(2.0), F.ceil(F.log2(60 / t))), F.pow(F.lit(2.0), -F.ceil(F.log2(t / 200)))
        t = F.when(t <= 0, 0.0).when(t < 60, t * up).when(t > 200, t * down).otherwise(t)
    return by.select(*keys, t.alias("tempo"))


def bpm_confidence(beats: DataFrame, env: DataFrame, key: str = TR) -> DataFrame:
    """Mean envelope at beats over the mean envelope (rows with equal (key, frame)), and stability of the beat gaps."""
    at = beats.join(env, [key, "frame"]).groupBy(key).agg(F.avg("env").alias("_b"))
    gap = beats.withColumn("_g", F.col("frame") - F.lag("frame").over(Window.partitionBy(key).orderBy("frame"))).groupBy(key).agg((1 - F.stddev_pop("_g") / F.avg("_g")).alias("stability"))
    return env.groupBy(key).agg(F.avg("env").alias("_e")).join(at, key).join(gap, key).select(key, (F.col("_b") / F.nullif(F.col("_e"), F.lit(0.0))).alias("confidence"), "stability")


def timing_stability(hits: DataFrame, unit: float = 1e6) -> DataFrame:
    """Mean over a track's types of 1 / (1 + variation of its intervals)."""
    x = intervals(hits, [TR, "type"]).withColumn("dt", F.col("d_us") / unit).where("dt IS NOT NULL")
    by = x.groupBy(TR, "type").agg((1 / (1 + F.stddev_pop("dt") / F.nullif(F.avg("dt"), F.lit(0.0)))).alias("_s"))
    return by.groupBy(TR).agg(F.avg("_s").alias("stability"))


def hit_density(hits: DataFrame, keys: list[str]) -> DataFrame:
    return hits.groupBy(*keys).agg((F.count(F.lit(1)) / F.nullif(F.max("time"), F.lit(0.0))).alias("density"))


def pattern_grid(hits: DataFrame, length: float, cells: int = 32, keys: tuple[str, ...] = (TR, "type")) -> DataFrame:
    """(keys, cell, velocity): the last hit of each cell of the pattern; cells without hits are absent."""
    cell = F.floor((F.col("time") - length * F.floor(F.col("time") / length)) / length * cells)
    return hits.groupBy(*keys, F.least(cell, F.lit(cells - 1)).cast("int").alias("cell")).agg(F.max_by("velocity", F.struct("time", "event_id")).alias("velocity"))


def dense_grid(grid: DataFrame, cells: int = 32, keys: tuple[str, ...] = (TR, "type")) -> DataFrame:
    """The grid as one array of ``cells`` values, zeros where nothing sounds."""
    m = F.map_from_entries(F.collect_list(F.struct("cell", "velocity")))
    return grid.groupBy(*keys).agg(m.alias("_m")).select(*keys, F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda k: F.coalesce(F.element_at("_m", k), F.lit(0.0))).alias("grid"))


def pattern_length(hits: DataFrame, max_lag: int = 64, unit: float = 1e6) -> DataFrame:
    """Per track and type: the sum of intervals up to the first peak of their autocorrelation, else four times the mean; 1.0 with fewer than two intervals."""
    from .windows import peak_positions

    def length(us: np.ndarray) -> float:
        dt = np.diff(us) / unit
        if len(dt) < 2:
            return 1.0
        x = dt - dt.mean()
        ac = np.array([x[: len(x) - k] @ x[k:] for k in range(min(max_lag, len(x)))])
        at = peak_positions(ac)
        return float(dt[: at[0]].sum()) if len(at) else float(4 * dt.mean())

    def fold(table: pa.Table, begins: np.ndarray) -> pa.Table:
        found = [length(us) for us in np.split(numbers(table, "us"), begins[1:])]
        return table.select([TR, "type"]).take(pa.array(begins)).append_column("length", pa.array(found, pa.float64()))

    return folded(hits.select(F.col(TR).cast("long").alias(TR), "type", "us"), [TR, "type"], ["us"], fold, f"{TR} long, type string, length double")


def track_pattern_length(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy(TR).agg(F.percentile("length", F.lit(0.5)).alias("length"))


def pattern_complexity(grids: DataFrame, grid: str = "grid", bins: int = 8) -> DataFrame:
    """Entropy of the density histogram of a grid's cells times the ratio of weak to strong (0, 8, 16, 24) energy."""
    from .entropy import histogram_entropy

    keys = [c for c in grids.columns if c != grid]
    cells = grids.select(*keys, F.posexplode(grid).alias("cell", "v"))
    strong = F.col("cell").isin(0, 8, 16, 24)
    ratio = cells.groupBy(*keys).agg((F.sum(F.when(~strong, F.col("v")).otherwise(0.0)) / (F.sum(F.when(strong, F.col("v")).otherwise(0.0)) + 1e-8)).alias("_r"))
    return histogram_entropy(cells, keys, "v", bins).join(ratio, keys).select(*keys, (F.col("entropy") * F.col("_r")).alias("complexity"))


def pattern_position(hits: DataFrame, length: float, beats_per_pattern: int = 4) -> DataFrame:
    """Place in the pattern (0..1), beat position and number of the pattern of each hit."""
    pos = (F.col("time") - length * F.floor(F.col("time") / length)) / length
    return hits.withColumn("position", pos).withColumn("beat_position", F.col("position") * beats_per_pattern).withColumn("pattern", F.floor(F.col("time") / length).cast("long"))


def quantise(hits: DataFrame, tempo: float = 120.0, resolution: int = 16) -> DataFrame:
    """Grid position of each hit in beats (half to even), velocity scaled by 1.25 to at most 1."""
    beats = F.col("time") * tempo / 60
    return hits.withColumn("position", F.bround(beats * resolution) / resolution).withColumn("level", F.least(F.lit(1.0), 1.25 * F.col("velocity"))).withColumn("beat", F.ceil(beats).cast("long"))


def _parity(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_odd", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) % 2)


def swing_strength(hits: DataFrame, keys: list[str], order: list[str], value: str = "velocity", cap: float = 5.0) -> DataFrame:
    """Mean odd over mean even strength, capped."""
    x = _parity(hits, keys, order)
    m = lambda p: F.avg(F.when(F.col("_odd") == p, F.col(value)))
    return x.groupBy(*keys).agg(F.least(F.lit(cap), F.coalesce(m(1) / F.nullif(m(0), F.lit(0.0)), F.lit(1.0))).alias("swing"))


def swing_intervals(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Mean odd over mean even interval."""
    x = _parity(intervals(hits, keys).where("d_us IS NOT NULL"), keys, order)
    m = lambda p: F.avg(F.when(F.col("_odd") == p, F.col("d_us")))
    return x.groupBy(*keys).agg(F.coalesce(m(1) / F.nullif(m(0), F.lit(0.0)), F.lit(1.0)).alias("swing"))


def swing_pairs(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Mean ratio of each second interval to the one before it."""
    x = _parity(intervals(hits, keys).where("d_us > 0"), keys, order).withColumn("_p", F.lag("d_us").over(Window.partitionBy(*keys).orderBy(*order)))
    return x.where("_odd = 1").groupBy(*keys).agg(F.avg(F.col("d_us") / F.col("_p")).alias("swing"))


def syncopation(hits: DataFrame, keys: list[str], on_beat: Column, value: str = "velocity") -> DataFrame:
    """Mean strength off the beat over that on the beat."""
    m = lambda c: F.avg(F.when(c, F.col(value)))
    return hits.groupBy(*keys).agg(F.coalesce(m(~on_beat) / F.nullif(m(on_beat), F.lit(0.0)), F.lit(0.0)).alias("syncopation"))


def weighted_syncopation(cells: DataFrame, weights: dict[str, float], key: str = TR) -> DataFrame:
    """Odd over even cells of a grid whose types count by weight."""
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("type")), F.lit(0.0)) * F.col("velocity")
    part = lambda p: F.sum(F.when(F.col("cell") % 2 == p, w).otherwise(0.0))
    return cells.groupBy(key).agg((part(1) / (part(0) + 1e-8)).alias("syncopation"))


def ghost_cells(cells: DataFrame, keys: list[str], ratio: float = 0.5) -> DataFrame:
    """Cells above zero and below ``ratio`` of their grid's mean, to nine decimals, so that the order of summation decides nothing."""
    m = F.avg("velocity").over(Window.partitionBy(*keys))
    return cells.withColumn("_m", m).where((F.col("velocity") > 0) & (F.round(ratio * F.col("_m") - F.col("velocity"), 9) > 0)).drop("_m")


def groove_density(frames: DataFrame, keys: list[str], order: list[str], parts: int, value: str = "velocity") -> DataFrame:
    """Share of rows above the mean of their part, averaged over ``parts`` equal parts. A row is above the mean to nine
    decimals, so that the order of summation decides nothing."""
    x = frames.withColumn("_part", F.ntile(parts).over(Window.partitionBy(*keys).orderBy(*order)))
    x = x.withColumn("_m", F.avg(value).over(Window.partitionBy(*keys, "_part")))
    by = x.groupBy(*keys, "_part").agg(F.avg((F.round(F.col(value) - F.col("_m"), 9) > 0).cast("double")).alias("_s"))
    return by.groupBy(*keys).agg(F.avg("_s").alias("density"))


def microtiming(samples: DataFrame, beats: DataFrame, bucket: float, key: str = TR, value: str = "velocity") -> DataFrame:
    """Per beat interval the deviation of its loudest sample from the middle, relative to its length."""
    j = events_in_intervals(samples, beats, key, bucket=bucket)
    top = j.groupBy(key, "start_time", "end_time").agg(F.max_by("time", F.struct(F.abs(value), -F.col("time"))).alias("_t"))
    length = F.col("end_time") - F.col("start_time")
    return top.select(key, "start_time", ((F.col("_t") - F.col("start_time") - length / 2) / length).alias("deviation"))


def histogram_complexity(df: DataFrame, keys: list[str], band: str, value: str, bins: int = 20) -> DataFrame:
    """Histogram entropy times variation, averaged over bands."""
    from .entropy import histogram_entropy

    m = df.groupBy(*keys, band).agg((F.stddev_pop(value) / (F.avg(value) + 1e-8)).alias("_v"))
    e = histogram_entropy(df, [*keys, band], value, bins).join(m, [*keys, band])
    return e.groupBy(*keys).agg(F.avg(F.col("entropy") * F.col("_v")).alias("complexity"))


def pulse_features(env: DataFrame, keys: list[str], order: str = "idx", value: str = "env") -> DataFrame:
    """Per segment: pulse clarity (mean of the first five autocorrelation peaks over lag 0) and meter strength (the strongest peak over lag 0). Segments bound the groups."""
    from .signal import autocorrelation
    from .windows import peak_positions

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        ac = autocorrelation(x) if len(x) > 2 else np.zeros(1)
        p = ac[peak_positions(ac)] / ac[0] if ac[0] > 0 else np.zeros(0)
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame(head | {"clarity": [float(p[:5].mean()) if len(p) else 0.0], "meter": [float(p.max()) if len(p) else 0.0]})

    kinds = ", ".join(f"{k} {env.schema[k].dataType.simpleString()}" for k in keys)
    return env.groupBy(*keys).applyInPandas(run, f"{kinds}, clarity double, meter double")


def subdivision_scores(beats: DataFrame, env: DataFrame, divisions: tuple[int, ...] = (1, 2, 3, 4, 6, 8), key: str = TR) -> DataFrame:
    """Mean envelope at the subdivisions of each beat, by division: an equi-join on the frame number."""
    w = Window.partitionBy(key).orderBy("frame")
    b = beats.withColumn("_n", F.lead("frame").over(w)).where("_n IS NOT NULL")
    d = b.select(key, "frame", "_n", F.explode(F.array(*map(F.lit, divisions))).alias("division")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("division") - 1)))
    at = d.select(key, "division", F.floor(F.col("frame") + (F.col("_n") - F.col("frame")) * F.col("k") / F.col("division")).alias("frame"))
    return at.join(env, [key, "frame"], "left").groupBy(key, "division").agg(F.avg(F.coalesce("env", F.lit(0.0))).alias("score"))


def downbeats(beats: DataFrame, distance: int = 4, key: str = TR, order: str = "idx", value: str = "value") -> DataFrame:
    """Peaks of the beats' amplitude at least ``distance`` beats apart; confidence is 0.8 of the beat's."""
    from .windows import non_max_by_priority

    return non_max_by_priority(beats, [key], distance, order=order, value=value).withColumn("confidence", 0.8 * F.col("confidence")).drop("prominence")


def pattern_windows(env: DataFrame, template: list[float], threshold: float = 0.7, keys: tuple[str, ...] = (TR,), order: str = "idx", value: str = "env", block: int = 65_536) -> DataFrame:
    """Starts at which the normalised cross-correlation with the template exceeds the threshold; a hit skips its length.

    Rows are numbered and dealt into blocks of ``block``, each with the rows that windows
    from it reach into, so that a long series is many tasks. Of the hits, those a
    template's length behind the one before are kept whatever came before them, and so
    begin a session; only within sessions hits are skipped one after the other.
    """
    from .windows import sessions

    t = np.asarray(template, float)
    n = len(t)
    t = (t - t.mean()) / (t.std() + 1e-12)
    names = list(keys)
    numbered = env.select(*names, F.col(order).cast("long").alias("start"), F.col(value).cast("double").alias("_x"), (F.row_number().over(Window.partitionBy(*names).orderBy(order)) - 1).cast("long").alias("_pos"))
    first = F.floor(F.greatest(F.col("_pos") - (n - 1), F.lit(0)) / block)
    dealt = numbered.withColumn("_block", F.explode(F.sequence(first, F.floor(F.col("_pos") / block))))

    def correlate(begins: np.ndarray, at: np.ndarray, of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, found = [np.zeros(0, int)], [np.zeros(0)]
        for first, z in zip(begins.tolist(), [*begins[1:].tolist(), len(at)], strict=True):
            x = values[first:z]
            own = int((at[first:z] // block == of[first]).sum())
            last = max(min(own, len(x) - n + 1), 0)
            for a in range(0, last, 8192):
                w = np.lib.stride_tricks.sliding_window_view(x[a : min(a + 8192, last) + n - 1], n)
                scores = ((w - w.mean(1, keepdims=True)) / (w.std(1, keepdims=True) + 1e-12)) @ t / n
                hit = np.flatnonzero(scores > threshold)
                rows.append(first + a + hit)
                found.append(scores[hit])
        return np.concatenate(rows), np.concatenate(found)

    hits = picked(dealt, [*names, "_block"], ["_pos"], ["_pos", "_block", "_x"], correlate, [*names, "_pos", "start"], T.StructField("score", T.DoubleType()))

    def skip(begins: np.ndarray, at: np.ndarray) -> list[int]:
        first, kept, free = set(begins.tolist()), [], -1
        for i, p in enumerate(at.tolist()):
            if i in first or p >= free:
                kept.append(i)
                free = p + n
        return kept

    return picked(sessions(hits, names, "_pos", n), [*names, "_session"], ["_pos"], ["_pos"], skip, [*names, "start", "score"])


def dtw_mean(a: np.ndarray, b: np.ndarray, beyond: float = np.inf) -> float:
    """Mean cost of the cheapest warping path, by anti-diagonals of which three are held; infinite as soon as it must exceed ``beyond``.

    A path has at most n + m - 1 steps and crosses one of any two neighbouring diagonals,
    whose least cost so bounds its cost.
    """
    n, m = len(a), len(b)
    free = lambda: (np.full(n + 1, np.inf), np.zeros(n + 1))
    (cost2, steps2), (cost1, steps1) = free(), free()
    cost2[0] = 0  # diagonal 0; diagonal 1 has the border alone
    for k in range(2, n + m + 1):
        cost, steps = free()
        lo, hi = max(1, k - m), min(n, k - 1) + 1
        options = np.stack([cost2[lo - 1 : hi - 1], cost1[lo - 1 : hi - 1], cost1[lo:hi]])
        length = np.stack([steps2[lo - 1 : hi - 1], steps1[lo - 1 : hi - 1], steps1[lo:hi]])
        best, at = options.argmin(0), np.arange(hi - lo)
        i = np.arange(lo, hi)
        cost[lo:hi] = options[best, at] + np.abs(a[i - 1] - b[k - i - 1])
        steps[lo:hi] = length[best, at] + 1
        if min(cost.min(), cost1.min() if k > 2 else np.inf) > beyond * (n + m - 1):
            return np.inf
        cost2, steps2, cost1, steps1 = cost1, steps1, cost, steps
    return float(cost1[n] / steps1[n])


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """1 / (1 + mean cost of the cheapest warping path)."""
    return 1 / (1 + dtw_mean(a, b))


def dtw_bound(a: np.ndarray, b: np.ndarray) -> float:
    """What ``dtw_mean`` is at least: the end points meet, and every value meets one within the other's range."""
    ends = abs(a[0] - b[0]) + (abs(a[-1] - b[-1]) if len(a) + len(b) > 2 else 0)
    outside = lambda x, y: float(np.maximum(np.maximum(x - y.max(), y.min() - x), 0).sum())
    return max(ends, outside(a, b), outside(b, a)) / (len(a) + len(b) - 1)


def dtw_align(segments: DataFrame, templates: dict[str, list[float]], id_col: str = "segment_id", vec: str = "samples", counts: bool = False) -> DataFrame:
    """(id, template, score) of the best template of each segment, the first by name on ties. Templates are a short list, sent with the code.

    Templates are tried in order of their lower bounds; those that cannot be better are
    skipped, and the others given up as soon as they cannot. ``counts`` adds how many
    were ``tried``. Memory is that of the two series. Null and empty samples score 0.
    """
    named = {k: np.asarray(v, float) for k, v in sorted(templates.items())}

    def best_of(x: np.ndarray) -> tuple[str, float, int]:
        if not len(x):
            return next(iter(named)), 0.0, 0
        mean, name, tried = np.inf, "", 0
        for bound, k in sorted((dtw_bound(x, t), k) for k, t in named.items()):
            if bound > mean:
                break
            tried += 1
            found = dtw_mean(x, named[k], mean)
            if (found, k) < (mean, name) or not name:
                mean, name = found, k
        return name, 1 / (1 + mean), tried

    def rows(batches):
        for pdf in batches:
            best = [best_of(np.asarray(x if x is not None else [], float)) for x in pdf[vec]]
            out = pd.DataFrame({id_col: pdf[id_col], "template": [b[0] for b in best], "score": [b[1] for b in best]})
            yield out.assign(tried=[b[2] for b in best]) if counts else out

    return segments.select(id_col, vec).mapInPandas(rows, f"{id_col} {segments.schema[id_col].dataType.simpleString()}, template string, score double" + ", tried int" * counts)


# fixed values
STRETCH_FACTORS = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0)
BASE_TEMPO = 168.0


def stretch_factor_match(df: DataFrame, tempo: str = "tempo") -> DataFrame:
    """The stretch factor nearest to tempo / base and its score 1 - |ratio - factor| (the smaller factor on ties)."""
    r = F.col(tempo) / BASE_TEMPO
    best = F.array_sort(F.array(*[F.struct(F.abs(r - x).alias("d"), F.lit(x).alias("f")) for x in STRETCH_FACTORS]))[0]
    return df.withColumn("factor", best["f"]).withColumn("score", 1 - best["d"])


def classify_variation(similarity: Column, complexity: Column, groove: Column, vip: float = 0.85) -> Column:
    return F.when(similarity > vip, "vip").when((complexity > 0.7) & (groove > 0.8), "dubplate").otherwise("original")


