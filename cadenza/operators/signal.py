"""Signal and frame features over chunks of samples.

Input is ``pcm_chunks``: one row per bounded chunk (track_id, chunk_idx, start_sample,
sr, samples). The Fourier transform, filterbanks and greedy picks run in numpy inside
Arrow batches, one chunk at a time; everything after is column expressions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .aggregates import correlation
from .joins import dot
from .windows import peak_positions

EPS = 1e-8


def segment(tracks: DataFrame, seg: int, hop: int, keep_tail: int | None = None, key: str = "track_id", length: str = "n_samples") -> DataFrame:
    """(key, segment, start, stop) windows of ``seg`` samples at ``hop``; tails of at least ``keep_tail`` stay, else only whole windows."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col(length) - 1, F.lit(0)), F.lit(hop)))
    out = tracks.select(key, length, starts.alias("start")).withColumn("stop", F.least(F.col("start") + seg, F.col(length)))
    least = seg if keep_tail is None else keep_tail
    return out.where(F.col("stop") - F.col("start") >= least).select(key, (F.col("start") / hop).cast("long").alias("segment"), "start", "stop")


def _per_chunk(chunks: DataFrame, columns: dict[str, T.DataType], fn) -> DataFrame:
    """Map each chunk's samples to rows of new columns; ``fn(samples, row) -> list of dicts``."""
    base = [f for f in chunks.schema.fields if f.name != "samples"]
    schema = T.StructType([*base, *[T.StructField(k, v) for k, v in columns.items()]])

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                x = np.asarray(row.pop("samples"), float)
                out += [row | r for r in fn(x, row)]
            yield pd.DataFrame(out, columns=schema.names)

    return chunks.mapInPandas(rows, schema)


def frame_matrix(x: np.ndarray, n_fft: int, hop: int, window: str = "hann") -> np.ndarray:
    """Windowed frames, one in each row; the tail that fills no frame is left out."""
    if len(x) < n_fft:
        return np.zeros((0, n_fft))
    f = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    return f * np.hanning(n_fft) if window == "hann" else f.copy()


def stft(chunks: DataFrame, n_fft: int = 2048, hop: int = 512, window: str = "hann") -> DataFrame:
    """Magnitude spectra: one row per frame with ``frame_idx`` and ``mag``. Chunks carry a margin, so no frame needs two."""

    def spectra(x, row):
        mags = np.abs(np.fft.rfft(frame_matrix(x, n_fft, hop, window), axis=1))
        first = int(row.get("start_sample", 0)) // hop
        return [{"frame_idx": first + i, "mag": m.tolist()} for i, m in enumerate(mags)]

    return _per_chunk(chunks, {"frame_idx": T.LongType(), "mag": T.ArrayType(T.DoubleType())}, spectra)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _axis(mag: Column) -> Column:
    """Bin positions 0..1."""
    return F.transform(mag, lambda _, i: i / F.greatest(F.size(mag) - 1, F.lit(1)))


def centroid(mag: Column) -> Column:
    return _sum(F.zip_with(mag, _axis(mag), lambda m, f: m * f)) / (_sum(mag) + EPS)


def bandwidth(mag: Column, center: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(mag, _axis(mag), lambda m, f: m * F.pow(f - center, F.lit(2)))) / (_sum(mag) + EPS))


def flatness(mag: Column) -> Column:
    n = F.size(mag)
    return F.exp(_sum(F.transform(mag, lambda m: F.log(m + EPS))) / n) / (_sum(mag) / n + EPS)


def rolloff(mag: Column, share: float = 0.85) -> Column:
    """First bin at which the running sum reaches the share of the whole, over the number of bins."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(-1).alias("at"), F.lit(0).alias("i"))
    limit = share * _sum(mag)

    def step(acc, m):
        s = acc["s"] + m
        return F.struct(s.alias("s"), F.when((acc["at"] < 0) & (s >= limit), acc["i"]).otherwise(acc["at"]).alias("at"), (acc["i"] + 1).alias("i"))

    return F.aggregate(mag, start, step, lambda acc: acc["at"] / acc["i"])


def contrast(mag: Column, parts: int = 6) -> Column:
    """log(max / (min + eps)) of each sixth of the bins (the last may be shorter)."""
    size = F.ceil(F.size(mag) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.log((F.array_max(F.slice(mag, k * size + 1, size)) + EPS) / (F.array_min(F.slice(mag, k * size + 1, size)) + EPS)))


def mel_bank(n_mels: int, n_bins: int, sr: int) -> np.ndarray:
    """Triangular filters with equal mel spacing: (n_mels, n_bins)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(0, mel(sr / 2), n_mels + 2) / 2595) - 1)
    f = np.linspace(0, sr / 2, n_bins)
    up = (f[None] - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None]
    down = (hz[2:, None] - f[None]) / (hz[2:] - hz[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def dct_matrix(n_out: int, n_in: int) -> np.ndarray:
    k = np.arange(n_out)[:, None]
    m = np.cos(np.pi * k * (2 * np.arange(n_in)[None] + 1) / (2 * n_in)) * math.sqrt(2 / n_in)
    m[0] /= math.sqrt(2)
    return m


def chroma_bank(n_bins: int, sr: int) -> np.ndarray:
    """Assigns each bin above 27.5 Hz to its pitch class: (12, n_bins)."""
    f = np.linspace(0, sr / 2, n_bins)
    out = np.zeros((12, n_bins))
    audible = f > 27.5
    out[np.round(12 * np.log2(f[audible] / 440)).astype(int) % 12, np.flatnonzero(audible)] = 1
    return out


def timbre(chunks: DataFrame, n_fft: int = 2048, hop: int = 512, n_mels: int = 128, n_mfcc: int = 20) -> DataFrame:
    """log_mel, mfcc and chroma of every frame, by one product each per chunk."""

    def run(x, row):
        power = np.abs(np.fft.rfft(frame_matrix(x, n_fft, hop), axis=1)) ** 2
        n_bins, sr = n_fft // 2 + 1, int(row["sr"])
        mel = np.log(power @ mel_bank(n_mels, n_bins, sr).T + EPS)
        mfcc, chroma = mel @ dct_matrix(n_mfcc, n_mels).T, power @ chroma_bank(n_bins, sr).T
        chroma = chroma / np.maximum(chroma.max(axis=1, keepdims=True), EPS) if len(chroma) else chroma
        return [{"frame_idx": i, "log_mel": a.tolist(), "mfcc": b.tolist(), "chroma": c.tolist()} for i, (a, b, c) in enumerate(zip(mel, mfcc, chroma, strict=True))]

    arr = T.ArrayType(T.DoubleType())
    return _per_chunk(chunks, {"frame_idx": T.LongType(), "log_mel": arr, "mfcc": arr, "chroma": arr}, run)


def rms(x: Column) -> Column:
    return F.sqrt(dot(x, x) / F.size(x))


def zero_crossing_rate(x: Column) -> Column:
    """Share of neighbours with opposite signs."""
    n = F.size(x)
    signs = F.zip_with(F.slice(x, 1, F.greatest(n - 1, F.lit(0))), F.slice(x, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a * b < 0, 1.0).otherwise(0.0))
    return _sum(signs) / n


def chunk_levels(chunks: DataFrame) -> DataFrame:
    return chunks.select("track_id", "chunk_idx", rms(F.col("samples")).alias("rms"), zero_crossing_rate(F.col("samples")).alias("zcr"))


def rms_envelope(samples: DataFrame, size: int = 512, key: str = "track_id", idx: str = "i", value: str = "x") -> DataFrame:
    """Root mean square of every ``size`` samples of a sample table."""
    return samples.groupBy(key, F.floor(F.col(idx) / size).alias("frame")).agg(F.sqrt(F.avg(F.pow(value, F.lit(2)))).alias("env"))


def temporal_centroid(env: DataFrame, key: str = "track_id", idx: str = "frame", value: str = "env") -> DataFrame:
    total = F.sum(value)
    return env.groupBy(key).agg(F.when(total > 0, F.sum(F.col(idx) * F.col(value)) / total).otherwise(0.0).alias("centroid"))


def mix_globals(samples: DataFrame, env: DataFrame, key: str = "track_id", value: str = "x") -> DataFrame:
    """Mean size, dynamic range and crest factor of a track."""
    a = samples.groupBy(key).agg(F.avg(F.abs(value)).alias("loudness"), (F.max(value) - F.min(value)).alias("dynamic_range"), F.max(F.abs(value)).alias("_peak"))
    e = env.groupBy(key).agg(F.avg("env").alias("_rms"))
    return a.join(e, key).select(key, "loudness", "dynamic_range", (F.col("_peak") / (F.col("_rms") + EPS)).alias("crest"))


def autocorrelation(x: np.ndarray) -> np.ndarray:
    n = len(x)
    f = np.fft.rfft(x - x.mean(), 2 * n)
    return np.fft.irfft(f * np.conj(f))[:n]


def tempo_from_autocorr(chunks: DataFrame, hop: int, max_bpm: float = 250) -> DataFrame:
    """Tempo of each chunk's onset envelope (``samples``) from its first autocorrelation peak at a playable lag; 0 without one."""

    def run(x, row):
        if len(x) < 4:
            return [{"tempo": 0.0}]
        rate = row["sr"] / hop
        at = peak_positions(autocorrelation(x))
        at = at[at >= 60 / max_bpm * rate]
        return [{"tempo": float(60 * rate / at[0]) if len(at) else 0.0}]

    return _per_chunk(chunks, {"tempo": T.DoubleType()}, run)


def stereo(samples: DataFrame, key: str = "track_id") -> DataFrame:
    """Width, pan and correlation of rows (key, i, left, right)."""
    side, mid = (F.col("left") - F.col("right")) / 2, (F.col("left") + F.col("right")) / 2
    root = lambda c: F.sqrt(F.avg(c * c))
    el, er = F.sum(F.col("left") * F.col("left")), F.sum(F.col("right") * F.col("right"))
    return samples.groupBy(key).agg((root(side) / (root(mid) + EPS)).alias("width"), ((er - el) / (er + el + EPS)).alias("pan"), correlation("left", "right").alias("correlation"))


def band_energy(bins: DataFrame, bands: list[tuple[str, float, float]], key: str = "track_id") -> DataFrame:
    """Energy, mean magnitude, peak frequency and energy share of each named band over rows (key, hz, mag)."""
    spark = bins.sparkSession
    table = spark.createDataFrame(bands, "band string, lo double, hi double")  # a short list of names
    e = bins.join(F.broadcast(table), (F.col("hz") >= F.col("lo")) & (F.col("hz") < F.col("hi")))
    by = e.groupBy(key, "band").agg(F.sum(F.col("mag") * F.col("mag")).alias("energy"), F.avg("mag").alias("mean_mag"), F.max_by("hz", F.struct("mag", -F.col("hz"))).alias("peak_hz"))
    total = bins.groupBy(key).agg(F.sum(F.col("mag") * F.col("mag")).alias("_t"))
    return by.join(total, key).withColumn("ratio", F.col("energy") / F.nullif(F.col("_t"), F.lit(0.0))).drop("_t")


def dominant_character(bass: Column, lead: Column, kick: Column) -> Column:
    return F.when(bass > 0.3, "bass_heavy").when(lead > 0.3, "lead_focused").when(kick > 0.2, "percussion_driven").otherwise("balanced")


def bass_features(frames: DataFrame, lo_bin: int, hi_bin: int, key: str = "track_id") -> DataFrame:
    """Mean and population variance of the energy of bins [lo, hi) over a track's frames."""
    e = _sum(F.transform(F.slice("mag", lo_bin + 1, hi_bin - lo_bin), lambda m: m * m))
    return frames.select(key, e.alias("e")).groupBy(key).agg(F.avg("e").alias("mean_energy"), F.var_pop("e").alias("var_energy"))


def band_onset_envelope(frames: DataFrame, bands: list[tuple[str, int, int]], key: str = "track_id") -> DataFrame:
    """Rise of each band's magnitude from frame to frame (the band is a range of bins)."""
    rows = F.array(*[F.struct(F.lit(b).alias("band"), _sum(F.slice("mag", lo + 1, hi - lo)).alias("level")) for b, lo, hi in bands])
    long = frames.select(key, "frame_idx", F.explode(rows).alias("r")).select(key, "frame_idx", "r.band", "r.level")
    w = Window.partitionBy(key, "band").orderBy("frame_idx")
    return long.withColumn("env", F.greatest(F.lit(0.0), F.coalesce(F.col("level") - F.lag("level").over(w), F.lit(0.0))))


def detect_hits(frames: DataFrame, bands: list[tuple[str, int, int]], distance: int, height: float = 0.1, prominence: float = 0.1, key: str = "track_id") -> DataFrame:
    """Hits of each band's class: peaks of its normalised onset envelope, with confidence and velocity."""
    from .windows import non_max_by_priority

    env = band_onset_envelope(frames, bands, key)
    top = F.max("env").over(Window.partitionBy(key, "band"))
    scaled = env.withColumn("value", F.when(top > 0, F.col("env") / top).otherwise(0.0)).withColumnRenamed("frame_idx", "idx")
    peaks = non_max_by_priority(scaled, [key, "band"], distance, prominence, height)
    best = F.max("prominence").over(Window.partitionBy(key))
    return peaks.select(key, F.col("band").alias("type"), "idx", (F.col("prominence") / best).alias("confidence"), F.col("value").alias("velocity"))


def attack_decay(x: Column) -> tuple[Column, Column]:
    """Index of the greatest value and of the first one after it below a tenth of it (the length if none)."""
    top = F.array_max(x)
    at = F.array_position(x, top) - 1
    after = F.filter(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda s: (s["i"] > at) & (s["v"] < 0.1 * top))
    return at.cast("long"), F.coalesce(F.get(after, F.lit(0))["i"].cast("long"), F.size(x).cast("long"))


def hit_boundaries(onsets: DataFrame, least: float, most: float, key: str = "track_id", time: str = "time") -> DataFrame:
    """Duration to the next onset, at most ``most``; shorter ones than ``least`` go."""
    w = Window.partitionBy(key).orderBy(time)
    return onsets.withColumn("duration", F.least(F.coalesce(F.lead(time).over(w) - F.col(time), F.lit(most)), F.lit(most))).where(F.col("duration") >= least)


# fixed values
BAND_WEIGHTS = {"sub": 0.15, "bass": 0.25, "low_mid": 0.15, "mid": 0.15, "high_mid": 0.1, "high": 0.1, "air": 0.1}


def transition_candidates(novelty: DataFrame, distance: int, prominence: float, weights: dict[str, float] = BAND_WEIGHTS, key: str = "track_id") -> DataFrame:
    """Peaks of the weighted sum of band novelties (key, idx, band, value)."""
    from .windows import non_max_by_priority

    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("band"))
    total = novelty.groupBy(key, "idx").agg(F.sum(w * F.col("value")).alias("value"))
    return non_max_by_priority(total, [key], distance, prominence)


def classify_transition(bands: DataFrame, key: str = "transition_id") -> DataFrame:
    """Rows (key, band, energy_change, flux, activity, prominence) to type, active bands and confidence. Changes and fluxes meet
    their limits to nine decimals, so that the order of summation decides nothing."""
    active = F.round(F.abs("energy_change"), 9) > 0.1
    by = bands.groupBy(key).agg(
        F.sum(active.cast("int")).alias("n_active"), F.max((active & (F.col("band") == "bass")).cast("int")).alias("_bass"),
        F.max((active & F.col("band").contains("high")).cast("int")).alias("_high"), F.round(F.max("flux"), 9).alias("_flux"),
        F.array_sort(F.collect_set(F.when(active, F.col("band")))).alias("components"),
        F.avg(F.abs("energy_change")).alias("_stab"), F.stddev_pop("activity").alias("_act"), F.max("prominence").alias("_prom"),
    )
    kind = (
        F.when((F.col("n_active") <= 2) & (F.col("_bass") == 1), "swap").when(F.col("_flux") < 0.05, "fade").when(F.col("_flux") > 0.2, "cut")
        .when(F.col("_high") == 1, "filter").otherwise("blend")
    )
    one = F.lit(1.0)
    conf = F.least(one, 2 * F.col("_prom")) * (1 - F.least(one, F.col("_stab"))) * (1 - F.least(one, 2 * F.col("_act")))
    return by.select(key, kind.alias("type"), "n_active", F.array_join("components", ",").alias("components"), conf.alias("confidence"))


def component_type(centroid_hz: Column, activity: Column, periodicity: Column, is_reese: Column, is_fx: Column) -> Column:
    """Rule classifier of a component, the first rule that fits."""
    c = centroid_hz
    return (
        F.when((c < 100) & (activity > 0.3), "subbass").when((c < 500) & is_reese, "reese").when((c < 200) & (periodicity > 0.7), "kick")
        .when(c.between(200, 2000) & (activity < 0.3), "snare").when((c > 5000) & (periodicity > 0.8), "hihat").when((c > 2000) & (activity < 0.2), "ambi")
        .when(is_fx, "fx").otherwise("synth")
    )


def trim_silence(levels: DataFrame, threshold_db: float, key: str = "track_id", order: str = "chunk_idx", value: str = "rms") -> DataFrame:
    """Chunks from the first to the last that lie above the threshold under the track's loudest."""
    w = Window.partitionBy(key)
    loud = 20 * F.log10(F.greatest(F.col(value), F.lit(1e-10)) / F.max(F.greatest(F.col(value), F.lit(1e-10))).over(w)) > -threshold_db
    out = levels.withColumn("_on", F.when(loud, F.col(order)))
    return out.withColumn("_a", F.min("_on").over(w)).withColumn("_z", F.max("_on").over(w)).where(F.col(order).between(F.col("_a"), F.col("_z"))).drop("_on", "_a", "_z")


def fidelity(pairs: DataFrame, keys: list[str], a: str = "value_a", b: str = "value_b") -> DataFrame:
    """SNR in dB, absolute correlation, mean squared, greatest and normalised error of aligned series."""
    err = F.col(a) - F.col(b)
    power, noise = F.avg(F.col(a) * F.col(a)), F.avg(err * err)
    return pairs.groupBy(*keys).agg(
        F.when(noise > 0, 10 * F.log10(power / noise)).otherwise(float("inf")).alias("snr_db"), F.abs(correlation(a, b)).alias("correlation"),
        noise.alias("mse"), F.max(F.abs(err)).alias("max_error"), F.sqrt(noise / F.nullif(power, F.lit(0.0))).alias("nrmse"),
    )


def fidelity_score(snr_db: Column, correlation: Column, spectral_distance: Column) -> Column:
    one = F.lit(1.0)
    return 0.4 * F.least(one, F.greatest(F.lit(0.0), snr_db / 30)) + 0.4 * correlation + 0.2 * (1 - F.least(one, spectral_distance))


def sinc_resample(chunks: DataFrame, factor: int, width: int = 64) -> DataFrame:
    """Samples at ``factor`` times the rate by a hann-windowed sinc kernel over the nearest ``width`` samples."""

    def run(x, row):
        n = len(x)
        if n == 0:
            return [{"resampled": []}]
        half = width // 2
        padded = np.pad(x, half)
        near = np.lib.stride_tricks.sliding_window_view(padded, width)[:n]
        offsets = np.arange(-half, half)
        out = np.empty((n, factor))
        for k in range(factor):
            t = k / factor - offsets
            out[:, k] = near @ (np.sinc(t) * np.where(np.abs(t) <= half, 0.5 + 0.5 * np.cos(np.pi * t / half), 0))
        return [{"resampled": out.ravel().tolist()}]

    return _per_chunk(chunks, {"resampled": T.ArrayType(T.DoubleType())}, run)


def reconstruct(states: DataFrame, dt: float, key: str = "track_id", mode: str = "mode_index", order: str = "time") -> DataFrame:
    """Sum over modes of amplitude times the cosine of the phase that the frequency integrates to, clipped to 110 % of the loudest single mode."""
    w = Window.partitionBy(key, mode).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    p = states.withColumn("_phi", F.sum(2 * math.pi * F.col("frequency") * dt).over(w))
    s = p.groupBy(key, order).agg(F.sum(F.col("amplitude") * F.cos("_phi")).alias("x"), F.max(F.abs("amplitude")).alias("_a"))
    top = 1.1 * F.max("_a").over(Window.partitionBy(key))
    return s.withColumn("x", F.greatest(-top, F.least(top, F.col("x")))).drop("_a")


def component_relations(components: DataFrame, key: str = "track_id", idx: str = "idx", value: str = "value", least: float = 0.3) -> DataFrame:
    """(a, b, correlation, overlap, energy_ratio) of a track's components over their common index, where correlation or overlap
    exceeds ``least``. Values, and what meets the limit, count to nine decimals, so that the order of summation decides nothing."""
    components = components.withColumn(value, F.round(value, 9))
    a = components.select(key, F.col("component").alias("a"), idx, F.col(value).alias("va"))
    b = components.select(key, F.col("component").alias("b"), idx, F.col(value).alias("vb"))
    j = a.join(b, [key, idx]).where("a < b")
    ab, aa, bb = F.sum(F.col("va") * F.col("vb")), F.sum(F.col("va") * F.col("va")), F.sum(F.col("vb") * F.col("vb"))
    out = j.groupBy(key, "a", "b").agg(correlation("va", "vb").alias("correlation"), (ab / F.nullif(F.sqrt(aa * bb), F.lit(0.0))).alias("overlap"), (aa / F.nullif(bb, F.lit(0.0))).alias("energy_ratio"))
    return out.where((F.round("correlation", 9) > least) | (F.round("overlap", 9) > least))


def uncertainty_regions(pairs: DataFrame, target: float, size: int = 1024, hop: int = 512, key: str = "track_id", idx: str = "i") -> DataFrame:
    """Windows of aligned samples whose fidelity is below 0.8 of the target, with the causes seen."""
    last = F.floor(F.col(idx) / hop)
    e = pairs.withColumn("window", F.explode(F.array_distinct(F.array(last, F.greatest(last - size // hop + 1, F.lit(0)))))).where(F.col(idx) - F.col("window") * hop < size)
    rm = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    f = fidelity(e, [key, "window"]).join(e.groupBy(key, "window").agg(rm("value_a").alias("ra"), rm("value_b").alias("rb")), [key, "window"])
    f = f.withColumn("fidelity", fidelity_score(F.col("snr_db"), F.coalesce("correlation", F.lit(0.0)), F.col("nrmse")))
    causes = F.array_compact(F.array(F.when(F.abs(F.col("ra") - F.col("rb")) > 0.2 * F.col("ra"), "level"), F.when(F.col("correlation") < 0.7, "shape")))
    return f.where(F.col("fidelity") < 0.8 * target).select(key, "window", (1 - F.col("fidelity")).alias("uncertainty"), F.array_join(causes, ",").alias("causes"))


def density_profile(bins: DataFrame, bands: int = 7, key: str = "track_id") -> DataFrame:
    """Sums of a normalised spectrum (key, idx, value) in equal bands."""
    n = bins.groupBy(key).agg(F.max("idx").alias("_m"), F.sum("value").alias("_t"))
    at = F.least(F.floor(F.col("idx") * bands / (F.col("_m") + 1)), F.lit(bands - 1)).cast("int")
    return bins.join(n, key).groupBy(key, at.alias("band")).agg(F.sum(F.col("value") / F.nullif(F.col("_t"), F.lit(0.0))).alias("share"))


def density_peaks(bins: DataFrame, top: int = 10, distance: int = 10, key: str = "track_id") -> DataFrame:
    """The ``top`` peaks above the mean plus two deviations, ``distance`` bins apart."""
    from .windows import non_max_by_priority

    m = bins.groupBy(key).agg((F.avg("value") + 2 * F.stddev_pop("value")).alias("_lim"))
    peaks = non_max_by_priority(bins, [key], distance).join(m, key).where(F.col("value") >= F.col("_lim"))
    w = Window.partitionBy(key).orderBy(F.desc("value"), "idx")
    return peaks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("_lim")


def compare_reconstructions(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (truth, a, b) on one grid: energy and maximum of the difference, each error against the truth, and a's share of information."""
    d = F.col("a") - F.col("b")
    mse = lambda c: F.avg(F.pow(F.col(c) - F.col("truth"), 2))
    ca, cb = 1 / (1 + mse("a")), 1 / (1 + mse("b"))
    return pairs.groupBy(*keys).agg(F.avg(d * d).alias("difference"), F.max(F.abs(d)).alias("max_difference"), mse("a").alias("mse_a"), mse("b").alias("mse_b"), (ca / (ca + cb)).alias("share_a"))


def top_modes(frames: DataFrame, m: int, keys: list[str], mag: str = "mag") -> DataFrame:
    """The m strongest bins of each spectrum; a pick masks its neighbours. Rows (keys, other scalars, rank, bin, value)."""
    scalars = [f for f in frames.schema.fields if f.name != mag and not isinstance(f.dataType, T.ArrayType)]
    schema = T.StructType([*scalars, T.StructField("rank", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("value", T.DoubleType())])
    names = [f.name for f in scalars]

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                x = np.asarray(row[mag], float).copy()
                reach = max(3, len(x) // 500)
                for r in range(1, min(m, len(x)) + 1):
                    i = int(np.argmax(x))
                    if not x[i] > 0:
                        break
                    out.append([row[n] for n in names] + [r, i, float(x[i])])
                    x[max(0, i - reach) : i + reach + 1] = -1
            yield pd.DataFrame(out, columns=schema.names)

    return frames.select(*names, mag).mapInPandas(rows, schema)

