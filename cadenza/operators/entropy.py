"""Entropy, state-space and thermodynamic statistics over hits and state trajectories."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def amplitude_labels(df: DataFrame, keys: list[str], value: str, n: int = 32) -> DataFrame:
    """Label 0..n-1 of each value by its place in its series' range; 0 in a constant series. Extremes are aggregated, then joined."""
    r = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    at = F.floor((F.col(value) - F.col("_lo")) / F.nullif(width, F.lit(0.0)) * n)
    return df.join(r, keys).withColumn("label", F.coalesce(F.least(F.lit(n - 1), F.greatest(F.lit(0), at)), F.lit(0)).cast("int")).drop("_lo", "_hi")


def distinct_states(labels: DataFrame, keys: list[str]) -> DataFrame:
    return labels.groupBy(*keys).agg(F.countDistinct("label").alias("states"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """(keys, bin, n, total, width): counts in equal bins over each series' range, the last one closed; constant series get width 1 and bin bins//2."""
    r = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("total"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    joined = df.join(r, keys).withColumn("width", F.when(w > 0, w).otherwise(1.0 / bins))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("width")), F.lit(bins - 1))).otherwise(bins // 2)
    return joined.groupBy(*keys, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("total"), F.first("width").alias("width"))


def histogram_entropy(df: DataFrame, keys: list[str], value: str, bins: int = 50, probability: bool = False) -> DataFrame:
    """-sum d log2 d over the density of each series' histogram (can be negative), or over its probabilities."""
    h = histogram(df, keys, value, bins)
    p = F.col("n") / F.col("total")
    d = p if probability else p / F.col("width")
    return h.groupBy(*keys).agg((-F.sum(d * F.log2(d))).alias("entropy"))


def shannon_entropy(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Entropy in nats of the labels of each series."""
    n = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    t = n.groupBy(*keys).agg(F.sum("_n").alias("_t"), F.sum(F.col("_n") * F.log("_n")).alias("_s"))
    return t.select(*keys, (F.log("_t") - F.col("_s") / F.col("_t")).alias("entropy"))


def occupation(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    n = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def mutual_information(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Mutual information in nats of two label columns per series."""
    n = pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("_n"))
    over = lambda *c: F.sum("_n").over(Window.partitionBy(*keys, *c))
    n = n.withColumns({"_a": over(a), "_b": over(b), "_t": over()})
    term = F.col("_n") / F.col("_t") * F.log(F.col("_n") * F.col("_t") / (F.col("_a") * F.col("_b")))
    return n.groupBy(*keys).agg(F.sum(term).alias("mi"))


def label_commutation(df: DataFrame, keys: list[str], label: str, observable: str) -> DataFrame:
    """Absolute correlation of labels and observable; 0 where either is constant."""
    flat = (F.stddev_pop(label) < 1e-15) | (F.stddev_pop(observable) < 1e-15)
    return df.groupBy(*keys).agg(F.when(flat, 0.0).otherwise(F.abs(F.corr(label, observable))).alias("r"))


def transition_matrix(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """(keys, from_state, to_state, n, p): frequencies of the next state given this one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    t = df.select(*keys, F.col(state).alias("from_state"), F.lead(state).over(w).alias("to_state")).where("to_state IS NOT NULL")
    n = t.groupBy(*keys, "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "from_state")))


def entropy_rate(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """-sum pi_i T_ij ln T_ij with pi the share of all states, the last included."""
    m = transition_matrix(df, keys, order, state)
    pi = occupation(df, keys, state).select(*keys, F.col(state).alias("from_state"), "share")
    return m.join(pi, [*keys, "from_state"]).groupBy(*keys).agg((-F.sum(F.col("share") * F.col("p") * F.log("p"))).alias("rate"))


def phase_state(phase: Column, n: int) -> Column:
    return F.pmod(F.floor(n * phase / (2 * math.pi)), F.lit(n))


def instantaneous_phase(chunks: DataFrame, samples: str = "samples") -> DataFrame:
    """Phase of the analytic signal of each chunk, by its Fourier transform; unwrap it with ``unwrap_phase``. Chunk ends differ from the whole signal's."""

    def rows(batches):
        for pdf in batches:
            out = []
            for x in pdf[samples]:
                x = np.asarray(x, float)
                n = len(x)
                gain = np.zeros(n)
                if n:
                    gain[0] = 1
                    gain[1 : (n + 1) // 2] = 2
                    if n % 2 == 0:
                        gain[n // 2] = 1
                out.append(np.angle(np.fft.ifft(np.fft.fft(x) * gain)) if n else x)
            yield pdf.assign(phase=out)

    from pyspark.sql import types as T

    schema = T.StructType([*chunks.schema.fields, T.StructField("phase", T.ArrayType(T.DoubleType()))])
    return chunks.mapInPandas(rows, schema)


def multimode_entropy(labels: DataFrame, keys: list[str], mode: str, label: str) -> DataFrame:
    """Sum over modes of ln(distinct states), in units of the Boltzmann constant, with the number of modes."""
    n = labels.groupBy(*keys, mode).agg(F.countDistinct(label).alias("_n"))
    return n.groupBy(*keys).agg(F.sum(F.log("_n")).alias("entropy"), F.count(F.lit(1)).alias("modes"))


def theory(modes: Column, n: int) -> Column:
    return modes * math.log(n)


def capacity(modes: Column, n: int) -> Column:
    return modes * math.log2(n)


def physical_capacity(sr: Column, snr: Column) -> Column:
    return sr / 2 * F.log2(1 + snr)


# fixed values
PHI0, TAU0, E0 = 1e-6, 1e-6, 1e-12


def s_entropy(df: DataFrame, phase_change: str = "dphi", frequency: str = "frequency", depth: str = "n", amplitude: str = "amplitude") -> DataFrame:
    """Coordinates s_k, s_t, s_e of each state."""
    tau = 1 / (F.col(frequency) * F.col(depth))
    energy = 0.5 * F.pow(amplitude, F.lit(2)) * F.pow(2 * math.pi * F.col(frequency), F.lit(2))
    return df.withColumns({
        "s_k": F.log((F.abs(phase_change) + PHI0) / PHI0), "s_t": F.log(F.greatest(tau, F.lit(TAU0)) / TAU0), "s_e": F.log((energy + E0) / E0),
    })


def partition_coordinate(df: DataFrame, depth: str = "n", rank: str = "rank", phase: str = "phase") -> DataFrame:
    """l, m, s, ``flat_index`` within the shell and its degeneracy 2 n^2."""
    turn = F.pmod(F.col(phase), F.lit(2 * math.pi)) / (2 * math.pi)
    j = F.least(F.floor(turn * F.col(depth)), F.col(depth) - 1)
    out = df.withColumn("l", F.greatest(F.least(F.col(rank), F.col(depth) - 1), F.lit(0)).cast("long"))
    m = F.bround(j / F.col(depth) * (2 * F.col("l") + 1)) - F.col("l")
    out = out.withColumn("m", F.least(F.col("l"), F.greatest(-F.col("l"), m)).cast("long")).withColumn("s", F.lit(0.5))
    # the shells below l hold 2 l^2 states
    flat = 2 * F.col("l") * F.col("l") + 2 * (F.col("m") + F.col("l")) + F.when(F.col("s") > 0, 0).otherwise(1)
    return out.withColumn("flat_index", flat.cast("long")).withColumn("degeneracy", (2 * F.col(depth) * F.col(depth)).cast("long"))


def measure_states(chunks: DataFrame, n_modes: int = 4, hop: int = 512) -> DataFrame:
    """States of chunks (track_id, chunk_idx, sr, samples): the strongest modes of each windowed frame with entropy coordinates and the change since the mode's last state."""
    from .signal import stft, top_modes
    from .windows import state_delta

    modes = top_modes(stft(chunks, 2 * hop, hop), n_modes, ["track_id", "frame_idx"])
    hz = F.col("bin") * F.col("sr") / (2 * hop)
    st = modes.withColumn("frequency", F.greatest(hz, F.lit(1.0))).withColumn("amplitude", F.col("value")).withColumn("n", F.col("rank"))
    w = Window.partitionBy("track_id", "rank").orderBy("frame_idx")
    st = st.withColumn("dphi", F.coalesce(F.col("bin") - F.lag("bin").over(w), F.lit(0)).cast("double"))
    st = s_entropy(st).withColumn("s_total", F.col("s_k") + F.col("s_t") + F.col("s_e"))
    return state_delta(st, ["track_id", "rank"], ["frame_idx"])


def ensemble_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population std of the coordinates, production per second and the irreversible share; needs ``delta`` and ``time``."""
    aggs = [f(c).alias(f"{n}_{c}") for c in ("s_k", "s_t", "s_e") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    span = F.max("time") - F.min("time")
    gain = F.sum(F.greatest(F.lit(0.0), F.col("delta")))
    return df.groupBy(*keys).agg(*aggs, F.when(span > 0, gain / span).otherwise(0.0).alias("rate"), F.avg((F.col("delta") > 0).cast("double")).alias("irreversible"))


def second_law_report(df: DataFrame, keys: list[str]) -> DataFrame:
    s = lambda c: F.sum(c.cast("long"))
    x = F.col("delta")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), s(x > 0).alias("positive"), s(x < 0).alias("negative"), s(x == 0).alias("zero"),
        F.avg(x).alias("mean_delta"), F.avg((x > 0).cast("double")).alias("share_positive"), F.sum(F.greatest(F.lit(0.0), x)).alias("production"),
    )


def partition_function(levels: DataFrame, keys: list[str], energy: str = "energy", beta: float = 1.0, degeneracy: str | None = None) -> DataFrame:
    """Z, mean energy, entropy (k_B) and free energy of each system's levels, measured from the lowest."""
    lo = levels.groupBy(*keys).agg(F.min(energy).alias("_e0"))
    g = F.lit(1.0) if degeneracy is None else F.col(degeneracy).cast("double")
    e = F.col(energy) - F.col("_e0")
    x = levels.join(lo, keys).withColumn("_w", g * F.exp(-beta * e)).withColumn("_e", e)
    z = F.sum("_w")
    out = x.groupBy(*keys).agg(z.alias("z"), (F.sum(F.col("_e") * F.col("_w")) / z + F.first("_e0")).alias("mean_energy"), F.first("_e0").alias("_e0"))
    return out.select(*keys, "z", "mean_energy", (F.log("z") + beta * (F.col("mean_energy") - F.col("_e0"))).alias("entropy"), (F.col("_e0") - F.log("z") / beta).alias("free_energy"))


def energy_levels(df: DataFrame, e_max: str, n: int) -> DataFrame:
    """Levels j E_max / n for j below n."""
    return df.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("energy", F.col("j") * F.col(e_max) / n)


def energy_to_amplitude(energy: Column, mass: float, omega: Column) -> Column:
    return F.sqrt(2 * energy / (mass * omega * omega))


def harmonic_clusters(pairs: DataFrame, modes: DataFrame, key: str = "track_id") -> DataFrame:
    """Connected groups of at least two modes of a track with fundamental, harmonic numbers and their log sum. Components are found
    by rounds of joins over the edges of all tracks at once; the smallest mode names its group."""
    from .similarity import min_label_components

    end = lambda mode: F.struct(F.col(key).alias("t"), F.col(mode).alias("m"))
    found = min_label_components(pairs.select(end("i").alias("a"), end("j").alias("b")))
    lab = found.select(F.col("id.t").alias(key), F.col("id.m").alias("mode"), F.col("label.m").alias("cluster"))
    m = lab.join(modes.select(key, "mode", "frequency").hint("merge"), [key, "mode"])
    base = m.groupBy(key, "cluster").agg(F.min("frequency").alias("fundamental"), F.count(F.lit(1)).alias("size"))
    h = F.greatest(F.lit(1.0), F.bround(F.col("frequency") / F.col("fundamental")))
    other = F.when(F.col("frequency") > F.col("fundamental"), F.log(h)).otherwise(0.0)
    return m.join(base.where("size >= 2").hint("merge"), [key, "cluster"]).groupBy(key, "cluster", "fundamental", "size").agg(F.sum(other).alias("log_product"), F.exp(F.sum(other)).alias("product"))


def coincidence_matrix(pairs: DataFrame, modes: DataFrame, key: str = "track_id") -> DataFrame:
    """(key, i, j, strength) both ways, with ones on the diagonal."""
    flipped = pairs.select(key, F.col("j").alias("i"), F.col("i").alias("j"), "strength")
    diagonal = modes.select(key, F.col("mode").alias("i"), F.col("mode").alias("j"), F.lit(1.0).alias("strength"))
    return pairs.select(key, "i", "j", "strength").unionByName(flipped).unionByName(diagonal)


def phase_locking(pairs: DataFrame, keys: list[str], a: str = "phase_a", b: str = "phase_b", k: str | int = 1) -> DataFrame:
    """|mean e^{i(b - k a)}| per series."""
    d = F.col(b) - (F.col(k) if isinstance(k, str) else F.lit(k)) * F.col(a)
    return pairs.groupBy(*keys).agg(F.sqrt(F.pow(F.avg(F.cos(d)), 2) + F.pow(F.avg(F.sin(d)), 2)).alias("plv"))


def resolution_product(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    p = F.stddev_pop("s_k") * F.stddev_pop("s_t")
    return df.groupBy(*keys).agg(p.alias("product"), (p >= 1 / (4 * math.pi)).alias("above_uncertainty"), (p < 1 / n**2).alias("below_cell"))


# fixed values
SCALE_WEIGHTS = [10 ** (-6 + 10 * k / 7) for k in range(8)]


def multi_scale_entropy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, domain, scale, entropy) to weighted sums per domain and in total."""
    weight = F.element_at(F.array(*map(F.lit, SCALE_WEIGHTS)), F.col("scale") + 1)
    total = lambda d: F.sum(F.when(F.col("domain") == d, weight * F.col("entropy")).otherwise(0.0))
    out = df.groupBy(*keys).agg(*[total(d).alias(f"s_{d}") for d in ("frequency", "time", "amplitude")])
    return out.withColumn("s_total", F.col("s_frequency") + F.col("s_time") + F.col("s_amplitude"))


def droplet_params(df: DataFrame) -> DataFrame:
    """velocity, size, angle and tension from the entropies; the root of a negative is NaN."""
    f, a, t = F.col("s_frequency"), F.col("s_amplitude"), F.col("s_time")
    root = F.when(a < 0, F.lit(float("nan"))).otherwise(F.sqrt(F.greatest(a, F.lit(0.0))))
    return df.withColumns({
        "velocity": 2.5 * f + 1.8 * a + 0.5, "size": 0.6 * root * F.exp(-2.1 * t), "angle": F.when(t == 0, 0.0).otherwise(F.atan(3.2 * f / F.nullif(t, F.lit(0.0)))),
        "tension": 0.4 + 0.3 * F.col("s_total"),
    })


def droplet_signature(df: DataFrame) -> DataFrame:
    """First 16 hex digits of md5 over the four values at six places: equal tracks have equal signatures."""
    return df.withColumn("signature", F.substring(F.md5(F.format_string("%.6f_%.6f_%.6f_%.6f", "velocity", "size", "angle", "tension")), 1, 16))


def fingerprint(df: DataFrame, keys: list[str], side: int = 16) -> DataFrame:
    """(keys, y, x, value): the four droplet values as a pattern; size shows on the diagonal alone."""
    at = F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))
    g = df.withColumn("_p", at).withColumn("y", F.floor(F.col("_p") / side).cast("int")).withColumn("x", (F.col("_p") % side).cast("int"))
    u = F.col("x") / (side - 1) * 2 * math.pi
    wave = F.cos(2 * u * F.col("angle")) * F.col("tension")
    spike = F.when(F.col("x") == F.col("y"), F.sin(u * F.col("velocity")) * F.col("size")).otherwise(0.0)
    return g.select(*keys, "y", "x", (wave + spike).alias("value"))


def energy_density(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Per series: total energy, entropy of its shares, their variance and the count."""
    t = df.groupBy(*keys).agg(F.sum(value).alias("total"))
    p = df.join(t, keys).withColumn("_p", F.col(value) / F.nullif(F.col("total"), F.lit(0.0)))
    return p.groupBy(*keys).agg(F.first("total").alias("total"), (-F.sum(F.col("_p") * F.log2(F.col("_p") + 1e-8))).alias("entropy"), F.var_pop("_p").alias("variance"), F.count(F.lit(1)).alias("n"))


def groove_metric(df: DataFrame, keys: list[str], order: list[str], eps: float = 1e-9) -> DataFrame:
    """Per series the mean distance of consecutive states in the curved and the flat metric, and exp(-mean/10)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = {c: F.col(c) - F.lag(c).over(w) for c in ("s_k", "s_t", "s_e")}
    x = df.withColumns({f"_d{c}": v for c, v in d.items()}).where("_ds_k IS NOT NULL")
    k, t, e = F.col("_ds_k"), F.col("_ds_t"), F.col("_ds_e")
    inv = lambda c: 1 / (F.col(c) + eps)
    q = inv("s_k") * k * k + inv("s_t") * t * t + inv("s_e") * e * e + 2 * 0.5 * F.sqrt(F.col("s_k") * F.col("s_t")) * k * t
    flat = F.sqrt(k * k + t * t + e * e)
    return x.groupBy(*keys).agg(F.avg(F.sqrt(F.greatest(q, F.lit(0.0)))).alias("curved"), F.avg(flat).alias("flat"), F.exp(-F.avg(flat) / 10).alias("similarity"))


def profile_match(series: DataFrame, profile: list[float], key: str, order: list[str], value: str, threshold: float) -> DataFrame:
    """Windows of the profile's length at half-length hops whose mean distance d to it gives exp(-d/10) >= threshold."""
    n = len(profile)
    hop = max(1, n // 2)
    pos = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    p = series.withColumn("_i", pos)
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: (F.floor(F.col("_i") / hop) - k) * hop), lambda s: (s >= 0) & (F.col("_i") - s < n))
    e = p.withColumn("start", F.explode(starts))
    ref = F.element_at(F.array(*[F.lit(float(x)) for x in profile]), (F.col("_i") - F.col("start") + 1).cast("int"))
    out = e.groupBy(key, "start").agg(F.avg(F.abs(F.col(value) - ref)).alias("distance"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n)
    return out.withColumn("similarity", F.exp(-F.col("distance") / 10)).where(F.col("similarity") >= threshold).drop("_n")


def drip_from_chunks(chunks: DataFrame, key: str = "track_id") -> DataFrame:
    """Entropies and droplet values of a track from its chunks' rms, centroid and zero-crossing rate."""
    by = chunks.groupBy(key).agg(F.sum("rms").alias("e"), F.avg("centroid").alias("c"), F.avg("zcr").alias("z"), F.sum("duration").alias("dur"))
    e, c, z = F.col("e"), F.col("c"), F.col("z")
    return by.select(
        key, (100 * c).alias("s_frequency"), (100 * F.col("dur")).alias("s_time"), (-1e6 * e).alias("s_amplitude"), (-8e5 * e).alias("s_total"),
        (-2e6 * e).alias("velocity"), F.when(e < 0.001, float("nan")).otherwise(1000 * e).alias("size"), (10 * z).alias("angle"), (-1000 * c).alias("tension"),
    )
