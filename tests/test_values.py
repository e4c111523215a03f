"""Values of operators that SQL cannot express, against loops over the smallest tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import text
from cadenza.operators import signal
from cadenza.plans import registry
from cadenza.plans import signal_plans as sp
from cadenza.schemas import hits, table


@pytest.fixture(scope="module")
def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").toPandas().sort_values("vec_id").reset_index(drop=True)


def run(spark, sf_dir, name):
    return registry.QUERIES[name](spark, sf_dir).toPandas()


def maxima(x):
    """Places lower on both sides, the middle of level ones, by a walk."""
    out, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            out.append((i + j) // 2)
        i = j + 1
    return out


def picked(x, distance, prominence=0.0, height=None):
    """{place: prominence} of peaks, the highest first, ``distance`` apart."""
    kept = []
    for i in sorted((i for i in maxima(x) if height is None or x[i] >= height), key=lambda i: (-x[i], i)):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    out = {}
    for i in kept:
        lows = []
        for side in (range(i - 1, -1, -1), range(i + 1, len(x))):
            low = x[i]
            for j in side:
                if x[j] > x[i]:
                    break
                low = min(low, x[j])
            lows.append(low)
        if x[i] - max(lows) >= prominence:
            out[i] = x[i] - max(lows)
    return out


def autocorrelation(x):
    x = np.asarray(x, float) - np.mean(x)
    return [float(sum(x[i] * x[i + k] for i in range(len(x) - k))) for k in range(len(x))]


def power_spectrum(frame):
    n = len(frame)
    w = [0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)]
    return [abs(sum(frame[k] * w[k] * complex(math.cos(2 * math.pi * b * k / n), -math.sin(2 * math.pi * b * k / n)) for k in range(n))) ** 2 for b in range(n // 2 + 1)]


def test_f7_timbre(spark, sf_dir, embeddings):
    n_fft, hop, n_mels, n_mfcc, sr = 32, 16, 16, 8, 8000
    got = {(r.chunk_idx, r.frame_idx): r for r in signal.timbre(sp.chunks(spark, sf_dir).where("chunk_idx < 6"), n_fft, hop, n_mels, n_mfcc).collect()}
    to_mel, to_hz = lambda f: 2595 * math.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [to_hz(to_mel(sr / 2) * k / (n_mels + 1)) for k in range(n_mels + 2)]
    for e in embeddings.itertuples():
        if e.vec_id >= 6:
            continue
        assert sum(k[0] == e.vec_id for k in got) == (64 - n_fft) // hop + 1
        for i in range((64 - n_fft) // hop + 1):
            power = power_spectrum([float(v) for v in e.embedding[i * hop : i * hop + n_fft]])
            hz = [sr / 2 * b / (n_fft // 2) for b in range(n_fft // 2 + 1)]
            mel = []
            for k in range(n_mels):
                lo, mid, hi = edges[k : k + 3]
                mel.append(math.log(sum(p * max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) for p, f in zip(power, hz)) + 1e-8))
            mfcc = [math.sqrt((1 if q == 0 else 2) / n_mels) * sum(v * math.cos(math.pi * q * (k + 0.5) / n_mels) for k, v in enumerate(mel)) for q in range(n_mfcc)]
            chroma = [0.0] * 12
            for p, f in zip(power, hz):
                if f > 27.5:
                    chroma[round(12 * math.log2(f / 440)) % 12] += p
            r = got[e.vec_id, i]
            assert np.allclose(r.log_mel, mel, atol=1e-6) and np.allclose(r.mfcc, mfcc, atol=1e-6) and np.allclose(r.chroma, [c / max(chroma) for c in chroma])


def test_f11_tempo_from_autocorrelation(spark, sf_dir, embeddings):
    got = run(spark, sf_dir, "f11_tempo_from_autocorr").set_index("chunk_idx")["tempo"]
    assert len(got) == len(embeddings) and (got > 0).any()
    for e in embeddings.itertuples():
        lags = [k for k in maxima(autocorrelation(e.embedding)) if 60 * 4 / k <= 250]  # 8000 samples a second in hops of 2000
        assert math.isclose(got[e.vec_id], 60 * 4 / lags[0] if lags else 0.0, abs_tol=1e-5)
    fast = spark.createDataFrame([(1, 0, 0, 100, [float(i % 2) for i in range(40)]), (2, 0, 0, 100, [1.0, 2.0])], "track_id long, chunk_idx long, start_sample long, sr int, samples array<double>")
    # a pulse every two frames of 10 a second is 300 a minute: beyond what is playable, so its double time counts
    assert {r.track_id: r.tempo for r in signal.tempo_from_autocorr(fast, 10).collect()} == {1: 150.0, 2: 0.0}


def test_f16_detect_hits(spark, sf_dir, embeddings):
    got = {(r.label, r.type, r.idx): (r.confidence, r.velocity) for r in run(spark, sf_dir, "f16_detect_hits").itertuples()}
    want = {}
    for label, part in embeddings.groupby("label"):
        found = {}
        for band, lo, hi in (("kick", 0, 8), ("snare", 8, 24), ("hihat", 24, 64)):
            level = [sum(abs(float(v)) for v in e[lo:hi]) for e in part["embedding"]]
            rise = [0.0] + [max(0.0, b - a) for a, b in zip(level, level[1:])]
            x = [v / max(rise) if max(rise) > 0 else 0.0 for v in rise]
            for i, p in picked(x, 2, 0.1, 0.1).items():
                found[band, int(part["vec_id"].iloc[i])] = (p, x[i])
        best = max(p for p, _ in found.values()) if found else 1
        want |= {(label, *k): (p / best, v) for k, (p, v) in found.items()}
    assert want and set(got) == set(want)
    assert all(np.allclose(got[k], want[k], atol=2e-6) for k in want)


def test_f19_transition_candidates(spark, sf_dir, embeddings):
    got = {(r.track_id, r.idx): (r.value, r.prominence) for r in run(spark, sf_dir, "f19_transition_candidates").itertuples()}
    want = {}
    for label, part in embeddings.groupby("label"):
        x = [sum(abs(float(v)) * (0.15 if i < 4 else 0.25 if i < 10 else 0.15 if i < 30 else 0.1) for i, v in enumerate(e)) for e in part["embedding"]]
        want |= {(label, int(part["vec_id"].iloc[i])): (x[i], p) for i, p in picked(x, 3, 0.01).items()}
    assert want and set(got) == set(want)
    assert all(np.allclose(got[k], want[k], atol=2e-6) for k in want)


def test_f26_uncertainty_regions(spark, sf_dir, embeddings):
    got = {(r.pair, r.window): (r.uncertainty, r.causes) for r in run(spark, sf_dir, "f26_uncertainty_regions").itertuples()}
    want = {}
    for _, part in embeddings.groupby("label"):
        b = np.asarray(part["embedding"].iloc[0], float)
        for e in part.iloc[1:].itertuples():
            for w in range(4):
                x, y = np.asarray(e.embedding, float)[16 * w : 16 * w + 32], b[16 * w : 16 * w + 32]
                noise, power = np.mean((x - y) ** 2), np.mean(x**2)
                r = abs(np.corrcoef(x, y)[0, 1])
                score = 0.4 * min(1, max(0, 10 * math.log10(power / noise) / 30)) + 0.4 * r + 0.2 * (1 - min(1, math.sqrt(noise / power)))
                if score < 0.8 * 0.9:
                    ra, rb = math.sqrt(power), math.sqrt(np.mean(y**2))
                    want[e.vec_id, w] = (1 - score, ",".join(n for n, bad in (("level", abs(ra - rb) > 0.2 * ra), ("shape", r < 0.7)) if bad))
    assert want and set(got) == set(want)
    assert all(math.isclose(got[k][0], want[k][0], abs_tol=1e-5) and got[k][1] == want[k][1] for k in want)


def test_r17_pulse_features(spark, sf_dir):
    h = hits(spark, sf_dir).toPandas()
    name = next(n for n in registry.QUERIES if n.startswith("r17") and "subdivision" not in n)
    got = run(spark, sf_dir, name).set_index("track_id")
    h["frame"] = (h["time"] // 3600).astype(int)
    some = 0
    for track, part in h.groupby("track_id"):
        x = part.groupby("frame")["velocity"].sum().sort_index().to_numpy()
        ac = autocorrelation(x) if len(x) > 2 else [0.0]
        p = [ac[i] / ac[0] for i in maxima(ac)] if ac[0] > 0 else []
        some += bool(p)
        assert math.isclose(got["clarity"][track], np.mean(p[:5]) if p else 0.0, abs_tol=2e-6) and math.isclose(got["meter"][track], max(p) if p else 0.0, abs_tol=2e-6)
    assert some and len(got) == h["track_id"].nunique()


def test_e13_measure_states(spark, sf_dir, embeddings):
    got = {(r.track_id, r.frame_idx, r.rank): r for r in run(spark, sf_dir, "e13_measure_states").itertuples()}
    want = {}
    for label, part in embeddings.groupby("label"):
        last = {}
        for e in part.itertuples():
            for i in range(3):
                mag = [math.sqrt(p) for p in power_spectrum([float(v) for v in e.embedding[16 * i : 16 * i + 32]])]
                for rank in (1, 2, 3):
                    top = max(range(len(mag)), key=lambda b: mag[b])
                    if mag[top] <= 0:
                        break
                    value, hz = mag[top], max(top * 8000 / 32, 1.0)
                    for b in range(max(0, top - 3), min(len(mag), top + 4)):
                        mag[b] = -1
                    moved = abs(top - last[rank][0]) if rank in last else 0
                    s_k, s_t = math.log((moved + 1e-6) / 1e-6), math.log(max(1 / (hz * rank), 1e-6) / 1e-6)
                    total = s_k + s_t + math.log((0.5 * value**2 * (2 * math.pi * hz) ** 2 + 1e-12) / 1e-12)
                    if rank in last:
                        want[label, e.vec_id * 4 + i, rank] = (total, total - last[rank][1])
                    last[rank] = (top, total)
    assert want and set(got) == set(want)
    for k, (total, delta) in want.items():
        r = got[k]
        assert math.isclose(r.s_total, total, rel_tol=1e-6) and math.isclose(r.delta, delta, abs_tol=1e-5) and (r.irreversible == (delta > 0) or abs(delta) < 1e-9)


def test_t13_index_track(spark, sf_dir):
    """Description by hand from the scores, and only tracks with an embedding."""
    got = run(spark, sf_dir, "t13_index_track")
    assert len(got) == len(set(got["track_id"])) > 0 and (got["dims"] == 64).all()
    columns = ["loudness", "tempo", "dynamic_range", "drum_intensity", "spectral_centroid", "spectral_rolloff", "high_freq_energy", "spectral_flatness", "rhythmic_complexity", "dissonance", "low_mid_energy", "background_contrast",
               "harmonic_richness", "microtiming", "syncopation", "bass_drum_interaction", "groove_quality", "transient_sharpness", "distortion", "high_freq_intensity", "reverb_amount", "stereo_width", "background_texture", "minor_key",
               "sparse_arrangement", "uplifting_progression", "bpm"]
    values = {"loudness": 0.5, "tempo": 120.0, "dynamic_range": 0.4, "drum_intensity": 7.0, "spectral_centroid": 2000.0, "spectral_rolloff": 8000.0, "high_freq_energy": 3.0, "bpm": 174.04}
    rows = [(1, *[values.get(c) for c in columns], "Am"), (2, *[None] * len(columns), None), (3, *[values.get(c) for c in columns], "Am")]
    features = spark.createDataFrame(rows, "track_id long, " + ", ".join(f"{c} double" for c in columns) + ", key string")
    vectors = spark.createDataFrame([(1, [0.5, 1.5]), (2, [1.0, 0.0]), (4, [1.0, 1.0])], "track_id long, embedding array<double>")
    out = {r.track_id: r for r in text.index_track(features, vectors).collect()}
    assert set(out) == {1, 2} and out[1].embedding == [0.5, 1.5]
    energy = 0.4 * 5 + 0.3 * 5 + 0.1 * 8 + 0.2 * 7
    brightness = min(10, 5 + 0.5 * 4 + 0.3 * 4 + 0.2 * 3)
    assert math.isclose(out[1].energy, energy) and math.isclose(out[1].brightness, brightness)
    assert out[1].description == f"Energy {energy:.1f}, brightness {brightness:.1f}, tempo 174.0 BPM, key Am."
    assert out[2].energy == 0 and out[2].tension == 5 and out[2].description == "Energy 0.0, brightness 5.0."
