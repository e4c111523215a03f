"""Queries that SQL cannot express, against plain versions over the smallest tables."""

import math
import struct

import numpy as np
import pytest
import xxhash

from cadenza.operators import joins, rhythm, similarity, windows
from cadenza.plans import registry
from cadenza.plans import signal_plans as sp
from cadenza.plans.joins_plans import modes
from cadenza.plans.rhythm_plans import grid
from cadenza.schemas import hits, table


@pytest.fixture(scope="module")
def h(spark, sf_dir):
    return hits(spark, sf_dir).toPandas()


@pytest.fixture(scope="module")
def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").toPandas().sort_values("vec_id").reset_index(drop=True)


def run(spark, sf_dir, name):
    return registry.QUERIES[name](spark, sf_dir).toPandas()


def spread(items, value, place, distance):
    """Items in falling order of value, each at least ``distance`` from all taken before (place of the greater first)."""
    taken = []
    for i in sorted(items, key=lambda i: (-value(i), -place(i))):
        if all(abs(place(i) - place(j)) >= distance for j in taken):
            taken.append(i)
    return taken


def entropy_of(values, bins):
    """Of the histogram's densities, in bits."""
    d, _ = np.histogram(values, bins=bins, density=True)
    d = d[d > 0]
    return float(-(d * np.log2(d)).sum())


def test_s13_sample_rows(spark, sf_dir, h):
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    order = sorted(h["event_id"], key=lambda i: (signed(xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)), i))
    assert set(run(spark, sf_dir, "s13_sample_rows")["event_id"]) == set(order[:1000])


def test_c11_pca_2d(spark, sf_dir):
    got = run(spark, sf_dir, "c11_pca_2d").sort_values(["l_orderkey", "l_linenumber"]).reset_index(drop=True)
    from cadenza.plans.aggregates_plans import COLS

    x = table(spark, sf_dir, "lineitem").toPandas().sort_values(["l_orderkey", "l_linenumber"]).reset_index(drop=True)[list(COLS)].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0)
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert len(got) == len(x)
    want = np.sort(np.abs(x @ v[:2].T), axis=0)
    assert np.allclose(np.sort(got[["pc1", "pc2"]].to_numpy(), axis=0), want, atol=1e-4)


def test_c6_kmeans_rows_are_nearest_to_their_own_centre(spark, sf_dir):
    got = run(spark, sf_dir, "c6_kmeans")
    x = got[["p_size", "p_retailprice"]].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0)
    label = got["cluster"].to_numpy()
    centres = np.array([x[label == k].mean(0) for k in range(4)])
    assert len(got) == table(spark, sf_dir, "part").count() and set(label) == {0, 1, 2, 3}
    assert (((x[:, None] - centres) ** 2).sum(-1).argmin(1) == label).mean() > 0.98


def test_c7_segments(spark, sf_dir, embeddings):
    """DBSCAN on standardised features, Ward where that finds fewer than two groups or noise; Ward against sums of squares."""
    got = run(spark, sf_dir, "c7_cluster_segments").set_index("id")["cluster"]
    assert len(got) == len(embeddings)
    for _, part in embeddings.groupby("label"):
        x = np.array(part["embedding"].tolist(), float)
        x = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
        near = np.sqrt(((x[:, None] - x) ** 2).sum(-1)) <= 0.5
        if (near.sum(1) >= 2).all():
            continue  # no noise: DBSCAN may stand
        own = got.loc[part["vec_id"]].to_numpy()
        assert len(set(own)) == max(2, len(part) // 3)
        groups = [list(g) for g in (np.flatnonzero(own == c) for c in set(own))]
        plain = [[i] for i in range(len(x))]
        spread_of = lambda g: ((x[g] - x[g].mean(0)) ** 2).sum()
        while len(plain) > len(groups):
            cost, i, j = min((spread_of(plain[i] + plain[j]) - spread_of(plain[i]) - spread_of(plain[j]), i, j) for i in range(len(plain)) for j in range(i))
            plain[j] += plain.pop(i)
        assert sorted(sorted(map(int, g)) for g in plain) == sorted(sorted(map(int, g)) for g in groups)


def test_ward_of_two_clumps():
    x = np.array([[0, 0], [5, 5], [0, 0.1], [5, 5.2], [0.2, 0]])
    assert similarity.ward(x, 2).tolist() == [0, 1, 0, 1, 0] and similarity.ward(x, 9).tolist() == [0, 1, 2, 3, 4]


def test_c13_onset_correlation(spark, sf_dir, embeddings):
    got = run(spark, sf_dir, "c13_onset_correlation")
    n = len(embeddings)
    assert len(got) == sum(v % 100 == 0 for v in embeddings["vec_id"]) * (n - 1)
    e = {i: np.array(v, float) for i, v in zip(embeddings["vec_id"], embeddings["embedding"], strict=True)}
    for r in got.sample(40, random_state=1).itertuples():
        a, b = (e[k] / max(np.abs(e[k]).max(), 1e-300) for k in (r.a, r.b))
        assert math.isclose(r.similarity, np.correlate(a, b, "full").max(), abs_tol=1e-5)


def test_e18_harmonic_clusters(spark, sf_dir):
    m = modes(spark, sf_dir)
    pairs = joins.harmonic_pairs(m, 0.005, 0.3).toPandas()
    frequency = {(r.track_id, r.mode): r.frequency for r in m.toPandas().itertuples()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in pairs.itertuples():
        a, b = find((r.track_id, r.i)), find((r.track_id, r.j))
        parent[max(a, b)] = min(a, b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    got = {(r.track_id, r.cluster): (r.size, r.fundamental, r.log_product) for r in run(spark, sf_dir, "e18_harmonic_clusters").itertuples()}
    assert set(got) == set(groups)
    for root, members in groups.items():
        f = [frequency[x] for x in members]
        logs = sum(math.log(max(1.0, np.round(v / min(f)))) for v in f if v > min(f))
        assert got[root][0] == len(f) and math.isclose(got[root][1], min(f), rel_tol=1e-4) and math.isclose(got[root][2], logs, abs_tol=1e-3)


def test_r18_downbeats(spark, sf_dir, h):
    got = run(spark, sf_dir, "r18_downbeats")
    want = set()
    for track, part in h[h["type"] == "purchase"].groupby("track_id"):
        part = part.sort_values("event_id")
        v, ids = part["velocity"].to_numpy(), part["event_id"].to_numpy()
        peaks = [i for i in windows.peak_positions(v)]
        want |= {(track, int(ids[i])) for i in spread(peaks, lambda i: v[i], lambda i: i, 4)}
    assert {(r.track_id, r.idx) for r in got.itertuples()} == want
    rated = h.set_index("event_id")["confidence"]
    assert np.allclose(got["confidence"], 0.8 * rated.loc[got["idx"]].to_numpy())


def test_f27_density_peaks(spark, sf_dir, embeddings):
    got = {}
    for r in run(spark, sf_dir, "f27_density_peaks").itertuples():
        got.setdefault(r.vec_id, []).append((r.rank, r.idx))
    for vec, part in sp.bins(spark, sf_dir).toPandas().groupby("vec_id"):
        v = np.abs(part.sort_values("i")["x"].to_numpy(float))
        peaks = spread(list(windows.peak_positions(v)), lambda i: v[i], lambda i: i, 10)
        best = sorted((i for i in peaks if v[i] >= v.mean() + 2 * v.std()), key=lambda i: (-v[i], i))[:10]
        assert sorted(got.get(vec, [])) == [(k + 1, i) for k, i in enumerate(best)], vec


def test_r16_histogram_complexity(spark, sf_dir, h):
    got = run(spark, sf_dir, "r16_histogram_complexity").set_index("track_id")["complexity"]
    for track, part in list(h.groupby("track_id"))[:30]:
        want = np.mean([entropy_of(v, 20) * v.std(ddof=0) / (v.mean() + 1e-8) for _, v in part.groupby("type")["velocity"]])
        assert math.isclose(got[track], want, rel_tol=1e-4, abs_tol=1e-5), track


def test_r8_pattern_complexity(spark, sf_dir):
    got = {(r.track_id, r.type): r.complexity for r in run(spark, sf_dir, "r8_pattern_complexity").itertuples()}
    for r in rhythm.dense_grid(grid(spark, sf_dir)).limit(40).collect():
        v = np.array(r.grid)
        strong = v[[0, 8, 16, 24]].sum()
        ratio = (v.sum() - strong) / (strong + 1e-8)
        assert math.isclose(got[r.track_id, r.type], entropy_of(v, 8) * ratio, rel_tol=1e-4, abs_tol=1e-5)


def test_x6_file_beats(spark, sf_dir, h):
    got = {}
    for r in run(spark, sf_dir, "x6_file_beats").itertuples():
        got.setdefault(r.track_id, []).append(r.us)
    for track, part in h.groupby("track_id"):
        part = part.sort_values("us", kind="stable")
        was, last, want = False, None, []
        for us, on in zip(part["us"], part["confidence"] >= 0.5, strict=True):
            if on and not was and (last is None or (us - last) / 3.6e9 >= 2.0):
                want.append(us)
                last = us
            was = on
        assert sorted(got.get(track, [])) == want, track


def test_window_streams_equal_their_batch_forms(spark, sf_dir, tmp_path):
    """X3 and X4 over a stream of files, with a watermark; the last windows stay open."""
    from pyspark.sql import functions as F

    from cadenza.streaming import beats

    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("track_id"), F.col("event_type").alias("type"), "value").orderBy("ts")
    src = str(tmp_path / "in")
    e.repartition(1).sortWithinPartitions("ts").write.parquet(src)
    for name, form in (("recent", lambda x: beats.recent_beats(x, "5 hours", "1 hour")), ("buffered", lambda x: beats.buffered_windows(x, "2 hours", "1 hour"))):
        stream = form(spark.readStream.schema(e.schema).parquet(src).withWatermark("ts", "1 hour"))
        query = stream.writeStream.format("memory").queryName(f"{name}_windows").outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        got = {tuple(r) for r in spark.table(f"{name}_windows").collect()}
        want = {tuple(r) for r in form(e).collect()}
        assert got and got <= want and len(got) > 0.9 * len(want)
