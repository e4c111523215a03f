"""Hand-computed tables, invariants and streams for the library's operators."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.operators import entropy, joins, rhythm, signal, similarity, topk, windows
from cadenza.schemas import hits, states, table
from cadenza.sources import signals, tables
from cadenza.streaming import beats


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_suppress_close_replaces_the_kept_peak(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.5), (1, 1, 0.05, 0.9), (1, 2, 0.12, 0.4), (1, 3, 0.2, 0.1), (2, 4, 0.0, 0.1)], "track_id long, event_id long, time double, confidence double")
    assert [r[1] for r in rows(windows.suppress_close(df, 0.1))] == [1, 3, 4]


def test_suppress_close_of_nothing(spark):
    df = spark.createDataFrame([], "track_id long, event_id long, time double, confidence double")
    assert rows(windows.suppress_close(df)) == []


def test_peaks_and_prominence():
    x = np.array([0, 3, 1, 2, 2, 2, 0, 5, 0.0])
    at = windows.peak_positions(x)
    assert at.tolist() == [1, 4, 7]
    assert windows.prominences(x, at).tolist() == [3, 1, 5]
    assert windows.greedy_by_height(x, at, 4).tolist() == [1, 7]


def test_non_max_by_priority(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 3, 1, 2, 0, 5, 0])], "track_id long, idx long, value double")
    out = windows.non_max_by_priority(df, ["track_id"], 3, 1.0)
    assert [(r.idx, r.value) for r in out.orderBy("idx").collect()] == [(1, 3.0), (5, 5.0)]


def test_merged_intervals_are_disjoint_and_cover(spark, sf_dir):
    h = hits(spark, sf_dir).select("track_id", "type", "confidence", F.col("time").alias("start_time"), (F.col("time") + 50_000 * F.col("confidence")).alias("end_time"))
    m = windows.merge_intervals(h).toPandas().sort_values(["track_id", "start_time"])
    same = m["track_id"].eq(m["track_id"].shift())
    assert (m["start_time"] > m["end_time"].shift())[same].all()
    assert m["n"].sum() == h.count()


def test_visibility_is_at_most_one_and_one_with_itself(spark, sf_dir):
    p = similarity.phase_profile(states(spark, sf_dir).withColumn("mode_index", F.col("event_id") % 8))
    twin = p.unionByName(p.withColumn("track_id", F.col("track_id") + 1_000_000))
    v = similarity.interference_visibility(twin).toPandas()
    assert (v["visibility"] <= 1 + 1e-9).all()
    own = v[v["b"] == v["a"] + 1_000_000]
    assert len(own) and np.allclose(own["visibility"], 1)


def test_transition_rows_sum_to_one_and_information_equals_entropy(spark, sf_dir):
    h = hits(spark, sf_dir)
    m = entropy.transition_matrix(h, ["track_id"], ["us"], "type").groupBy("track_id", "from_state").agg(F.sum("p").alias("p"))
    assert np.allclose(m.toPandas()["p"], 1)
    mi = entropy.mutual_information(h.withColumn("t2", F.col("type")), ["track_id"], "type", "t2")
    both = mi.join(entropy.shannon_entropy(h, ["track_id"], "type"), "track_id").toPandas()
    assert np.allclose(both["mi"], both["entropy"])


def test_flat_index_is_unique_in_a_shell(spark):
    n = 4
    cells = [(n, lv, (k + 0.5) / 400 * 2 * math.pi) for lv in range(n) for k in range(400)]
    df = spark.createDataFrame(cells, "n int, rank int, phase double")
    out = entropy.partition_coordinate(df).select("l", "m", "flat_index", "degeneracy").distinct().toPandas()
    assert out["flat_index"].is_unique and (out["degeneracy"] == 2 * n * n).all() and (out["flat_index"] < 2 * n * n).all()


def test_dbscan_finds_two_groups_and_noise(spark):
    pts = {0: (1, 0), 1: (1, 0.01), 2: (1, 0.02), 3: (0, 1), 4: (0.01, 1), 5: (0.02, 1), 6: (-1, -1)}
    df = spark.createDataFrame([(k, 0, [float(x) for x in v]) for k, v in pts.items()], "id long, g int, embedding array<double>")
    got = {r.id: r.cluster for r in similarity.similar_groups(df, "g", "id", 0.01, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: -1}


def test_segments_of_every_label_are_clustered(spark, tmp_path):
    from cadenza.plans import registry

    near = {0: (1, 0), 1: (1, 0.01), 2: (0, 1), 3: (0.01, 1)}  # two groups: DBSCAN decides
    lone = {4: (1, 0), 5: (1, 0.02), 6: (0, 1), 7: (-1, 0), 8: (-1, -0.02), 9: (0.02, 1), 10: (0.03, -1)}  # noise: bisecting
    data = [(i, 1, [float(c) for c in v]) for i, v in near.items()] + [(i, g, [float(c) for c in v]) for g in (2, 3) for i, v in ((k + 100 * (g - 2), v) for k, v in lone.items())]
    spark.createDataFrame(data, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = registry.QUERIES["c7_cluster_segments"](spark, str(tmp_path)).collect()
    assert sorted(r.id for r in out) == sorted(i for i, _, _ in data)
    got = {r.id: (r.label, r.cluster) for r in out}
    assert [got[i] for i in range(4)] == [(1, 0), (1, 0), (1, 2), (1, 2)]
    for g in (2, 3):
        own = {k: c for k, (label, c) in got.items() if label == g}
        assert len(own) == 7 and len(set(own.values())) == 2
        assert own[4 + 100 * (g - 2)] == own[5 + 100 * (g - 2)] and own[7 + 100 * (g - 2)] == own[8 + 100 * (g - 2)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.label for r in similarity.min_label_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_components_of_a_path_that_walks_down_to_its_least_id(spark):
    path = [0, *range(100, 0, -1)]
    edges = spark.createDataFrame([*zip(path, path[1:], strict=False), (200, 200)], "a long, b long")
    got = {r.id: r.label for r in similarity.min_label_components(edges).collect()}
    assert got == {i: 0 for i in path} | {200: 200}


def test_components_equal_union_find_on_random_edges(spark):
    rnd = np.random.default_rng(7)
    pairs = [(int(x), int(y)) for x, y in rnd.integers(0, 300, (220, 2))]
    root = {i: i for p in pairs for i in p}
    for _ in root:
        for x, y in pairs:
            root[x] = root[y] = min(root[x], root[y])
    got = {r.id: r.label for r in similarity.min_label_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == root


def test_similar_pairs_equal_brute_force(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    got = {(r.a, r.b): r.similarity for r in joins.similar_pairs(e, "label", "vec_id", block=7).collect()}
    p = e.toPandas()
    want = {}
    for _, g in p.groupby("label"):
        x = np.array(g["embedding"].tolist(), float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids = g["vec_id"].tolist()
        want |= {(min(a, b), max(a, b)): float(x[i] @ x[j]) for i, a in enumerate(ids) for j, b in enumerate(ids[:i])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_zero_vector_scores_nothing(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "track_id long, embedding array<double>")
    assert rows(topk.top_k_cosine(df, [1.0, 1.0])) == [(1, 0.0), (2, 1.0)]


def test_dtw_of_equal_and_shifted_series():
    a = np.array([0, 1, 2, 1, 0.0])
    assert rhythm.dtw(a, a) == 1
    assert rhythm.dtw(a, np.array([0, 0, 1, 2, 1, 0.0])) == 1
    assert rhythm.dtw(a, a + 1) < 1


def test_pattern_length_of_a_repeating_rhythm(spark):
    us = np.cumsum([0] + [200_000, 200_000, 400_000] * 10)
    df = spark.createDataFrame([(1, "kick", int(t)) for t in us], "track_id long, type string, us long")
    assert abs(rhythm.pattern_length(df).first().length - 0.8) < 1e-9


def test_sine_has_its_mode_and_crossings(spark):
    c = signals.to_chunks(signals.sine(spark, 1000, 1.0), 4000, 8000)
    frames = signal.stft(c, 512, 256)
    top = signal.top_modes(frames, 1, ["track_id", "frame_idx"]).toPandas()
    assert (abs(top["bin"] * 8000 / 512 - 1000) <= 8000 / 512).all()
    z = signal.chunk_levels(c).toPandas()
    assert np.allclose(z["rms"], 1 / math.sqrt(2), atol=1e-3) and np.allclose(z["zcr"], 0.25, atol=0.01)


def test_resampling_a_sine(spark):
    c = signals.to_chunks(signals.sine(spark, 200, 0.5), 4000, 8000)
    x = np.array(signal.sinc_resample(c, 2).first().resampled)
    t = np.arange(len(x)) / 16000
    inner = slice(200, -200)
    assert np.abs(x - np.sin(2 * math.pi * 200 * t))[inner].max() < 0.02


def test_break_pattern_peaks_at_one(spark):
    x = signals.break_pattern(spark, 1).toPandas()["x"]
    assert abs(x.abs().max() - 1) < 1e-9


def test_fidelity_of_equal_series(spark):
    df = spark.createDataFrame([(1, float(i), float(i)) for i in range(5)], "k int, value_a double, value_b double")
    r = signal.fidelity(df, ["k"]).first()
    assert math.isinf(r.snr_db) and abs(r.correlation - 1) < 1e-12 and r.max_error == 0


def test_phase_of_a_chunk_is_linear(spark):
    c = signals.to_chunks(signals.sine(spark, 100, 0.8), 6400, 8000)
    ph = np.unwrap(np.array(entropy.instantaneous_phase(c).first().phase))
    assert np.allclose(np.diff(ph), 2 * math.pi * 100 / 8000, atol=1e-3)


def test_upsert_keeps_what_is_null(spark):
    old = spark.createDataFrame([(1, 5, "a", "b"), (2, 6, "a", "b")], "track_id long, score int, added string, updated string")
    new = spark.createDataFrame([(2, None), (3, 7)], "track_id long, score int")
    assert rows(topk.upsert_tracks(old, new, "now")) == [(1, 5, "a", "b"), (2, 6, "a", "now"), (3, 7, "now", "now")]


def test_results_files_round_trip(spark, tmp_path):
    (tmp_path / "mix.json").write_text('{"duration": 1.5}')
    (tmp_path / "bad.json").write_text('{"duration": ')
    (tmp_path / "Song.WAV").write_bytes(b"0")
    from pyspark.sql import types as T

    got = tables.read_results(spark, [str(tmp_path)], T.StructType([T.StructField("duration", T.DoubleType())]))
    assert [(r.file, r.duration) for r in got.collect()] == [("mix", 1.5)]
    assert tables.discover_files(spark, str(tmp_path)).count() == 1
    df = spark.createDataFrame([(1, ("x", [1, 2]))], "id int, m struct<a:string,b:array<int>>")
    tables.write_results(df, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().asDict() == {"id": "1", "m_a": "x", "m_b": "[1,2]"}
    tables.save_versioned(df.select("id"), str(tmp_path / "v"), "2.1.0")
    saved = spark.read.parquet(str(tmp_path / "v"))
    assert tables.compatible(saved, "2.9.9").count() == 1 and tables.compatible(saved, "1.0.0").count() == 0


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


SCHEMA = "event_id long, track_id long, ts timestamp, us long, activation double"


def streamed(spark, tmp_path, batches, make, name):
    """The rows that a stream gives for files taken one a micro-batch, and its last number of state rows. A far later row of a
    track of its own comes last, so that the watermark passes all others."""
    src = tmp_path / name
    src.mkdir()
    end = max(b["ts"].max() for b in batches) + timedelta(days=400)
    for k in range(2):
        batches = [*batches, pd.DataFrame([(10**9 + k, -1, end + timedelta(days=k), 0, 0.0)], columns=["event_id", "track_id", "ts", "us", "activation"])]
    import os

    for i, b in enumerate(batches):
        b.to_parquet(src / f"{i}.parquet", index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(src / f"{i}.parquet", (10**9 + i, 10**9 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    state = [op["numRowsTotal"] for op in q.recentProgress[-1]["stateOperators"]]
    return spark.table(name).where("track_id >= 0").toPandas(), state


def test_stream_of_beats_equals_the_batch(spark, sf_dir, tmp_path, rocksdb):
    """Rows of three micro-batches overlap in time by days; within the watermark the order does not matter."""
    ev = hits(spark, sf_dir).select("event_id", "track_id", (F.col("us") / 1e6).cast("timestamp").alias("ts"), "us", F.col("confidence").alias("activation")).orderBy("us").toPandas()
    args = {"threshold": 0.5, "min_interval": 2.0, "low": 2.0, "high": 48.0, "unit": 3.6e9}
    mixed = ev.sample(frac=1, random_state=1)
    batches = [mixed.iloc[part] for part in np.array_split(np.arange(len(mixed)), 3)]
    got, _ = streamed(spark, tmp_path, batches, lambda s: beats.stream_beats(s.withWatermark("ts", "300 days"), **args), "beats")
    got = got.sort_values(["track_id", "us"], ignore_index=True)
    want = beats.batch_beats(spark.createDataFrame(ev), **args).orderBy("track_id", "us").toPandas()
    pd.testing.assert_frame_equal(got, want)


def test_idle_tracks_begin_anew_and_leave_no_state(spark, tmp_path, rocksdb):
    t = datetime(2024, 1, 1)
    secs = [0, 0.5, 1.0, 1.5, 100, 100.4, 100.8, 300, 300.5, 301]
    rows = pd.DataFrame([(i, i % 2, t + timedelta(seconds=x), int(x * 1e6), 0.9) for i, x in enumerate(s for s in secs for _ in range(2))], columns=["event_id", "track_id", "ts", "us", "activation"])
    batches = [rows.iloc[[1, 0, 3, 2, 5, 4, 7, 6]], rows.iloc[8:14], rows.iloc[14:]]
    got, state = streamed(spark, tmp_path, batches, lambda s: beats.stream_beats(s.withWatermark("ts", "1 second"), idle=30.0), "idle")
    want = beats.batch_beats(spark.createDataFrame(rows), idle=30.0).toPandas()
    pd.testing.assert_frame_equal(got.sort_values(["track_id", "us"], ignore_index=True), want.sort_values(["track_id", "us"], ignore_index=True))
    assert (want[want["us"].isin([100_000_000, 300_000_000])]["tempo"] == 120).all()
    assert max(state) <= 6  # only the closing row's track is left


def test_stream_of_tempos_ends_at_the_batch(spark, sf_dir, tmp_path, rocksdb):
    ev = hits(spark, sf_dir).where("type = 'purchase'").select("event_id", "track_id", (F.col("us") / 1e6).cast("timestamp").alias("ts"), "us", F.lit(1.0).alias("activation")).orderBy("us").toPandas()
    batches = [ev.iloc[part].sample(frac=1, random_state=3) for part in np.array_split(np.arange(len(ev)), 3)]
    got, _ = streamed(spark, tmp_path, batches, lambda s: beats.stream_tempo(s.withWatermark("ts", "1 second"), 8, 2.0, 48.0, 3.6e9), "tempo")
    last = got.sort_values("us").groupby("track_id").tail(1).set_index("track_id")["tempo"]
    want = beats.last_tempo(spark.createDataFrame(ev), 8, 2.0, 48.0, 3.6e9).toPandas().set_index("track_id")["tempo"]
    pd.testing.assert_series_equal(last.sort_index(), want.sort_index())
    assert len(got) > len(want)  # a tempo whenever beats came


def test_stream_density_drops_late_rows_and_repeats(spark, tmp_path):
    t, sec = datetime(2024, 1, 1), lambda n: timedelta(seconds=n)
    files = [[(1, t, "a"), (1, t, "a"), (2, t + sec(60), "a")], [(4, t + sec(200), "a")], [(3, t + sec(1), "a"), (6, t + sec(300), "a")], [(5, t + sec(400), "a")]]
    src = tmp_path / "in"
    src.mkdir()
    for i, f in enumerate(files):
        spark.createDataFrame(f, "event_id long, ts timestamp, type string").coalesce(1).write.parquet(str(src / str(i)))
    stream = spark.readStream.schema("event_id long, ts timestamp, type string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    q = beats.stream_density(beats.prepare(stream)).writeStream.format("memory").queryName("density").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.start: r.n for r in spark.table("density").collect()}
    assert all(n == 1 for n in got.values()) and t in got


@pytest.mark.parametrize("name", ["a1_hit_stats_by_type", "w8_merge_intervals", "e6_transition_matrix"])
def test_queries_read_an_empty_table(spark, sf_dir, name, tmp_path):
    from cadenza.plans import registry

    table(spark, sf_dir, "events").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0
