"""Operators on one long track or one large group, against plain versions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import aggregates, carry, joins, selection, similarity, windows


def test_nearest_onset_on_one_long_track(spark):
    """200,000 beats and as many onsets of one track, in blocks, within seconds and equal to numpy."""
    n = 200_000
    rng = np.random.default_rng(1)
    beats, onsets = np.sort(rng.integers(0, 4 * 10**9, n)), np.sort(rng.integers(10**8, 4 * 10**9, n))
    onsets = onsets[(onsets < 10**9) | (onsets > 2 * 10**9)]  # a long gap: many blocks without an onset
    b = spark.createDataFrame([(7, int(x), i) for i, x in enumerate(beats)], "track_id long, us long, n int")
    o = spark.createDataFrame([(7, int(x)) for x in onsets], "track_id long, us long")
    b.count(), o.count()
    began = time.time()
    got = {r.n: (r.onset_us, r.deviation_us) for r in joins.nearest_onset(b, o).collect()}
    assert time.time() - began < 20
    at = np.searchsorted(onsets, beats, "right")
    before, after = onsets[np.maximum(at - 1, 0)], onsets[np.minimum(at, len(onsets) - 1)]
    want = np.where(at == 0, after, np.where((at == len(onsets)) | (beats - before <= after - beats), before, after))
    assert got == {i: (int(w), int(w - x)) for i, (w, x) in enumerate(zip(want, beats, strict=True))}


def test_nearest_onset_odd_rows(spark):
    b = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, None, "b"), (2, 9, None), (None, 9, "c"), (3, -10**9, "d")], "track_id long, us long, _point string")
    o = spark.createDataFrame([(1, 3, 0), (1, 7, 0), (1, 7, 0), (1, None, 0), (None, 10, 0), (3, 10**9, 0), (4, 1, 0)], "track_id long, us long, _row int")
    got = sorted(map(tuple, joins.nearest_onset(b, o, block_us=4).collect()), key=str)
    assert got == sorted([(1, 5, "a", 3, -2)] * 2 + [(1, None, "b", None, None), (2, 9, None, None, None), (None, 9, "c", 10, 1), (3, -(10**9), "d", 10**9, 2 * 10**9)], key=str)
    assert joins.nearest_onset(b.limit(0), o).count() == 0 and joins.nearest_onset(b, o.limit(0)).where("onset_us IS NOT NULL").count() == 0


def test_interpolation_equals_numpy_in_any_blocks(spark):
    rng = np.random.default_rng(2)
    t, v, x = np.sort(rng.random(500)) * 900 - 100, rng.random(500), np.sort(rng.random(800)) * 1200 - 250
    s = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, v, strict=True)], "track_id long, time double, y double")
    q = spark.createDataFrame([(1, float(a)) for a in x], "track_id long, time double")
    for block in (60.0, 1.5, 1e6):
        got = [r.y for r in windows.interpolate(s, q, ["track_id"], "y", block=block).orderBy("time").collect()]
        assert np.allclose(got, np.interp(x, t, v))


def test_no_frame_reaches_to_the_end(spark, capsys):
    b = spark.createDataFrame([(1, 5)], "track_id long, us long")
    carry.neighbours(b, b, ["track_id"], "us", 10).explain(True)
    assert "UNBOUNDED FOLLOWING" not in capsys.readouterr().out.upper()


@pytest.fixture(scope="module")
def values():
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.random(), 1.0, 2.0, float(rnd.randint(-5, 5))])) for _ in range(5000)]
    return rows + [("lone", 4.0), ("two", 1.0), ("two", 2.0), ("void", None), ("a", None), ("big", 1e300), ("big", -1e300)]


def test_quantiles_equal_numpy(spark, values):
    at = (0.0, 0.25, 0.5, 0.9, 1.0)
    long = spark.createDataFrame(values, "metric string, value double").repartition(7)
    got = {r.metric: r.q for r in selection.quantiles(long, ["metric"], at).collect()}
    groups = {}
    for m, v in values:
        if v is not None:
            groups.setdefault(m, []).append(v)
    assert set(got) == set(groups)
    for m, v in groups.items():
        assert np.allclose(got[m], np.quantile(v, at)), m
    assert selection.quantiles(long.limit(0), ["metric"], at).count() == 0


def test_metrics_keep_groups_without_values(spark, values, capsys):
    long = spark.createDataFrame(values, "metric string, value double")
    found = aggregates.compare_metrics(long)
    got = {r.metric: r for r in found.collect()}
    assert got["void"].median is None and got["void"].n == 0 and got["two"].median == 1.5 and set(got) == {m for m, _ in values}
    assert {r.metric: r.median for r in aggregates.distribution_moments(long).collect()} == {m: r.median for m, r in got.items()}
    found.explain(True)
    assert "percentile" not in capsys.readouterr().out


@pytest.mark.parametrize("most", [200_000, 0])
def test_scaling_by_broadcast_and_by_salt(spark, values, monkeypatch, capsys, most):
    monkeypatch.setattr(selection, "BROADCAST_ROWS", most)
    long = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "n long, metric string, value double")
    for op, centre, spread in ((similarity.standardise, np.mean, np.std), (similarity.robust_scale, np.median, lambda v: np.quantile(v, 0.75) - np.quantile(v, 0.25))):
        df = op(long)
        df.explain()
        assert ("_salt" in capsys.readouterr().out) == (most == 0)
        got = {r.n: r.scaled for r in df.collect()}
        assert len(got) == len(values)
        for m in {m for m, _ in values}:
            v = [x for k, x in values if k == m and x is not None]
            with np.errstate(over="ignore"):
                s = spread(v) if v else 1
            for i, (k, x) in enumerate(values):
                if k == m and np.isfinite(s):
                    assert got[i] is None if x is None else np.isclose(got[i], (x - centre(v)) / (s or 1))


def clustered(n, groups, spread, seed=4, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (max(n // 25, 1), d))
    v = centres[rng.integers(0, len(centres), n)] + rng.normal(0, spread, (n, d))
    v[: n // 50] = 0.0
    v[n // 50 : n // 25] = v[n // 25]  # copies
    return [(i, f"g{i % groups}" if i % 97 else None, [float(y) for y in x]) for i, x in enumerate(v)]


@pytest.mark.parametrize(("threshold", "euclid"), [(0.9, False), (0.3, False), (0.0, False), (-1.0, False), (0.5, True), (2.5, True), (0.0, True)])
def test_similar_pairs_equal_all_pairs(spark, monkeypatch, threshold, euclid):
    from cadenza.operators import metric_cells

    monkeypatch.setattr(metric_cells, "DEALT", 60)
    rows = clustered(400, 3, 0.2)
    df = spark.createDataFrame(rows, "id long, g string, embedding array<double>")
    got = {(r[0], r.a, r.b): r[3] for r in joins.similar_pairs(df, "g", threshold=threshold, block=16, euclid=euclid).collect()}
    want = {}
    for i, (a, g, x) in enumerate(rows):
        for b, h, y in rows[i + 1 :]:
            if g == h and g is not None:
                x_, y_ = np.array(x), np.array(y)
                n = np.linalg.norm(x_) * np.linalg.norm(y_)
                s = np.linalg.norm(x_ - y_) if euclid else (x_ @ y_ / n if n else 0.0)
                want[g, a, b] = s
    for k, s in want.items():
        near = s - threshold if not euclid else threshold - s
        if abs(near) > 1e-6:  # what lies on the edge may fall on either side by rounding
            assert (k in got) == (near > 0), (k, s)
        if k in got:
            assert abs(got[k] - s) < 1e-6
    assert set(got) <= set(want) and len(got) == joins.similar_pairs(df, "g", threshold=threshold, block=16, euclid=euclid).count()


def test_copies_in_cells_stay_few_on_clustered_vectors(spark, capsys):
    """Ten times the rows give fewer than 10**1.5 times as many rows in cells."""
    from cadenza.operators.metric_cells import placed, unit

    sent = []
    for n in (1000, 10_000):
        df = spark.createDataFrame([(i, "g", x) for i, _, x in clustered(n, 1, 0.02)], "id long, g string, v array<double>").withColumn("v", unit("v")).where("v IS NOT NULL")
        cells = placed(df, np.sqrt(2 - 2 * 0.99), 64)
        sent.append(cells.count())
        assert cells.where("home").count() == df.count() and cells.dropDuplicates(["cell", "id"]).count() == sent[-1]
    with capsys.disabled():
        print(" copies a row:", sent[0] / 1000, sent[1] / 10_000)
    assert sent[1] < 10**1.5 * sent[0]


def plain_nearest(queries, rows, k):
    out = []
    for q, x in queries:
        scored = []
        for i, y in rows:
            n = np.linalg.norm(x) * np.linalg.norm(y)
            if i != q:
                scored.append((-round(float(np.dot(x, y) / n), 9) if n else 0.0, i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def close(got, want):
    got, want = sorted(got, key=lambda r: (r[0], r[3])), sorted(want, key=lambda r: (r[0], r[3]))
    return len(got) == len(want) and all(a[0] == b[0] and a[3] == b[3] and abs(a[2] - b[2]) < 1e-8 and (a[1] == b[1] or abs(a[2] - b[2]) < 2e-9) for a, b in zip(got, want, strict=True))


def test_index_is_exact_saved_updated_and_skips_cells(spark, tmp_path, capsys):
    from cadenza.operators import topk, vector_index

    rows = [(i, x) for i, _, x in clustered(3000, 1, 0.1)]
    df = spark.createDataFrame(rows, "ref_id long, embedding array<double>")
    queries = df.where("ref_id % 100 = 0").withColumnRenamed("ref_id", "query_id")
    asked = [r for r in rows if r[0] % 100 == 0]
    index = vector_index.build(df, "ref_id", per_cell=32)
    index.save(str(tmp_path))
    index = vector_index.load(spark, str(tmp_path))
    assert close(map(tuple, topk.search_many(queries, df, 5, index=index).collect()), plain_nearest(asked, rows, 5))
    got = vector_index.nearest(index, queries, 5, keep_n=True).agg(F.sum("n")).first()[0]
    share = got / (sum(any(x) for _, x in asked) * 3000)
    with capsys.disabled():
        print(f" share of rows scored {share:.3f}")
    assert share < 0.2
    # rows replaced, added and removed
    new = {7: [1.0] + [0.0] * 7, 5000: [0.0, 2.0] + [0.0] * 6}
    changed = index.upserted(spark.createDataFrame(list(new.items()), "id long, embedding array<double>")).removed(spark.createDataFrame([(i,) for i in range(100, 200)], "id long"))
    now = [(i, new.get(i, x)) for i, x in [*rows, (5000, None)] if not 100 <= i < 200]
    refs = spark.createDataFrame(now, "ref_id long, embedding array<double>")
    assert close(map(tuple, topk.search_many(queries, refs, 3, index=changed).collect()), plain_nearest(asked, now, 3))


def test_threshold_search_equals_plain(spark):
    from cadenza.operators import topk, vector_index

    rows = [(i, "s", x) for i, _, x in clustered(600, 1, 0.3)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    queries = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    for t in (0.7, 0.05, 0.0, -0.5):
        got = {(r.query_id, r.vec_id): r.score for r in topk.segments_for_texts(queries, df, t).collect()}
        want = {}
        for q, _, x in rows[::50]:
            for i, _, y in rows:
                n = np.linalg.norm(x) * np.linalg.norm(y)
                s = round(float(np.dot(x, y) / n), 9) if n else 0.0
                if s > t:
                    want[q, i] = s
        assert {k for k in set(got) ^ set(want) if abs({**got, **want}[k] - t) > 2e-9} == set()
        assert all(abs(s - want.get(k, s)) < 1e-8 for k, s in got.items())
    empty = vector_index.build(df.limit(0), "vec_id")
    assert vector_index.nearest(empty, queries, 3).count() == 0 and vector_index.within(empty, queries, 0.5).count() == 0


def ward_by_matrix(x, k):
    """Ward on a full matrix of distances, the least entry merged each time."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1) / 2
    d[np.arange(n), np.arange(n)] = np.inf
    size, label = np.ones(n), np.arange(n)
    for _ in range(n - k):
        i, j = sorted(divmod(int(d.argmin()), n))
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return label


@pytest.mark.parametrize(("n", "k"), [(1500, 500), (1500, 3), (40, 13), (3, 2), (1, 2)])
def test_ward_by_chains_equals_ward_by_matrix(n, k):
    rng = np.random.default_rng(n + k)
    x = rng.normal(0, 1, (n, 4)) + rng.integers(0, 3, (n, 1))
    assert similarity.ward(x, k).tolist() == ward_by_matrix(x, min(k, n)).tolist()


def test_segments_of_long_and_of_clumped_tracks(spark):
    """A track of more than a thousand segments gets Ward as a short one does; a clumped one keeps its density groups."""
    rng = np.random.default_rng(9)
    long, short = rng.normal(0, 1, (1200, 3)), rng.normal(0, 1, (30, 3))
    clumps = np.repeat([[0, 0, 0], [9, 9, 9], [0, 9, 0]], 10, axis=0) + rng.normal(0, 0.01, (30, 3))
    rows = [(i, t, [float(y) for y in v]) for i, (t, v) in enumerate((t, v) for t, x in (("long", long), ("short", short), ("clumps", clumps)) for v in x)]
    got = {r.id: r.cluster for r in similarity.cluster_segments(spark.createDataFrame(rows, "id long, track string, embedding array<double>"), "track", "id").collect()}
    at = 0
    for x, k in ((long, 400), (short, 10)):
        scaled = (x - x.mean(0)) / x.std(0)
        assert [got[at + i] for i in range(len(x))] == [at + j for j in ward_by_matrix(scaled, k).tolist()]
        at += len(x)
    assert [got[at + i] for i in range(30)] == [at] * 10 + [at + 10] * 10 + [at + 20] * 10


def test_similarity_stats_equal_all_pairs(spark):
    rows = [*clustered(500, 3, 0.3), (9000, "two", [1.0] + [0.0] * 7), (9001, "two", [0.0, 1.0] + [0.0] * 6), (9002, "one", [1.0] * 8), (9003, "void", [0.0] * 8), (9004, "void", [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, g string, embedding array<double>")
    got = {r.g: r for r in similarity.similarity_stats(df, "g", block=16).collect()}
    assert set(got) == {"g0", "g1", "g2", "two", "void"}
    for g, r in got.items():
        x = np.array([v for _, h, v in rows if h == g])
        n = np.linalg.norm(x, axis=1, keepdims=True)
        u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        s = (u @ u.T)[np.triu_indices(len(u), 1)]
        assert np.isclose(r["mean"], 2 * s.sum() / len(u) ** 2) and np.isclose(r["max"], s.max())
        assert (r.min_nonzero is None) if not (s != 0).any() else np.isclose(r.min_nonzero, s[s != 0].min())


HARD = [
    {"a": 1, "s": 'quote " and \\" }, {"a": 2} [', "n": [{"a": 5}, {"a": [1, 2]}]},
    {"a": 2, "s": "\\\\", "n": []},
    {"a": 3, "s": "\\" * 7 + '"', "n": [{"a": 1}] * 30},
    {"a": 4, "s": "é漢🙂 " * 40, "n": None},
    {"a": 5, "s": "x" * 3000 + "{[", "n": [{}]},
    {"a": 6, "s": "", "n": []},
]


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_json_arrays_in_ranges(spark, tmp_path, size):
    import json

    from cadenza.sources import json_arrays

    rnd = random.Random(size)
    want = []
    for name, ascii_ in (("one", True), ("two", False), ("none", True)):
        records = [] if name == "none" else [{**rnd.choice(HARD), "i": i} for i in range(25)]
        want += records
        (tmp_path / f"{name}.json").write_text(json.dumps(records, ensure_ascii=ascii_, indent=rnd.choice([None, 1])))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "mixed.json").write_text('[1, "a{", [{"i": 7}], {"i": 99, "s": "last"}, {"i": 100, "s": "cut')
    schema = spark.createDataFrame([], "i long, a long, s string").schema
    got = sorted((r.i, r.a, r.s) for r in json_arrays.read_array(spark, str(tmp_path / "*.json"), schema, size).collect() if r.i != 99)
    assert got == sorted((r["i"], r["a"], r["s"]) for r in want)


def test_a_large_json_array_is_read_by_many_tasks(spark, tmp_path):
    import json

    from cadenza.sources import tables

    rows = [{"event_id": i, "type": "kick}{", "us": i * 1000} for i in range(150_000)]
    (tmp_path / "hits.json").write_text(json.dumps(rows))
    schema = spark.createDataFrame([], "event_id long, type string, us long").schema
    from cadenza.sources import json_arrays

    df = json_arrays.read_array(spark, str(tmp_path / "hits.json"), schema, 1 << 20)
    assert df.agg(F.count("*"), F.sum("us")).first()[:] == (150_000, sum(r["us"] for r in rows))
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert tables.read_hits_json(spark, str(tmp_path / "hits.json"), schema, array=True).count() == 150_000


def plain_prominences(x, at):
    out = []
    for p in at:
        sides = []
        for side in (x[:p][::-1], x[p + 1 :]):
            low = x[p]
            for v in side:
                if v > x[p]:
                    break
                low = min(low, v)
            sides.append(low)
        out.append(x[p] - max(sides))
    return out


def plain_greedy(x, at, distance):
    kept = []
    for i in sorted(range(len(at)), key=lambda i: (-x[at[i]], i)):
        if all(abs(at[i] - at[k]) >= distance for k in kept):
            kept.append(i)
    return sorted(at[k] for k in kept)


def test_peaks_equal_plain_loops_and_are_linear():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 30, 200):
        for _ in range(30):
            x = rng.integers(0, 6, n).astype(float)
            at = windows.peak_positions(x)
            assert np.allclose(windows.prominences(x, at), plain_prominences(x, at))
            kept = windows.greedy_by_height(x, at, 4)
            assert kept.tolist() == plain_greedy(x, at, 4)
            assert np.allclose(windows.prominences(x, kept), plain_prominences(x, kept))
    for x in (rng.random(1_000_000), np.arange(1_000_000) % 2 + np.linspace(0, 9, 1_000_000)):  # noise, and a rising staircase
        began = time.time()
        at = windows.greedy_by_height(x, windows.peak_positions(x), 20)
        assert len(windows.prominences(x, at)) == len(at) > 10_000
        assert time.time() - began < 12


def test_peaks_by_blocks_equal_one_pass(spark):
    """Levels, chains of ever higher peaks and higher ground that reach over many blocks; null keys, values that are none."""
    import pandas as pd

    rng = np.random.default_rng(3)
    cases = {
        "noise": rng.integers(0, 6, 400).astype(float),
        "stairs": np.arange(400) % 2 + np.linspace(0, 9, 400),
        "levels": np.repeat(rng.random(12), 40),
        "roof": 3.0 * (np.arange(400) % 3) - np.abs(np.arange(-200, 200)),
        "flat": np.ones(90),
        "two": np.array([1.0, 2.0]),
        None: rng.random(100),
    }
    table = pd.concat([pd.DataFrame({"k": k, "idx": np.arange(len(x)) * 3, "value": x}) for k, x in cases.items()])
    holes = pd.DataFrame({"k": ["noise", "stairs"], "idx": [4, 7], "value": [None, float("nan")]})
    df = spark.createDataFrame(pd.concat([table, holes]), "k string, idx long, value double")
    df = df.withColumn("value", F.when(F.col("idx") == 4, None).otherwise(F.col("value")))
    for distance, height, least in ((3, None, 0.0), (2, 1.0, 0.5)):
        got = windows.non_max_by_priority(df, ["k"], distance, least, height, block=16).collect()
        whole = windows.non_max_by_priority(df, ["k"], distance, least, height, block=None).collect()
        for k, x in cases.items():
            at = windows.peak_positions(x)
            at = windows.greedy_by_height(x, at if height is None else at[x[at] >= height], distance)
            prom = windows.prominences(x, at)
            want = [(3 * i, round(p, 9)) for i, p in zip(at.tolist(), prom.tolist(), strict=True) if p >= least]
            assert sorted((r.idx, round(r.prominence, 9)) for r in got if r.k == k) == want, (k, distance)
            assert sorted((r.idx, round(r.prominence, 9)) for r in whole if r.k == k) == want, (k, distance)
    assert windows.non_max_by_priority(df.limit(0), ["k"], 3, block=16).count() == 0


def test_alike_tracks_equal_all_pairs_and_are_few(spark):
    """2,000 tracks in 200 families: the same pairs as of all, from few candidates."""
    rng = np.random.default_rng(9)
    family = rng.normal(size=(200, 16))
    frames = [(t, (family[t % 200] + 0.2 * rng.normal(size=16)).tolist()) for t in range(2000) for _ in range(3)]
    df = spark.createDataFrame([*frames, (5000, [0.0] * 16), (None, [1.0] * 16)], "track long, embedding array<double>")
    unit = np.array([v for _, v in frames])
    mean = (unit / np.linalg.norm(unit, axis=1)[:, None]).reshape(2000, 3, 16).mean(1)
    all_pairs = mean @ mean.T
    want = {(a, b) for a, b in zip(*np.nonzero(all_pairs >= 0.9), strict=True) if a < b}
    got = {(r.a, r.b): r.similarity for r in similarity.alike_tracks(df, "track", 0.9).collect()}
    assert set(got) == want and len(want) > 2000
    assert all(abs(all_pairs[p] - s) < 1e-9 for p, s in got.items())
    assert similarity.alike_tracks(df.limit(0), "track", 0.9).count() == 0
    few = df.where("track < 40")
    every = {(r.a, r.b): r.similarity for r in similarity.mean_pair_cosine(few, "track").collect()}
    assert len(every) == 40 * 39 // 2 and all(abs(all_pairs[p] - s) < 1e-9 for p, s in every.items())
    with pytest.raises(ValueError):
        similarity.alike_tracks(df, "track", 0.0)


def test_dtw_equals_the_full_matrix_and_skips_templates(spark):
    from cadenza.operators import rhythm

    rng = np.random.default_rng(6)

    def full(a, b):
        cost, steps = np.full((len(a) + 1, len(b) + 1), np.inf), np.zeros((len(a) + 1, len(b) + 1))
        cost[0, 0] = 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                near = [(i - 1, j - 1), (i - 1, j), (i, j - 1)]
                k = int(np.argmin([cost[p] for p in near]))
                cost[i, j], steps[i, j] = cost[near[k]] + abs(a[i - 1] - b[j - 1]), steps[near[k]] + 1
        return cost[-1, -1] / steps[-1, -1]

    for n, m in ((1, 1), (1, 5), (7, 3), (20, 20), (33, 18)):
        a, b = rng.normal(0, 1, n), rng.normal(0.5, 1, m)
        want = full(a, b)
        assert np.isclose(rhythm.dtw_mean(a, b), want) and rhythm.dtw_bound(a, b) <= want + 1e-12
        assert np.isclose(rhythm.dtw_mean(a, b, want * 1.0001), want) and rhythm.dtw_mean(a, b, want * 0.2) in (np.inf, rhythm.dtw_mean(a, b))
    templates = {f"t{k}": (rng.normal(k * 2, 1, 25)).tolist() for k in range(12)}
    series = [rng.normal(k % 12 * 2, 1, 30).tolist() for k in range(60)] + [[], None]
    df = spark.createDataFrame(list(enumerate(series)), "segment_id long, samples array<double>")
    got = {r.segment_id: r for r in rhythm.dtw_align(df, templates, counts=True).collect()}
    for i, x in enumerate(series[:60]):
        score, name = max((1 / (1 + full(np.array(x), np.array(t))), k) for k, t in templates.items())
        assert got[i].template == name and np.isclose(got[i].score, score)
    assert got[60].score == got[61].score == 0
    assert sum(r.tried for r in got.values()) < 0.6 * 60 * 12  # the others were skipped by their bounds alone


def test_harmonics_equal_all_pairs(spark):
    from cadenza.operators import entropy

    rnd = random.Random(8)
    modes = [(t, i, rnd.choice([110.0, 220.5, 331.0, rnd.uniform(20, 4000), rnd.uniform(20, 200)]), rnd.uniform(0.5, 2)) for t in range(3) for i in range(40)] + [(9, 0, 0.0, 1.0), (9, 1, -5.0, 1.0)]
    df = spark.createDataFrame(modes, "track_id long, mode long, frequency double, amplitude double")
    for tol, least in ((0.02, 0.1), (0.15, 0.6)):
        want = {}
        for t, i, fi, ai in modes:
            for u, j, fj, aj in modes:
                if t == u and fi > 0 and fj > 0 and ((fi, i) < (fj, j)):
                    top = max(a for v, _, _, a in modes if v == t)
                    k = next((k for k in range(1, 17) if abs(fj / fi - k) / k < tol), None)
                    if k and (ai * aj) ** 0.5 / top >= least:
                        want[t, i, j] = k
        pairs = joins.harmonic_pairs(df, tol, least)
        assert {(r.track_id, r.i, r.j): r.k for r in pairs.collect()} == want
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for t, i, j in want:
        a, b = find((t, i)), find((t, j))
        parent[max(a, b)] = min(a, b)
    sizes = {}
    for x in parent:
        sizes[find(x)] = sizes.get(find(x), 0) + 1
    assert {(r.track_id, r.cluster): r.size for r in entropy.harmonic_clusters(pairs, df).collect()} == sizes


def plain_patterns(x, template, threshold):
    t = np.asarray(template, float)
    t, n, out, i = (t - t.mean()) / (t.std() + 1e-12), len(t), [], 0
    while i + n <= len(x):
        w = x[i : i + n]
        s = ((w - w.mean()) / (w.std() + 1e-12)) @ t / n
        if s > threshold:
            out.append((i, s))
            i += n
        else:
            i += 1
    return out


@pytest.mark.parametrize("block", [3, 10, 65_536])
def test_pattern_windows_equal_the_plain_loop(spark, block):
    from cadenza.operators import rhythm

    rng = np.random.default_rng(block)
    template = [1, 5, 2, 1, 0, 4]
    tracks = {1: rng.random(300), 2: np.tile(template, 12) + rng.normal(0, 0.3, 72), 3: rng.random(4), 4: np.ones(20), 5: np.repeat([[1.0, 5, 2, 1, 0, 4, 2]], 9, 0).ravel()}
    rows = [(k, 3 * i + 1, float(v)) for k, x in tracks.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "track_id long, idx long, env double").repartition(5)
    for threshold in (0.7, 0.2):
        got = {}
        for r in rhythm.pattern_windows(df, template, threshold, block=block).collect():
            got.setdefault(r.track_id, {})[r.start] = r.score
        for k, x in tracks.items():
            want = {3 * i + 1: s for i, s in plain_patterns(x, template, threshold)}
            assert sorted(got.get(k, {})) == sorted(want) and all(np.isclose(got[k][i], s) for i, s in want.items())


def test_folds_by_session_equal_folds_by_track(spark):
    from cadenza.streaming import beats

    rnd = random.Random(12)
    rows = sorted({(t, rnd.randint(0, 4000)) for t in (1, 2) for _ in range(900)})
    peaks = spark.createDataFrame([(t, i, p / 100, rnd.random(), p) for i, (t, p) in enumerate(rows)], "track_id long, event_id long, time double, confidence double, pos long").repartition(4)
    data = [tuple(r) for r in peaks.orderBy("track_id", "pos").collect()]
    close_, wait, active = set(), set(), set()
    for t in (1, 2):
        kept, last, beat = None, None, None
        run = [r for r in data if r[0] == t]
        for n, r in enumerate(run):
            if kept is None or r[2] - kept[2] >= 0.05:
                close_.add(kept[1]) if kept else None
                kept = r
            elif r[3] > kept[3]:
                kept = r
            if last is None or r[4] > last + 7:
                wait.add(r[1])
                last = r[4]
            if r[3] >= 0.4 and (n == 0 or run[n - 1][3] < 0.4) and (beat is None or r[4] - beat >= 9):
                active.add((t, r[4]))
                beat = r[4]
        close_.add(kept[1])
    assert {r.event_id for r in windows.suppress_close(peaks, 0.05).collect()} == close_
    assert {r.event_id for r in windows.wait_between(peaks, "pos", 7).collect()} == wait
    frames = peaks.select("track_id", F.col("pos").alias("us"), F.col("confidence").alias("activation"))
    assert {tuple(r) for r in beats.file_beats(frames, 0.4, 9.0, 1.0).collect()} == active
