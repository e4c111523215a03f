"""Operators whose memory, groups or jobs grew with the input."""

import os
import time
import tracemalloc
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cadenza.operators import aggregates, entropy, folds, joins, metric_cells, rhythm, signal, similarity, windows
from cadenza.session import written


def test_mean_pair_distance_by_tiles(spark):
    """Tracks of several tiles, with equal frames, nearly equal ones and frames far from the origin."""
    rng = np.random.default_rng(5)
    tracks = {1: rng.normal(size=(23, 4)), 2: rng.normal(size=(9, 4)) * 100, 3: rng.normal(size=(1, 4))}
    tracks[2][:3] = tracks[1][:3]
    tracks[3][0] = tracks[1][5] + 1e-9
    frames = spark.createDataFrame([(t, x.tolist()) for t, v in tracks.items() for x in v], "label int, embedding array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a int, b int")
    got = {(r.a, r.b): r.similarity for r in similarity.mean_pair_distance(pairs, frames, "label", block=3, tile=4).collect()}
    want = {(a, b): 1 - np.sqrt(((tracks[a][:, None] - tracks[b][None]) ** 2).sum(-1)).mean() for a, b in got}
    assert len(got) == 3 and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_distances_in_bounded_memory():
    """No array of rows by rows by dimensions: 4,000 frames meet 4,000 in less than 60 MB."""
    u = np.random.default_rng(6).normal(size=(4000, 64))
    tracemalloc.start()
    total = similarity._distance_sum(u, u, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.sqrt(((u[:50, None] - u[None]) ** 2).sum(-1)).sum()
    assert peak < 60e6 and abs(similarity._distance_sum(u[:50], u, 7) - want) < 1e-6 * want and total > 0


def test_components_broadcast_nothing_that_grows(spark):
    """Sides that grow with the edges are merged, however small they look packed: broadcast, they filled the driver."""
    modes = spark.createDataFrame([(t, m, 50.0 * m, 1.0) for t in range(3) for m in (1, 2, 4, 7)], "track_id long, mode long, frequency double, amplitude double")
    out = entropy.harmonic_clusters(joins.harmonic_pairs(modes, 0.005, 0.3), modes)
    assert out.count() == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_many_short_series_fold_in_one_task(spark):
    """20,000 sessions of a few peaks, null track included: a group of its own for each took a minute and more."""
    rng = np.random.default_rng(7)
    n = 60_000
    rows = sorted((int(t), float(x), int(i), float(c)) for i, (t, x, c) in enumerate(zip(rng.integers(0, 50, n), rng.integers(0, 20_000, n) / 4, rng.random(n), strict=True)))
    frame = spark.createDataFrame([(None if t == 0 else t, x, i, c) for t, x, i, c in rows], "track_id long, time double, event_id long, confidence double").repartition(4)
    frame.count()
    began = time.time()
    got = {r.event_id for r in windows.suppress_close(frame, 0.3).collect()}
    assert time.time() - began < 30
    kept: list[tuple] = []
    for r in rows:
        if not kept or kept[-1][0] != r[0] or r[1] - kept[-1][1] >= 0.3:
            kept.append(r)
        elif r[3] > kept[-1][3]:
            kept[-1] = r
    assert got == {r[2] for r in kept}


def test_whole_series_in_any_batches():
    rng = np.random.default_rng(8)
    key = np.sort(rng.integers(0, 30, 400))
    table = pa.table({"a": pa.array([None if k < 5 else int(k) for k in key], pa.int64()), "b": ["x" if k < 2 else None for k in key], "n": np.arange(400)})
    for size in (1, 7, 50, 400):
        pieces = list(folds.whole_series(iter(table.to_batches(max_chunksize=size)), ["a", "b"]))
        assert pa.concat_tables([t for t, _ in pieces]).equals(table)
        begins = np.concatenate([t["n"].to_numpy()[b] for t, b in pieces]).tolist()
        assert begins == [i for i in range(400) if i == 0 or (max(key[i], 4), key[i] < 2) != (max(key[i - 1], 4), key[i - 1] < 2)]
        assert all(len(b) for _, b in pieces) and list(folds.whole_series(iter([]), ["a"])) == []


def test_limits_met_exactly_whatever_the_order_of_summation(spark):
    """A19, F19, R13, R14: values that lie on a limit in decimals do so in any order of their rows."""
    frame = lambda values, column: spark.createDataFrame(
        [(t, "x", i, v) for t, p in enumerate(list(permutations(values))[:120]) for i, v in enumerate(p)], f"track_id long, label string, idx int, {column} double"
    ).coalesce(1)
    scores = frame((0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8), "score")
    assert aggregates.average_predictions(scores, 0.45, 3).count() == 120
    assert rhythm.ghost_cells(frame((0.15, 0.2, 0.3, 0.35, 0.5), "velocity"), ["track_id"]).count() == 0
    dense = rhythm.groove_density(frame((0.1, 0.2, 0.3), "velocity"), ["track_id"], ["idx"], 1).select("density").distinct().collect()
    assert [round(r.density, 9) for r in dense] == [round(1 / 3, 9)]
    up = np.nextafter(0.1, 1)
    bands = [(t, b, e, f, 0.1 * k, 0.3) for t, e, f in ((1, 0.1, 0.2), (2, up, 0.2 + 1e-16), (3, 0.1, 0.20000000000000007)) for k, b in enumerate(("bass", "mid", "high"))]
    cols = "transition_id long, band string, energy_change double, flux double, activity double, prominence double"
    out = signal.classify_transition(spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in bands], cols)).collect()
    assert {(r.type, r.n_active, r.components) for r in out} == {("blend", 0, "")}


def test_harmonic_pairs_equal_all_pairs(spark):
    """Pruned multiples and quiet modes lose no pair, at wide and narrow tolerances."""
    rng = np.random.default_rng(9)
    rows = [(t, m, float(f), float(a)) for t in range(4) for m, (f, a) in enumerate(zip(rng.integers(-2, 60, 25) * 2.5, rng.integers(0, 40, 25) / 2, strict=True))]
    modes = spark.createDataFrame(rows, "track_id long, mode long, frequency double, amplitude double")
    for tol, least, most in ((0.02, 0.1, 16), (0.3, 0.5, 4), (0.005, 0.3, 16)):
        want = {}
        for t, i, f, a in rows:
            loudest = max(r[3] for r in rows if r[0] == t)
            for u, j, g, b in rows:
                if t == u and i != j and f > 0 and g > 0 and (f, i) < (g, j) and a * b >= 0 and np.sqrt(a * b) / loudest >= least:
                    k = [k for k in range(1, most + 1) if abs(g / f - k) / k < tol]
                    if k:
                        want[t, i, j] = k[0]
        got = {(r.track_id, r.i, r.j): r.k for r in joins.harmonic_pairs(modes, tol, least, most).collect()}
        assert got == want


def test_constant_components_have_no_correlation(spark):
    """Values that don't vary: ``corr`` divided by zero, an error in ANSI mode, once a track's component was alike on two days."""
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    values = {"x": [2.0, 2.0, 2.0], "y": [1.0, 3.0, None], "z": [2.0, 6.0, 1.0], "o": [7.0], "n": [0.0, 0.0]}
    c = spark.createDataFrame([(1, k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "track_id long, component string, idx long, value double")
    got = {(r.a, r.b): (r.correlation, r.overlap) for r in signal.component_relations(c).collect()}
    assert got["x", "z"][0] is None and abs(got["x", "z"][1] - 18 / np.sqrt(12 * 41)) < 1e-12
    assert abs(got["y", "z"][0] - 1) < 1e-12 and got["o", "x"] == (None, 1.0) and ("n", "x") not in got
    pairs = spark.createDataFrame([(1, 2.0, 2.0), (1, 2.0, 3.0)], "k int, value_a double, value_b double")
    assert signal.fidelity(pairs, ["k"]).first().correlation is None
    assert similarity.correlation_matrix(pairs, ["value_a", "value_b"]).first().r is None


def test_equal_sums_have_no_correlation_whatever_their_order(spark):
    """a component whose sums are alike in decimals on all days doesn't vary, in any order of their rows; nor do the parts of a
    mean that merge. A value on the limit is not above it, nor is one without a correlation."""
    sums = [(0.1 + 0.2) + 0.3, 0.1 + (0.2 + 0.3)] * 20
    assert sums[0] != sums[1]
    cells = {1: (sums, list(range(1, 41))), 2: ([4.35] * 40, [float(v) for v in range(40)]), 3: ([1.0] * 25, [1e6] + [0.0] * 24)}
    c = [(t, k, i, float(v)) for t, xy in cells.items() for k, vs in zip("xy", xy, strict=True) for i, v in enumerate(vs)]
    c = spark.createDataFrame(c, "track_id long, component string, idx long, value double").repartition(8)
    got = {r.track_id: r for r in signal.component_relations(c).collect()}
    assert {1, 2} == set(got) and got[1].correlation is None and got[2].correlation is None
    edge = spark.createDataFrame([(1, "x", 0, 1.0), (1, "x", 1, 0.0), (1, "y", 0, 0.3), (1, "y", 1, float(np.sqrt(0.91)))], "track_id long, component string, idx long, value double")
    assert signal.component_relations(edge, least=0.3).count() == 0


def test_shuffles_of_a_written_table_are_dropped(spark):
    """The files of a step's shuffles stayed until the driver happened to collect its garbage; the setting is as before then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    top, before = spark.conf.get("spark.local.dir"), spark.conf.get(key, None)
    files = lambda: {f for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    held = files()
    table = written(spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).count(), "dropped")
    for _ in range(50):
        if files() <= held:
            break
        time.sleep(0.1)
    assert files() <= held and len(table.collect()) == 100 and spark.conf.get(key, None) == before


def test_groups_without_pairs_equal_pairs(spark, monkeypatch):
    """C4, C7: neighbours are counted and core points joined in blocks; the pairs of neighbours were rows. Chains, copies, border points
    near two groups, noise, groups of one and of none."""
    written_rows = []

    def counted(df, name):
        table = written(df, name)
        written_rows.append((name, table.count()))
        return table

    monkeypatch.setattr(similarity, "written", counted)
    rng = np.random.default_rng(3)
    crowd = np.concatenate([rng.normal(size=(300, 2)) * 0.02, rng.normal(size=(120, 2)) * 3, np.arange(40)[:, None] * np.array([[0.1, 0.0]]) + 9])
    rows = [(i, g, x.tolist()) for g, part in enumerate((crowd, crowd[:90] * 7, crowd[:1])) for i, x in enumerate(part, 1000 * g)]
    vectors = spark.createDataFrame(rows, "id long, g int, embedding array<double>")
    for least, block in ((3, 4096), (3, 16), (6, 32)):
        written_rows.clear()
        got = {r.id: (r.cluster, r.core) for r in similarity.similar_groups(vectors, "g", "id", 0.11, least, euclid=True, block=block).collect()}
        want = {}
        for g in range(3):
            ids, x = np.array([r[0] for r in rows if r[1] == g]), np.array([r[2] for r in rows if r[1] == g])
            near = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.11) & ~np.eye(len(x), dtype=bool)
            core = near.sum(1) + 1 >= least
            label = np.where(core, ids, -1)
            while True:
                best = np.array([min([label[i], *label[near[i] & core]]) if core[i] else -1 for i in range(len(x))])
                if (best == label).all():
                    break
                label = best
            for i in range(len(x)):
                reach = label[near[i] & core]
                want[int(ids[i])] = (int(label[i] if core[i] else reach.min() if len(reach) else -1), bool(core[i]))
        assert got == want
        # 300 rows that are all near each other are 44,850 pairs
        assert max(n for _, n in written_rows) < (1000 if block == 4096 else 20_000)


def test_copies_grow_slower_than_a_group(spark):
    """C9: where a threshold skips nothing, a vector was shuffled once for each block of its group; cells and blocks now grow with it."""
    x = np.random.default_rng(8).normal(size=(640, 3))
    vectors = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "g int, id long, embedding array<double>")
    cells = joins.near_cells(vectors, "g", "id", "embedding", 100.0, 16, True)
    assert metric_cells.meeting(cells, 16).count() < 20 * len(x)
    assert joins.similar_pairs(vectors, "g", "id", threshold=100.0, block=16, euclid=True).count() == 640 * 639 // 2


def test_query_sets_meet_rows_in_blocks(spark, monkeypatch):
    """Pairs are not rows of a join: a block of rows is shuffled once for a block of queries. Copies tie, null and empty vectors
    have cosine 0, envelopes have several lengths, classes may lack a phase; few pairs at a time, in one set of texts or several."""
    monkeypatch.setattr(joins, "ROWS", 40)
    monkeypatch.setattr(joins, "QUERIES", 7)
    rng = np.random.default_rng(8)
    v = [rng.normal(size=3).tolist() for _ in range(60)]
    v[3], v[4], v[5], v[6] = v[7], v[7], [0.0] * 3, None
    frame = spark.createDataFrame(list(enumerate(v)), "i long, v array<float>")
    texts, audio = frame.where("i % 3 = 0").toDF("text_id", "text"), frame.toDF("audio_id", "audio")
    w = audio.crossJoin(texts).select("audio_id", "text_id", joins.cosine("audio", "text").alias("s")).collect()
    for ranked in (65_536, 5):
        monkeypatch.setattr(joins, "RANKED", ranked)
        out = joins.rank_queries(audio, texts)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.audio_id, r.text_id): (r.similarity, r.rank) for r in out.collect()}
        assert len(got) == len(w)
        for a in range(60):
            order = sorted((-r.s, r.text_id) for r in w if r.audio_id == a)
            assert [got[a, t] for _, t in order] == [(-s, k) for k, (s, _) in enumerate(order, 1)]
    envs = {i: rng.normal(size=n).tolist() for i, n in enumerate([5, 9, 9, 1, 0, 5, 30, 9])} | {8: [0.0] * 5, 9: [-1.0]}
    out = similarity.onset_correlation(spark.createDataFrame(list(envs.items()), "track_id long, env array<double>"), "track_id % 2 = 0")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.a, r.b): r.similarity for r in out.collect()}
    assert set(got) == {(a, b) for a in envs for b in envs if a % 2 == 0 and a != b}
    arrays = [np.array(envs[i]) for i in range(len(envs))]
    monkeypatch.setattr(similarity, "LAGS", 60)  # long envelopes one by one
    single = similarity._greatest_correlations(arrays, arrays)
    for (a, b), s in got.items():
        x, y = arrays[a], arrays[b]
        top = np.abs(x).max(initial=0) * np.abs(y).max(initial=0)
        want = np.correlate(x, y, "full").max() / top if top else 0
        assert abs(s - want) < 1e-12 and abs(single[a, b] - want) < 1e-12
    p = {1: {0: 0.3, 1: 200.0}, 2: {1: 5.0, 2: 1.0}, 3: {0: None, 1: 2.0}, 4: {2: 0.0}, 5: {0: None}, 6: {}}
    rows = [(t, m, x) for t, c in p.items() for m, x in c.items()]
    out = similarity.interference_visibility(spark.createDataFrame(rows, "track_id long, mode_index long, phase double"), "track_id < 4")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.a, r.b): r.visibility for r in out.collect()}
    assert set(got) == {(a, b) for a in (1, 2, 3) for b in p if a != b and set(p[a]) & set(p[b])}
    for (a, b), s in got.items():
        d = [p[a][m] - p[b][m] for m in set(p[a]) & set(p[b]) if None not in (p[a][m], p[b][m])]
        assert s is None if not d else abs(s - abs(np.exp(1j * np.array(d)).mean())) < 1e-9


def test_vectors_that_nothing_separates_are_shuffled_seldom(spark, monkeypatch):
    """Random vectors, no pair of which a threshold rules out by cells: each was shuffled about n / 256 times, and its copies were
    made in Python. Pairs come a few at a time."""
    rng = np.random.default_rng(9)
    n, sent, real = 2500, [], joins.meeting
    v = rng.normal(size=(n, 8))
    df = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "id long, g int, embedding array<double>")
    monkeypatch.setattr(joins, "meeting", lambda cells, block: sent.append(real(cells, block)) or sent[-1])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert joins.similar_pairs(df, "g", threshold=0.5).count() == (np.triu(unit @ unit.T, 1) >= 0.5).sum() and sent[0].count() <= 2 * n
    monkeypatch.setattr(joins, "PAIRS", 1000)
    assert joins.similar_pairs(df, "g", threshold=0.5, block=600).count() == (np.triu(unit @ unit.T, 1) >= 0.5).sum()
    far = np.sqrt(np.maximum(((v[:, None, :2] - v[None, :, :2]) ** 2).sum(-1), 0))
    flat = df.selectExpr("id", "g", "slice(embedding, 1, 2) AS embedding")
    assert joins.similar_pairs(flat, "g", threshold=0.3, block=600, euclid=True).count() == (np.triu(far <= 0.3, 1) & np.triu(np.ones((n, n), bool), 1)).sum()


def test_ward_skips_groups_that_are_gone():
    """Far from the origin, with copies and ties, as by all distances; 4,000 rows took several times as long by differences."""
    rng = np.random.default_rng(10)
    far = np.concatenate([rng.normal(size=(40, 3)) + 1e7, np.repeat(rng.normal(size=(5, 3)), 4, 0), np.round(rng.normal(size=(30, 3)))])
    got, centres, sizes = np.arange(len(far)), far.copy(), np.ones(len(far))
    left = list(range(len(far)))
    while len(left) > 6:
        added = {(i, j): sizes[i] * sizes[j] / (sizes[i] + sizes[j]) * ((centres[i] - centres[j]) ** 2).sum() for i in left for j in left if i < j}
        i, j = min(added, key=lambda k: (added[k], k))
        centres[i] = (sizes[i] * centres[i] + sizes[j] * centres[j]) / (sizes[i] + sizes[j])
        sizes[i] += sizes[j]
        left.remove(j)
        got[got == j] = i
    assert similarity.ward(far, 6).tolist() == got.tolist()
    began = time.time()
    similarity.ward(rng.normal(size=(4000, 64)), 1333)
    assert time.time() - began < 5  # 2 s; by differences 7


def test_documents_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """S3: a document a row, a file a document. One task wrote them through Spark's committer, 13 ms each; 3,000 took 40 s."""
    from cadenza.plans import registry
    from cadenza.sources import json_arrays, tables

    spark.range(3000).selectExpr("id AS s_suppkey", "'Supplier#' || id AS s_name", "id / 7 AS s_acctbal").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    began = time.time()
    got = registry.QUERIES["s3_read_results"](spark, str(tmp_path)).collect()
    assert time.time() - began < 20
    assert sorted(tuple(r) for r in got) == [(i, f"Supplier#{i}", i / 7) for i in range(3000)]
    monkeypatch.setattr(tables, "DOCUMENTS", 7)
    odd = [None, "", 'quote " \\', "two\nlines\r\n", "{[", "\u2028 é漢🙂", " x "]
    rows = [(None if k % 5 == 0 else k % 9, odd[k % 7]) for k in range(50)]  # rows repeat, some are null throughout
    df = spark.createDataFrame(rows, "id long, s string")
    for k, (schemes, folders) in enumerate(((json_arrays.SCHEMES, 8), ((), 1))):
        monkeypatch.setattr(json_arrays, "SCHEMES", schemes)
        path = tmp_path / f"some space {k}"
        found = tables.write_documents(df, str(path))
        (path / "left").mkdir()
        (path / "left" / "of a lost task.json").write_text('{"id": 77}')
        back = tables.read_results(spark, found, df.schema).collect()
        assert len(found) == folders and len({r.file for r in back}) == 50
        assert sorted(((r.id, r.s) for r in back), key=repr) == sorted(rows, key=repr)
    none = tables.write_documents(df.where("id = 77"), str(tmp_path / "none"))
    assert none == [] and tables.read_results(spark, none, df.schema).columns == ["id", "s", "file"]
