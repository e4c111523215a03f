"""Queries C1 to C18."""

from pyspark.sql import functions as F

from ..operators import joins
from ..operators import similarity as op
from ..schemas import hits as hits_df
from ..schemas import states as states_df
from ..schemas import table
from .aggregates_plans import COLS, LONG, long_lineitem, rounded
from .common import Plans, hits, states
from .entropy_plans import SE, entropies
from .joins_plans import cos_sql

PLANS = Plans()
add = PLANS.add
_ST = "sm AS (SELECT track_id, event_id % 8 AS mode_index, phase FROM s)"


@add("c1_interference_visibility", states(f""", {_ST}, p AS (SELECT track_id, mode_index, sum(phase) AS phase FROM sm GROUP BY 1, 2)
SELECT x.track_id AS a, y.track_id AS b, round(sqrt(pow(avg(cos(x.phase-y.phase)),2)+pow(avg(sin(x.phase-y.phase)),2)),6) AS visibility FROM p x JOIN p y ON x.mode_index=y.mode_index AND x.track_id % 100 = 0 AND x.track_id<>y.track_id GROUP BY 1, 2"""))
def c1(spark, d):
    st = states_df(spark, d).withColumn("mode_index", F.col("event_id") % 8)
    return rounded(op.interference_visibility(op.phase_profile(st), "track_id % 100 = 0"))


@add("c2_track_spectrum", states(f", {SE} SELECT track_id, count(*) AS n, round(avg(s_k),6) AS mean_s_k, round(stddev_pop(s_k),6) AS std_s_k, round(avg(s_t),6) AS mean_s_t, round(stddev_pop(s_t),6) AS std_s_t, round(avg(s_e),6) AS mean_s_e, round(stddev_pop(s_e),6) AS std_s_e, round(sum(phase),6) AS phase_sum FROM se GROUP BY 1 HAVING count(*) > 10"))
def c2(spark, d):
    return rounded(op.track_spectrum(entropies(spark, d))).drop("class_phase", "class_n")


@add("c2_track_classes", states(""", t AS (SELECT track_id FROM s GROUP BY 1 HAVING count(*) > 10), e AS (SELECT track_id, event_id % 8 AS class, phase, k // 10 AS depth FROM s JOIN t USING (track_id))
SELECT track_id, 'phase' AS kind, class AS key, round(sum(phase), 6) AS value FROM e GROUP BY 1, 3 UNION ALL SELECT track_id, 'depth', depth, CAST(count(*) AS DOUBLE) FROM e GROUP BY 1, 3"""))
def c2b(spark, d):
    st = states_df(spark, d).select("track_id", "phase", (F.col("event_id") % 8).alias("class"), F.floor(F.col("k") / 10).alias("depth"), *(F.lit(0.0).alias(c) for c in ("s_k", "s_t", "s_e")))
    sp = op.track_spectrum(st, classes="class", depth="depth")
    part = lambda kind, column: sp.select("track_id", F.lit(kind).alias("kind"), F.explode(column).alias("key", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))
    return part("phase", "class_phase").unionByName(part("depth", "depth_n"))


@add("c3_similarity_stats", f"""WITH p AS (SELECT x.label, {cos_sql('x.embedding', 'y.embedding')} AS s FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label, round(2*sum(s)/(any_value(n)*any_value(n)),6) AS mean, round(max(s),6) AS max, round(min(s),6) AS min_nonzero FROM p JOIN n USING (label) GROUP BY label""")
def c3(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(op.similarity_stats(e, "label", "vec_id"))


@add("c4_similar_groups")
def c4(spark, d):
    return op.similar_groups(table(spark, d, "embeddings"), "label", "vec_id", 0.8, 3)


@add("c5_standardise", f"WITH {LONG} SELECT l_orderkey, l_linenumber, metric, value, round((value - avg(value) OVER w)/stddev_pop(value) OVER w, 5) AS scaled FROM m WINDOW w AS (PARTITION BY metric)")
def c5(spark, d):
    return op.standardise(long_lineitem(spark, d, ("l_orderkey", "l_linenumber"))).withColumn("scaled", F.round("scaled", 5)).select("l_orderkey", "l_linenumber", "metric", "value", "scaled")


@add("c5_robust_scale", f"WITH {LONG}, q AS (SELECT metric, quantile_cont(value,0.5) AS md, quantile_cont(value,0.75)-quantile_cont(value,0.25) AS iqr FROM m GROUP BY 1) SELECT l_orderkey, l_linenumber, metric, value, round((value-md)/CASE WHEN iqr=0 THEN 1 ELSE iqr END, 5) AS scaled FROM m JOIN q USING (metric)")
def c5b(spark, d):
    return op.robust_scale(long_lineitem(spark, d, ("l_orderkey", "l_linenumber"))).withColumn("scaled", F.round("scaled", 5)).select("l_orderkey", "l_linenumber", "metric", "value", "scaled")


@add("c6_kmeans")
def c6(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return op.kmeans(p, ["p_size", "p_retailprice"], 4)


@add("c7_cluster_segments")
def c7(spark, d):
    return op.cluster_segments(table(spark, d, "embeddings"), "label", "vec_id")


@add("c8_cluster_confidence", """WITH x AS (SELECT vec_id, label, unnest(range(0,64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2), d AS (SELECT vec_id, label, sqrt(sum(pow(x-m,2))) AS distance FROM x JOIN c USING (label, i) GROUP BY 1, 2)
SELECT vec_id, label, round(distance,6) AS distance, round(1/(1+distance),6) AS confidence FROM d""")
def c8(spark, d):
    return rounded(op.cluster_confidence(table(spark, d, "embeddings"), "label", "vec_id"))


@add("c9_similar_segments", """WITH p AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, 1 - sqrt(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: pow(CAST(p[1] AS DOUBLE)-CAST(p[2] AS DOUBLE),2))))/8 AS s FROM embeddings x JOIN embeddings y ON x.label=y.label AND x.vec_id<y.vec_id)
SELECT label, a, b, round(s,6) AS similarity FROM p WHERE s > 0.8""")
def c9(spark, d):
    return rounded(op.similar_segments(table(spark, d, "embeddings"), "label", "vec_id"))


_PAIRS = [(a, b) for i, a in enumerate(COLS) for b in COLS[i + 1 :]]


@add("c10_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),6) AS r FROM lineitem" for a, b in _PAIRS))
def c10(spark, d):
    return rounded(op.correlation_matrix(table(spark, d, "lineitem"), COLS))


@add("c11_pca_2d")
def c11(spark, d):
    return op.pca_2d(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *COLS), COLS).select("l_orderkey", "l_linenumber", F.round(F.abs("pc1"), 6).alias("pc1"), F.round(F.abs("pc2"), 6).alias("pc2"))


_CASE = "CASE l_linenumber % 5 WHEN 0 THEN 'spectral' WHEN 1 THEN 'rhythmic' WHEN 2 THEN 'timbral' WHEN 3 THEN 'harmonic' ELSE 'temporal' END"
_WCASE = "CASE component WHEN 'spectral' THEN 0.25 WHEN 'rhythmic' THEN 0.25 WHEN 'timbral' THEN 0.2 ELSE 0.15 END"


@add("c12_composite_score", f"""WITH s AS (SELECT l_suppkey AS pair_id, {_CASE} AS component, l_discount*10 AS score, l_suppkey % 3 AS t FROM lineitem), b AS (SELECT pair_id, component, avg(score) AS score, max(t) AS t FROM s GROUP BY 1, 2)
SELECT pair_id, round(sum({_WCASE}*score),6) AS score, round((1-least(1.0,2*stddev_pop(score)))*(1-0.1*max(t)),6) AS confidence FROM b GROUP BY 1""")
def c12(spark, d):
    tr = F.expr("slice(array('a','b','c'), 1, cast(l_suppkey % 3 as int))")
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pair_id"), F.expr(_CASE).alias("component"), (F.col("l_discount") * 10).alias("score"), tr.alias("transforms"))
    return rounded(op.composite_score(s, "transforms"))


@add("c13_mean_pair_cosine", f"WITH p AS (SELECT x.label AS a, y.label AS b, {cos_sql('x.embedding', 'y.embedding')} AS s FROM embeddings x JOIN embeddings y ON x.label < y.label) SELECT a, b, round(avg(s),6) AS similarity FROM p GROUP BY 1, 2")
def c13(spark, d):
    return rounded(op.mean_pair_cosine(table(spark, d, "embeddings"), "label"))


@add("c13_alike_tracks", f"WITH p AS (SELECT x.label AS a, y.label AS b, {cos_sql('x.embedding', 'y.embedding')} AS s FROM embeddings x JOIN embeddings y ON x.label < y.label) SELECT a, b, round(avg(s),6) AS similarity FROM p GROUP BY 1, 2 HAVING avg(s) >= 0.002")
def c13_alike(spark, d):
    out = op.alike_tracks(table(spark, d, "embeddings"), "label", 0.002)
    return rounded(out.select(F.col("a").cast("int"), F.col("b").cast("int"), "similarity"))


@add("c13_tempo_similarity", hits(", t AS (SELECT track_id, avg(velocity) AS tempo FROM h GROUP BY 1) SELECT x.track_id AS a, y.track_id AS b, round(least(x.tempo,y.tempo)/greatest(x.tempo,y.tempo),6) AS similarity FROM t x JOIN t y ON x.track_id % 100 = 0 AND x.track_id <> y.track_id"))
def c13b(spark, d):
    t = hits_df(spark, d).groupBy("track_id").agg(F.avg("velocity").alias("tempo"))
    q = t.where("track_id % 100 = 0").select(F.col("track_id").alias("a"), F.col("tempo").alias("ta"))
    p = joins.query_pairs(q, t.select(F.col("track_id").alias("b"), F.col("tempo").alias("tb"))).where("a <> b")
    return rounded(p.select("a", "b", op.ratio_similarity(F.col("ta"), F.col("tb")).alias("similarity")))


_UN = "un AS (SELECT label, vec_id, unnest(range(0,64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@add("c13_mean_pair_correlation", f"WITH {_UN}, p AS (SELECT a.label AS a, b.label AS b, corr(a.x, b.x) AS r FROM un a JOIN un b ON a.i = b.i AND a.label < b.label GROUP BY a.label, b.label, a.vec_id, b.vec_id) SELECT a, b, round(avg(r),6) AS similarity FROM p GROUP BY 1, 2")
def c13c(spark, d):
    return rounded(op.mean_pair_correlation(table(spark, d, "embeddings"), "label"))


def _label_pairs(e):
    tracks = e.select("label").distinct()
    return joins.query_pairs(tracks.select(F.col("label").alias("a")), tracks.select(F.col("label").alias("b")), 4).where("a < b")


@add("c13_mean_pair_distance", f"WITH {_UN}, p AS (SELECT a.label AS a, b.label AS b, sqrt(sum(pow(a.x-b.x,2))) AS d FROM un a JOIN un b ON a.i = b.i AND b.label > a.label GROUP BY a.label, b.label, a.vec_id, b.vec_id) SELECT a, b, round(1-avg(d),6) AS similarity FROM p GROUP BY 1, 2")
def c13d(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(op.mean_pair_distance(_label_pairs(e), e, "label"))


@add("c13_onset_correlation")
def c13e(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(op.onset_correlation(e.select(F.col("vec_id").alias("track_id"), F.col("embedding").alias("env")), "track_id % 100 = 0"))


@add("c14_transform_flags", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([CASE WHEN l_discount*3>0.15 THEN 'time_stretch' END, CASE WHEN l_quantity/10>2.0 THEN 'pitch_shift' END, CASE WHEN l_tax*5>0.2 THEN 'filter' END], lambda x: x IS NOT NULL), ',') AS flags FROM lineitem")
def c14(spark, d):
    flags = op.transform_flags(F.col("l_discount") * 3, F.col("l_quantity") / 10, F.col("l_tax") * 5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(flags, ",").alias("flags"))


@add("c15_feature_distribution", "WITH r AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT CAST(least(floor((p_retailprice-lo)/((hi-lo)/20)),19) AS INTEGER) AS bin, count(*) AS n FROM part CROSS JOIN r GROUP BY 1")
def c15(spark, d):
    return op.feature_distribution(table(spark, d, "part"), "p_retailprice")


@add("c16_compare_series", hits(""", x AS (SELECT track_id, us, row_number() OVER w AS rn, count(*) OVER (PARTITION BY track_id) AS n, percent_rank() OVER w AS position, (velocity - min(velocity) OVER t)/(max(velocity) OVER t - min(velocity) OVER t) AS scaled FROM h WINDOW w AS (PARTITION BY track_id ORDER BY us), t AS (PARTITION BY track_id)),
k AS (SELECT unnest(range(0,10)) AS k) SELECT DISTINCT track_id, us, round(position,6) AS position, round(scaled,6) AS scaled FROM x JOIN k ON rn - 1 = CASE WHEN n <= 10 THEN k ELSE floor(k*(n-1)/9.0) END"""))
def c16(spark, d):
    return rounded(op.compare_series(hits_df(spark, d), 10))


@add("c17_comparison_rows", """SELECT o_custkey AS file, o_orderpriority AS config, max(CASE WHEN o_orderstatus='F' THEN p END) AS f, max(CASE WHEN o_orderstatus='O' THEN p END) AS o, max(CASE WHEN o_orderstatus='P' THEN p END) AS p
FROM (SELECT o_custkey, o_orderpriority, o_orderstatus, max(o_totalprice) AS p FROM orders GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def c17(spark, d):
    r = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("config"), F.lower("o_orderstatus").alias("metric")).agg(F.max("o_totalprice").alias("value"))
    return op.comparison_rows(r, ["f", "o", "p"])


@add("c18_track_panel", hits(", t AS (SELECT track_id, sum(velocity) AS energy, count(*) AS n FROM h GROUP BY 1) SELECT track_id, round(energy,4) AS energy, n, round(energy/max(energy) OVER (),6) AS energy_rel, round(n/max(n) OVER (),6) AS n_rel FROM t"))
def c18(spark, d):
    t = hits_df(spark, d).groupBy("track_id").agg(F.sum("velocity").alias("energy"), F.count(F.lit(1)).alias("n"))
    return rounded(op.track_panel(t, ["energy", "n"]), keep=("energy",)).withColumn("energy", F.round("energy", 4))
