"""Queries J1 to J14."""

from pyspark.sql import functions as F

from ..operators import joins as op
from ..schemas import hits as hits_df
from ..schemas import table
from .common import Plans, hits

PLANS = Plans()
add = PLANS.add
BEATS = "SELECT track_id, us, event_id FROM h WHERE type='purchase'"
ONSETS = "SELECT track_id, us FROM h WHERE type='click'"
NEAR = f"""b AS ({BEATS}), o AS ({ONSETS}),
n AS (SELECT b.event_id, b.track_id, b.us, o.us AS onset_us, row_number() OVER (PARTITION BY b.event_id ORDER BY abs(o.us - b.us), o.us) AS rn FROM b JOIN o USING (track_id)),
near AS (SELECT event_id, track_id, us, onset_us, onset_us - us AS deviation_us FROM n WHERE rn = 1)"""


def _beats(spark, d):
    return hits_df(spark, d).where("type = 'purchase'").select("track_id", "us", "event_id")


def _onsets(spark, d):
    return hits_df(spark, d).where("type = 'click'").select("track_id", "us")


@add("j1_nearest_onset", hits(f", {NEAR} SELECT * FROM near"))
def j1(spark, d):
    return op.nearest_onset(_beats(spark, d), _onsets(spark, d)).where("onset_us IS NOT NULL").select("event_id", "track_id", "us", "onset_us", "deviation_us")


@add("j2_onset_match", hits(f""", {NEAR} SELECT track_id, count(*) AS n, round(avg(abs(deviation_us)), 1) AS mean_us, max(abs(deviation_us)) AS max_us,
  round(stddev_pop(abs(deviation_us)), 1) AS std_us, round(avg(CASE WHEN abs(deviation_us) < 3600000000 THEN 1.0 ELSE 0.0 END), 6) AS matched FROM near GROUP BY track_id"""))
def j2(spark, d):
    out = op.onset_match(_beats(spark, d), _onsets(spark, d), 3_600_000_000)
    return out.select("track_id", "n", F.round("mean_us", 1).alias("mean_us"), "max_us", F.round("std_us", 1).alias("std_us"), F.round("matched", 6).alias("matched"))


@add("j3_ghost_notes", hits(""", m AS (SELECT * FROM h WHERE confidence >= 0.5), c AS (SELECT * FROM h WHERE confidence < 0.5 AND type IN ('view','error')),
mean AS (SELECT type, avg(velocity) AS mv FROM m GROUP BY type)
SELECT c.event_id, c.track_id, c.type, c.velocity FROM c JOIN mean USING (type)
WHERE c.velocity < 0.7 * mv AND NOT EXISTS (SELECT 1 FROM m WHERE m.track_id = c.track_id AND m.type = c.type AND abs(m.us - c.us) < 7200000000)"""))
def j3(spark, d):
    h = hits_df(spark, d)
    out = op.ghost_notes(h.where("confidence < 0.5"), h.where("confidence >= 0.5"), 7_200_000_000, 0.7, ("view", "error"))
    return out.select("event_id", F.col("track_id"), "type", "velocity")


@add("j4_nearby_count", hits(f""", b AS ({BEATS}), o AS ({ONSETS}) SELECT b.event_id, CAST(count(o.us) AS BIGINT) AS n_near
FROM b LEFT JOIN o ON o.track_id = b.track_id AND abs(o.us - b.us) < 36000000000 GROUP BY b.event_id"""))
def j4(spark, d):
    return op.nearby_count(_beats(spark, d), _onsets(spark, d), 36_000_000_000).select("event_id", F.col("n_near").cast("long").alias("n_near"))


_INTERVALS = "iv AS (SELECT event_id AS segment_id, track_id, time AS start_time, time + 3600 AS end_time FROM h WHERE type = 'signup')"


@add("j5_events_in_intervals", hits(f""", {_INTERVALS} SELECT h.event_id, iv.segment_id FROM h JOIN iv ON h.track_id = iv.track_id AND h.time >= iv.start_time AND h.time < iv.end_time"""))
def j5(spark, d):
    h = hits_df(spark, d)
    iv = h.where("type = 'signup'").select(F.col("event_id").alias("segment_id"), "track_id", F.col("time").alias("start_time"), (F.col("time") + 3600).alias("end_time"))
    return op.events_in_intervals(h.select("event_id", "track_id", "time"), iv, bucket=3600.0).select("event_id", "segment_id")


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def dot_sql(a, b):
    return _DOT.format(a=a, b=b)


def cos_sql(a, b):
    return f"{dot_sql(a, b)} / (sqrt({dot_sql(a, a)}) * sqrt({dot_sql(b, b)}))"


@add("j6_similar_pairs", f"""WITH p AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, {cos_sql('x.embedding', 'y.embedding')} AS s FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id)
SELECT label, a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.3""")
def j6(spark, d):
    out = op.similar_pairs(table(spark, d, "embeddings"), "label", "vec_id", threshold=0.3)
    return out.select("label", "a", "b", F.round("similarity", 6).alias("similarity"))


MODES_SQL = "md AS (SELECT track_id, CAST(floor(velocity / 5) AS BIGINT) AS mode, max(40 + velocity * 3) AS frequency, sum(velocity) AS amplitude FROM h GROUP BY 1, 2)"


def modes(spark, d):
    h = hits_df(spark, d)
    return h.groupBy("track_id", F.floor(F.col("velocity") / 5).alias("mode")).agg(F.max(40 + F.col("velocity") * 3).alias("frequency"), F.sum("velocity").alias("amplitude"))


@add("j7_harmonic_pairs", hits(f""", {MODES_SQL}, mx AS (SELECT *, max(amplitude) OVER (PARTITION BY track_id) AS mxa FROM md),
p AS (SELECT a.track_id, a.mode AS i, b.mode AS j, b.frequency / a.frequency AS r, sqrt(a.amplitude * b.amplitude) / a.mxa AS strength FROM mx a JOIN mx b
  ON a.track_id = b.track_id AND (a.frequency < b.frequency OR (a.frequency = b.frequency AND a.mode < b.mode))),
q AS (SELECT p.*, k FROM p JOIN (SELECT unnest(range(1, 17)) AS k) ON abs(r - k) / k < 0.02)
SELECT track_id, i, j, CAST(min(k) AS INTEGER) AS k, round(min(strength), 6) AS strength FROM q WHERE strength >= 0.1 GROUP BY track_id, i, j"""))
def j7(spark, d):
    return op.harmonic_pairs(modes(spark, d)).withColumn("strength", F.round("strength", 6))


@add("j8_cross_task_list", "SELECT DISTINCT s_nationkey AS file, r_regionkey AS config FROM supplier CROSS JOIN region")
def j8(spark, d):
    return op.cross_task_list(table(spark, d, "supplier").select(F.col("s_nationkey").alias("file")), table(spark, d, "region").select(F.col("r_regionkey").alias("config")))


@add("j9_resume", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j9(spark, d):
    return op.resume(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@add("j10_tracks_with_metadata", "SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j10(spark, d):
    return op.with_metadata(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@add("j11_recommend_samples", f"""WITH s AS (SELECT s_suppkey AS hit_id, 'T' || (s_suppkey % 5) AS type, [CAST(s_suppkey % 7 + 1 AS DOUBLE), CAST(s_nationkey + 1 AS DOUBLE), s_acctbal] AS hf FROM supplier),
l AS (SELECT p_partkey AS sample_id, 'T' || (p_partkey % 5) AS type, [CAST(p_size AS DOUBLE), CAST(p_partkey % 11 + 1 AS DOUBLE), p_retailprice] AS sf FROM part),
c AS (SELECT hit_id, sample_id, round({cos_sql('hf', 'sf')}, 9) AS similarity FROM s JOIN l USING (type)),
r AS (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY similarity DESC, sample_id) AS rank FROM c)
SELECT hit_id, sample_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def j11(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("hit_id"), F.concat(F.lit("T"), F.col("s_suppkey") % 5).alias("type"), F.array((F.col("s_suppkey") % 7 + 1).cast("double"), (F.col("s_nationkey") + 1).cast("double"), "s_acctbal").alias("hit_features"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.concat(F.lit("T"), F.col("p_partkey") % 5).alias("type"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 11 + 1).cast("double"), "p_retailprice").alias("sample_features"))
    return op.recommend(s, p).select("hit_id", "sample_id", F.round("similarity", 6).alias("similarity"), "rank")


@add("j12_consecutive_transitions", hits(""", g AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY us) AS idx, confidence > 0.3 AS tin, confidence < 0.7 AS tout FROM h),
l AS (SELECT *, lead(tin) OVER w AS nin, lead(idx) OVER w AS to_idx FROM g WINDOW w AS (PARTITION BY track_id ORDER BY idx))
SELECT track_id, CAST(idx AS INTEGER) AS from_idx, CAST(to_idx AS INTEGER) AS to_idx FROM l WHERE tout AND nin"""))
def j12(spark, d):
    from pyspark.sql import Window

    g = hits_df(spark, d).select("track_id", F.row_number().over(Window.partitionBy("track_id").orderBy("us")).alias("idx"), (F.col("confidence") > 0.3).alias("transition_in"), (F.col("confidence") < 0.7).alias("transition_out"))
    return op.consecutive_transitions(g)


@add("j13_query_vs_texts", f"""WITH a AS (SELECT vec_id AS audio_id, embedding AS x FROM embeddings), t AS (SELECT vec_id AS text_id, embedding AS y FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT audio_id, text_id, {cos_sql('x', 'y')} AS s FROM a CROSS JOIN t)
SELECT audio_id, text_id, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY audio_id ORDER BY s DESC, text_id) AS INTEGER) AS rank FROM c""")
def j13(spark, d):
    e = table(spark, d, "embeddings")
    t = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("text_id"), F.col("embedding").alias("text"))
    return op.rank_queries(e.select(F.col("vec_id").alias("audio_id"), F.col("embedding").alias("audio")), t).withColumn("similarity", F.round("similarity", 6))


@add("j14_align_series", hits(""", x AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY us) AS pos, velocity AS value_a FROM h WHERE type='click'),
y AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY us) AS pos, velocity AS value_b FROM h WHERE type='view')
SELECT track_id, CAST(pos AS INTEGER) AS pos, value_a, value_b FROM x JOIN y USING (track_id, pos)"""))
def j14(spark, d):
    h = hits_df(spark, d).withColumn("value", F.col("velocity"))
    return op.align_series(h.where("type = 'click'"), h.where("type = 'view'"), "track_id", ["us"])
