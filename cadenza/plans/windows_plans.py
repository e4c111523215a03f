"""Queries W1 to W21."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as op
from ..schemas import hits as hits_df
from ..schemas import states as states_df
from ..schemas import table
from .aggregates_plans import LONG, TRANSITIONS, long_lineitem, rounded, transitions
from .common import Plans, hits, states

PLANS = Plans()
add = PLANS.add
TR = ["track_id"]
ORD = ["us", "event_id"]
OVER = "(PARTITION BY track_id ORDER BY us, event_id)"


@add("w1_inter_onset_intervals", hits("SELECT event_id, track_id, type, us - lag(us) OVER (PARTITION BY track_id, type ORDER BY us, event_id) AS d_us FROM h"))
def w1(spark, d):
    return op.intervals(hits_df(spark, d), ["track_id", "type"]).select("event_id", "track_id", "type", "d_us")


@add("w2_moving_mean_std", hits(""", a AS (SELECT *, avg(velocity) OVER (PARTITION BY track_id ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS lm FROM h),
b AS (SELECT *, sqrt(avg(pow(velocity - lm, 2)) OVER (PARTITION BY track_id ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)) AS ls FROM a)
SELECT event_id, round(lm, 6) AS local_mean, round(ls, 5) AS local_std, round(greatest(0.0, velocity - (lm + 2*ls)), 5) AS above FROM b"""))
def w2(spark, d):
    out = op.moving_mean_std(hits_df(spark, d), TR, ORD, "velocity", 8)
    return out.select("event_id", F.round("local_mean", 6).alias("local_mean"), F.round("local_std", 5).alias("local_std"), F.round("above", 5).alias("above"))


_LAGS = " + ".join(f"{c} * {f'lag(velocity, {3 - k}) OVER w' if k < 3 else 'velocity' if k == 3 else f'lead(velocity, {k - 3}) OVER w'}" for k, c in enumerate(op.SAVGOL_7_3))


@add("w3_savgol", hits(f"SELECT event_id, round(coalesce(({_LAGS}) / 21, velocity), 6) AS smooth FROM h WINDOW w AS {OVER}"))
def w3(spark, d):
    return rounded(op.savgol(hits_df(spark, d), TR, ORD, "velocity").select("event_id", "smooth"))


@add("w4_moving_average", hits("SELECT event_id, round(sum(velocity) OVER (PARTITION BY track_id ORDER BY us, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11, 6) AS average FROM h"))
def w4(spark, d):
    return rounded(op.moving_average(hits_df(spark, d), TR, ORD, "velocity").select("event_id", "average"))


@add("w5_local_maxima", hits(f""", a AS (SELECT *, round(velocity / 5) AS v, row_number() OVER w AS pos, CASE WHEN round(velocity/5) = lag(round(velocity/5)) OVER w THEN 0 ELSE 1 END AS nw FROM h WINDOW w AS {OVER}),
b AS (SELECT *, sum(nw) OVER (PARTITION BY track_id ORDER BY pos) AS run FROM a), c AS (SELECT *, min(pos) OVER r AS pa, max(pos) OVER r AS pz FROM b WINDOW r AS (PARTITION BY track_id, run)),
e AS (SELECT * FROM c WHERE pos = (pa + pz) // 2), f AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM e WINDOW w AS (PARTITION BY track_id ORDER BY run))
SELECT event_id, v FROM f WHERE v > p AND v > n AND v >= 4"""))
def w5(spark, d):
    h = hits_df(spark, d).withColumn("v", F.round(F.col("velocity") / 5))
    return op.local_maxima(h, TR, ORD, "v", 4).select("event_id", "v")


@add("w6_positive_flux", hits(f""", a AS (SELECT event_id, track_id, CASE WHEN lag(us) OVER w IS NULL THEN 0.0 ELSE greatest(0.0, velocity - lag(velocity) OVER w) + greatest(0.0, confidence - lag(confidence) OVER w) END AS flux FROM h WINDOW w AS {OVER})
SELECT event_id, round(flux, 6) AS flux, round(CASE WHEN max(flux) OVER t > 0 THEN flux / max(flux) OVER t ELSE 0 END, 6) AS flux_norm FROM a WINDOW t AS (PARTITION BY track_id)"""))
def w6(spark, d):
    f = hits_df(spark, d).withColumn("mag", F.array("velocity", "confidence")).withColumn("frame_idx", F.struct("us", "event_id"))
    return rounded(op.positive_flux(f, TR).select("event_id", "flux", "flux_norm"))


@add("w7_rise_onsets", hits(f""", a AS (SELECT track_id, event_id AS idx, velocity - lag(velocity) OVER (PARTITION BY track_id ORDER BY event_id) AS rise FROM h)
SELECT track_id, idx, round(rise, 6) AS rise, round(idx * 512 / 44100, 6) AS time FROM a WHERE rise > 20"""))
def w7(spark, d):
    h = hits_df(spark, d).select("track_id", F.col("event_id").alias("idx"), F.col("velocity").alias("env"))
    return rounded(op.rise_onsets(h, TR, 20.0).select("track_id", "idx", "rise", "time"))


_WIDE = "tr AS (SELECT event_id, track_id, type, confidence, time AS start_time, time + confidence * 72000 AS end_time FROM h)"
MERGED = f"""{_WIDE}, w AS (SELECT *, max(end_time) OVER (PARTITION BY track_id ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM tr),
i AS (SELECT *, sum(CASE WHEN pm IS NULL OR start_time > pm THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS island FROM w),
mg AS (SELECT track_id, CAST(island AS BIGINT) AS island, min(start_time) AS start_time, max(end_time) AS end_time, max(confidence) AS confidence, CASE WHEN min(type)=max(type) THEN min(type) ELSE 'blend' END AS type,
  array_to_string(list_sort(list(DISTINCT type)), ',') AS components, count(*) AS n FROM i GROUP BY 1, 2)"""


def merged(spark, d):
    h = hits_df(spark, d)
    tr = h.select("event_id", "track_id", "type", "confidence", F.col("time").alias("start_time"), (F.col("time") + F.col("confidence") * 72000).alias("end_time"))
    return op.merge_intervals(tr)


@add("w8_merge_intervals", hits(f", {MERGED} SELECT track_id, island, round(start_time,6) AS start_time, round(end_time,6) AS end_time, confidence, type, components, n FROM mg"))
def w8(spark, d):
    return rounded(merged(spark, d), keep=("confidence",)).withColumn("components", F.array_join("components", ","))


@add("w9_suppress_close")
def w9(spark, d):
    return op.suppress_close(hits_df(spark, d), 3600.0)


@add("w10_non_max_by_priority")
def w10(spark, d):
    h = hits_df(spark, d).select("track_id", F.floor(F.col("time") / 604800).alias("segment"), F.col("event_id").alias("idx"), F.col("velocity").alias("value"))
    return op.non_max_by_priority(h, ["track_id", "segment"], 3, 5.0, block=None)


@add("w11_rolling_max_peaks", hits("""SELECT event_id, velocity FROM (SELECT *, max(velocity) OVER w AS m, avg(velocity) OVER w AS a FROM h WINDOW w AS (PARTITION BY track_id ORDER BY us, event_id ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING))
WHERE velocity = m AND velocity >= a + 0.5"""))
def w11(spark, d):
    return op.rolling_max_peaks(hits_df(spark, d), TR, ORD, "velocity").select("event_id", "velocity")


@add("w11_peak_pick", hits(""", c AS (SELECT track_id, event_id, velocity, pos FROM (SELECT *, row_number() OVER o AS pos, max(velocity) OVER w AS m, avg(velocity) OVER w AS a FROM h
  WINDOW o AS (PARTITION BY track_id ORDER BY us, event_id), w AS (PARTITION BY track_id ORDER BY us, event_id ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)) WHERE velocity = m AND velocity >= a + 0.5),
r AS (SELECT track_id, min(pos) AS pos FROM c GROUP BY 1 UNION ALL SELECT r.track_id, (SELECT min(c.pos) FROM c WHERE c.track_id = r.track_id AND c.pos > r.pos + 20) FROM r WHERE r.pos IS NOT NULL)
SELECT event_id, velocity FROM c JOIN r USING (track_id, pos)""").replace("WITH ", "WITH RECURSIVE ", 1))
def w11b(spark, d):
    h = hits_df(spark, d).select("track_id", "event_id", "us", "velocity", F.row_number().over(Window.partitionBy("track_id").orderBy("us", "event_id")).alias("pos"))
    return op.wait_between(op.rolling_max_peaks(h, TR, ORD, "velocity"), "pos").select("event_id", "velocity")


@add("w12_min_max_normalise", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_extendedprice - min(l_extendedprice) OVER w) / (max(l_extendedprice) OVER w - min(l_extendedprice) OVER w), 6) AS scaled FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def w12(spark, d):
    return rounded(op.min_max(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "scaled"))


@add("w12_max_abs_normalise", hits("SELECT event_id, round(velocity / max(abs(velocity)) OVER (PARTITION BY track_id), 6) AS scaled FROM h"))
def w12b(spark, d):
    return rounded(op.max_abs(hits_df(spark, d), TR, "velocity").select("event_id", "scaled"))


@add("w13_normalised_time", hits(f"SELECT event_id, round(percent_rank() OVER {OVER}, 6) AS position FROM h"))
def w13(spark, d):
    return rounded(op.normalised_time(hits_df(spark, d), TR, ORD).select("event_id", "position"))


@add("w14_outliers_z", f"""WITH {LONG}, s AS (SELECT metric, avg(value) AS mu, stddev_pop(value) AS sd FROM m GROUP BY metric)
SELECT l_orderkey, l_linenumber, metric, value, round((value-mu)/sd, 6) AS z FROM m JOIN s USING (metric) WHERE abs((value-mu)/sd) > 1.8""")
def w14(spark, d):
    out = op.outliers_z(long_lineitem(spark, d, ("l_orderkey", "l_linenumber")), 1.8)
    return out.select("l_orderkey", "l_linenumber", "metric", "value", F.round("z", 6).alias("z"))


@add("w15_state_delta", states(""", t AS (SELECT *, ln(1 + amplitude) + ln(1 + phase) AS st FROM s), u AS (SELECT event_id, st - lag(st) OVER (PARTITION BY track_id, mode_index ORDER BY time, event_id) AS delta FROM t)
SELECT event_id, round(delta, 6) AS delta, delta > 0 AS irreversible FROM u WHERE delta IS NOT NULL"""))
def w15(spark, d):
    s = states_df(spark, d).withColumn("s_total", F.log(1 + F.col("amplitude")) + F.log(1 + F.col("phase")))
    return rounded(op.state_delta(s, ["track_id", "mode_index"], ["time", "event_id"]).select("event_id", "delta", "irreversible"))


@add("w16_unwrap_phase", states(""", a AS (SELECT event_id, track_id, time, phase, k, k - lag(k) OVER w AS dk FROM s WINDOW w AS (PARTITION BY track_id ORDER BY time, event_id)),
b AS (SELECT *, CASE WHEN abs(dk) > 50 THEN -2*pi()*sign(dk) ELSE 0 END AS fix FROM a)
SELECT event_id, round(phase + sum(coalesce(fix, 0)) OVER (PARTITION BY track_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM b"""))
def w16(spark, d):
    return rounded(op.unwrap_phase(states_df(spark, d), TR, ["time", "event_id"]).select("event_id", "unwrapped"))


@add("w17_gradient", hits(f"""SELECT event_id, round(coalesce((lead(velocity) OVER w - lag(velocity) OVER w) / 2, lead(velocity) OVER w - velocity, velocity - lag(velocity) OVER w), 6) AS gradient FROM h WINDOW w AS {OVER}"""))
def w17(spark, d):
    return rounded(op.gradient(hits_df(spark, d), TR, ORD, "velocity").select("event_id", "gradient"))


@add("w18_grid_deviation", hits(f"SELECT event_id, round((row_number() OVER {OVER} - 1) * (60e6 / (4*136.7)), 1) AS grid_us, round(us - (row_number() OVER {OVER} - 1) * (60e6 / (4*136.7)), 1) AS deviation_us FROM h"))
def w18(spark, d):
    return rounded(op.grid_deviation(hits_df(spark, d), 136.7, TR, ORD).select("event_id", "grid_us", "deviation_us"), 1)


@add("w19_repetition_pairs", """WITH a AS (SELECT label, vec_id, embedding AS x, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM embeddings),
b AS (SELECT label, vec_id, unnest(x)::DOUBLE AS x, unnest(y)::DOUBLE AS y FROM a WHERE y IS NOT NULL)
SELECT label, vec_id, round(abs(corr(x, y)), 6) AS r FROM b GROUP BY 1, 2 HAVING abs(corr(x, y)) > 0.05""")
def w19(spark, d):
    return rounded(op.repetition_pairs(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.05))


@add("w20_linear_interpolation", hits(""", c AS (SELECT track_id, us, velocity FROM h WHERE type='click'), t AS (SELECT track_id, us FROM h WHERE type='view'),
p AS (SELECT t.*, (SELECT max(c.us) FROM c WHERE c.track_id=t.track_id AND c.us<=t.us) AS a, (SELECT min(c.us) FROM c WHERE c.track_id=t.track_id AND c.us>=t.us) AS b FROM t)
SELECT p.track_id, p.us, round(CASE WHEN a IS NULL THEN cb.velocity WHEN b IS NULL OR b = a THEN ca.velocity ELSE ca.velocity + (cb.velocity - ca.velocity) * (p.us - a) / (b - a) END, 6) AS velocity
FROM p LEFT JOIN c ca ON ca.track_id=p.track_id AND ca.us=a LEFT JOIN c cb ON cb.track_id=p.track_id AND cb.us=b"""))
def w20(spark, d):
    h = hits_df(spark, d)
    return rounded(op.interpolate(h.where("type='click'"), h.where("type='view'"), TR, "velocity", "us"))


@add("w21_segments_from_transitions", hits(f""", {MERGED}, du AS (SELECT track_id, max(time) + 200000 AS duration FROM h GROUP BY 1),
g AS (SELECT track_id, coalesce(lag(end_time) OVER w, 0) AS a, start_time AS b, lag(start_time) OVER w AS in_start, start_time AS out_start FROM mg WINDOW w AS (PARTITION BY track_id ORDER BY start_time)
  UNION ALL SELECT du.track_id, coalesce(e, 0), duration, l, NULL FROM du LEFT JOIN (SELECT track_id, max(end_time) AS e, max(start_time) AS l FROM mg GROUP BY 1) USING (track_id))
SELECT track_id, round(a,6) AS start_time, round(b,6) AS end_time, round(in_start,6) AS in_start, round(out_start,6) AS out_start FROM g WHERE b - a >= 3600"""))
def w21(spark, d):
    du = hits_df(spark, d).groupBy("track_id").agg((F.max("time") + 200000).alias("duration"))
    return rounded(op.segments_between(merged(spark, d), du, 3600.0))
