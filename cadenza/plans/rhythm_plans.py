"""Queries R1 to R21. Event times are days apart, so intervals count in units of an hour."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rhythm as op
from ..schemas import hits as hits_df
from ..schemas import table
from .aggregates_plans import rounded
from .common import Plans, hits

PLANS = Plans()
add = PLANS.add
TR = ["track_id"]
ORD = ["us", "event_id"]
HOUR = 3.6e9
DT = "dt AS (SELECT *, (us - lag(us) OVER (PARTITION BY track_id ORDER BY us, event_id)) / 3.6e9 AS dt FROM h), dtt AS (SELECT *, (us - lag(us) OVER (PARTITION BY track_id, type ORDER BY us, event_id)) / 3.6e9 AS dt FROM h)"


def _stats(src, keys):
    return f"""SELECT {keys}, count(*) AS n, round(avg(dt),6) AS mean, round(quantile_cont(dt,0.5),6) AS median, round(stddev_pop(dt),6) AS std FROM {src} WHERE dt > 0.05 AND dt < 24 GROUP BY {keys}"""


@add("r1_timing_stats", hits(f", {DT} {_stats('dt', 'track_id')}"))
def r1(spark, d):
    return rounded(op.timing_stats(hits_df(spark, d), TR, 0.05, 24.0, HOUR).drop("tempo", "consistency"))


@add("r1_timing_stats_by_type", hits(f", {DT} {_stats('dtt', 'track_id, type')}"))
def r1b(spark, d):
    return rounded(op.timing_stats(hits_df(spark, d), ["track_id", "type"], 0.05, 24.0, HOUR).drop("tempo", "consistency"))


@add("r2_tempo_estimate", hits(f", {DT} SELECT track_id, round(coalesce(60/nullif(quantile_cont(CASE WHEN dt<24 THEN dt END,0.5),0),0),6) AS tempo FROM dt GROUP BY 1"))
def r2(spark, d):
    return rounded(op.tempo_estimate(hits_df(spark, d), TR, 24.0, unit=HOUR))


@add("r2_tempo_folded", hits(f""", {DT}, t AS (SELECT track_id, coalesce(60/nullif(quantile_cont(CASE WHEN dt<24 THEN dt END,0.5),0),0) AS t FROM dt GROUP BY 1)
SELECT track_id, round(CASE WHEN t<=0 THEN 0 WHEN t<60 THEN t*pow(2.0,ceil(log2(60/t))) WHEN t>200 THEN t*pow(2.0,-ceil(log2(t/200))) ELSE t END,6) AS tempo FROM t"""))
def r2b(spark, d):
    return rounded(op.tempo_estimate(hits_df(spark, d), TR, 24.0, True, HOUR))


_FR = "fr AS (SELECT track_id, CAST(floor(time/3600) AS BIGINT) AS frame, sum(velocity) AS env FROM h GROUP BY 1, 2), bt AS (SELECT DISTINCT track_id, CAST(floor(time/3600) AS BIGINT) AS frame FROM h WHERE type='purchase')"


def _env(spark, d):
    return hits_df(spark, d).groupBy("track_id", F.floor(F.col("time") / 3600).alias("frame")).agg(F.sum("velocity").alias("env"))


def _beat_frames(spark, d):
    return hits_df(spark, d).where("type='purchase'").select("track_id", F.floor(F.col("time") / 3600).alias("frame")).distinct()


@add("r3_bpm_confidence", hits(f""", {_FR}, g AS (SELECT track_id, frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS g FROM bt), s AS (SELECT track_id, 1-stddev_pop(g)/avg(g) AS st FROM g GROUP BY 1),
b AS (SELECT track_id, avg(env) AS b FROM bt JOIN fr USING (track_id, frame) GROUP BY 1) SELECT track_id, round(any_value(b)/avg(env),6) AS confidence, round(any_value(st),6) AS stability FROM fr JOIN b USING (track_id) JOIN s USING (track_id) GROUP BY 1"""))
def r3(spark, d):
    return rounded(op.bpm_confidence(_beat_frames(spark, d), _env(spark, d)))


@add("r4_timing_stability", hits(f", {DT}, s AS (SELECT track_id, type, 1/(1+stddev_pop(dt)/avg(dt)) AS s FROM dtt WHERE dt IS NOT NULL GROUP BY 1, 2) SELECT track_id, round(avg(s),6) AS stability FROM s GROUP BY 1"))
def r4(spark, d):
    return rounded(op.timing_stability(hits_df(spark, d), HOUR))


@add("r5_hit_density", hits("SELECT track_id, round(count(*)/max(time),9) AS density FROM h GROUP BY 1"))
def r5(spark, d):
    return rounded(op.hit_density(hits_df(spark, d), TR), 9)


GRID = "gr AS (SELECT track_id, type, CAST(least(floor((time-86400*floor(time/86400))/86400*32),31) AS INTEGER) AS cell, arg_max(velocity, us) AS velocity FROM h GROUP BY 1, 2, 3)"


def grid(spark, d):
    return op.pattern_grid(hits_df(spark, d), 86400.0)


@add("r6_pattern_grid", hits(f", {GRID} SELECT track_id, type, cell, velocity FROM gr"))
def r6(spark, d):
    return grid(spark, d)


@add("r6_dense_grid", hits(f", {GRID}, k AS (SELECT DISTINCT track_id, type FROM gr), f AS (SELECT k.*, unnest(range(0,32)) AS cell FROM k) SELECT track_id, type, string_agg(printf('%.2f', coalesce(velocity,0)), ',' ORDER BY f.cell) AS grid FROM f LEFT JOIN gr USING (track_id, type, cell) GROUP BY 1, 2"))
def r6b(spark, d):
    g = op.dense_grid(grid(spark, d))
    return g.select("track_id", "type", F.array_join(F.transform("grid", lambda v: F.format_string("%.2f", v)), ",").alias("grid"))


@add("r7_pattern_length")
def r7(spark, d):
    return rounded(op.track_pattern_length(op.pattern_length(hits_df(spark, d), unit=HOUR)))


@add("r8_pattern_complexity")
def r8(spark, d):
    return rounded(op.pattern_complexity(op.dense_grid(grid(spark, d))))


@add("r9_pattern_position", hits("SELECT event_id, round((time-86400*floor(time/86400))/86400,6) AS position, round((time-86400*floor(time/86400))/86400*4,6) AS beat_position, CAST(floor(time/86400) AS BIGINT) AS pattern FROM h"))
def r9(spark, d):
    return rounded(op.pattern_position(hits_df(spark, d), 86400.0).select("event_id", "position", "beat_position", "pattern"))


@add("r10_quantise", hits("SELECT event_id, round_even(time*120/60*16, 0)/16 AS position, round(least(1.0,1.25*confidence),6) AS level, CAST(ceil(time*120/60) AS BIGINT) AS beat FROM h"))
def r10(spark, d):
    h = hits_df(spark, d).withColumn("velocity", F.col("confidence"))
    return op.quantise(h).select("event_id", "position", F.round("level", 6).alias("level"), "beat")


_PAR = "pa AS (SELECT *, (row_number() OVER (PARTITION BY track_id ORDER BY us, event_id)-1)%2 AS odd FROM h)"


@add("r11_swing_strength", hits(f", {_PAR} SELECT track_id, round(least(5.0,avg(CASE WHEN odd=1 THEN velocity END)/avg(CASE WHEN odd=0 THEN velocity END)),6) AS swing FROM pa GROUP BY 1"))
def r11(spark, d):
    return rounded(op.swing_strength(hits_df(spark, d), TR, ORD))


_IV = f"{DT}, iv AS (SELECT track_id, us, dt, (row_number() OVER (PARTITION BY track_id ORDER BY us)-1)%2 AS odd, lag(dt) OVER (PARTITION BY track_id ORDER BY us) AS p FROM dt WHERE dt IS NOT NULL)"


@add("r11_swing_intervals", hits(f", {_IV} SELECT track_id, round(avg(CASE WHEN odd=1 THEN dt END)/avg(CASE WHEN odd=0 THEN dt END),6) AS swing FROM iv GROUP BY 1"))
def r11b(spark, d):
    return rounded(op.swing_intervals(hits_df(spark, d), TR, ORD))


@add("r11_swing_pairs", hits(f", {_IV} SELECT track_id, round(avg(dt/p),4) AS swing FROM iv WHERE odd=1 GROUP BY 1"))
def r11c(spark, d):
    return rounded(op.swing_pairs(hits_df(spark, d), TR, ORD), 4)


@add("r12_syncopation", hits("SELECT track_id, round(coalesce(avg(CASE WHEN type<>'purchase' THEN velocity END)/nullif(avg(CASE WHEN type='purchase' THEN velocity END),0),0),6) AS syncopation FROM h GROUP BY 1"))
def r12(spark, d):
    return rounded(op.syncopation(hits_df(spark, d), TR, F.col("type") == "purchase"))


@add("r12_weighted_syncopation", hits(f", {GRID}, w AS (SELECT track_id, cell, velocity*CASE type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.8 WHEN 'view' THEN 0.5 ELSE 0 END AS w FROM gr) SELECT track_id, round(sum(CASE WHEN cell%2=1 THEN w ELSE 0 END)/(sum(CASE WHEN cell%2=0 THEN w ELSE 0 END)+1e-8),5) AS syncopation FROM w GROUP BY 1 HAVING sum(CASE WHEN cell%2=0 THEN w ELSE 0 END) > 0"))
def r12b(spark, d):
    g = grid(spark, d)
    ok = g.where("cell % 2 = 0 AND type IN ('purchase','click','view') AND velocity > 0").select("track_id").distinct()
    return rounded(op.weighted_syncopation(g, {"purchase": 1.0, "click": 0.8, "view": 0.5}).join(ok, "track_id", "left_semi"), 5)


# of hits of a cell at one time the last event, as the operator's grid has it
_LAST_GRID = GRID.replace("arg_max(velocity, us)", "arg_max(velocity, struct_pack(u := us, e := event_id))")


@add("r13_ghost_cells", hits(f", {_LAST_GRID}, m AS (SELECT *, avg(velocity) OVER (PARTITION BY track_id, type) AS m FROM gr) SELECT track_id, type, cell, velocity FROM m WHERE velocity>0 AND round(0.5*m-velocity,9)>0"))
def r13(spark, d):
    return op.ghost_cells(grid(spark, d), ["track_id", "type"])


@add("r14_groove_density", hits(""", p AS (SELECT *, ntile(4) OVER (PARTITION BY track_id ORDER BY us, event_id) AS part FROM h), m AS (SELECT *, avg(velocity) OVER (PARTITION BY track_id, part) AS m FROM p), s AS (SELECT track_id, part, avg(CASE WHEN round(velocity-m,9)>0 THEN 1.0 ELSE 0.0 END) AS s FROM m GROUP BY 1, 2)
SELECT track_id, round(avg(s),6) AS density FROM s GROUP BY 1"""))
def r14(spark, d):
    return rounded(op.groove_density(hits_df(spark, d), TR, ORD, 4))


@add("r15_microtiming", hits(""", b AS (SELECT track_id, time AS a, lead(time) OVER (PARTITION BY track_id ORDER BY time) AS z FROM h WHERE type='purchase'), j AS (SELECT b.track_id, a, z, h.time, velocity FROM b JOIN h ON h.track_id=b.track_id AND h.time>=a AND h.time<z WHERE z IS NOT NULL),
t AS (SELECT track_id, a, z, arg_max(time, struct_pack(v := velocity, t := -time)) AS t FROM j GROUP BY 1, 2, 3) SELECT track_id, round(a,6) AS start_time, round((t-a-(z-a)/2)/(z-a),6) AS deviation FROM t"""))
def r15(spark, d):
    h = hits_df(spark, d)
    w = Window.partitionBy("track_id").orderBy("time")
    b = h.where("type='purchase'").select("track_id", F.col("time").alias("start_time"), F.lead("time").over(w).alias("end_time")).where("end_time IS NOT NULL")
    return rounded(op.microtiming(h.select("track_id", "time", "velocity"), b, 86400.0))


@add("r16_histogram_complexity")
def r16(spark, d):
    return rounded(op.histogram_complexity(hits_df(spark, d), TR, "type", "velocity"))


@add("r17_pulse_features")
def r17(spark, d):
    return rounded(op.pulse_features(_env(spark, d).withColumnRenamed("frame", "idx"), TR))


@add("r17_subdivision_scores", hits(f""", {_FR}, n AS (SELECT track_id, frame, lead(frame) OVER (PARTITION BY track_id ORDER BY frame) AS nx FROM bt), dv AS (SELECT track_id, frame, nx, unnest([1,2,3,4,6,8]) AS division FROM n WHERE nx IS NOT NULL), k AS (SELECT *, unnest(range(0,division)) AS k FROM dv),
a AS (SELECT track_id, division, CAST(floor(frame+(nx-frame)*k/division) AS BIGINT) AS frame FROM k) SELECT track_id, CAST(division AS INTEGER) AS division, round(avg(coalesce(env,0)),9) AS score FROM a LEFT JOIN fr USING (track_id, frame) GROUP BY 1, 2"""))
def r17b(spark, d):
    return rounded(op.subdivision_scores(_beat_frames(spark, d), _env(spark, d)), 9)


@add("r18_downbeats")
def r18(spark, d):
    b = hits_df(spark, d).where("type='purchase'").select("track_id", F.col("event_id").alias("idx"), F.col("velocity").alias("value"), "confidence")
    return op.downbeats(b)


@add("r19_pattern_windows")
def r19(spark, d):
    return rounded(op.pattern_windows(_env(spark, d).withColumnRenamed("frame", "idx"), [1, 5, 2, 1]))


@add("r20_dtw_align")
def r20(spark, d):
    t = {"flat": [0.0] * 32, "rise": [k / 32 for k in range(32)], "saw": [k % 8 / 8 for k in range(32)]}
    return rounded(op.dtw_align(table(spark, d, "embeddings").select(F.col("vec_id").alias("segment_id"), F.col("embedding").alias("samples")), t))


@add("r21_stretch_factor_match", """WITH p AS (SELECT p_partkey, p_retailprice/8 AS t FROM part), f AS (SELECT p_partkey, t, unnest([0.5,0.75,1.0,1.25,1.5,2.0]) AS f FROM p), r AS (SELECT *, abs(t/168-f) AS d, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(t/168-f), f) AS rn FROM f)
SELECT p_partkey, CAST(f AS DOUBLE) AS factor, round(1-d,6) AS score FROM r WHERE rn=1""")
def r21(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 8).alias("tempo"))
    return rounded(op.stretch_factor_match(p).select("p_partkey", "factor", "score"))


@add("r21_classify_variation", "SELECT p_partkey, CASE WHEN p_size/50.0>0.85 THEN 'vip' WHEN (p_partkey%10)/10.0>0.7 AND (p_partkey%7)/7.0>0.8 THEN 'dubplate' ELSE 'original' END AS variation FROM part")
def r21b(spark, d):
    v = op.classify_variation(F.col("p_size") / 50.0, (F.col("p_partkey") % 10) / 10.0, (F.col("p_partkey") % 7) / 7.0)
    return table(spark, d, "part").select("p_partkey", v.alias("variation"))
