"""Queries E1 to E29."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import entropy as op
from ..operators import joins, windows
from ..schemas import hits as hits_df
from ..schemas import states as states_df
from ..schemas import table
from .aggregates_plans import rounded
from .common import Plans, hits, states
from .joins_plans import MODES_SQL, modes

PLANS = Plans()
add = PLANS.add
TR = ["track_id"]
ORD = ["us", "event_id"]
LABELS = """r AS (SELECT track_id, min(velocity) AS lo, max(velocity) AS hi FROM h GROUP BY 1),
lb AS (SELECT h.*, CASE WHEN hi > lo THEN CAST(least(31, greatest(0, floor((velocity-lo)/(hi-lo)*32))) AS INTEGER) ELSE 0 END AS label FROM h JOIN r USING (track_id))"""


def labels(spark, d):
    return op.amplitude_labels(hits_df(spark, d), TR, "velocity")


@add("e1_amplitude_labels", hits(f", {LABELS} SELECT event_id, label FROM lb"))
def e1(spark, d):
    return labels(spark, d).select("event_id", "label")


@add("e1_distinct_states", hits(f", {LABELS} SELECT track_id, count(DISTINCT label) AS states FROM lb GROUP BY 1"))
def e1b(spark, d):
    return op.distinct_states(labels(spark, d), TR)


HIST = """r AS (SELECT type, min(velocity) AS lo, max(velocity) AS hi, count(*) AS total FROM h GROUP BY 1),
b AS (SELECT h.type, CAST(least(floor((velocity-lo)/((hi-lo)/50)), 49) AS INTEGER) AS bin, any_value(total) AS total, any_value((hi-lo)/50) AS width, count(*) AS n FROM h JOIN r USING (type) GROUP BY 1, 2)"""


@add("e2_histogram_entropy", hits(f", {HIST} SELECT type, round(-sum(n/total/width * log2(n/total/width)), 6) AS entropy FROM b GROUP BY type"))
def e2(spark, d):
    return rounded(op.histogram_entropy(hits_df(spark, d), ["type"], "velocity"))


@add("e2_histogram_entropy_probability", hits(f", {HIST} SELECT type, round(-sum(n/total * log2(n/total)), 6) AS entropy FROM b GROUP BY type"))
def e2b(spark, d):
    return rounded(op.histogram_entropy(hits_df(spark, d), ["type"], "velocity", probability=True))


@add("e3_shannon_entropy", hits(", c AS (SELECT track_id, type, count(*) AS n FROM h GROUP BY 1, 2), p AS (SELECT track_id, n / sum(n) OVER (PARTITION BY track_id) AS p FROM c) SELECT track_id, round(-sum(p*ln(p)), 6) AS entropy FROM p GROUP BY 1"))
def e3(spark, d):
    return rounded(op.shannon_entropy(hits_df(spark, d), TR, "type"))


@add("e3_occupation", hits(", c AS (SELECT track_id, type, count(*) AS n FROM h GROUP BY 1, 2) SELECT track_id, type, n, round(n / sum(n) OVER (PARTITION BY track_id), 6) AS share FROM c"))
def e3b(spark, d):
    return rounded(op.occupation(hits_df(spark, d), TR, "type"))


@add("e4_mutual_information", hits(""", c AS (SELECT track_id, type AS a, floor(confidence*4) AS b, count(*) AS n FROM h GROUP BY 1, 2, 3),
m AS (SELECT *, sum(n) OVER (PARTITION BY track_id, a) AS na, sum(n) OVER (PARTITION BY track_id, b) AS nb, sum(n) OVER (PARTITION BY track_id) AS t FROM c)
SELECT track_id, round(sum(n/t*ln(n*t/(na*nb))), 6) AS mi FROM m GROUP BY 1"""))
def e4(spark, d):
    h = hits_df(spark, d).withColumn("q", F.floor(F.col("confidence") * 4))
    return rounded(op.mutual_information(h, TR, "type", "q"))


@add("e5_label_commutation", hits(f", {LABELS} SELECT track_id, round(abs(corr(label, confidence)), 6) AS r FROM lb GROUP BY 1"))
def e5(spark, d):
    return rounded(op.label_commutation(labels(spark, d), TR, "label", "confidence"))


TM = """t AS (SELECT track_id, type AS from_state, lead(type) OVER (PARTITION BY track_id ORDER BY us, event_id) AS to_state FROM h),
tm AS (SELECT track_id, from_state, to_state, count(*) AS n FROM t WHERE to_state IS NOT NULL GROUP BY 1, 2, 3), tp AS (SELECT *, n / sum(n) OVER (PARTITION BY track_id, from_state) AS p FROM tm)"""


@add("e6_transition_matrix", hits(f", {TM} SELECT track_id, from_state, to_state, n, round(p, 6) AS p FROM tp"))
def e6(spark, d):
    return rounded(op.transition_matrix(hits_df(spark, d), TR, ORD, "type"))


@add("e7_entropy_rate", hits(f""", {TM}, c AS (SELECT track_id, type AS from_state, count(*) AS n FROM h GROUP BY 1, 2), pi AS (SELECT track_id, from_state, n / sum(n) OVER (PARTITION BY track_id) AS s FROM c)
SELECT track_id, round(-sum(s*p*ln(p)), 6) AS rate FROM tp JOIN pi USING (track_id, from_state) GROUP BY 1"""))
def e7(spark, d):
    return rounded(op.entropy_rate(hits_df(spark, d), TR, ORD, "type"))


@add("e8_phase_state", states("SELECT event_id, CAST(((CAST(floor(8 * ((k + 0.5) * 2 * pi() / 100 - 3) / (2*pi())) AS BIGINT) % 8) + 8) % 8 AS BIGINT) AS state FROM s"))
def e8(spark, d):
    ph = (F.col("k") + 0.5) * 2 * F.pi() / 100 - 3
    return states_df(spark, d).select("event_id", op.phase_state(ph, 8).cast("long").alias("state"))


@add("e9_instantaneous_phase")
def e9(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("samples"))
    return op.instantaneous_phase(e).select("vec_id", F.posexplode("phase").alias("i", "phase"))


@add("e10_multimode_entropy", hits(f""", {LABELS}, c AS (SELECT track_id, type, count(DISTINCT label) AS n FROM lb GROUP BY 1, 2), e AS (SELECT track_id, sum(ln(n)) AS entropy, count(*) AS modes FROM c GROUP BY 1)
SELECT track_id, round(entropy, 6) AS entropy, modes, round(modes*ln(32), 6) AS theory, round(modes*log2(32), 6) AS capacity, round(44100/2.0*log2(1+entropy), 4) AS physical FROM e"""))
def e10(spark, d):
    m = op.multimode_entropy(labels(spark, d), TR, "type", "label")
    phys = op.physical_capacity(F.lit(44100.0), F.col("entropy"))
    return m.select("track_id", F.round("entropy", 6).alias("entropy"), "modes", F.round(op.theory(F.col("modes"), 32), 6).alias("theory"), F.round(op.capacity(F.col("modes"), 32), 6).alias("capacity"), F.round(phys, 4).alias("physical"))


SE = """se AS (SELECT s.*, ln((abs(phase) + 1e-6)/1e-6) AS s_k, ln(greatest(1/(frequency*(mode_index+1)), 1e-6)/1e-6) AS s_t, ln((0.5*amplitude*amplitude*pow(2*pi()*frequency,2) + 1e-12)/1e-12) AS s_e FROM s),
sd AS (SELECT *, (s_k+s_t+s_e) - lag(s_k+s_t+s_e) OVER (PARTITION BY track_id, mode_index ORDER BY time, event_id) AS delta FROM se)"""


def entropies(spark, d):
    return op.s_entropy(states_df(spark, d).withColumn("n", F.col("mode_index") + 1), "phase")


def deltas(spark, d):
    e = entropies(spark, d).withColumn("s_total", F.col("s_k") + F.col("s_t") + F.col("s_e"))
    return windows.state_delta(e, ["track_id", "mode_index"], ["time", "event_id"])


@add("e11_s_entropy", states(f", {SE} SELECT event_id, round(s_k, 6) AS s_k, round(s_t, 6) AS s_t, round(s_e, 6) AS s_e FROM se"))
def e11(spark, d):
    return rounded(entropies(spark, d).select("event_id", "s_k", "s_t", "s_e"))


@add("e12_partition_coordinate", states(""", a AS (SELECT event_id, 8 AS n, least(mode_index, 7) AS l, (CAST(floor((k + 0.5) / 100 * 8) AS BIGINT)) % 8 AS j FROM s),
b AS (SELECT event_id, n, l, CASE WHEN l = 0 THEN 0 ELSE CAST(least(l, greatest(-l, round_even(j / 8 * (2*l+1), 0) - l)) AS BIGINT) END AS m FROM a)
SELECT event_id, CAST(l AS BIGINT) AS l, CAST(m AS BIGINT) AS m, CAST(2*l*l + 2*(m+l) AS BIGINT) AS flat_index, CAST(2*n*n AS BIGINT) AS degeneracy FROM b"""))
def e12(spark, d):
    st = states_df(spark, d).withColumn("n", F.lit(8)).withColumn("phase", (F.col("k") + 0.5) / 100 * 2 * F.pi())
    return op.partition_coordinate(st, rank="mode_index").select("event_id", "l", "m", "flat_index", "degeneracy")


@add("e13_measure_states")
def e13(spark, d):
    from .signal_plans import chunks

    in_order = chunks(spark, d).withColumn("start_sample", F.col("chunk_idx") * 64)  # each chunk of 64 samples at its own place in the track
    return op.measure_states(in_order, 3, 16).select("track_id", "frame_idx", "rank", "s_total", "delta", "irreversible")


@add("e14_ensemble_stats", states(f""", {SE} SELECT track_id, round(avg(s_k),6) AS mean_s_k, round(stddev_pop(s_k),6) AS std_s_k, round(avg(s_t),6) AS mean_s_t, round(stddev_pop(s_t),6) AS std_s_t, round(avg(s_e),6) AS mean_s_e, round(stddev_pop(s_e),6) AS std_s_e,
  round(CASE WHEN max(time)>min(time) THEN sum(greatest(0, delta))/(max(time)-min(time)) ELSE 0 END, 9) AS rate, round(avg(CASE WHEN delta>0 THEN 1.0 ELSE 0.0 END),6) AS irreversible FROM sd WHERE delta IS NOT NULL GROUP BY 1"""))
def e14(spark, d):
    out = op.ensemble_stats(deltas(spark, d), TR)
    return rounded(out, keep=("rate",)).withColumn("rate", F.round("rate", 9))


@add("e15_second_law_report", states(f""", {SE} SELECT mode_index, count(*) AS n, CAST(sum(CASE WHEN delta>0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, CAST(sum(CASE WHEN delta<0 THEN 1 ELSE 0 END) AS BIGINT) AS negative, CAST(sum(CASE WHEN delta=0 THEN 1 ELSE 0 END) AS BIGINT) AS zero,
  round(avg(delta),6) AS mean_delta, round(avg(CASE WHEN delta>0 THEN 1.0 ELSE 0.0 END),6) AS share_positive, round(sum(greatest(0,delta)),4) AS production FROM sd WHERE delta IS NOT NULL GROUP BY 1"""))
def e15(spark, d):
    out = op.second_law_report(deltas(spark, d), ["mode_index"])
    return rounded(out, keep=("production",)).withColumn("production", F.round("production", 4))


@add("e16_partition_function", """WITH e AS (SELECT l_suppkey, l_quantity AS energy FROM lineitem), m AS (SELECT *, energy - min(energy) OVER (PARTITION BY l_suppkey) AS x, min(energy) OVER (PARTITION BY l_suppkey) AS e0 FROM e),
z AS (SELECT l_suppkey, sum(exp(-0.1*x)) AS z, sum(x*exp(-0.1*x)) AS ex, any_value(e0) AS e0 FROM m GROUP BY 1)
SELECT l_suppkey, round(z,6) AS z, round(ex/z + e0, 6) AS mean_energy, round(ln(z) + 0.1*ex/z, 6) AS entropy, round(e0 - ln(z)/0.1, 6) AS free_energy FROM z""")
def e16(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("energy"))
    return rounded(op.partition_function(li, ["l_suppkey"], beta=0.1))


@add("e17_energy_levels", "WITH l AS (SELECT s_suppkey, s_acctbal, unnest(range(0, 8)) AS j FROM supplier WHERE s_acctbal > 0) SELECT s_suppkey, CAST(j AS INTEGER) AS j, round(j*s_acctbal/8, 6) AS energy, round(sqrt(2*(j*s_acctbal/8)/(2.0*100)), 6) AS amplitude FROM l")
def e17(spark, d):
    lv = op.energy_levels(table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_acctbal"), "s_acctbal", 8)
    return rounded(lv.select("s_suppkey", "j", "energy", op.energy_to_amplitude(F.col("energy"), 2.0, F.lit(10.0)).alias("amplitude")))


@add("e18_harmonic_clusters")
def e18(spark, d):
    m = modes(spark, d)
    return rounded(op.harmonic_clusters(joins.harmonic_pairs(m, 0.005, 0.3), m), 4)


@add("e19_coincidence_matrix", hits(f""", {MODES_SQL}, mx AS (SELECT *, max(amplitude) OVER (PARTITION BY track_id) AS mxa FROM md),
p AS (SELECT a.track_id, a.mode AS i, b.mode AS j, b.frequency / a.frequency AS r, sqrt(a.amplitude * b.amplitude) / a.mxa AS strength FROM mx a JOIN mx b ON a.track_id = b.track_id AND (a.frequency < b.frequency OR (a.frequency = b.frequency AND a.mode < b.mode))),
q AS (SELECT track_id, i, j, min(strength) AS strength FROM p JOIN (SELECT unnest(range(1, 17)) AS k) ON abs(r - k) / k < 0.02 WHERE strength >= 0.1 GROUP BY 1, 2, 3)
SELECT track_id, i, j, round(strength, 6) AS strength FROM q UNION ALL SELECT track_id, j, i, round(strength, 6) FROM q UNION ALL SELECT track_id, mode, mode, 1.0::DOUBLE FROM md"""))
def e19(spark, d):
    m = modes(spark, d)
    return rounded(op.coincidence_matrix(joins.harmonic_pairs(m), m))


@add("e20_phase_locking_value", states(""", p AS (SELECT mode_index, track_id, phase AS a, lead(phase) OVER (PARTITION BY track_id ORDER BY time, event_id) AS b FROM s)
SELECT mode_index, round(sqrt(pow(avg(cos(b - 2*a)), 2) + pow(avg(sin(b - 2*a)), 2)), 6) AS plv FROM p WHERE b IS NOT NULL GROUP BY 1"""))
def e20(spark, d):
    w = Window.partitionBy("track_id").orderBy("time", "event_id")
    p = states_df(spark, d).select("mode_index", F.col("phase").alias("phase_a"), F.lead("phase").over(w).alias("phase_b")).where("phase_b IS NOT NULL")
    return rounded(op.phase_locking(p, ["mode_index"], k=2))


@add("e21_resolution_product", states(f", {SE} SELECT mode_index, round(stddev_pop(s_k)*stddev_pop(s_t), 6) AS product, stddev_pop(s_k)*stddev_pop(s_t) >= {1 / (4 * math.pi)} AS above_uncertainty, stddev_pop(s_k)*stddev_pop(s_t) < {1 / 64} AS below_cell FROM se GROUP BY 1"))
def e21(spark, d):
    return rounded(op.resolution_product(entropies(spark, d), ["mode_index"], 8))


_W8 = "[" + ", ".join(repr(w) for w in op.SCALE_WEIGHTS) + "]"
_MS = f"""ms AS (SELECT l_suppkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'frequency' WHEN 1 THEN 'time' ELSE 'amplitude' END AS domain, (l_orderkey % 8) AS scale, l_discount AS entropy FROM lineitem),
dr AS (SELECT l_suppkey, sum(CASE WHEN domain='frequency' THEN {_W8}[scale+1]*entropy ELSE 0 END) AS s_frequency, sum(CASE WHEN domain='time' THEN {_W8}[scale+1]*entropy ELSE 0 END) AS s_time, sum(CASE WHEN domain='amplitude' THEN {_W8}[scale+1]*entropy ELSE 0 END) AS s_amplitude FROM ms GROUP BY 1)"""


def _scales(spark, d):
    dom = F.when(F.col("l_linenumber") % 3 == 0, "frequency").when(F.col("l_linenumber") % 3 == 1, "time").otherwise("amplitude")
    return table(spark, d, "lineitem").select("l_suppkey", dom.alias("domain"), (F.col("l_orderkey") % 8).cast("int").alias("scale"), F.col("l_discount").alias("entropy"))


@add("e22_multi_scale_entropy", f"WITH {_MS} SELECT l_suppkey, round(s_frequency,4) AS s_frequency, round(s_time,4) AS s_time, round(s_amplitude,4) AS s_amplitude, round(s_frequency+s_time+s_amplitude,4) AS s_total FROM dr")
def e22(spark, d):
    return rounded(op.multi_scale_entropy(_scales(spark, d), ["l_suppkey"]), 4)


_DROP = "dp AS (SELECT p_partkey, p_size/50.0 AS s_frequency, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_partkey/4000.0 END AS s_time, p_retailprice/1000 - 1 AS s_amplitude FROM part)"
_DVAL = f"""{_DROP}, dv AS (SELECT p_partkey, 2.5*s_frequency+1.8*s_amplitude+0.5 AS velocity, CASE WHEN s_amplitude<0 THEN 'nan'::DOUBLE ELSE 0.6*sqrt(greatest(s_amplitude,0))*exp(-2.1*s_time) END AS size,
  CASE WHEN s_time=0 THEN 0 ELSE atan(3.2*s_frequency/s_time) END AS angle, 0.4+0.3*(s_frequency+s_time+s_amplitude) AS tension FROM dp)"""


def droplets(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("s_frequency"), F.when(F.col("p_size") % 5 == 0, 0.0).otherwise(F.col("p_partkey") / 4000.0).alias("s_time"), (F.col("p_retailprice") / 1000 - 1).alias("s_amplitude"))
    return op.droplet_params(p.withColumn("s_total", F.col("s_frequency") + F.col("s_time") + F.col("s_amplitude")))


@add("e23_droplet_params", f"WITH {_DVAL} SELECT p_partkey, round(velocity,6) AS velocity, round(size,6) AS size, round(angle,6) AS angle, round(tension,6) AS tension FROM dv")
def e23(spark, d):
    return rounded(droplets(spark, d).select("p_partkey", "velocity", "size", "angle", "tension"))


@add("e24_droplet_signature", "SELECT p_partkey, substr(md5(printf('%.6f_%.6f_%.6f_%.6f', p_size/4.0, p_partkey/8.0, p_size/2.0, p_partkey*1.0)), 1, 16) AS signature FROM part")
def e24(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 4.0).alias("velocity"), (F.col("p_partkey") / 8.0).alias("size"), (F.col("p_size") / 2.0).alias("angle"), (F.col("p_partkey") * 1.0).cast("double").alias("tension"))
    return op.droplet_signature(p).select("p_partkey", "signature")


@add("e25_fingerprint", """WITH g AS (SELECT s_suppkey, s_suppkey*0.1 AS velocity, s_nationkey*0.2 AS size, s_suppkey*0.05 AS angle, s_nationkey*0.5 AS tension, unnest(range(0,256)) AS p FROM supplier), x AS (SELECT *, p // 16 AS y, p % 16 AS x FROM g)
SELECT s_suppkey, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round((CASE WHEN x=y THEN sin(x/15*2*pi()*velocity)*size ELSE 0 END) + cos(2*(x/15*2*pi())*angle)*tension, 6) AS value FROM x""")
def e25(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 0.1).cast("double").alias("velocity"), (F.col("s_nationkey") * 0.2).cast("double").alias("size"), (F.col("s_suppkey") * 0.05).cast("double").alias("angle"), (F.col("s_nationkey") * 0.5).cast("double").alias("tension"))
    return rounded(op.fingerprint(s, ["s_suppkey"]))


@add("e26_energy_density", hits(", t AS (SELECT *, velocity / sum(velocity) OVER (PARTITION BY track_id) AS p, sum(velocity) OVER (PARTITION BY track_id) AS total FROM h) SELECT track_id, round(any_value(total),4) AS total, round(-sum(p*log2(p+1e-8)),6) AS entropy, round(var_pop(p),9) AS variance, count(*) AS n FROM t GROUP BY 1"))
def e26(spark, d):
    out = op.energy_density(hits_df(spark, d), TR, "velocity")
    return out.select("track_id", F.round("total", 4).alias("total"), F.round("entropy", 6).alias("entropy"), F.round("variance", 9).alias("variance"), "n")


@add("e27_groove_metric", states(f""", {SE}, dd AS (SELECT track_id, s_k, s_t, s_e, s_k - lag(s_k) OVER w AS k, s_t - lag(s_t) OVER w AS t, s_e - lag(s_e) OVER w AS e FROM se WINDOW w AS (PARTITION BY track_id ORDER BY time, event_id)),
q AS (SELECT track_id, k*k/(s_k+1e-9) + t*t/(s_t+1e-9) + e*e/(s_e+1e-9) + sqrt(s_k*s_t)*k*t AS q, sqrt(k*k+t*t+e*e) AS f FROM dd WHERE k IS NOT NULL)
SELECT track_id, round(avg(sqrt(greatest(q,0))),4) AS curved, round(avg(f),6) AS flat, round(exp(-avg(f)/10),6) AS similarity FROM q GROUP BY 1"""))
def e27(spark, d):
    out = op.groove_metric(entropies(spark, d), TR, ["time", "event_id"])
    return rounded(out, keep=("curved",)).withColumn("curved", F.round("curved", 4))


@add("e28_profile_match", hits(""", p AS (SELECT track_id, velocity, row_number() OVER (PARTITION BY track_id ORDER BY us, event_id) - 1 AS i FROM h), s AS (SELECT track_id, unnest(range(0, max(i)+1, 2)) AS start FROM p GROUP BY 1),
e AS (SELECT s.track_id, s.start, avg(abs(velocity - [10.0,20.0,30.0,20.0][i-s.start+1])) AS distance, count(*) AS n FROM s JOIN p ON p.track_id=s.track_id AND i>=start AND i<start+4 GROUP BY 1, 2)
SELECT track_id, CAST(start AS BIGINT) AS start, round(distance,6) AS distance, round(exp(-distance/10),6) AS similarity FROM e WHERE n=4 AND exp(-distance/10) >= 0.2"""))
def e28(spark, d):
    return rounded(op.profile_match(hits_df(spark, d), [10, 20, 30, 20], "track_id", ORD, "velocity", 0.2)).withColumn("start", F.col("start").cast("long"))


@add("e29_drip_from_chunks", hits(""", c AS (SELECT track_id, sum(confidence/1000) AS e, avg(velocity) AS c, avg(confidence) AS z, sum(30.0) AS dur FROM h GROUP BY 1)
SELECT track_id, round(100*c,4) AS s_frequency, round(100*dur::DOUBLE,4) AS s_time, round(-1e6*e,4) AS s_amplitude, round(-8e5*e,4) AS s_total, round(-2e6*e,4) AS velocity, round(CASE WHEN e<0.001 THEN 'nan'::DOUBLE ELSE 1000*e END,4) AS size, round(10*z,4) AS angle, round(-1000*c,4) AS tension FROM c"""))
def e29(spark, d):
    h = hits_df(spark, d).select("track_id", (F.col("confidence") / 1000).alias("rms"), F.col("velocity").alias("centroid"), F.col("confidence").alias("zcr"), F.lit(30.0).alias("duration"))
    return rounded(op.drip_from_chunks(h), 4)
