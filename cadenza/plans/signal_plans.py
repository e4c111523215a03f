"""Queries F1 to F28. Embedding rows play chunks of 64 samples (their label the track), their absolute values a spectrum."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import signal as op
from ..operators import windows as win
from ..operators.selection import with_aggregate
from ..schemas import hits as hits_df
from ..schemas import states as states_df
from ..schemas import table
from .aggregates_plans import rounded
from .common import Plans, hits, states
from .joins_plans import dot_sql

PLANS = Plans()
add = PLANS.add
BINS = "bn AS (SELECT vec_id, label, unnest(range(0,64)) AS i, abs(CAST(unnest(embedding) AS DOUBLE)) AS m, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def chunks(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").cast("long").alias("track_id"), F.col("vec_id").alias("chunk_idx"), F.lit(0).cast("long").alias("start_sample"), F.lit(8000).alias("sr"), F.col("embedding").alias("samples"))


def spectra(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("mag"))


def bins(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


@add("f1_segment", hits(", t AS (SELECT track_id, count(*)*100 AS n FROM h GROUP BY 1), s AS (SELECT track_id, n, unnest(range(0, n, 500)) AS start FROM t) SELECT track_id, CAST(start/500 AS BIGINT) AS segment, CAST(start AS BIGINT) AS start, CAST(least(start+1000, n) AS BIGINT) AS stop FROM s WHERE least(start+1000, n) - start >= 250"))
def f1(spark, d):
    t = hits_df(spark, d).groupBy("track_id").agg((F.count(F.lit(1)) * 100).alias("n_samples"))
    return op.segment(t, 1000, 500, 250).select("track_id", "segment", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@add("f2_stft")
def f2(spark, d):
    return op.stft(chunks(spark, d), 32, 16).select("track_id", "chunk_idx", "frame_idx", F.transform("mag", lambda m: F.round(m, 6)).alias("mag")).withColumn("mag", F.array_join(F.col("mag").cast("array<string>"), ","))


_CEN = "c AS (SELECT vec_id, sum(m) AS s, sum(m*i/63.0)/(sum(m)+1e-8) AS centroid FROM bn GROUP BY 1)"


@add("f3_centroid_bandwidth", f"WITH {BINS}, {_CEN} SELECT vec_id, round(any_value(centroid),6) AS centroid, round(sqrt(sum(m*pow(i/63.0-centroid,2))/(any_value(s)+1e-8)),6) AS bandwidth FROM bn JOIN c USING (vec_id) GROUP BY vec_id")
def f3(spark, d):
    s = spectra(spark, d).withColumn("centroid", op.centroid(F.col("mag")))
    return rounded(s.select("vec_id", "centroid", op.bandwidth(F.col("mag"), F.col("centroid")).alias("bandwidth")))


@add("f4_flatness", f"WITH {BINS} SELECT vec_id, round(exp(avg(ln(m+1e-8)))/(avg(m)+1e-8),6) AS flatness FROM bn GROUP BY 1")
def f4(spark, d):
    return rounded(spectra(spark, d).select("vec_id", op.flatness(F.col("mag")).alias("flatness")))


@add("f5_rolloff", f"WITH {BINS}, r AS (SELECT vec_id, i, sum(m) OVER (PARTITION BY vec_id ORDER BY i) AS run, sum(m) OVER (PARTITION BY vec_id) AS t FROM bn) SELECT vec_id, min(i)/64.0::DOUBLE AS rolloff FROM r WHERE run >= 0.85*t GROUP BY 1")
def f5(spark, d):
    return spectra(spark, d).select("vec_id", op.rolloff(F.col("mag")).alias("rolloff"))


@add("f6_contrast", f"WITH {BINS} SELECT vec_id, CAST(i // 11 AS INTEGER) AS part, round(ln((max(m)+1e-8)/(min(m)+1e-8)),6) AS contrast FROM bn GROUP BY 1, 2")
def f6(spark, d):
    return rounded(spectra(spark, d).select("vec_id", F.posexplode(op.contrast(F.col("mag"))).alias("part", "contrast")))


@add("f7_timbre")
def f7(spark, d):
    out = op.timbre(chunks(spark, d), 32, 16, 16, 8)
    return out.select("track_id", "chunk_idx", "frame_idx", *[F.round(F.col(c)[0], 6).alias(c) for c in ("log_mel", "mfcc", "chroma")])


@add("f8_rms_zcr", f"WITH {BINS}, z AS (SELECT *, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS px FROM bn) SELECT CAST(label AS BIGINT) AS track_id, vec_id AS chunk_idx, round(sqrt(avg(x*x)),6) AS rms, round(sum(CASE WHEN x*px<0 THEN 1.0 ELSE 0.0 END)/64,6) AS zcr FROM z GROUP BY 1, 2")
def f8(spark, d):
    return rounded(op.chunk_levels(chunks(spark, d)))


@add("f9_rms_envelope", f"WITH {BINS} SELECT vec_id, CAST(i // 16 AS BIGINT) AS frame, round(sqrt(avg(x*x)),6) AS env FROM bn GROUP BY 1, 2")
def f9(spark, d):
    return rounded(op.rms_envelope(bins(spark, d), 16, "vec_id"))


@add("f9_temporal_centroid", f"WITH {BINS}, e AS (SELECT vec_id, i // 16 AS frame, sqrt(avg(x*x)) AS env FROM bn GROUP BY 1, 2) SELECT vec_id, round(sum(frame*env)/sum(env),6) AS centroid FROM e GROUP BY 1")
def f9b(spark, d):
    return rounded(op.temporal_centroid(op.rms_envelope(bins(spark, d), 16, "vec_id"), "vec_id"))


@add("f10_mix_globals", f"WITH {BINS}, e AS (SELECT vec_id, avg(env) AS r FROM (SELECT vec_id, i // 16 AS frame, sqrt(avg(x*x)) AS env FROM bn GROUP BY 1, 2) GROUP BY 1) SELECT vec_id, round(avg(abs(x)),6) AS loudness, round(max(x)-min(x),6) AS dynamic_range, round(max(abs(x))/(any_value(r)+1e-8),6) AS crest FROM bn JOIN e USING (vec_id) GROUP BY 1")
def f10(spark, d):
    b = bins(spark, d)
    return rounded(op.mix_globals(b, op.rms_envelope(b, 16, "vec_id"), "vec_id"))


@add("f11_tempo_from_autocorr")
def f11(spark, d):
    return rounded(op.tempo_from_autocorr(chunks(spark, d), 2000))


@add("f12_stereo", f"WITH {BINS}, p AS (SELECT vec_id, i // 2 AS j, max(CASE WHEN i%2=0 THEN x END) AS l, max(CASE WHEN i%2=1 THEN x END) AS r FROM bn GROUP BY 1, 2) SELECT vec_id, round(sqrt(avg(pow((l-r)/2,2)))/(sqrt(avg(pow((l+r)/2,2)))+1e-8),6) AS width, round((sum(r*r)-sum(l*l))/(sum(r*r)+sum(l*l)+1e-8),6) AS pan, round(corr(l,r),6) AS correlation FROM p GROUP BY 1")
def f12(spark, d):
    b = bins(spark, d).groupBy("vec_id", F.floor(F.col("i") / 2).alias("j")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("x"))).alias("left"), F.max(F.when(F.col("i") % 2 == 1, F.col("x"))).alias("right"))
    return rounded(op.stereo(b, "vec_id"))


_BANDS = [("bass", 0.0, 500.0), ("mid", 500.0, 2000.0), ("high", 2000.0, 4000.0)]
_BT = "bt AS (SELECT * FROM (VALUES ('bass',0.0,500.0),('mid',500.0,2000.0),('high',2000.0,4000.0)) v(band,lo,hi))"


@add("f13_band_energy", f"WITH {BINS}, {_BT}, z AS (SELECT vec_id, i*62.5 AS hz, m FROM bn), t AS (SELECT vec_id, sum(m*m) AS t FROM z GROUP BY 1) SELECT vec_id, band, round(sum(m*m),6) AS energy, round(avg(m),6) AS mean_mag, CAST(arg_max(hz, m) AS DOUBLE) AS peak_hz, round(sum(m*m)/any_value(t),6) AS ratio FROM z JOIN bt ON hz>=lo AND hz<hi JOIN t USING (vec_id) GROUP BY 1, 2")
def f13(spark, d):
    b = bins(spark, d).select("vec_id", (F.col("i") * 62.5).cast("double").alias("hz"), F.abs("x").alias("mag"))
    return rounded(op.band_energy(b, _BANDS, "vec_id"))


@add("f13_dominant_character", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount*5>0.3 THEN 'bass_heavy' WHEN l_tax*6>0.3 THEN 'lead_focused' WHEN l_quantity/100>0.2 THEN 'percussion_driven' ELSE 'balanced' END AS character FROM lineitem")
def f13b(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", op.dominant_character(F.col("l_discount") * 5, F.col("l_tax") * 6, F.col("l_quantity") / 100).alias("character"))


@add("f14_bass_features", f"WITH {BINS}, e AS (SELECT vec_id, label, sum(m*m) AS e FROM bn WHERE i>=2 AND i<10 GROUP BY 1, 2) SELECT label, round(avg(e),6) AS mean_energy, round(var_pop(e),6) AS var_energy FROM e GROUP BY 1")
def f14(spark, d):
    return rounded(op.bass_features(spectra(spark, d), 2, 10, "label"))


_OB = [("kick", 0, 8), ("snare", 8, 24), ("hihat", 24, 64)]


def _frames(spark, d):
    return spectra(spark, d).select("label", F.col("vec_id").alias("frame_idx"), "mag")


@add("f15_multiband_onset_env", f"""WITH {BINS}, l AS (SELECT label, vec_id AS frame_idx, CASE WHEN i<8 THEN 'kick' WHEN i<24 THEN 'snare' ELSE 'hihat' END AS band, sum(m) AS level FROM bn GROUP BY 1, 2, 3)
SELECT label, frame_idx, band, round(greatest(0.0, coalesce(level-lag(level) OVER (PARTITION BY label, band ORDER BY frame_idx), 0)),6) AS env FROM l""")
def f15(spark, d):
    return rounded(op.band_onset_envelope(_frames(spark, d), _OB, "label").drop("level"))


@add("f16_detect_hits")
def f16(spark, d):
    return rounded(op.detect_hits(_frames(spark, d), _OB, 2, key="label"))


@add("f17_attack_decay", f"""WITH {BINS}, t AS (SELECT vec_id, max(m) AS top, arg_max(i, m) AS attack FROM bn GROUP BY 1) SELECT t.vec_id, CAST(attack AS BIGINT) AS attack, CAST(coalesce(min(CASE WHEN i>attack AND m<0.1*top THEN i END), 64) AS BIGINT) AS decay FROM t JOIN bn USING (vec_id) GROUP BY t.vec_id, attack""")
def f17(spark, d):
    a, z = op.attack_decay(F.col("mag"))
    return spectra(spark, d).select("vec_id", a.alias("attack"), z.alias("decay"))


@add("f18_hit_boundaries", hits(", b AS (SELECT event_id, track_id, time, least(coalesce(lead(time) OVER (PARTITION BY track_id ORDER BY time)-time, 36000), 36000) AS duration FROM h) SELECT event_id, round(duration,6) AS duration FROM b WHERE duration >= 3600"))
def f18(spark, d):
    return rounded(op.hit_boundaries(hits_df(spark, d), 3600.0, 36000.0).select("event_id", "duration"))


@add("f19_transition_candidates")
def f19(spark, d):
    b = F.when(F.col("i") < 4, "sub").when(F.col("i") < 10, "bass").when(F.col("i") < 30, "mid").otherwise("high")
    n = bins(spark, d).groupBy(F.col("label").alias("track_id"), F.col("vec_id").alias("idx"), b.alias("band")).agg(F.sum(F.abs("x")).alias("value"))
    return rounded(op.transition_candidates(n, 3, 0.01))


_BN = "CASE l_linenumber % 4 WHEN 0 THEN 'bass' WHEN 1 THEN 'mid' WHEN 2 THEN 'high_mid' ELSE 'high' END"


@add("f19_classify_transition", f"""WITH b AS (SELECT l_suppkey AS transition_id, {_BN} AS band, avg(l_discount)*2.2 AS energy_change, avg(l_tax)*4 AS flux, avg(l_quantity)/100 AS activity, max(l_discount)*4 AS prominence FROM lineitem GROUP BY 1, 2),
g AS (SELECT transition_id, sum(CASE WHEN round(abs(energy_change),9)>0.1 THEN 1 ELSE 0 END) AS n, max(CASE WHEN round(abs(energy_change),9)>0.1 AND band='bass' THEN 1 ELSE 0 END) AS bs, max(CASE WHEN round(abs(energy_change),9)>0.1 AND band LIKE '%high%' THEN 1 ELSE 0 END) AS hg, round(max(flux),9) AS fx,
  string_agg(CASE WHEN round(abs(energy_change),9)>0.1 THEN band END, ',' ORDER BY band) AS comp, avg(abs(energy_change)) AS st, stddev_pop(activity) AS ac, max(prominence) AS pr FROM b GROUP BY 1)
SELECT transition_id, CASE WHEN n<=2 AND bs=1 THEN 'swap' WHEN fx<0.05 THEN 'fade' WHEN fx>0.2 THEN 'cut' WHEN hg=1 THEN 'filter' ELSE 'blend' END AS type, CAST(n AS BIGINT) AS n_active, coalesce(comp,'') AS components, round(least(1,2*pr)*(1-least(1,st))*(1-least(1,2*ac)),6) AS confidence FROM g""")
def f19b(spark, d):
    b = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("transition_id"), F.expr(_BN).alias("band")).agg((F.avg("l_discount") * 2.2).alias("energy_change"), (F.avg("l_tax") * 4).alias("flux"), (F.avg("l_quantity") / 100).alias("activity"), (F.max("l_discount") * 4).alias("prominence"))
    return rounded(op.classify_transition(b))


@add("f20_component_type", """WITH c AS (SELECT p_partkey, p_partkey*4.0 AS c, p_size/50.0 AS a, (p_partkey%10)/10.0 AS p, p_size%7=0 AS r, p_size%5=0 AS f FROM part)
SELECT p_partkey, CASE WHEN c<100 AND a>0.3 THEN 'subbass' WHEN c<500 AND r THEN 'reese' WHEN c<200 AND p>0.7 THEN 'kick' WHEN c BETWEEN 200 AND 2000 AND a<0.3 THEN 'snare' WHEN c>5000 AND p>0.8 THEN 'hihat' WHEN c>2000 AND a<0.2 THEN 'ambi' WHEN f THEN 'fx' ELSE 'synth' END AS type FROM c""")
def f20(spark, d):
    k = op.component_type(F.col("p_partkey") * 4.0, F.col("p_size") / 50.0, (F.col("p_partkey") % 10) / 10.0, F.col("p_size") % 7 == 0, F.col("p_size") % 5 == 0)
    return table(spark, d, "part").select("p_partkey", k.alias("type"))


@add("f21_trim_silence", hits(""", l AS (SELECT *, 20*log10(greatest(velocity,1e-10)/max(greatest(velocity,1e-10)) OVER (PARTITION BY track_id)) > -6 AS loud FROM h), r AS (SELECT *, min(CASE WHEN loud THEN us END) OVER (PARTITION BY track_id) AS a, max(CASE WHEN loud THEN us END) OVER (PARTITION BY track_id) AS z FROM l)
SELECT event_id, track_id FROM r WHERE us BETWEEN a AND z"""))
def f21(spark, d):
    return op.trim_silence(hits_df(spark, d), 6.0, "track_id", "us", "velocity").select("event_id", "track_id")


_PAIR = "pr AS (SELECT a.label, a.vec_id AS pair, unnest(range(0,64)) AS i, CAST(unnest(a.embedding) AS DOUBLE) AS va, CAST(unnest(b.embedding) AS DOUBLE) AS vb FROM embeddings a JOIN (SELECT label, min(vec_id) AS v FROM embeddings GROUP BY 1) m ON a.label=m.label JOIN embeddings b ON b.vec_id=m.v WHERE a.vec_id<>m.v)"


def pairs(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vb"), F.min("vec_id").alias("v"))
    z = with_aggregate(e, first, ["label"]).where("vec_id <> v")
    x = z.select("label", F.col("vec_id").alias("pair"), F.posexplode(F.arrays_zip("embedding", "vb")).alias("i", "p"))
    return x.select("label", "pair", "i", F.col("p.embedding").cast("double").alias("value_a"), F.col("p.vb").cast("double").alias("value_b"))


@add("f22_fidelity", f"WITH {_PAIR} SELECT pair, round(10*log10(avg(va*va)/avg(pow(va-vb,2))),6) AS snr_db, round(abs(corr(va,vb)),6) AS correlation, round(avg(pow(va-vb,2)),6) AS mse, round(max(abs(va-vb)),6) AS max_error, round(sqrt(avg(pow(va-vb,2))/avg(va*va)),6) AS nrmse FROM pr GROUP BY 1")
def f22(spark, d):
    return rounded(op.fidelity(pairs(spark, d), ["pair"]))


@add("f23_sinc_resample")
def f23(spark, d):
    out = op.sinc_resample(chunks(spark, d), 2, 16).select("track_id", "chunk_idx", F.posexplode("resampled").alias("i", "x"))
    return rounded(out)


@add("f24_reconstruct_from_states", states(""", p AS (SELECT track_id, event_id, time, amplitude, sum(2*pi()*frequency*0.001) OVER (PARTITION BY track_id, mode_index ORDER BY time ROWS UNBOUNDED PRECEDING) AS phi FROM s), q AS (SELECT track_id, time, sum(amplitude*cos(phi)) AS x, max(abs(amplitude)) AS a FROM p GROUP BY 1, 2)
SELECT track_id, time, round(greatest(-1.1*max(a) OVER (PARTITION BY track_id), least(1.1*max(a) OVER (PARTITION BY track_id), x)),4) AS x FROM q"""))
def f24(spark, d):
    return op.reconstruct(states_df(spark, d), 0.001).select("track_id", "time", F.round("x", 4).alias("x"))


@add("f25_component_relations", hits(""", c AS (SELECT track_id, type AS component, CAST(floor(time/86400) AS BIGINT) AS idx, round(sum(velocity),9) AS value FROM h GROUP BY 1, 2, 3), p AS (SELECT x.track_id, x.component AS a, y.component AS b, x.value AS va, y.value AS vb, CASE WHEN y.value IS NOT NULL THEN x.value END AS ka, CASE WHEN x.value IS NOT NULL THEN y.value END AS kb
FROM c x JOIN c y ON x.track_id=y.track_id AND x.idx=y.idx AND x.component<y.component), j AS (SELECT track_id, a, b, CASE WHEN min(ka)<max(ka) AND min(kb)<max(kb) THEN corr(ka,kb) END AS cr, sum(va*vb)/nullif(sqrt(sum(va*va)*sum(vb*vb)),0) AS ov, sum(va*va)/nullif(sum(vb*vb),0) AS er FROM p GROUP BY 1, 2, 3)
SELECT track_id, a, b, round(cr,5) AS correlation, round(ov,5) AS overlap, round(er,5) AS energy_ratio FROM j WHERE round(cr,9)>0.3 OR round(ov,9)>0.3"""))
def f25(spark, d):
    c = hits_df(spark, d).groupBy("track_id", F.col("type").alias("component"), F.floor(F.col("time") / 86400).alias("idx")).agg(F.sum("velocity").alias("value"))
    return rounded(op.component_relations(c), 5)


@add("f26_uncertainty_regions")
def f26(spark, d):
    return rounded(op.uncertainty_regions(pairs(spark, d), 0.9, 32, 16, "pair"))


@add("f27_density_profile", f"WITH {BINS} SELECT vec_id, CAST(least(floor(i*7/64.0),6) AS INTEGER) AS band, round(sum(m)/any_value(t),6) AS share FROM bn JOIN (SELECT vec_id, sum(m) AS t FROM bn GROUP BY 1) USING (vec_id) GROUP BY 1, 2")
def f27(spark, d):
    b = bins(spark, d).select("vec_id", F.col("i").alias("idx"), F.abs("x").alias("value"))
    return rounded(op.density_profile(b, key="vec_id"))


@add("f27_density_peaks")
def f27b(spark, d):
    b = bins(spark, d).select("vec_id", F.col("i").alias("idx"), F.abs("x").alias("value"))
    return rounded(op.density_peaks(b, key="vec_id"))


@add("f28_compare_reconstructions", f"WITH {_PAIR}, g AS (SELECT pair, i, va AS truth, vb AS a, va*0.9 AS b FROM pr), r AS (SELECT pair, avg(pow(a-b,2)) AS difference, max(abs(a-b)) AS md, avg(pow(a-truth,2)) AS ma, avg(pow(b-truth,2)) AS mb FROM g GROUP BY 1) SELECT pair, round(difference,6) AS difference, round(md,6) AS max_difference, round(ma,6) AS mse_a, round(mb,6) AS mse_b, round((1/(1+ma))/((1/(1+ma))+(1/(1+mb))),6) AS share_a FROM r")
def f28(spark, d):
    g = pairs(spark, d).select("pair", F.col("value_a").alias("truth"), F.col("value_b").alias("a"), (F.col("value_a") * 0.9).alias("b"))
    return rounded(op.compare_reconstructions(g, ["pair"]))
