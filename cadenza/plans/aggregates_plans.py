"""Queries A1 to A25."""

from pyspark.sql import functions as F

from ..operators import aggregates as op
from ..schemas import hits as hits_df
from ..schemas import long_metrics, table
from .common import Plans, hits

PLANS = Plans()
add = PLANS.add
COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG = f"""m AS (SELECT l_returnflag, l_linestatus, l_shipdate, l_orderkey, l_linenumber, unnest({COLS!r}) AS metric, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem)"""


def rounded(df, digits=6, keep=()):
    """Doubles rounded for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def long_lineitem(spark, d, keys=("l_returnflag",)):
    return long_metrics(table(spark, d, "lineitem"), list(keys), COLS)


@add("a1_hit_stats_by_type", hits("""SELECT type, count(*) AS hits, round(100.0*count(*)/sum(count(*)) OVER (), 6) AS pct, round(avg(confidence), 6) AS avg_confidence, round(avg(velocity), 6) AS avg_velocity FROM h GROUP BY type"""))
def a1(spark, d):
    return rounded(op.hit_stats_by_type(hits_df(spark, d)))


@add("a2_count_by_type", hits(""", c AS (SELECT type, count(*) AS n FROM h GROUP BY type), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, type) AS rn FROM c)
SELECT CASE WHEN rn > 3 THEN 'Other' ELSE type END AS type, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1"""))
def a2(spark, d):
    return op.count_by_type(hits_df(spark, d), 3)


@add("a3_time_span", hits("SELECT min(time) AS first, max(time) AS last, round(max(time)-min(time), 6) AS duration, round(avg(confidence), 6) AS avg_confidence, round(avg(velocity), 6) AS avg_velocity FROM h"))
def a3(spark, d):
    return rounded(op.time_span(hits_df(spark, d)), keep=("first", "last"))


@add("a4_density_histogram", hits(""", sp AS (SELECT min(time) AS lo, max(time) AS hi, greatest(5.0, (max(time)-min(time))/100) AS w FROM h),
sb AS (SELECT *, CAST(greatest(1, ceil((hi-lo)/w - 1e-9)) AS INTEGER) AS nb FROM sp), c AS (SELECT CAST(least(floor((time-lo)/w), nb-1) AS INTEGER) AS bin, count(*) AS n FROM h CROSS JOIN sb GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin*w, 6) AS start, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(range(0, nb)) AS bin, lo, w FROM sb) b LEFT JOIN c USING (bin)"""))
def a4(spark, d):
    return rounded(op.density_histogram(hits_df(spark, d)))


@add("a5_density_heatmap", hits(""", sp AS (SELECT min(time) AS lo, max(time) AS hi FROM h), c AS (SELECT type, CAST(least(floor((time-lo)/((hi-lo)/50)), 49) AS INTEGER) AS bin, count(*) AS n FROM h CROSS JOIN sp GROUP BY 1, 2)
SELECT type, bin, n, round(n / max(n) OVER (PARTITION BY type), 6) AS level FROM c"""))
def a5(spark, d):
    return rounded(op.density_heatmap(hits_df(spark, d)))


_CMP = "round(avg(value),6) AS mean, round(quantile_cont(value,0.5),6) AS median, round(stddev_samp(value),6) AS std, min(value) AS min, max(value) AS max, round(max(value)-min(value),6) AS range, count(value) AS n"


@add("a6_compare_metrics", f"WITH {LONG} SELECT metric, {_CMP} FROM m GROUP BY metric")
def a6(spark, d):
    return rounded(op.compare_metrics(long_lineitem(spark, d)))


@add("a6_compare_metrics_grouped", f"WITH {LONG} SELECT metric, l_returnflag, {_CMP} FROM m GROUP BY metric, l_returnflag")
def a6b(spark, d):
    return rounded(op.compare_metrics(long_lineitem(spark, d), ["l_returnflag"]))


@add("a7_feature_stats", f"""WITH {LONG} SELECT metric, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value),6) AS mean, round(var_pop(value),4) AS var, round(stddev_pop(value),6) AS std,
  round(avg(CASE WHEN value=0 THEN 1.0 ELSE 0.0 END),6) AS sparsity, round(count(value)*8/1048576,6) AS size_mb FROM m GROUP BY metric""")
def a7(spark, d):
    return rounded(op.feature_stats(long_lineitem(spark, d))).withColumn("var", F.round("var", 4))


@add("a8_segment_rollup", """WITH x AS (SELECT label, unnest(range(0, 64)) AS idx, unnest(embedding) AS x FROM embeddings)
SELECT label, CAST(idx AS INTEGER) AS idx, round(avg(CAST(x AS DOUBLE)),6) AS mean, round(stddev_pop(CAST(x AS DOUBLE)),6) AS std, round(CAST(max(x) AS DOUBLE),6) AS max, round(CAST(min(x) AS DOUBLE),6) AS min FROM x GROUP BY label, idx""")
def a8(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec"))
    return rounded(op.segment_rollup(e, "label"))


@add("a9_weighted_segment_mean", "SELECT l_returnflag, round(CASE WHEN sum(l_discount)=0 THEN avg(l_quantity) ELSE sum(l_quantity*l_discount)/nullif(sum(l_discount),0) END, 6) AS value FROM lineitem GROUP BY 1")
def a9(spark, d):
    return rounded(op.weighted_mean(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_discount"))


@add("a10_combine_batches", hits(""", b AS (SELECT track_id, CAST(floor(time/86400) AS BIGINT) AS batch, list(event_id ORDER BY event_id) AS items, avg(velocity) AS number, min(type) AS label FROM h GROUP BY 1, 2)
SELECT track_id, array_to_string(flatten(list(items ORDER BY batch)), ',') AS items, round(avg(number),6) AS number, arg_min(label, batch) AS label FROM b GROUP BY track_id"""))
def a10(spark, d):
    b = hits_df(spark, d).groupBy("track_id", F.floor(F.col("time") / 86400).alias("batch")).agg(F.array_sort(F.collect_list("event_id")).alias("items"), F.avg("velocity").alias("number"), F.min("type").alias("label"))
    return rounded(op.combine_batches(b)).withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@add("a11_background_rollup", f"WITH {LONG} SELECT metric, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std FROM m GROUP BY metric")
def a11(spark, d):
    return rounded(op.background_rollup(long_lineitem(spark, d)))


@add("a12_peak_statistics", hits("SELECT track_id, count(*) AS total, round(CASE WHEN max(time)>min(time) THEN count(*)/(max(time)-min(time)) ELSE 0 END, 9) AS density, round(avg(confidence),6) AS avg_confidence FROM h GROUP BY track_id"))
def a12(spark, d):
    return op.peak_statistics(hits_df(spark, d)).select("track_id", "total", F.round("density", 9).alias("density"), F.round("avg_confidence", 6).alias("avg_confidence"))


@add("a12_peaks_by_type", hits("SELECT track_id, type, count(*) AS n FROM h GROUP BY 1, 2"))
def a12b(spark, d):
    return op.peaks_by_type(hits_df(spark, d))


@add("a13_band_activity", hits("SELECT type, round(avg(confidence),6) AS mean, round(stddev_pop(confidence),6) AS std, max(confidence) AS max, round(avg(CASE WHEN confidence>0.1 THEN 1.0 ELSE 0.0 END),6) AS active FROM h GROUP BY type"))
def a13(spark, d):
    return rounded(op.band_activity(hits_df(spark, d), "type", "confidence"))


TRANSITIONS = "tr AS (SELECT event_id, track_id, type, confidence, time AS start_time, time + confidence * 3600 AS end_time FROM h)"


def transitions(spark, d):
    return hits_df(spark, d).select("event_id", "track_id", "type", "confidence", F.col("time").alias("start_time"), (F.col("time") + F.col("confidence") * 3600).alias("end_time"))


@add("a14_transition_summary", hits(f", {TRANSITIONS} SELECT type, count(*) AS n, round(avg(end_time-start_time),4) AS avg_length FROM tr GROUP BY type"))
def a14(spark, d):
    return rounded(op.transition_summary(transitions(spark, d)), 4)


@add("a15_cluster_stats", hits(f", {TRANSITIONS} SELECT CAST(track_id % 8 AS BIGINT) AS cluster, count(*) AS n, round(avg(end_time-start_time),4) AS avg_duration, round(avg(confidence),6) AS avg_confidence FROM tr GROUP BY 1"))
def a15(spark, d):
    out = op.cluster_stats(transitions(spark, d).withColumn("cluster", F.col("track_id") % 8))
    return out.select("cluster", "n", F.round("avg_duration", 4).alias("avg_duration"), F.round("avg_confidence", 6).alias("avg_confidence"))


@add("a16_batch_summary", """SELECT o_orderpriority AS config, count(*) AS total, CAST(sum(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS BIGINT) AS success, CAST(sum(CASE WHEN o_orderstatus='P' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  round(sum(o_totalprice),2) AS total_time, round(100.0*sum(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END)/count(*),6) AS success_pct FROM orders GROUP BY ROLLUP(o_orderpriority)""")
def a16(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("config"), status.alias("status"), F.col("o_totalprice").alias("seconds"))
    return rounded(op.batch_summary(t)).withColumn("total_time", F.round("total_time", 2))


@add("a17_emotion_stats", f"WITH {LONG} SELECT metric, round(avg(value),6) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value),6) AS std FROM m GROUP BY metric")
def a17(spark, d):
    return rounded(op.emotion_stats(long_lineitem(spark, d)))


@add("a18_beat_statistics", hits(""", b AS (SELECT track_id, count(*) AS beats, min(time) AS a, max(time) AS z FROM h WHERE type='purchase' GROUP BY 1), c AS (SELECT track_id, count(*) AS n FROM h GROUP BY 1)
SELECT track_id, beats, round(CASE WHEN beats>1 THEN (z-a)/(beats-1) ELSE 0 END,4) AS avg_interval, round(CASE WHEN z>0 THEN n/z ELSE 0 END,9) AS hit_density FROM b JOIN c USING (track_id)"""))
def a18(spark, d):
    h = hits_df(spark, d)
    out = op.beat_statistics(h.where("type='purchase'"), h)
    return out.select("track_id", "beats", F.round("avg_interval", 4).alias("avg_interval"), F.round("hit_density", 9).alias("hit_density"))


@add("a19_average_predictions", hits(""", g AS (SELECT track_id, type AS label, avg(confidence) AS score FROM h GROUP BY 1, 2 HAVING round(avg(confidence), 9) >= 0.45),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(score,9) DESC, label) AS rank FROM g) SELECT track_id, label, round(score,6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""))
def a19(spark, d):
    s = hits_df(spark, d).select("track_id", F.col("type").alias("label"), F.col("confidence").alias("score"))
    return rounded(op.average_predictions(s, 0.45, 3)).select("track_id", "label", "score", "rank")


_GROUPS = {"purchase": "rhythm", "click": "rhythm", "view": "bass", "error": "ambient"}
_GCASE = "CASE type WHEN 'purchase' THEN 'rhythm' WHEN 'click' THEN 'rhythm' WHEN 'view' THEN 'bass' WHEN 'error' THEN 'ambient' END"


@add("a20_component_balance", hits(f""", e AS (SELECT track_id, {_GCASE} AS grp, sum(velocity) AS e FROM h WHERE type <> 'signup' GROUP BY 1, 2)
SELECT track_id, grp, round(CASE WHEN sum(e) OVER w > 0 THEN e / sum(e) OVER w ELSE 0 END, 6) AS share FROM e WINDOW w AS (PARTITION BY track_id)"""))
def a20(spark, d):
    return rounded(op.component_balance(hits_df(spark, d).withColumn("energy", F.col("velocity")), _GROUPS))


@add("a21_energy_distribution", hits(""", e AS (SELECT track_id, type, sum(velocity) AS e FROM h GROUP BY 1, 2)
SELECT track_id, type, round(e / sum(e) OVER (PARTITION BY track_id), 6) AS share, row_number() OVER (PARTITION BY track_id ORDER BY e DESC, type) <= 3 AS dominant FROM e"""))
def a21(spark, d):
    return rounded(op.energy_distribution(hits_df(spark, d).withColumn("energy", F.col("velocity"))))


@add("a22_transformation_counts", "WITH x AS (SELECT unnest(string_split(p_name, ' ')) AS kind FROM part) SELECT kind, count(*) AS n FROM x GROUP BY kind")
def a22(spark, d):
    return op.transformation_counts(table(spark, d, "part").select(F.split("p_name", " ").alias("transforms")))


@add("a22_list_complexity", "SELECT p_partkey, round((len(string_split(p_name,' ')) + p_size % 3) / (2.0 * p_size), 6) AS complexity FROM part WHERE p_size > 0")
def a22b(spark, d):
    p = table(spark, d, "part").where("p_size > 0")
    return p.select("p_partkey", F.round(op.list_complexity(F.size(F.split("p_name", " ")), F.col("p_size") % 3, F.col("p_size")), 6).alias("complexity"))


@add("a23_distribution_moments", f"""WITH {LONG}, g AS (SELECT metric, avg(value) AS mu FROM m GROUP BY metric),
c AS (SELECT metric, avg(pow(value-mu,2)) AS m2, avg(pow(value-mu,3)) AS m3, avg(pow(value-mu,4)) AS m4 FROM m JOIN g USING (metric) GROUP BY metric)
SELECT metric, round(avg(value),5) AS mean, round(stddev_pop(value),6) AS std, min(value) AS min, max(value) AS max, round(any_value(m3)/pow(any_value(m2),1.5),6) AS skewness, round(any_value(m4)/pow(any_value(m2),2)-3,6) AS kurtosis,
  round(quantile_cont(value,0.25),6) AS q1, round(quantile_cont(value,0.5),6) AS median, round(quantile_cont(value,0.75),6) AS q3, round(quantile_cont(value,0.75)-quantile_cont(value,0.25),6) AS iqr FROM m JOIN c USING (metric) GROUP BY metric""")
def a23(spark, d):
    return rounded(op.distribution_moments(long_lineitem(spark, d)), keep=("mean",)).withColumn("mean", F.round("mean", 5))


DOC_LONG = """dl AS (SELECT o_orderkey AS id, unnest(['entropy','entropy','droplet','droplet']) AS family, unnest([o_totalprice-100000, o_custkey*10.0, o_totalprice/500, o_custkey-700.0]) AS value FROM orders)"""


def doc_long(spark, d):
    vals = [("entropy", F.col("o_totalprice") - 100000), ("entropy", F.col("o_custkey") * 10.0), ("droplet", F.col("o_totalprice") / 500), ("droplet", F.col("o_custkey") - 700.0)]
    rows = F.array(*[F.struct(F.lit(f).alias("family"), v.cast("double").alias("value")) for f, v in vals])
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.explode(rows).alias("r")).select("id", "r.family", "r.value")


@add("a24_log_summary", f"WITH {DOC_LONG} SELECT id, round(avg(log10(value)),6) AS mean, round(quantile_cont(log10(value),0.5),6) AS median, round(stddev_pop(log10(value)),6) AS std, count(*) AS n FROM dl WHERE value > 0 GROUP BY id")
def a24(spark, d):
    return rounded(op.log_summary(doc_long(spark, d)))


@add("a25_grouped_feature_vector", f"""WITH {DOC_LONG}, g AS (SELECT id, avg(abs(value)) FILTER (family='entropy') AS e_mean, stddev_pop(abs(value)) FILTER (family='entropy') AS e_std, max(abs(value)) FILTER (family='entropy') AS e_max,
  count(*) FILTER (family='entropy') AS e_count, avg(abs(value)) FILTER (family='droplet') AS d_mean, stddev_pop(abs(value)) FILTER (family='droplet') AS d_std, max(abs(value)) FILTER (family='droplet') AS d_max FROM dl GROUP BY id)
SELECT id, round(e_mean,6) AS e_mean, round(e_std,6) AS e_std, round(e_max,6) AS e_max, e_count, round(d_mean,6) AS d_mean, round(d_std,6) AS d_std, round(d_max,6) AS d_max,
  CAST(o_custkey AS DOUBLE) AS duration, round(o_custkey*44100/1e6,6) AS msamples, 44.1::DOUBLE AS khz FROM g JOIN orders ON id=o_orderkey""")
def a25(spark, d):
    audio = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("double").alias("duration"), (F.col("o_custkey") * 44100).alias("samples"), F.lit(44100.0).alias("sr"))
    return rounded(op.grouped_feature_vector(doc_long(spark, d), audio))
