"""Queries P1 to P13."""

from pyspark.sql import functions as F

from ..operators import filters as op
from ..operators import windows as win
from ..schemas import hits as hits_df
from ..schemas import table
from .common import Plans, hits

PLANS = Plans()
add = PLANS.add


@add("p1_time_slice", hits("SELECT event_id, track_id, time FROM h WHERE time BETWEEN 86400 AND 432000"))
def p1(spark, d):
    return op.time_slice(hits_df(spark, d), 86400, 432000).select("event_id", "track_id", "time")


@add("p2_by_type", hits("SELECT event_id, type, time FROM h WHERE type='click' ORDER BY time, event_id LIMIT 1000"))
def p2(spark, d):
    return op.by_type(hits_df(spark, d), "click").select("event_id", "type", "time")


def _results(spark, d):
    """Orders as nested result documents."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("file"),
        F.struct(
            F.col("o_totalprice").alias("duration"), F.lit(44100).alias("sample_rate"), F.lit(2).alias("channels"),
            F.struct((F.col("o_custkey") % 200).cast("double").alias("bpm"), F.col("o_orderstatus").alias("label")).alias("tempo"),
            F.struct(F.col("o_orderpriority").alias("key"), F.lit(None).cast("string").alias("scale"), F.lit(None).cast("double").alias("confidence")).alias("key"),
            F.create_map(F.lit("snr"), F.col("o_totalprice") / 1000).alias("quality"),
            F.create_map(F.lit("energy"), F.col("o_custkey").cast("double")).alias("features"),
            F.when(F.col("o_orderkey") % 3 > 0, F.sequence(F.lit(1), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("segments"),
            F.array(F.lit(1)).alias("transitions"),
        ).alias("result"),
    )


@add("p3_extract_metrics", """SELECT o_orderkey AS file, unnest(['duration','sample_rate','channels','bpm','key_confidence','quality_snr','feature_energy']) AS metric,
  round(unnest([o_totalprice, 44100.0, 2.0, CAST(o_custkey % 200 AS DOUBLE), 0.0, o_totalprice/1000, CAST(o_custkey AS DOUBLE)]), 6) AS value FROM orders""")
def p3(spark, d):
    return op.extract_metrics(_results(spark, d)).withColumn("value", F.round("value", 6))


@add("p3_extract_labels", "SELECT o_orderkey AS file, o_orderstatus AS tempo_label, o_orderpriority AS key, '' AS scale FROM orders")
def p3b(spark, d):
    return op.extract_labels(_results(spark, d))


@add("p4_extract_batch_metrics", """SELECT o_orderkey AS file, CAST(o_custkey % 200 AS DOUBLE) AS bpm,
  CAST(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 + 1 ELSE 0 END AS BIGINT) AS segments, CAST(1 AS BIGINT) AS transitions FROM orders""")
def p4(spark, d):
    return op.extract_batch_metrics(_results(spark, d))


_KEYS = ["bpm", "Beat_times", "segments", "peak_list", "transition", "spectral", "mood"]


@add("p5_route_result", f"""WITH k AS (SELECT unnest({_KEYS!r}) AS k), p AS (SELECT p_partkey, k, p_name || ' ' || k AS key FROM part CROSS JOIN k)
SELECT p_partkey, key, CASE WHEN regexp_matches(lower(key), 'bpm|tempo|beat|rhythm|spectral') THEN 'features'
  WHEN regexp_matches(lower(key), 'segment|peak|transition') THEN 'annotation' ELSE 'analysis' END AS section FROM p""")
def p5(spark, d):
    keys = F.explode(F.array(*map(F.lit, _KEYS)))
    p = table(spark, d, "part").select("p_partkey", "p_name", keys.alias("k")).select("p_partkey", F.concat_ws(" ", "p_name", "k").alias("key"))
    return p.withColumn("section", op.route(F.col("key")))


_ODD = "CASE l_linenumber WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN '-inf'::DOUBLE ELSE l_quantity END"


def _odd(c="l_quantity"):
    n = F.col("l_linenumber")
    return F.when(n == 1, float("nan")).when(n == 2, float("inf")).when(n == 3, float("-inf")).otherwise(F.col(c))


@add("p6_sanitize", f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN isnan(x) THEN 0.0 WHEN x = 'inf'::DOUBLE THEN 1.0 WHEN x = '-inf'::DOUBLE THEN 0.0 ELSE x END AS value
FROM (SELECT l_orderkey, l_linenumber, l_partkey, {_ODD} AS x FROM lineitem)""")
def p6(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", op.sanitize(_odd()).alias("value"))


_LONG = """l AS (SELECT o_orderkey AS id, unnest(['velocity_a','size_b','tension']) AS param,
  unnest([CASE WHEN o_orderkey % 7 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice * 20 END, o_totalprice / 100, o_totalprice - 100000]) AS value FROM orders)"""


def _long(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 7 == 0, float("nan")).otherwise(F.col("o_totalprice") * 20).alias("velocity_a"),
        (F.col("o_totalprice") / 100).alias("size_b"),
        (F.col("o_totalprice") - 100000).alias("tension"),
    )
    return o.unpivot(["id"], ["velocity_a", "size_b", "tension"], "param", "value")


@add("p7_extreme_flag", f"""WITH {_LONG}, f AS (SELECT *, CASE split_part(param,'_',1) WHEN 'velocity' THEN 1e6 WHEN 'size' THEN 1e3 ELSE 1e6 END AS lim FROM l)
SELECT id, param, CASE WHEN isnan(value) THEN 'NaN' WHEN abs(value) > lim THEN 'Extreme' ELSE 'Normal' END AS category,
  round(CASE WHEN isnan(value) THEN 0.0 WHEN abs(value) > lim THEN log10(abs(value)) ELSE value END, 6) AS measure FROM f""")
def p7(spark, d):
    return op.extreme_flag(_long(spark, d)).select("id", "param", "category", F.round("measure", 6).alias("measure"))


@add("p8_nan_census", f"WITH {_LONG} SELECT param, CAST(sum(CASE WHEN isnan(value) THEN 1 ELSE 0 END) AS BIGINT) AS n_nan, CAST(sum(CASE WHEN isnan(value) THEN 0 ELSE 1 END) AS BIGINT) AS n_valid FROM l GROUP BY param")
def p8(spark, d):
    return op.nan_census(_long(spark, d))


@add("p9_anomaly_list", f"WITH {_LONG} SELECT id, param, CASE WHEN isnan(value) THEN 'NaN' ELSE 'extreme' END AS reason FROM l WHERE isnan(value) OR abs(value) > 1e6")
def p9(spark, d):
    return op.anomalies(_long(spark, d)).select("id", "param", "reason")


@add("p10_anomaly_score", f"""WITH {_LONG}, p AS (SELECT id, sum(CASE WHEN isnan(value) THEN 0.2 WHEN abs(value) > 1e6 THEN CASE WHEN param='velocity_a' THEN 0.3 ELSE 0.25 END
  WHEN abs(value) > CASE WHEN param='velocity_a' THEN 1e4 ELSE 1e3 END THEN CASE WHEN param='velocity_a' THEN 0.1 ELSE 0.05 END ELSE 0.0 END) AS points FROM l GROUP BY id)
SELECT o_orderkey AS id, round(CAST(least(1.0, points + CASE WHEN o_custkey > 1000 THEN 0.1 ELSE 0.0 END) AS DOUBLE), 6) AS score FROM p JOIN orders ON id = o_orderkey""")
def p10(spark, d):
    long = _long(spark, d).withColumn("family", F.when(F.col("param") == "velocity_a", "entropy").otherwise("droplet"))
    extra = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("duration"), F.lit(0.0).alias("samples"))
    return op.anomaly_score(long, extra).withColumn("score", F.round("score", 6))


@add("p11_log_signs", f"""WITH {_LONG} SELECT id, param, CASE WHEN value >= 0 THEN 1 ELSE -1 END AS sign, round(CASE WHEN value = 0 THEN 0.0 ELSE log10(abs(value)) END, 6) AS log_abs
FROM l WHERE NOT isnan(value)""")
def p11(spark, d):
    return op.log_signs(_long(spark, d).where(~F.isnan("value"))).select("id", "param", "sign", F.round("log_abs", 6).alias("log_abs"))


@add("p12_derived_rates", """WITH x AS (SELECT o_orderkey AS id, o_totalprice AS entropy, CAST(o_custkey AS DOUBLE) AS duration, CAST(o_custkey * 8000 AS DOUBLE) AS samples FROM orders),
m AS (SELECT *, samples * 32 / (8.0 * 1024 * 1024) AS mb FROM x)
SELECT id, round(mb, 6) AS mb, round(CASE WHEN mb > 0 THEN entropy/mb ELSE 0 END, 6) AS entropy_per_mb, round(CASE WHEN duration > 0 THEN entropy/duration ELSE 0 END, 8) AS entropy_per_second,
  round(CASE WHEN samples > 0 THEN entropy/samples ELSE 0 END, 6) AS entropy_per_sample, round(CASE WHEN duration > 0 THEN samples/duration ELSE 0 END, 6) AS samples_per_second FROM m""")
def p12(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("entropy"), F.col("o_custkey").cast("double").alias("duration"), (F.col("o_custkey") * 8000).cast("double").alias("samples"))
    out = op.derived_rates(o)
    return out.select("id", *[F.round(c, 8 if c == "entropy_per_second" else 6).alias(c) for c in out.columns[1:]])


@add("p13_filters", hits("""SELECT event_id, dt FROM (SELECT event_id, confidence, (us - lag(us) OVER (PARTITION BY track_id ORDER BY us, event_id)) / 1e9 AS dt FROM h)
WHERE confidence >= 0.5 AND dt > 0.05 AND dt < 2.0"""))
def p13(spark, d):
    w = win.intervals(hits_df(spark, d), ["track_id"]).withColumn("dt", F.col("d_us") / 1e9)
    return op.filter_interval(op.filter_confidence(w, 0.5)).select("event_id", "dt")
