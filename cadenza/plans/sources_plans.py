"""Queries S1 to S15."""

import uuid

from pyspark.sql import functions as F

from ..schemas import hits as hits_df
from ..schemas import table
from ..session import shared_dir
from ..sources import tables as op
from .common import Plans, hits

PLANS = Plans()
add = PLANS.add


@add("s1_read_hits", hits("SELECT event_id, track_id, type, us, confidence, velocity FROM h"))
def s1(spark, d):
    h = hits_df(spark, d)
    lines = h.select(F.to_json(F.struct("event_id", "track_id", "type", "us", "confidence", "velocity")).alias("j"))
    parsed = lines.select(F.from_json("j", "event_id long, track_id long, type string, us long, confidence double, velocity double").alias("r"))
    return parsed.select("r.*")


@add("s2_read_features", hits("SELECT track_id, type, time, velocity FROM h"))
def s2(spark, d):
    h = hits_df(spark, d)
    ev = F.collect_list(F.struct("type", "time", "velocity"))
    nested = h.groupBy("track_id").agg(ev.alias("ev"))
    even = F.col("track_id") % 2 == 0
    docs = nested.select("track_id", F.when(even, F.struct(F.col("ev").alias("events"))).alias("percussion"), F.when(~even, F.struct(F.col("ev").alias("events"))).alias("drum"))
    return op.flatten_events(docs, ("percussion", "drum"), ("track_id",))


@add("s5_track_info", """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' - ' || p_name ELSE p_name END AS stem FROM part)
SELECT p_partkey, CASE WHEN contains(stem, ' - ') THEN split_part(stem, ' - ', 1) ELSE 'Unknown Artist' END AS artist, CASE WHEN contains(stem, ' - ') THEN split_part(stem, ' - ', 2) ELSE stem END AS title FROM n""")
def s5(spark, d):
    stem = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" - ", "p_brand", "p_name")).otherwise(F.col("p_name"))
    artist, title = op.track_info(F.concat(F.lit("/music/"), stem, F.lit(".wav")))
    return table(spark, d, "part").select("p_partkey", artist.alias("artist"), title.alias("title"))


@add("s6_segment_pcm", "SELECT vec_id, CAST(10 AS BIGINT) AS start_sample, 30 AS n, round(list_sum(list_transform(embedding[11:40], lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def s6(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.lit(0).cast("long").alias("start_sample"), F.col("embedding").alias("samples"))
    out = op.segment_pcm(e, 10, 40)
    return out.select("vec_id", "start_sample", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@add("s7_inspect_structure", """WITH kv AS (SELECT 'k' AS key, json_extract_string(props, '$.k') AS v FROM events) SELECT key, 'BIGINT' AS type, count(*) AS n, array_to_string(list_sort(list(DISTINCT v))[1:3], ',') AS examples FROM kv GROUP BY 1""")
def s7(spark, d):
    return op.inspect_structure(table(spark, d, "events"), "props", None).withColumn("examples", F.array_join("examples", ","))


@add("s9_flatten_for_csv", "SELECT o_orderkey AS id, o_totalprice AS price_value, o_orderstatus AS price_meta_status, '[' || o_custkey || ',1]' AS tags FROM orders")
def s9(spark, d):
    o = table(spark, d, "orders")
    nested = o.select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_totalprice").alias("value"), F.struct(F.col("o_orderstatus").alias("status")).alias("meta")).alias("price"), F.array("o_custkey", F.lit(1)).alias("tags"))
    return op.flatten_for_csv(nested)


@add("s10_versioned_results", "SELECT o_orderkey, '2.1.0' AS version, 2 AS version_major FROM orders WHERE o_orderkey % 2 = 0")
def s10(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    both = op.versioned(o.where("o_orderkey % 2 = 0"), "2.1.0").unionByName(op.versioned(o.where("o_orderkey % 2 = 1"), "1.9.0"))
    return op.compatible(both, "2.0.0")


@add("s10_list_results", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN '2.1.0' ELSE '1.9.0' END AS version, count(*) AS n FROM orders GROUP BY 1")
def s10b(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return op.list_results(op.versioned(o.where("o_orderkey % 2 = 0"), "2.1.0").unionByName(op.versioned(o.where("o_orderkey % 2 = 1"), "1.9.0")))


@add("s11_subsample", hits(""", p AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY us, event_id) - 1 AS idx FROM h), c AS (SELECT * FROM p WHERE idx >= 4 AND idx < 60 AND (idx-4) % 2 = 0), n AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS q FROM c)
SELECT event_id, track_id FROM n WHERE q % (CASE WHEN n > 10 THEN n // 10 + 1 ELSE 1 END) = 0"""))
def s11(spark, d):
    from pyspark.sql import Window

    h = hits_df(spark, d).withColumn("idx", F.row_number().over(Window.partitionBy("track_id").orderBy("us", "event_id")) - 1)
    return op.subsample(h, ["track_id"], "idx", 4, 60, 2, 10).select("event_id", "track_id")


@add("s12_downsample_even", hits(""", p AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY us, event_id) - 1 AS p, count(*) OVER (PARTITION BY track_id) AS n FROM h), k AS (SELECT unnest(range(0, 20)) AS k)
SELECT DISTINCT event_id, track_id FROM p JOIN k ON n <= 20 OR p = (k*(n-1)) // 19"""))
def s12(spark, d):
    return op.downsample_even(hits_df(spark, d), ["track_id"], ["us", "event_id"], 20).select("event_id", "track_id")


@add("s13_sample_rows")
def s13(spark, d):
    return op.sample_rows(hits_df(spark, d), 1000).select("event_id", "track_id")


@add("s14_index_analysis", "SELECT 'metadata' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'summary', count(*) FROM customer UNION ALL SELECT 'segment', count(*) FROM lineitem UNION ALL SELECT 'features', count(*) FROM part")
def s14(spark, d):
    named = lambda t, key: table(spark, d, t).withColumn("mix_id", F.col(key).cast("long"))
    out = op.index_analysis(named("orders", "o_orderkey"), named("customer", "c_custkey"), named("lineitem", "l_orderkey"), named("part", "p_partkey"))
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@add("s15_signals_of_tracks", hits(""", t AS (SELECT track_id, avg(velocity) AS f FROM h GROUP BY 1), i AS (SELECT track_id, f, unnest(range(0, 100)) AS i FROM t)
SELECT track_id, CAST(i AS BIGINT) AS i, round(sin(2*pi()*f*i/8000) + 0.5*sin(2*pi()*2*f*i/8000), 6) AS x FROM i"""))
def s15(spark, d):
    import math

    t = hits_df(spark, d).groupBy("track_id").agg(F.avg("velocity").alias("f")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))))
    w = 2 * math.pi * F.col("f") * F.col("i") / 8000
    return t.select("track_id", "i", F.round(F.sin(w) + 0.5 * F.sin(2 * w), 6).alias("x"))


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@add("s3_read_results", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s3(spark, d):
    path, s = _folder(spark, "results"), table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return op.read_results(spark, op.write_documents(s, path), s.schema).drop("file")


@add("s4_discover_files", "SELECT DISTINCT o_orderstatus AS folder FROM orders")
def s4(spark, d):
    path = _folder(spark, "found")
    orders = table(spark, d, "orders")
    orders.write.partitionBy("o_orderstatus").parquet(path)
    orders.select("o_orderkey").write.csv(f"{path}/other=x")
    found = op.discover_files(spark, path, ("parquet",)).where("length > 0")
    return found.select(F.regexp_extract("path", "o_orderstatus=([^/]*)/", 1).alias("folder")).distinct()


@add("s8_write_results", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS info_nation, c_mktsegment AS info_segment FROM customer")
def s8(spark, d):
    path = _folder(spark, "written")
    c = table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("info"))
    op.write_results(c, path, "csv")
    return spark.read.option("header", True).csv(path)
