"""Queries K1 to K8 and U1 to U6."""

import datetime

from pyspark.sql import functions as F

from ..operators import topk as op
from ..operators import windows as win
from ..schemas import hits as hits_df
from ..schemas import table
from .aggregates_plans import rounded
from .common import Plans, hits
from .joins_plans import cos_sql

PLANS = Plans()
add = PLANS.add
_Q = "q AS (SELECT embedding AS qe, vec_id AS qid FROM embeddings ORDER BY vec_id LIMIT 1)"
_CUT = datetime.datetime(1997, 1, 1)


def _query(e):
    return list(e.orderBy("vec_id").limit(1).first()["embedding"])


@add("k1_top_k_cosine", f"WITH {_Q} SELECT vec_id, round({cos_sql('embedding', 'qe')}, 6) AS score FROM embeddings CROSS JOIN q WHERE round({cos_sql('embedding', 'qe')}, 9) >= 0 ORDER BY round({cos_sql('embedding', 'qe')}, 9) DESC, vec_id LIMIT 5")
def k1(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(op.top_k_cosine(e, _query(e), id_col="vec_id"))


@add("k2_search_with_audio", f"""WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT query_id, vec_id AS ref_id, round({cos_sql('embedding', 'qe')}, 9) AS score FROM embeddings CROSS JOIN q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS rank FROM c) SELECT query_id, ref_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def k2(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return rounded(op.search_many(q, e.withColumnRenamed("vec_id", "ref_id"), 5))


@add("k3_timestamps_for_text", f"WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT query_id, vec_id, label, round({cos_sql('embedding', 'qe')}, 9) AS score FROM embeddings CROSS JOIN q) SELECT query_id, vec_id, label, round(score, 6) AS score FROM c WHERE score > 0.05")
def k3(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(op.segments_for_texts(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e, 0.05))


@add("k4_top_tags", hits(""", r AS (SELECT track_id, type, event_id AS tag, confidence AS score, row_number() OVER (PARTITION BY track_id, type ORDER BY confidence DESC, event_id) AS rank FROM h WHERE confidence >= 0.5)
SELECT track_id, type, tag, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""))
def k4(spark, d):
    s = hits_df(spark, d).select("track_id", "type", F.col("event_id").alias("tag"), F.col("confidence").alias("score"))
    return op.top_tags(s, ["track_id", "type"], 0.5, 3)


@add("k5_dominant", """SELECT p_partkey, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS dominant, greatest(a, b, c) AS value
FROM (SELECT p_partkey, CAST(p_partkey % 7 AS DOUBLE) AS a, CAST(p_size % 7 AS DOUBLE) AS b, CAST(p_partkey % 5 AS DOUBLE) AS c FROM part)""")
def k5(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 7).cast("double").alias("a"), (F.col("p_size") % 7).cast("double").alias("b"), (F.col("p_partkey") % 5).cast("double").alias("c"))
    return op.dominant(p, ["p_partkey"], ["a", "b", "c"])


def _jobs(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("completed_at"))


@add("k6_page", """WITH f AS (SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderstatus='F'), t AS (SELECT count(*) AS total, CAST(ceil(count(*)/20.0) AS BIGINT) AS pages FROM f)
SELECT * FROM (SELECT * FROM f ORDER BY created_at DESC, id LIMIT 20 OFFSET 20) CROSS JOIN t""")
def k6(spark, d):
    return op.page(_jobs(spark, d), 2, 20, "F").select("id", "created_at", "total", "pages")


@add("k7_retain", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus='P' OR o_orderdate >= TIMESTAMP '1997-01-01'")
def k7(spark, d):
    return op.retain(_jobs(spark, d), _CUT).select("id", "status")


@add("k8_top_modes")
def k8(spark, d):
    from ..operators.signal import top_modes

    frames = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_idx"), F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("mag"))
    return top_modes(frames, 5, ["frame_idx"])


@add("u1_union_results", "SELECT source, count(*) AS total FROM documents GROUP BY source")
def u1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return op.union_results(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")).groupBy("source").agg(F.count(F.lit(1)).alias("total"))


@add("u2_combine_peaks", hits("SELECT event_id, track_id, time, CASE type WHEN 'click' THEN 'onset' WHEN 'view' THEN 'beat' ELSE 'downbeat' END AS type FROM h WHERE type IN ('click','view','error')"))
def u2(spark, d):
    h = hits_df(spark, d).select("event_id", "track_id", "time", "type")
    kinds = {"click": "onset", "view": "beat", "error": "downbeat"}
    return op.union_results(*[h.where(F.col("type") == t).withColumn("type", F.lit(name)) for t, name in kinds.items()])


@add("u3_dedupe_tasks", "SELECT DISTINCT l_partkey AS file, l_returnflag AS config FROM lineitem")
def u3(spark, d):
    return op.dedupe_tasks(table(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_returnflag").alias("config")))


@add("u4_upsert_tracks", """WITH o AS (SELECT vec_id AS track_id, label AS score FROM embeddings WHERE vec_id % 3 < 2), n AS (SELECT vec_id AS track_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE label + 100 END AS score FROM embeddings WHERE vec_id % 3 > 0)
SELECT track_id, coalesce(n.score, o.score) AS score, CASE WHEN o.track_id IS NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS added,
  CASE WHEN n.track_id IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS updated FROM o FULL JOIN n USING (track_id)""")
def u4(spark, d):
    e = table(spark, d, "embeddings")
    first, now = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)
    old = e.where("vec_id % 3 < 2").select(F.col("vec_id").alias("track_id"), F.col("label").alias("score"), F.lit(first).alias("added"), F.lit(first).alias("updated"))
    new = e.where("vec_id % 3 > 0").select(F.col("vec_id").alias("track_id"), F.when(F.col("vec_id") % 5 != 0, F.col("label") + 100).alias("score"))
    return op.upsert_tracks(old, new, now)


@add("u4_remove_tracks", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def u4b(spark, d):
    return op.remove_tracks(table(spark, d, "embeddings").select("vec_id", "label"), table(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id")


@add("u5_overlap_types", """WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type) || ' ' || p_name, ' ') AS b FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_intersect(a, b))), ',') AS shared, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either FROM a""")
def u5(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.split(F.concat_ws(" ", F.lower("p_type"), "p_name"), " ").alias("b"))
    return op.overlap_types(p, "a", "b").select("p_partkey", F.array_join("shared", ",").alias("shared"), F.array_join("either", ",").alias("either"))


@add("u6_common_features", hits(""", l AS (SELECT track_id AS file, type AS feature, avg(velocity) AS value FROM h WHERE confidence > 0.5 GROUP BY 1, 2), c AS (SELECT feature FROM l GROUP BY 1 HAVING count(DISTINCT file) = (SELECT count(DISTINCT file) FROM l))
SELECT feature, file, round(value, 6) AS value FROM l JOIN c USING (feature)"""))
def u6(spark, d):
    long = hits_df(spark, d).where("confidence > 0.5").groupBy(F.col("track_id").alias("file"), F.col("type").alias("feature")).agg(F.avg("velocity").alias("value"))
    return rounded(op.common_features(long)).select("feature", "file", "value")
