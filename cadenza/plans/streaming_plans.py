"""Queries X1 to X6: batch twins; tests hold the streams against them."""

from pyspark.sql import functions as F

from ..schemas import hits as hits_df
from ..schemas import table
from ..streaming import beats as op
from .aggregates_plans import rounded
from .common import Plans, hits

PLANS = Plans()
add = PLANS.add
HOUR = 3.6e9


def activations(spark, d):
    return hits_df(spark, d).select("track_id", "us", F.col("confidence").alias("activation"))


@add("x1_stream_beats")
def x1(spark, d):
    return rounded(op.batch_beats(activations(spark, d), 0.5, 2.0, 2.0, 48.0, unit=HOUR))


@add("x2_stream_tempo", hits(""", b AS (SELECT track_id, us, (us - lag(us) OVER (PARTITION BY track_id ORDER BY us)) / 3.6e9 AS dt FROM h WHERE type='purchase'), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY us DESC) AS r FROM b WHERE dt > 2 AND dt < 48),
t AS (SELECT track_id, 60/quantile_cont(dt, 0.5) AS tempo FROM r WHERE r <= 8 GROUP BY 1) SELECT track_id, round(coalesce(tempo, 120), 6) AS tempo FROM (SELECT DISTINCT track_id FROM b) LEFT JOIN t USING (track_id)"""))
def x2(spark, d):
    b = hits_df(spark, d).where("type='purchase'").select("track_id", "us")
    return rounded(op.last_tempo(b, 8, 2.0, 48.0, HOUR))


def _events(spark, d):
    return table(spark, d, "events").select("ts", F.col("user_id").alias("track_id"), F.col("event_type").alias("type"), "value")


def _windows(step, count, agg):
    return f"""WITH e AS (SELECT user_id AS track_id, epoch_us(ts) AS u, value FROM events), w AS (SELECT track_id, value, (u // {step} - k) * {step} AS s FROM e CROSS JOIN (SELECT unnest(range(0, {count})) AS k))
SELECT track_id, make_timestamp(s) AS start, {agg} FROM w GROUP BY 1, 2"""


@add("x3_recent_beats", _windows(3_600_000_000, 5, "count(*) AS n"))
def x3(spark, d):
    return op.recent_beats(_events(spark, d), "5 hours", "1 hour")


@add("x4_buffered_windows", _windows(3_600_000_000, 2, "count(*) AS n, round(avg(value), 6) AS mean"))
def x4(spark, d):
    return rounded(op.buffered_windows(_events(spark, d), "2 hours", "1 hour"))


@add("x5_stream_density", "SELECT event_type AS type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def x5(spark, d):
    return op.stream_density(_events(spark, d), "1 hour")


@add("x6_file_beats")
def x6(spark, d):
    return op.file_beats(activations(spark, d), 0.5, 2.0, HOUR)
