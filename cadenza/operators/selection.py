"""Distributed selection: exact quantiles of groups whose distinct values no task could hold, and joins with small aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: An aggregate of up to so many rows is broadcast (some tens of MB); a larger one is joined with salted keys.
BROADCAST_ROWS = 200_000


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal; ``b`` gives its other columns."""
    renamed = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    met = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return a.join(renamed, met, how).drop(*[f"_{k}" for k in keys])


def with_aggregate(rows: DataFrame, found: DataFrame, keys: list[str], salts: int = 64) -> DataFrame:
    """Every row with its group's row of ``found`` (one a group). The aggregate is written and counted: up to
    ``BROADCAST_ROWS`` it is broadcast, so that rows stay where they are; beyond, both are dealt by key and salt, so that a
    hot group is many tasks."""
    found = written(found, "aggregate")
    if found.count() <= BROADCAST_ROWS:
        return same(rows, F.broadcast(found), keys)
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    every = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return same(salted, every, [*keys, "_salt"]).drop("_salt")


def quantiles(long: DataFrame, keys: list[str], at: tuple[float, ...], value: str = "value") -> DataFrame:
    """keys and ``q``, the array of exact quantiles (linear between ranks) of each group's values that aren't null.

    Values are counted, then dealt by range over all groups; sums of the parts' counts tell
    which part holds a rank, and only that part's values are ranked. The counts are
    written once. No task holds more than a part of a group's distinct values; a group
    without values gives no row.
    """
    counts = long.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    dealt = written(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "value-counts")
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_c").alias("_s"))
    by = Window.partitionBy(*keys)
    sums = sums.withColumn("_from", F.sum("_s").over(by.orderBy("_part")) - F.col("_s")).withColumn("_n", F.sum("_s").over(by))
    # ranks from 0: the two that each quantile lies between
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(q) * (F.col("_n") - 1)).alias("x")) for i, q in enumerate(at)])
    each = sums.select(*keys, "_part", "_from", "_s", F.explode(ranks).alias("r")).select("*", F.col("r.i").alias("_i"), F.col("r.x").alias("_x"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("up"), F.floor("_x").alias("rank")), F.struct(F.lit(1).alias("up"), F.ceil("_x").alias("rank"))))
    wanted = each.select(*keys, "_part", "_from", "_s", "_i", "_x", ends.alias("e")).where("e.rank >= _from AND e.rank < _from + _s")
    parts = wanted.groupBy(*keys, "_part", "_from").agg(F.collect_list(F.struct("_i", "_x", "e.up", "e.rank")).alias("_wanted"))  # at most two a quantile
    held = same(dealt, parts, [*keys, "_part"])
    run = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v")) + F.col("_from")
    found = held.withColumn("_end", run).withColumn("_w", F.explode("_wanted")).where("_w.rank < _end AND _w.rank >= _end - _c")
    lines = found.groupBy(*keys, F.col("_w._i").alias("_i")).agg(
        F.min(F.when(F.col("_w.up") == 0, F.col("_v"))).alias("_lo"), F.min(F.when(F.col("_w.up") == 1, F.col("_v"))).alias("_hi"), F.first("_w._x").alias("_x")
    )
    line = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_x") - F.floor("_x"))
    done = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", line.alias("v")))).alias("_q"))
    return done.select(*keys, F.transform("_q", lambda x: x["v"]).alias("q"))
