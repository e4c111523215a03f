"""Block-carry scan: the nearest known row before and after each row, in blocks of time, so that one long track is many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(rows: DataFrame, known: DataFrame, keys: list[str], time: str, width: float, values: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``_before`` and ``_after``: structs (time, then ``values``) of the last row of ``known`` at or before each
    row's time and of the first one after it, of the same keys; null where there is none.

    Time is cut into blocks of ``width``. What is known last before and first after each
    block comes from one row a block, and goes into the block as a row of its own; in the
    block two running windows, one each way, do the rest. So work is linear, a task holds
    blocks and not tracks, and no frame reaches to the end of a partition. Rows without a
    time have no neighbours; null keys are equal to each other.
    """
    point = F.struct(F.col(time), *values)
    block = F.floor(F.col(time) / width).alias("_block")
    here = rows.select(*keys, F.col(time), block, F.struct(*rows.columns).alias("_row"))
    there = known.where(F.col(time).isNotNull()).select(*keys, F.col(time), block, point.alias("_point"))
    ends = there.groupBy(*keys, "_block").agg(F.min("_point").alias("_first"), F.max("_point").alias("_last"))
    wanted = here.where(F.col(time).isNotNull()).select(*keys, "_block").distinct()
    # one row a block: runs of the known before and after it
    summary = ends.unionByName(wanted, allowMissingColumns=True).groupBy(*keys, "_block").agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    forth, back = Window.partitionBy(*keys).orderBy("_block"), Window.partitionBy(*keys).orderBy(F.desc("_block"))
    run = (Window.unboundedPreceding, -1)
    carried = summary.select(*keys, "_block", F.last("_last", True).over(forth.rowsBetween(*run)).alias("_a"), F.last("_first", True).over(back.rowsBetween(*run)).alias("_b"))
    carry = carried.select(*keys, "_block", F.explode(F.array("_a", "_b")).alias("_point")).where("_point IS NOT NULL")
    carry = carry.select(*keys, F.col(f"_point.{time}").alias(time), "_block", "_point")
    both = here.unionByName(there.unionByName(carry), allowMissingColumns=True)
    of = Window.partitionBy(*keys, "_block")
    is_row = F.col("_row").isNotNull()
    till = (Window.unboundedPreceding, 0)
    near = both.withColumn("_before", F.last("_point", True).over(of.orderBy(F.col(time), is_row, "_point").rowsBetween(*till)))
    near = near.withColumn("_after", F.last("_point", True).over(of.orderBy(F.desc(time), F.desc(is_row), F.desc("_point")).rowsBetween(*till)))
    some = F.col(time).isNotNull()
    return near.where(is_row).select("_row.*", F.when(some, F.col("_before")).alias("_before"), F.when(some, F.col("_after")).alias("_after"))
