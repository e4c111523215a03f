"""Peaks of series of any length: level tops, a least distance with the highest first, prominence.

A series is numbered by parts and cut into blocks, so that a long one is many tasks. What
a block cannot know by itself comes from one row a block (``prominence``), from the rows
around it (``spread``, ``tops``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .folds import picked
from .selection import same

BLOCK = 65_536  # rows of a block
HALO = 8  # distances that a block sees beyond its ends


def greedy_by_height(x: np.ndarray, at: np.ndarray, distance: int) -> np.ndarray:
    """Of peak positions in order, keep the highest first and drop those nearer than ``distance`` to a kept one."""
    kept, _ = decided(at, x[at], distance)
    return at[kept]


def decided(at: np.ndarray, height: np.ndarray, distance: int, hidden: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(kept, unsure) of peaks in order of position, the highest first. A peak is unsure where some of its neighbours are
    ``hidden``, or where it is near to a higher one that is unsure."""
    gone, blocked = np.zeros(len(at), bool), np.zeros(len(at), bool) if hidden is None else hidden.copy()
    kept, unsure = np.zeros(len(at), bool), np.zeros(len(at), bool)
    lo, hi = np.searchsorted(at, at - distance, "right"), np.searchsorted(at, at + distance, "left")
    for i in np.argsort(-height, kind="stable").tolist():
        if gone[i]:
            continue
        mine, near = (unsure, blocked) if blocked[i] else (kept, gone)
        near[lo[i] : hi[i]] = True
        mine[i] = True
    return kept, unsure


def _lowest_before(height: np.ndarray, valley: np.ndarray) -> np.ndarray:
    """For each of a row of heights the lowest valley back to the last strictly greater one (or to the start); ``valley[i]`` lies
    before height i. A stack of falling heights: each height goes in and out once."""
    out = np.empty(len(height))
    stack: list[tuple[float, float]] = []
    for i, (h, low) in enumerate(zip(height.tolist(), valley.tolist(), strict=True)):
        while stack and stack[-1][0] <= h:
            low = min(low, stack.pop()[1])
        out[i] = low
        stack.append((h, low))
    return out


def valleys(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, left_open, right_open): the lowest point between each peak and higher ground on either side; a side is open
    where there is no higher ground, and its lowest point then the lowest to the end. Linear in the samples."""
    # ground can only be higher at a peak or at an end, and lowest between two of these
    nodes = np.unique(np.concatenate([[0], peak_positions(x), at, [len(x) - 1]])).astype(int)
    height, between = x[nodes], np.minimum.reduceat(x, nodes)
    between[:-1] = np.minimum(between[:-1], height[1:])
    left = _lowest_before(height, np.concatenate([[height[0]], between[:-1]]))
    right = _lowest_before(height[::-1], np.concatenate([[height[-1]], between[:-1][::-1]]))[::-1]
    left_open = np.maximum.accumulate(height) <= height
    right_open = np.maximum.accumulate(height[::-1])[::-1] <= height
    of = np.searchsorted(nodes, at)
    return left[of], right[of], left_open[of], right_open[of]


def prominences(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Height of each peak above the higher of the two lowest points that part it from higher ground, in time linear in the samples."""
    if not len(at):
        return np.zeros(0)
    left, right, _, _ = valleys(x, at)
    return x[at] - np.maximum(np.minimum(left, x[at]), np.minimum(right, x[at]))


def peak_positions(x: np.ndarray) -> np.ndarray:
    """Positions of maxima, the middle of level tops."""
    if len(x) < 3:
        return np.zeros(0, int)
    edge = np.flatnonzero(np.diff(x) != 0)
    start, end = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(x) - 1]])
    v = x[start]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return (start[top] + end[top]) // 2


def numbered(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``series`` with ``_pos``, the row's number from 0 within its keys, and ``_x``, its value as a double; written once.

    Rows without a number as value are left out. Rows are dealt by range of (keys, order)
    and numbered within a part; the counts of the parts before give where it begins.
    """
    rows = series.withColumn("_x", F.col(value).cast("double")).where("_x IS NOT NULL AND NOT isnan(_x)")
    dealt = written(rows.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()), "series")
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    begins = counts.select(*keys, "_part", (F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_c")).alias("_from"))
    within = dealt.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order, "_x")) - 1)
    return written(same(within, begins, [*keys, "_part"]).withColumn("_pos", F.col("_pos") + F.col("_from")).drop("_part", "_from"), "numbered")


def tops(rows: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, _pos, _x) of the maxima of numbered rows, the middle of level tops; levels may span blocks."""
    own = F.floor(F.col("_pos") / block)
    last = F.col("_pos") % block == block - 1  # is also the row before the next block
    dealt = rows.select(*keys, "_pos", "_x", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))).alias("_block"))
    of = Window.partitionBy(*keys, "_block").orderBy("_pos")
    steps = dealt.withColumn("_prev", F.lag("_x").over(of)).where(own == F.col("_block"))
    starts = steps.where("_prev IS NULL OR _prev <> _x").withColumn("_level", F.struct("_pos", "_x"))
    # the level after a block's last one is the first of the next block that has a start
    firsts = starts.groupBy(*keys, "_block").agg(F.min("_level").alias("_first"))
    carried = firsts.select(*keys, "_block", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carried"))
    level = same(starts.withColumn("_next", F.lead("_level").over(of)), carried, [*keys, "_block"])
    after = F.coalesce("_next", "_carried")
    return level.where((F.col("_x") > F.col("_prev")) & (F.col("_x") > after["_x"])).select(*keys, F.floor((F.col("_pos") + after["_pos"] - 1) / 2).alias("_pos"), "_x")


def spread(peaks: DataFrame, keys: list[str], distance: int, block: int = BLOCK) -> DataFrame:
    """The peaks (keys, _pos, _x) that stay when the highest is taken first and those nearer than ``distance`` to it go.

    A block sees ``HALO`` distances beyond its ends and decides what depends on nothing
    farther away. Only where a chain of ever higher peaks reaches beyond that, what is
    open is folded with the kept peaks, by sessions of peaks nearer than ``distance``:
    peaks that are known to go change nothing for the others.
    """
    from .windows import sessions

    halo = HALO * distance
    block = max(block, 2 * halo)
    reach = F.sequence(F.floor(F.greatest(F.col("_pos") - halo, F.lit(0)) / block), F.floor((F.col("_pos") + halo) / block))
    schema = T.StructType([*peaks.select(*keys, "_pos", "_x").schema.fields, T.StructField("_unsure", T.BooleanType())])

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        at, here = pdf["_pos"].to_numpy(), int(pdf["_block"].iloc[0])
        first, end = here * block - halo, (here + 1) * block + halo
        hidden = ((at - distance < first - 1) & (first > 0)) | (at + distance > end)
        kept, unsure = decided(at, pdf["_x"].to_numpy(), distance, hidden)
        return pdf.assign(_unsure=unsure)[(kept | unsure) & (at // block == here)].drop(columns="_block")

    dealt = peaks.select(*keys, "_pos", "_x", F.explode(reach).alias("_block"))
    known = written(dealt.groupBy(*keys, "_block").applyInPandas(decide, schema), "peaks")
    if known.where("_unsure").isEmpty():
        return known.drop("_unsure")

    def pick(begins: np.ndarray, at: np.ndarray, height: np.ndarray) -> np.ndarray:
        ends = [*begins[1:].tolist(), len(at)]
        return np.concatenate([a + np.flatnonzero(decided(at[a:z], height[a:z], distance)[0]) for a, z in zip(begins.tolist(), ends, strict=True)])

    chains = sessions(known.drop("_unsure"), keys, "_pos", distance)
    return picked(chains, [*keys, "_session"], ["_pos"], ["_pos", "_x"], pick, known.drop("_unsure").columns)


def _beyond(first: np.ndarray, least: np.ndarray, height: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ground going away from a peak (highest and lowest point a step): the step at which it first is higher than ``height``
    (the number of steps if nowhere), and the lowest point before it, ``low`` included."""
    step = np.searchsorted(np.maximum.accumulate(first), height, "right") if len(first) else np.zeros(len(height), int)
    run = np.concatenate([[np.inf], np.minimum.accumulate(least)]) if len(least) else np.array([np.inf])
    return step, np.minimum(low, run[step])


def prominence(rows: DataFrame, peaks: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, _pos, prominence) of peaks of numbered rows.

    A block finds the lowest point towards higher ground on either side of its peaks. Where
    it holds no higher ground, the highest and lowest points of the other blocks (one row a
    block, a series' together) tell which block does, and that one the rest.
    """
    at = F.floor(F.col("_pos") / block).alias("_block")
    ground, tip = rows.select(*keys, "_pos", "_x", at), peaks.select(*keys, "_pos", "_x", at)
    by = [*keys, "_block"]
    side = [T.StructField("_side", T.IntegerType()), T.StructField("_low", T.DoubleType())]
    sides = T.StructType([*tip.schema.fields, *side, T.StructField("_open", T.BooleanType())])
    goals = T.StructType([*tip.schema.fields, *side])  # of these _block is where higher ground lies, null if nowhere

    def within(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        x, n = g.sort_values("_pos")["_x"].to_numpy(), len(p)
        found = valleys(x, p["_pos"].to_numpy() - int(g["_pos"].min())) if n else (np.zeros(0),) * 4
        left, right, no_left, no_right = found
        both = p.iloc[np.tile(np.arange(n), 2)]
        return both.assign(_side=np.repeat([-1, 1], n), _low=np.concatenate([left, right]), _open=np.concatenate([no_left, no_right]).astype(bool))

    def across(s: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("_block")
        high, least = s["_high"].to_numpy(), s["_least"].to_numpy()
        low, goal = o["_low"].to_numpy().copy(), np.full(len(o), -1)
        for (b, way), i in o.groupby(["_block", "_side"]).indices.items():
            away = slice(b + 1, None) if way > 0 else slice(b - 1, None, -1) if b else slice(0, 0)
            step, low[i] = _beyond(high[away], least[away], o["_x"].to_numpy()[i], low[i])
            goal[i] = np.where(step < len(high[away]), b + way * (step + 1), -1)
        return o.assign(_low=low, _block=pd.Series(goal, o.index, "Int64").mask(goal < 0))

    def there(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        x, low = g.sort_values("_pos")["_x"].to_numpy(), p["_low"].to_numpy().copy()
        for way, i in p.groupby("_side").indices.items():
            away = x if way > 0 else x[::-1]
            low[i] = _beyond(away, away, p["_x"].to_numpy()[i], low[i])[1]
        return p.assign(_low=low)

    near = written(ground.groupBy(*by).cogroup(tip.groupBy(*by)).applyInPandas(within, sides), "sides")
    done = near.where("NOT _open").drop("_open")
    blocks = ground.groupBy(*by).agg(F.max("_x").alias("_high"), F.min("_x").alias("_least"))
    far = written(blocks.groupBy(*keys).cogroup(near.where("_open").drop("_open").groupBy(*keys)).applyInPandas(across, goals), "sides-open")
    asked = far.where("_block IS NOT NULL")
    held = same(ground, asked.select(*by).distinct(), by, "left_semi")
    found = held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(there, goals)
    low = done.unionByName(far.where("_block IS NULL")).unionByName(found)
    return low.groupBy(*keys, "_pos", "_x").agg(F.max(F.least("_low", "_x")).alias("_base")).select(*keys, "_pos", (F.col("_x") - F.col("_base")).alias("prominence"))


def non_max_by_priority(series: DataFrame, keys: list[str], distance: int, prominence_min: float = 0.0, height: float | None = None, order: str = "idx", value: str = "value", block: int | None = BLOCK) -> DataFrame:
    """Rows of ``series`` that are peaks, the highest first, ``distance`` rows apart, with ``prominence`` of at least
    ``prominence_min``. Rows without a number as value are no part of a series; fewer than three rows have no peak.

    Series of at most ``block`` rows are picked whole, many in one task; longer ones in blocks. ``block`` None is for keys that
    bound a series (tracks cut into segments), and spares the count.
    """
    number = F.col(value).cast("double")
    valid = series.where(number.isNotNull() & ~F.isnan(number))
    if block is None:
        return _by_series(valid, keys, distance, prominence_min, height, order, value)
    long = written(valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select(*keys), "long-series")
    if long.isEmpty():
        return _by_series(valid, keys, distance, prominence_min, height, order, value)
    short = _by_series(same(valid, long, keys, "left_anti"), keys, distance, prominence_min, height, order, value)
    rows = numbered(same(valid, long, keys, "left_semi"), keys, order, value)
    peaks = tops(rows, keys, block)
    kept = written(spread(peaks if height is None else peaks.where(F.col("_x") >= height), keys, distance, block), "spread")
    found = prominence(rows, kept, keys, block).where(F.col("prominence") >= prominence_min)
    return short.unionByName(same(rows, found, [*keys, "_pos"]).select(*series.columns, "prominence"))


def _by_series(series: DataFrame, keys: list[str], distance: int, prominence_min: float, height: float | None, order: str, value: str) -> DataFrame:
    def pick(begins: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, proms = [np.zeros(0, int)], [np.zeros(0)]
        for a, x in zip(begins.tolist(), np.split(values.astype(float), begins[1:]), strict=True):
            at = peak_positions(x)
            at = greedy_by_height(x, at if height is None else at[x[at] >= height], distance) if len(at) else at
            if len(at):
                prom = prominences(x, at)
                rows.append(a + at[prom >= prominence_min])
                proms.append(prom[prom >= prominence_min])
        return np.concatenate(rows), np.concatenate(proms)

    return picked(series, keys, [order, value], [value], pick, series.columns, T.StructField("prominence", T.DoubleType()))
