"""A clustered vector index with certified bounds: a cell is skipped only if its best possible cosine is too low."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .metric_cells import STRIP, matrix, pivots, spread, unit

#: Rounding that bounds allow for.
SLACK = 1e-6


def _chords(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * x @ p.T, 0))


def _assigned(units: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cell, id, v, near) of (id, v): the nearest of the centres and the distance to it."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), STRIP):
                pdf = batch.iloc[i : i + STRIP]
                d = _chords(matrix(pdf["v"]), centres)
                cell = d.argmin(1)
                yield pdf.assign(cell=cell.astype(np.int32), near=d[np.arange(len(d)), cell])[["cell", "id", "v", "near"]]

    kind = units.schema["id"].dataType.simpleString()
    return units.mapInPandas(rows, f"cell int, id {kind}, v array<double>, near double")


@dataclass
class VectorIndex:
    """``rows``: (cell, id, v, near) with unit vectors; ``cells``: (cell, centre), at most about ``PIVOTS`` of them."""

    rows: DataFrame
    cells: DataFrame

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")

    def centres(self) -> np.ndarray:
        """The cells' centres by number, collected: their number is bounded."""
        found = self.cells.orderBy("cell").collect()
        return np.array([r.centre for r in found], float)

    def upserted(self, vectors: DataFrame, id_col: str = "id", vec: str = "embedding") -> VectorIndex:
        """With rows added, or put in the place of those with their ids. Cells stay as they are."""
        new = _units(vectors, id_col, vec)
        kept = self.rows.join(vectors.select(F.col(id_col).alias("id")), "id", "left_anti").select(*self.rows.columns)
        return VectorIndex(written(kept.unionByName(_assigned(new, self.centres())), "vector-index"), self.cells)

    def removed(self, ids: DataFrame, id_col: str = "id") -> VectorIndex:
        return VectorIndex(self.rows.join(ids.select(F.col(id_col).alias("id")), "id", "left_anti").select(*self.rows.columns), self.cells)


def load(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"))


def _units(vectors: DataFrame, id_col: str, vec: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), unit(vec).alias("v")).where("v IS NOT NULL")


def build(vectors: DataFrame, id_col: str = "id", vec: str = "embedding", per_cell: int = 512) -> VectorIndex:
    """The index of all vectors that have a length, written to the shared folder. Centres are a sample by hash of about one in
    ``per_cell``, at most about ``PIVOTS``; every row is indexed."""
    units = _units(vectors, id_col, vec)
    _, chosen = pivots(units.withColumn("g", F.lit(0)), per_cell)
    found = sorted((r.h, list(r.v)) for r in chosen.select("h", "v").collect())
    spark = vectors.sparkSession
    cells = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(found)], "cell int, centre array<double>")
    if not found:
        kind = units.schema["id"].dataType.simpleString()
        return VectorIndex(spark.createDataFrame([], f"cell int, id {kind}, v array<double>, near double"), cells)
    return VectorIndex(written(_assigned(units, np.array([v for _, v in found])), "vector-index"), cells)


def _plan(queries: DataFrame, centres: np.ndarray, reach: np.ndarray, sizes: np.ndarray, first: int | None, least: float | None) -> DataFrame:
    """(query_id, q, cell, least) of the cells that each query (query_id, q[, least]) must meet: those of the best bounds that hold
    ``first`` rows together (and only these), or else all whose best possible cosine is ``least`` or more."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), STRIP):
                pdf = batch.iloc[i : i + STRIP]
                far = np.maximum(_chords(matrix(pdf["q"]), centres) - reach[None, :] - SLACK, 0)
                best = np.where(sizes[None, :] > 0, 1 - far**2 / 2, -np.inf)
                floor = np.full(len(pdf), least) if least is not None else pdf["least"].to_numpy() if first is None else np.full(len(pdf), -2.0)
                if first is None:
                    met = [np.flatnonzero(b >= f - SLACK) for b, f in zip(best, floor, strict=True)]
                else:
                    order = np.argsort(-best, axis=1, kind="stable")
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    met = [o[(n < first) & (sizes[o] > 0)] for o, n in zip(order, before, strict=True)]
                cells = pd.Series([m.astype(np.int32) for m in met], index=pdf.index, dtype=object)
                yield pd.DataFrame({"query_id": pdf["query_id"], "q": pdf["q"], "cells": cells, "least": floor})

    # a query once, with its cells' numbers: it is copied where Spark unpacks them, not in Python
    kind = queries.schema["query_id"].dataType.simpleString()
    found = queries.mapInPandas(rows, f"query_id {kind}, q array<double>, cells array<int>, least double")
    return found.select("query_id", "q", F.explode("cells").alias("cell"), "least")


def _scored(index: VectorIndex, planned: DataFrame, sizes: DataFrame, k: int | None, block: int = 1024) -> DataFrame:
    """(query_id, id, score, n) of planned queries against their cells, at ``least`` or more; with ``k`` the best k (and ties by id) of
    each block. A block of a cell and a block of its queries are one product in one task; ``n`` on a block's first row of a
    query says how many rows it was scored against."""
    asked = planned.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nq"))
    parts = sizes.select("cell", F.ceil(F.col("n") / block).cast("int").alias("nr")).join(asked, "cell")
    deal = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    left = planned.join(parts, "cell").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nr") - 1))).select("cell", F.col("b"), deal("query_id", "nq").alias("c"), "query_id", "q", "least")
    right = index.rows.join(parts, "cell").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select(F.col("cell").alias("cell"), deal("id", "nr").alias("b"), F.col("c").alias("c"), F.col("id").alias("id"), F.col("v").alias("v"))

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": x["query_id"].iloc[:0], "id": y["id"].iloc[:0], "score": pd.Series(dtype=float), "n": pd.Series(dtype="int64")})
        if x.empty or y.empty:
            return empty
        y = y.sort_values("id", kind="stable")
        found = np.round(matrix(x["q"]) @ matrix(y["v"]).T, 9)
        keep = found >= x["least"].to_numpy()[:, None] - SLACK
        if k is not None and found.shape[1] > k:
            kth = -np.partition(-found, k - 1, axis=1)[:, k - 1]
            keep &= found >= kth[:, None]
        at, col = np.nonzero(keep)
        n = np.where(np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool), len(y), 0)
        return pd.DataFrame({"query_id": x["query_id"].to_numpy()[at], "id": y["id"].to_numpy()[col], "score": found[at, col], "n": n})

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((planned, "query_id"), (index.rows, "id"))]
    key = ["cell", "b", "c"]
    return spread(left, *key).groupBy(*key).cogroup(spread(right, *key).groupBy(*key)).applyInPandas(product, f"query_id {kinds[0]}, id {kinds[1]}, score double, n long")


def _bounds(index: VectorIndex, centres: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(cell, n, reach) as a table and as arrays by cell: how many rows and how far from the centre."""
    found = index.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("near").alias("reach")).collect()  # a row a cell
    sizes, reach = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in found:
        sizes[r.cell], reach[r.cell] = r.n, r.reach
    return index.rows.sparkSession.createDataFrame([tuple(r) for r in found], "cell int, n long, reach double"), sizes, reach


def _asked(queries: DataFrame, vec: str) -> DataFrame:
    return queries.select("query_id", unit(vec).alias("q")).where("q IS NOT NULL")


def within(index: VectorIndex, queries: DataFrame, threshold: float, vec: str = "embedding") -> DataFrame:
    """(query_id, id, score) of all rows whose cosine, rounded to nine digits, exceeds a positive threshold. Vectors without length
    have cosine 0 and so no rows."""
    if threshold <= 0:
        raise ValueError("a threshold of 0 or less also meets vectors without length, which the index does not hold")
    centres = index.centres()
    if not len(centres):
        return _none(index, queries)
    table, sizes, reach = _bounds(index, centres)
    planned = _plan(_asked(queries, vec), centres, reach, sizes, None, threshold)
    return _scored(index, planned, table, None).where(F.col("score") > threshold).select("query_id", "id", "score")


def _none(index: VectorIndex, queries: DataFrame) -> DataFrame:
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (index.rows, "id"))]
    return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double, n long, rank int")


def nearest(index: VectorIndex, queries: DataFrame, k: int, vec: str = "embedding", but_itself: bool = False, keep_n: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k rows of greatest cosine (nine digits, ties by id) of each query that has a length; with
    ``but_itself`` without the row of the query's own id.

    Each query first meets the cells of the best bounds that hold enough rows. Its k-th
    score there is one to beat: of the others it meets those whose best possible cosine
    reaches it. Exact; ``keep_n`` gives all candidates instead, with the counts of rows scored.
    """
    centres = index.centres()
    if not len(centres):
        return _none(index, queries)
    table, sizes, reach = _bounds(index, centres)
    asked = _asked(queries, vec)
    start = _plan(asked, centres, reach, sizes, k + 1 if but_itself else k, None)
    own = F.col("query_id") != F.col("id") if but_itself else F.lit(True)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    extra = int(but_itself)
    seen = written(_scored(index, start, table, k + extra), "vector-candidates")
    floor = seen.where(own).withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", F.col("score").alias("least"))
    more = _plan(asked.join(floor, "query_id", "left").select("query_id", "q", F.coalesce("least", F.lit(-2.0)).alias("least")), centres, reach, sizes, None, None)
    met = start.select("query_id", "cell")
    rest = _scored(index, more.join(met, ["query_id", "cell"], "left_anti").select(*more.columns), table, k + extra)
    every = seen.unionByName(rest)
    if keep_n:
        return every
    return every.where(own).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")
