"""Top-k, paging, retention and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vector_index
from .joins import cosine, norm, query_pairs


def top_k_cosine(tracks: DataFrame, query: list[float], k: int = 5, threshold: float = 0.0, vec: str = "embedding", id_col: str = "track_id") -> DataFrame:
    """The k tracks nearest to one query vector (a literal); zero vectors score 0, the threshold is inclusive."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = tracks.select(id_col, F.round(cosine(vec, q), 9).alias("score")).where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def search_many(queries: DataFrame, refs: DataFrame, k: int, vec: str = "embedding", index: vector_index.VectorIndex | None = None) -> DataFrame:
    """(query_id, ref_id, score, rank): per query the k references with the greatest dot product of unit vectors, but for itself.

    Through a clustered vector index (``index``, else one built here of ``refs``), which
    skips the cells that cannot hold one of the k. A reference without length scores 0
    and a query without length scores 0 with all: such scores are added after the search.
    """
    index = index or vector_index.build(refs, "ref_id", vec)
    found = vector_index.nearest(index, queries, k, vec, but_itself=True).select("query_id", F.col("id").alias("ref_id"), "score")
    # scores of 0 by definition: at most k of them, the smallest ids, matter to a query
    none = norm(vec) == 0
    low = Window.partitionBy("query_id").orderBy("ref_id")
    few = refs.where(none).select("ref_id").orderBy("ref_id").limit(k + 1)
    flat = query_pairs(queries.where(norm(vec) > 0).select("query_id"), few, 1)
    first = refs.select("ref_id").orderBy("ref_id").limit(k + 1)
    flat = flat.unionByName(query_pairs(queries.where(none).select("query_id"), first, 1)).where("query_id <> ref_id")
    flat = flat.withColumn("r", F.row_number().over(low)).where(F.col("r") <= k).select("query_id", "ref_id", F.lit(0.0).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ref_id")
    return found.unionByName(flat).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "ref_id", "score", "rank")


def segments_for_text(segments: DataFrame, query: list[float], threshold: float = 0.3, vec: str = "embedding") -> DataFrame:
    """Segments that score above the threshold, with their rank by score."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return segments.withColumn("score", F.round(cosine(vec, q), 9)).where(F.col("score") > threshold).drop(vec)


def segments_for_texts(queries: DataFrame, segments: DataFrame, threshold: float = 0.3, vec: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Per text of a stated query set (query_id, vector) the segments that score above the threshold: through a clustered vector
    index for a positive one, else by all pairs in blocks. ``id_col`` names one segment."""
    if threshold > 0:
        found = vector_index.within(vector_index.build(segments, id_col, vec), queries, threshold, vec)
        return segments.drop(vec).join(found.withColumnRenamed("id", id_col), id_col).select("query_id", *[c for c in segments.columns if c != vec], "score")
    q = queries.select("query_id", F.col(vec).alias("_q"))
    return query_pairs(q, segments).withColumn("score", F.round(cosine(vec, "_q"), 9)).where(F.col("score") > threshold).drop(vec, "_q")


def top_tags(scores: DataFrame, keys: list[str], threshold: float = 0.5, k: int = 10) -> DataFrame:
    """Per key the k best tags at or above the threshold."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "tag")
    return scores.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dominant(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Name and value of the greatest of the columns; the first name on ties."""
    best = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("v"), F.lit(c).alias("name")) for c in columns]))[0]
    return df.select(*keys, best["name"].alias("dominant"), (-best["v"]).alias("value"))


def page(jobs: DataFrame, number: int, per_page: int = 20, status: str | None = None, created: str = "created_at", id_col: str = "id") -> DataFrame:
    """One page, newest first, with the total and the number of pages on each row."""
    chosen = jobs if status is None else jobs.where(F.col("status") == status)
    total = chosen.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / per_page))
    rows = chosen.orderBy(F.desc(created), id_col).offset((number - 1) * per_page).limit(per_page)
    return rows.crossJoin(F.broadcast(total))  # one row


def retain(jobs: DataFrame, cutoff, completed: str = "completed_at") -> DataFrame:
    """Jobs that run still or completed at the cutoff or later."""
    return jobs.where(F.col(completed).isNull() | (F.col(completed) >= F.lit(cutoff)))


def union_results(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dedupe_tasks(tasks: DataFrame, on: tuple[str, ...] = ("file", "config")) -> DataFrame:
    return tasks.dropDuplicates(list(on))


def upsert_tracks(old: DataFrame, new: DataFrame, now, id_col: str = "track_id") -> DataFrame:
    """Newer rows replace older ones by id; null fields keep what was there, ``added`` stays and ``updated`` becomes ``now``."""
    out = [F.col(id_col)]
    for c in old.columns:
        if c == id_col:
            continue
        if c == "added":
            out.append(F.coalesce("o.added", F.lit(now)).alias(c))
        elif c == "updated":
            out.append(F.when(F.col("n._new"), F.lit(now)).otherwise(F.col("o.updated")).alias(c))
        elif c in new.columns:
            out.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), id_col, "full").select(*out)


def remove_tracks(tracks: DataFrame, gone: DataFrame, id_col: str = "track_id") -> DataFrame:
    return tracks.join(gone.select(id_col), id_col, "left_anti")


def overlap_types(df: DataFrame, a: str, b: str) -> DataFrame:
    """Components of both sides: ``shared`` and ``either``, sorted."""
    return df.withColumn("shared", F.array_sort(F.array_intersect(a, b))).withColumn("either", F.array_sort(F.array_union(a, b)))


def common_features(long: DataFrame, n_files: int | None = None) -> DataFrame:
    """(feature, file, value) of the features that every file has."""
    need = long.agg(F.countDistinct("file").alias("need")) if n_files is None else None
    have = long.groupBy("feature").agg(F.countDistinct("file").alias("have"))
    full = have.crossJoin(F.broadcast(need)).where("have = need") if need is not None else have.where(F.col("have") == n_files)
    return long.join(full.select("feature"), "feature", "left_semi")
