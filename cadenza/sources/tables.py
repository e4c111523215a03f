"""Readers, writers, sampling and inspection of result and feature tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import json_arrays

AUDIO = ("wav", "mp3", "flac", "ogg", "m4a", "aac")
DOCUMENTS = 5000  # files that a task writes into its folder


def read_hits_json(spark: SparkSession, path: str, schema: T.StructType, array: bool = False) -> DataFrame:
    """Event records from JSON lines, or from files that are one JSON array each: both in byte ranges, many tasks a file. Arrays in
    stores that Spark alone can open are one task a file."""
    if array and path.rpartition("://")[0] in json_arrays.SCHEMES:
        return json_arrays.read_array(spark, path, schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path, multiLine=array)


def flatten_events(docs: DataFrame, holders: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """The first non-null of the nested event arrays (``percussion.events``, ``drum.events``, ..), one row per event."""
    return docs.select(*keep, F.inline(F.coalesce(*[F.col(f"{h}.events") for h in holders])))


def read_results(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Result documents with ``file`` (the stem of the file's name); unreadable files go."""
    if not paths:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("file", T.StringType())]))
    bad = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(bad).option("columnNameOfCorruptRecord", "_corrupt").json(paths, multiLine=True, pathGlobFilter="*.json")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return rows.withColumn("file", name).where("_corrupt IS NULL").drop("_corrupt")


def _documents(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = uuid.uuid4().hex, 0
        where, name = json_arrays.located(f"{root}/{own}")
        where.create_dir(name)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                with where.open_output_stream(f"{name}/{own}-{n}.json") as f:
                    f.write(text.encode())
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{own}"])], names=["folder"])

    return write


def write_documents(df: DataFrame, path: str) -> list[str]:
    """Every row as a JSON document in a file of its own, written by all tasks; returns the folders below ``path`` that hold them.
    A task that is run again fills a new folder, and only the folders of tasks that were done are returned. Spark's writer takes
    milliseconds a file, as it commits each; it is used in stores that Spark alone can open."""
    spark = df.sparkSession
    df.write.json(f"{path}/rows")
    rows = spark.read.text(f"{path}/rows")
    n = rows.count()
    if n == 0:
        return []
    parts = max(min(n, spark.sparkContext.defaultParallelism), -(-n // DOCUMENTS))
    root = spark.read.format("binaryFile").load(f"{path}/rows").select("path").first().path.rpartition("/rows/")[0]  # with its scheme
    if root.partition(":")[0] not in json_arrays.SCHEMES:
        spark.read.schema(df.schema).json(f"{path}/rows").repartition(parts).write.option("maxRecordsPerFile", 1).json(f"{path}/documents")
        return [f"{path}/documents"]
    return [r.folder for r in rows.repartition(parts).mapInArrow(_documents(root), "folder string").collect()]


def discover_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = AUDIO) -> DataFrame:
    """path, length and modificationTime of files below ``path`` by extension in any case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return files.where(F.lower(F.substring_index("path", ".", -1)).isin(*extensions))


def track_info(path: Column) -> tuple[Column, Column]:
    """(artist, title) of ``Artist - Title.ext``; Unknown Artist without a separator."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    parts = F.split(stem, " - ", 2)
    two = F.size(parts) == 2
    return F.when(two, F.trim(parts[0])).otherwise("Unknown Artist"), F.when(two, F.trim(F.get(parts, F.lit(1)))).otherwise(stem)


def segment_pcm(chunks: DataFrame, start: int, stop: int) -> DataFrame:
    """Samples [start, stop) of every track: chunks by predicate, the two at the edges sliced."""
    n = F.size("samples")
    c = chunks.where((F.col("start_sample") < stop) & (F.col("start_sample") + n > start))
    a = F.greatest(F.lit(0), start - F.col("start_sample")).cast("int")
    z = F.least(n, (F.lit(stop) - F.col("start_sample")).cast("int"))
    return c.withColumn("samples", F.slice("samples", a + 1, z - a)).withColumn("start_sample", F.col("start_sample") + a)


def inspect_structure(df: DataFrame, column: str, sample: int | None = 100, examples: int = 3, order: str | None = None) -> DataFrame:
    """Per key of a JSON column and type of its value: count and up to ``examples`` values, of a sample or of all rows."""
    rows = df if sample is None else (df.orderBy(order) if order else df).limit(sample)
    kv = rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    kind = F.coalesce(F.schema_of_variant(F.try_parse_json("value")), F.lit("STRING"))
    return kv.withColumn("type", kind).groupBy("key", "type").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_set("value")), 1, examples).alias("examples"))


def write_results(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet, JSON or CSV; nested columns are flattened for CSV."""
    out = flatten_for_csv(df) if kind == "csv" else df
    writer = out.write.mode(mode).format(kind)
    (writer.option("header", True) if kind == "csv" else writer).save(path)


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Struct fields as ``parent_child`` columns; arrays and maps as JSON text."""

    def walk(fields, path: tuple[str, ...]):
        for f in fields:
            here = (*path, f.name)
            c = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType.fields, here)
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                yield F.to_json(c).alias("_".join(here))
            else:
                yield c.alias("_".join(here))

    return df.select(*walk(df.schema.fields, ()))


def versioned(df: DataFrame, version: str) -> DataFrame:
    """Rows stamped with version and major version."""
    return df.withColumn("version", F.lit(version)).withColumn("version_major", F.split(F.lit(version), r"\.")[0].cast("int"))


def save_versioned(df: DataFrame, path: str, version: str) -> None:
    versioned(df, version).write.mode("append").partitionBy("version_major").parquet(path)


def compatible(df: DataFrame, version: str) -> DataFrame:
    """Rows whose major version equals that of ``version``: a partition filter on saved tables."""
    return df.where(F.col("version_major") == int(version.split(".")[0]))


def list_results(df: DataFrame) -> DataFrame:
    return df.groupBy("version").agg(F.count(F.lit(1)).alias("n"))


def subsample(df: DataFrame, keys: list[str], idx: str, start: int, stop: int, factor: int, most: int) -> DataFrame:
    """Rows [start, stop) of each feature, every ``factor``-th, and if more than ``most`` are left every (n // most + 1)-th of these."""
    cut = df.where((F.col(idx) >= start) & (F.col(idx) < stop) & ((F.col(idx) - start) % factor == 0))
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    pos = F.row_number().over(w.orderBy(idx)) - 1
    out = cut.withColumn("_n", n).withColumn("_p", pos)
    step = F.when(F.col("_n") > most, F.floor(F.col("_n") / most) + 1).otherwise(1)
    return out.where(F.col("_p") % step == 0).drop("_n", "_p")


def downsample_even(df: DataFrame, keys: list[str], order: list[str], points: int) -> DataFrame:
    """The rows at floor(k (n-1) / (points-1)) of each series; series of at most ``points`` rows stay whole."""
    w = Window.partitionBy(*keys)
    x = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_p", F.row_number().over(w.orderBy(*order)) - 1)
    # row p is picked if some k of 0..points-1 maps to it
    k = F.ceil(F.col("_p") * (points - 1) / (F.col("_n") - 1))
    picked = F.floor(k * (F.col("_n") - 1) / (points - 1)) == F.col("_p")
    return x.where((F.col("_n") <= points) | picked).drop("_n", "_p")


def sample_rows(df: DataFrame, n: int = 10_000, id_col: str = "event_id") -> DataFrame:
    """A repeatable random sample: the n rows of least hash."""
    return df.orderBy(F.xxhash64(id_col), id_col).limit(n)


def index_analysis(metadata: DataFrame, summary: DataFrame, segments: DataFrame, features: DataFrame) -> DataFrame:
    """The components of analysed mixes as typed rows (mix_id, kind, body)."""
    parts = {"metadata": metadata, "summary": summary, "segment": segments, "features": features}
    rows = [df.select("mix_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in df.columns if c != "mix_id"])).alias("body")) for kind, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
