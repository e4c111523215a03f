"""A splittable reader of files that are one large JSON array each.

Files are read in byte ranges. A first pass folds each range into what it does to the
reader's state, from each state it could begin in: outside strings, in a string, or
behind a backslash there; and by how much nesting changes. These few numbers a range are
composed along each file, which gives every range its true first state, so that the
second pass finds records exactly, whatever strings and nested arrays hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

RANGE = 16 << 20
OUTSIDE, STRING, ESCAPED = 0, 1, 2
#: Stores that tasks open by themselves; files elsewhere are read by Spark, one task a file.
SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")

_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


def located(path: str) -> tuple:
    """(file system, name there) of a path below any file system that pyarrow knows."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme in ("file", "") or not rest:
        return fs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))


def read_range(path: str, offset: int, length: int) -> bytes:
    where, name = located(path)
    with where.open_input_file(name) as f:
        return f.read_at(length, offset)


def scan(data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(in a string, change of nesting) of every byte, and the state after the last, from a first state."""
    if state == ESCAPED:  # as if the backslash were here
        inside, steps, end = scan(np.concatenate([np.array([92], np.uint8), data]), STRING)
        return inside[1:], steps[1:], end
    at = np.arange(len(data))
    slash = data == 92
    plain = np.maximum.accumulate(np.where(slash, -1, at)) if len(data) else at  # the last byte that is no backslash
    before = np.concatenate([[0], (at - plain)[:-1]]) if len(data) else at  # backslashes right before each byte
    quote = (data == 34) & (before % 2 == 0)
    inside = (np.cumsum(quote) + (state == STRING)) % 2 == 1
    steps = np.where(inside, 0, _STEP[data])  # a closing quote counts as outside; it has no step
    if not len(data) or not inside[-1]:
        return inside, steps, OUTSIDE if len(data) else state
    return inside, steps, ESCAPED if slash[-1] and (at[-1] - plain[-1]) % 2 == 1 else STRING


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, offset, length in zip(pdf["path"], pdf["offset"], pdf["length"], strict=True):
            data = np.frombuffer(read_range(path, offset, length), np.uint8)
            each = [scan(data, s) for s in (OUTSIDE, STRING, ESCAPED)]
            out.append((path, offset, length, [e for _, _, e in each], [int(s.sum()) for _, s, _ in each]))
        yield pd.DataFrame(out, columns=["path", "offset", "length", "ends", "steps"])


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, offset, length, state, depth in zip(pdf["path"], pdf["offset"], pdf["length"], pdf["state"], pdf["depth"], strict=True):
            raw, more = read_range(path, offset, length), 1 << 20
            while True:
                data = np.frombuffer(raw, np.uint8)
                inside, steps, _ = scan(data, state)
                level = depth + np.cumsum(steps)
                first = np.flatnonzero((data == 123) & ~inside & (level == 2))
                last = np.flatnonzero((data == 125) & ~inside & (level == 1))
                own = first[first < length]
                ends = last[np.searchsorted(last, own)] if len(own) and len(last) and last[-1] > own[-1] else None
                if not len(own) or ends is not None:
                    break
                tail = read_range(path, offset + len(raw), more)  # the last record goes on
                if not tail:
                    own = own[: len(last)] if len(last) else own[:0]  # the file ends within it
                    own = own[own < (last[-1] if len(last) else 0)]
                    ends = last[np.searchsorted(last, own)]
                    break
                raw, more = raw + tail, more * 2
            for a in range(0, len(own), 5000):
                yield pd.DataFrame({"record": [raw[x : y + 1].decode("utf-8", "replace") for x, y in zip(own[a : a + 5000], ends[a : a + 5000], strict=True)]})


def _dealt(each: DataFrame) -> DataFrame:
    """Ranges dealt evenly: rows are a few bytes, but their work is not, so that a number is given and no partitions are merged."""
    return each.repartition(min(max(each.count(), 1), 8 * each.sparkSession.sparkContext.defaultParallelism))


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, offset, length, state, depth): byte ranges of all files below ``path`` with the state that each begins in."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    each = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("offset"))
    each = each.select("path", "offset", F.least(F.lit(size), F.col("bytes") - F.col("offset")).cast("long").alias("length")).where("length > 0")
    effects = _dealt(each).mapInPandas(_effects, "path string, offset long, length long, ends array<int>, steps array<long>")
    effects = written(effects, "json-ranges")
    order = Window.partitionBy("path").orderBy("offset")
    before = F.collect_list(F.struct("ends", "steps")).over(order.rowsBetween(Window.unboundedPreceding, -1))  # a few numbers a range of one file
    start = F.struct(F.lit(OUTSIDE).alias("state"), F.lit(0).cast("long").alias("depth"))
    at = F.aggregate(before, start, lambda s, x: F.struct(x["ends"][s["state"]].alias("state"), (s["depth"] + x["steps"][s["state"]]).alias("depth")))
    return effects.withColumn("at", at).select("path", "offset", "length", "at.state", "at.depth")


def read_array(spark: SparkSession, path: str, schema: T.StructType, size: int = RANGE) -> DataFrame:
    """The objects of files that are one JSON array each, by many tasks a file; other elements of the array are left out, a record
    that does not fit the schema has nulls."""
    return _dealt(ranges(spark, path, size)).mapInPandas(_records, "record string").select(F.from_json("record", schema).alias("r")).select("r.*")
