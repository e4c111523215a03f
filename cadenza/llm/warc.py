"""Operator 8: WARC archives with a two-level capture index.

``write_archives`` turns pages into WARC/1.1 records. Of records with equal payloads
of at least ``min_bytes`` the one with the largest id is a response, the others are
revisits of it. Each record is a gzip member of its own, so that it can be read by file,
offset and length of compressed bytes; files are closed at ``FILE_BYTES``. Spark's own
writer commits them, so a lost executor's files are written again.

``scan_archives`` finds the members of the files and checks the payload digests.
``build_index`` sorts the captures by reversed-host key into compressed blocks;
``directory`` has the first and last key of each, ``DIRECTORY`` entries at about most
(blocks grow with the table), so it can be broadcast. ``lookup`` searches it by
bisection for any table of keys and opens only the blocks that can hold one, and
``read_records`` reads the captures found by byte ranges.

A null payload counts as empty, a null URL as an empty one; line ends in a URL, which a
header cannot hold, are written ``%0D`` and ``%0A``, all else as it is. Repeated rows
give repeated records. An empty table gives empty archives. Only page_id, url and html
are read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import work_path

GAP = "\r\n\r\n"
FILE_BYTES = 64 << 20
DIRECTORY = 100_000
KEY_CHARS = 256  # of a key, in the directory
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
CAPTURES = f"{RECORD}, file string, offset long, length long"
_EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()


def classify(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to for each page.

    Equal payloads are found among ids, sizes and digests; verdicts of pages whose payload
    repeats come back by id and digest, so no payload's copies meet in one task.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8")))
    same = ["payload_digest", "payload_bytes"]
    narrow = rows.where(F.col("payload_bytes") >= min_bytes).select("page_id", *same)
    last = narrow.groupBy(*same).agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 AND last IS NOT NULL").drop("n")
    again = narrow.join(last, same).where("NOT page_id <=> last").select(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"), "last").distinct()
    met = rows.join(again, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("digest")), "left").drop("id", "digest")
    return met.withColumn("record_type", F.when(F.col("last").isNotNull(), "revisit").otherwise("response")).withColumnRenamed("last", "refers_to")


def _one_line(c: Column) -> Column:
    """Header values hold no line ends; all other characters stay as they are."""
    return F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A")


def record(date: Column) -> Column:
    """One WARC record from the columns of ``classify``."""
    payload = F.when(F.col("record_type") == "response", F.col("html")).otherwise(F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(GAP), payload)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: "), date,
        F.lit("\r\nWARC-Target-URI: "), _one_line(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(http).cast("string"), F.lit(GAP),
    )
    return F.concat(head, http, F.lit(GAP))


def _members(file_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records to gzip members without their last byte, which is 0 and comes as line separator, under numbered volumes."""
        volume, filled = 0, 0
        for batch in batches:
            members, volumes = [], []
            for raw in batch.column(0).cast(pa.large_binary()).to_pylist():
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(raw) + packer.flush()
                if data[-1]:  # ends with its size in little-endian: 16 MB and more; an empty member follows
                    data += _EMPTY_MEMBER
                if filled and filled + len(data) > file_bytes:
                    volume, filled = volume + 1, 0
                filled += len(data)
                members.append(data[:-1])
                volumes.append(volume)
            yield pa.RecordBatch.from_arrays([pa.array(volumes, pa.int32()), pa.array(members, pa.binary())], names=["volume", "value"])

    return rows


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, file_bytes: int = FILE_BYTES, date: Column | None = None) -> None:
    """Write WARC files of one gzip member a record below ``path``; ``date`` is the capture's time in ISO form (default: now)."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    records = classify(pages, min_bytes).select(record(now if date is None else date).alias("value"))
    members = records.mapInArrow(_members(file_bytes), "volume int, value binary")
    members.select("volume", F.col("value").cast("string").alias("value")).write.partitionBy("volume").option("lineSep", "\0").text(path)


def _filesystem(path: str):
    """(filesystem, path in it) of a folder that executors can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _parse(raw: bytes, where: str) -> tuple:
    """The facts of one record, in the order of ``RECORD``; a response's payload is held against its digest."""
    end = raw.index(b"\r\n\r\n")
    head = dict(x.split(b": ", 1) for x in raw[:end].split(b"\r\n")[1:])
    block = raw[end + 4 : end + 4 + int(head[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    kind, digest = head[b"WARC-Type"].decode(), head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{where}: the record does not match its digest")
    number = lambda v: int(v[10:-1]) if v and len(v) > 11 else None
    return number(head[b"WARC-Record-ID"]), head[b"WARC-Target-URI"].decode(), size, digest, kind, number(head.get(b"WARC-Refers-To"))


def _scan(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a file, read in parts; empty members belong to the one before."""
    offset, held, found = 0, b"", None
    while True:
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not held:
                held = stream.read(1 << 20)
                if not held:
                    break
            parts.append(unpacker.decompress(held))
            used += len(held) - len(unpacker.unused_data)
            held = unpacker.unused_data
        content = b"".join(parts)
        if content or not used:
            if found:
                yield found
            if not used:
                return
            found = (offset, used, content)
        else:
            found = (found[0], found[1] + used, found[2])
        offset += used


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.strip().split() for f in schema.split(",")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below ``path``: ids, digests, type, file, offset and length of compressed bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                at = _filesystem(name)[1]
                file = "/".join(at.rsplit("/", 2)[-2:])
                with store.open_input_stream(at) as stream:
                    held = []
                    for offset, length, raw in _scan(stream):
                        held.append((*_parse(raw, f"{file} at {offset}"), file, offset, length))
                        if len(held) == 5000:
                            yield _table(held, CAPTURES)
                            held = []
                    yield _table(held, CAPTURES)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path")
    return files.mapInArrow(rows, CAPTURES)


def read_records(captures: DataFrame, path: str) -> DataFrame:
    """The records of captures (file, offset, length), each by one range read of an archive below ``path``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(path)
        name, source = None, None
        for batch in batches:
            held = []
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if file != name:
                    if source:
                        source.close()
                    name, source = file, store.open_input_file(f"{root.rstrip('/')}/{file}")
                source.seek(offset)
                held.append(_parse(zlib.decompressobj(31).decompress(source.read(length)), f"{file} at {offset}"))
            yield _table(held, RECORD)
        if source:
            source.close()

    near = captures.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return near.mapInArrow(rows, RECORD)


def surt(url: Column) -> Column:
    """Reversed-host key: ``http://a.b.org/x`` becomes ``org,b,a)/x``; lower-case host."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host, tail = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)


def build_index(captures: DataFrame, path: str, per_block: int = 500) -> DataFrame:
    """Blocks (no, first, last, n, block): captures sorted by key, ``per_block`` or more to a compressed block.

    The range partitions break ties of hot keys by page id, so one host's captures spread over many.
    """
    spark = captures.sparkSession
    keyed = captures.withColumn("key", surt(F.col("url")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_block = max(per_block, -(-captures.count() // DIRECTORY))
    ordered = keyed.repartitionByRange(n, "key", "page_id", "offset").sortWithinPartitions("key", "page_id", "offset")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        number = TaskContext.get().partitionId() << 32

        def block(rows: list[dict]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            data = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in rows).encode())
            return pa.RecordBatch.from_pydict({"no": pa.array([number], pa.int64()), "first": [rows[0]["key"]], "last": [rows[-1]["key"]], "n": pa.array([len(rows)], pa.int32()), "block": pa.array([data], pa.binary())})

        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= per_block:
                yield block(held[:per_block])
                held = held[per_block:]
        if held:
            yield block(held)

    schema = "no long, first string, last string, n int, block binary"
    ordered.mapInArrow(pack, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def directory(blocks: DataFrame) -> tuple[list[str], list[str], list[int]]:
    """The sparse directory: first key, last key and number of each block, in order. ``build_index`` bounds the entries, and keys
    are cut to ``KEY_CHARS``, which keeps their order, so its bytes are bounded as well."""
    cut = lambda c: F.substring(c, 1, KEY_CHARS)
    rows = sorted((r.first_key, r.last_key, r.no) for r in blocks.select(cut("first").alias("first_key"), cut("last").alias("last_key"), "no").collect())
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def unpack(blocks: DataFrame) -> DataFrame:
    """The captures in index blocks, with their key."""
    schema = CAPTURES + ", key string"
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
                yield _table([tuple(r.get(c) for c in names) for r in found], schema)

    return blocks.select("block").mapInArrow(rows, schema)


def lookup(blocks: DataFrame, entries: tuple[list[str], list[str], list[int]], keys: DataFrame) -> DataFrame:
    """Captures of the keys in column ``key`` of a table of any size: binary search in the directory, then only the blocks
    that can hold one of them. Keys that are equal up to ``KEY_CHARS`` share their blocks; the join tells them apart."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(entries)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, no = shared.value
        seen: set[int] = set()
        cuts: set[str] = set()  # of keys that are longer
        for batch in batches:
            for key in batch.column(0).to_pylist():
                k = key[:KEY_CHARS]
                if len(key) > KEY_CHARS:
                    if k in cuts:
                        continue
                    cuts.add(k)
                i = bisect.bisect_left(last, k)
                while i < len(no) and first[i] <= k:
                    seen.add(no[i])
                    i += 1
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], names=["no"])

    wanted = keys.where("key IS NOT NULL").select("key").distinct()
    hits = wanted.mapInArrow(rows, "no long").distinct()
    return unpack(blocks.join(hits, "no", "left_semi")).join(wanted, "key", "left_semi")


def url_key(url: Column) -> Column:
    """The index key of a page's URL as ``write_archives`` writes it."""
    return surt(_one_line(F.coalesce(url.cast("string"), F.lit(""))))


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write the pages' archives and index below the shared folder, then look every page's URL up and read its captures."""
    spark = pages.sparkSession
    archives = work_path(spark, "warc")
    write_archives(pages, archives, min_bytes)
    blocks = build_index(scan_archives(spark, archives), work_path(spark, "captures"))
    return read_records(lookup(blocks, directory(blocks), pages.select(url_key(F.col("url")).alias("key"))), archives)
