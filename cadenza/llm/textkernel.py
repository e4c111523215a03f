"""Vectorised text work inside Arrow tasks: chunks of documents as byte arrays, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 20
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and extended by doubling."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of table values times powers: the hash of [a, b) is ``(p[b]-p[a]) * inverse**a``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [a, b) for arrays of bounds."""
    raw = (sums[b] - sums[a]) * powers(_INVERSE, len(sums))[a]
    return mix(raw + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chunks(batch: pa.RecordBatch, text_at: int, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of documents of about ``limit`` bytes; null texts are empty.

    A document is never divided, so a chunk is as large as its largest document at least.
    """
    col = batch.column(text_at).cast(pa.large_binary())
    n = len(col)
    if n == 0:
        return
    if col.null_count:
        col = col.fill_null(b"")
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, separates: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of non-separators; runs end where documents do."""
    inside = ~separates[data]
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lowered_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word, A-Z lower-cased."""
    starts, ends, doc = words(data, offsets)
    return span_hash(prefix_sums(LOWER[data]), starts, ends), doc


def shingle_hashes(word: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of k words of one document; of all its words where it has 1 to k-1."""
    n = len(word)
    if n == 0:
        return word, doc
    out_h, out_d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= k:
        m = n - k + 1
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h = mix(h * np.uint64(0x100000001B3) + word[j : j + m])
        whole = doc[:m] == doc[k - 1 :]
        out_h, out_d = h[whole], doc[:m][whole]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    for a, c in zip(first[size < k], size[size < k], strict=True):
        h = np.full(1, c, np.uint64)
        for j in range(c):
            h = mix(h * np.uint64(0x100000001B3) + word[a + j : a + j + 1])
        out_h, out_d = np.concatenate([out_h, h]), np.concatenate([out_d, doc[a : a + 1]])
    order = np.argsort(out_d, kind="stable")
    return out_h[order], out_d[order]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each document (empty without words)."""
    h, d = shingle_hashes(*lowered_words(data, offsets), k)
    cut = np.searchsorted(d, np.arange(len(offsets)))
    return [np.unique(h[cut[i] : cut[i + 1]]) for i in range(len(offsets) - 1)]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        z = [pa.compress(r, codec="zstd", asbytes=True) if r else b"" for r in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary()), pa.array([len(r) for r in raw], pa.int64())], names=["doc_id", "z", "size"])


def packed(texts: DataFrame) -> DataFrame:
    """doc_id, z, size of (doc_id, text): compressed bytes, so that half as much goes through a shuffle."""
    return texts.select("doc_id", "text").mapInArrow(_pack, "doc_id long, z binary, size long")


def unpack(z: pa.Array, size: pa.Array) -> pa.Array:
    """The texts of ``packed`` rows as bytes."""
    return pa.array([pa.decompress(a, n, codec="zstd", asbytes=True) if n else b"" for a, n in zip(z.to_pylist(), size.to_pylist(), strict=True)], pa.large_binary())
