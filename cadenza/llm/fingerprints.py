"""Document fingerprints by locally consistent parsing.

A text is parsed bottom-up. On each level runs of one symbol become a symbol; then
deterministic coin tossing (the lowest bit in which a symbol differs from the one before
it, thrice, so that labels are below 6) picks local maxima as phrase starts, and each
phrase's name, a hash of its symbols, is a symbol of the next level. Where a phrase
starts depends on a few symbols around it alone, so equal substrings get equal names
inside, wherever they lie. The fingerprint keeps least hashes of the names of the
levels ``LEVELS``, whose phrases have about 10 and 30 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .textkernel import mix

LEVELS = (2, 3)
#: Bins of the sketch, a byte each.
BINS = 128
#: Bytes of texts that are parsed at once; a longer text is parsed alone.
CHUNK = 2 << 20

_rng = np.random.default_rng(20240301)
#: Name of each byte, and factors by place within a phrase (longer phrases repeat them with another multiplier).
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For bin i, the order in which an empty bin asks the others.
_ASK = np.stack([_rng.permutation(BINS) for _ in range(BINS)], 1)


def _toss(symbols: int) -> np.ndarray:
    """Label of (symbol before, symbol) for small symbols: twice the lowest bit that differs, plus that bit of the symbol."""
    a, b = np.meshgrid(np.arange(symbols), np.arange(symbols), indexing="ij")
    x = a ^ b
    low = np.where(x > 0, np.log2(np.maximum(x & -x, 1)).astype(np.int64), 0)
    return (2 * low + (b >> low & 1)).astype(np.uint8).ravel()


_TOSS8, _TOSS7, _TOSS4 = _toss(256), _toss(128), _toss(16)


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 of symbols (bytes or 64-bit names) by three tosses; neighbours differ where the symbols do. ``first`` are
    the starts of texts, which have nothing before them."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = symbols[first] ^ symbols.dtype.type(1)
    if symbols.dtype == np.uint8:
        label = _TOSS8[before.astype(np.uint16) << 8 | symbols]
    else:
        x = before ^ symbols
        low = np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1
        low[x == 0] = 0
        label = (2 * low + (symbols >> low.astype(np.uint64) & np.uint64(1)).astype(np.int64)).astype(np.uint8)
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        label = _TOSS7[before.astype(np.uint16) << 7 | label]
    for _ in range(2 if symbols.dtype == np.uint8 else 1):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        label = _TOSS4[before.astype(np.uint16) << 4 | label]
    return label


def _level(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's (names, offsets) of texts, none of them empty."""
    # runs of one symbol
    new = np.empty(len(symbols), bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[offsets[:-1]] = True
    at = np.flatnonzero(new)
    names = _BYTE[symbols] if symbols.dtype == np.uint8 else symbols
    if len(at) < len(symbols):
        length = np.diff(np.append(at, len(symbols)))
        symbols, names = symbols[at], names[at]
        runs = length > 1
        names[runs] = mix(names[runs] + length[runs].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if symbols.dtype != np.uint8:
            symbols = names
        offsets = np.searchsorted(at, offsets)
    # phrases start at texts' starts and at local maxima of the labels
    label = _labels(symbols, offsets[:-1])
    start = np.zeros(len(label), bool)
    start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    start[offsets[1:] - 1] = False  # has nothing after it
    start[offsets[:-1]] = True
    at = np.flatnonzero(start)
    length = np.diff(np.append(at, len(label)))
    place = np.arange(len(label)) - np.repeat(at, length)
    factor = _PLACE[place & 63] if int(length.max()) <= 64 else _PLACE[place & 63] * (2 * (place >> 6).astype(np.uint64) + np.uint64(1))
    phrases = mix(np.add.reduceat(mix(names) * factor, at) + length.astype(np.uint64))
    return phrases, np.searchsorted(at, offsets)


def parse(data: np.ndarray, offsets: np.ndarray, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, offsets) of each level from 1, of texts that are not empty, given as bytes one after the other."""
    out, symbols = [], data
    for _ in range(levels):
        symbols, offsets = _level(symbols, offsets)
        out.append((symbols, offsets))
    return out


def sketches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, BINS) bytes: each bin has the last byte of the least hash of the names that fall into it; empty bins take another's."""
    n = len(offsets) - 1
    least = np.full((n, BINS), np.iinfo(np.uint64).max, np.uint64)
    for k, (names, cuts) in enumerate(parse(data, offsets, max(LEVELS)), 1):
        if k in LEVELS:
            h = mix(names + np.uint64(k))
            cell = np.repeat(np.arange(n), np.diff(cuts)) * BINS + (h % np.uint64(BINS)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            cell, h = cell[order], h[order]
            at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            flat = least.reshape(-1)
            flat[cell[at]] = np.minimum(flat[cell[at]], np.minimum.reduceat(h, at))
    full = least != np.iinfo(np.uint64).max
    out = mix(least)
    row, bin_ = np.nonzero(~full)
    for ask in _ASK:
        if not len(row):
            break
        other = ask[bin_]
        found = full[row, other]
        out[row[found], bin_[found]] = mix(least[row[found], other[found]])
        row, bin_ = row[~found], bin_[~found]
    return (out & np.uint64(255)).astype(np.uint8)


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints in hex; '' for empty texts."""
    out = [""] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    a = 0
    while a < len(some):
        b, size = a, 0
        while b < len(some) and (b == a or size + len(texts[some[b]]) <= CHUNK):
            size += len(texts[some[b]])
            b += 1
        part = [texts[i] for i in some[a:b]]
        found = sketches(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in part])]))
        for i, row in zip(some[a:b], found, strict=True):
            out[i] = row.tobytes().hex()
        a = b
    return out


def likeness(a: str, b: str) -> float:
    """The share of equal bins, less what chance gives: an estimate of the Jaccard similarity of the texts' phrases. 1 for equal
    fingerprints, 0 if one text alone is empty."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    same = np.count_nonzero(np.frombuffer(bytes.fromhex(a), np.uint8) == np.frombuffer(bytes.fromhex(b), np.uint8)) / BINS
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


MADE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ROWS = f"{MADE}, part int, first boolean, last boolean, text string"


def _made(rows: list[tuple], following: list[tuple[str, str]]) -> dict[str, list]:
    """Columns of ``MADE`` for (doc_id, text, fingerprint) rows, with the text and the fingerprint that follow each."""
    new = [edited(t, f).encode() for (_, t, _), (f, _) in zip(rows, following, strict=True)]
    marks = fingerprints(new)
    return {
        "doc_id": [r[0] for r in rows],
        "n_chars": [len(r[1]) for r in rows],
        "edited_sha256": [hashlib.sha256(x).hexdigest() for x in new],
        "fingerprint": [r[2] for r in rows],
        "edited_fingerprint": marks,
        "near_edited": [likeness(r[2], m) for r, m in zip(rows, marks, strict=True)],
        "near_next": [likeness(r[2], f) for r, (_, f) in zip(rows, following, strict=True)],
    }


def _types(spec: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in spec.split(", "))])


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range of ids in order. Each is finished once the next is seen; the range's first and last are also given with
    their texts, the last unfinished."""
    part, schema = TaskContext.get().partitionId(), _types(ROWS)
    held: tuple | None = None
    first = True
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a in range(0, len(ids), 2000):
            t = texts[a : a + 2000]
            now = list(zip(ids[a : a + 2000], t, fingerprints([x.encode() for x in t]), strict=True))
            if first:
                yield pa.RecordBatch.from_pylist([{"doc_id": now[0][0], "fingerprint": now[0][2], "part": part, "first": True, "last": False, "text": now[0][1]}], schema)
                first = False
            rows = [*([held] if held else []), *now]
            held = rows[-1]
            if len(rows) > 1:
                made = _made(rows[:-1], [r[1:] for r in rows[1:]])
                n = len(rows) - 1
                made |= {"part": [part] * n, "first": [False] * n, "last": [False] * n, "text": [None] * n}
                yield pa.RecordBatch.from_pydict(made, schema)
    if held:
        yield pa.RecordBatch.from_pylist([{"doc_id": held[0], "fingerprint": held[2], "part": part, "first": False, "last": True, "text": held[1]}], schema)


def _at_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, marks, next_texts, next_marks = (batch.column(i).to_pylist() for i in range(5))
        yield pa.RecordBatch.from_pydict(_made(list(zip(ids, texts, marks, strict=True)), list(zip(next_texts, next_marks, strict=True))), _types(MADE))


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every (doc_id, text).

    The next document is that of the next larger doc_id; after the last comes the
    first, so a lone document follows itself. Null texts are empty. Rows without an id
    come first; rows of one id are ordered by a hash of the text. An empty table gives
    no rows. Texts are shuffled once, into ranges of ids; a range's last row meets the
    next range's first by a join of one row a range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = materialise(ranged.mapInArrow(_along, ROWS), "fingerprints")
    columns = [f.split()[0] for f in MADE.split(", ")]
    done = made.where("NOT first AND NOT last").select(*columns)
    borders = made.where("first").select("part").distinct()  # one row a range
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    follows = borders.select("part", after.alias("after"))
    heads = made.where("first").select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    last = made.where("last").join(follows, "part").join(heads, "after").select("doc_id", "text", "fingerprint", "next_text", "next_mark")
    return done.unionByName(last.mapInArrow(_at_borders, MADE))
