"""Operator 4: best-fit packing with certified bounds.

``token_pieces`` tokenises every document, appends the end id and cuts only what is
longer than a sequence. ``pack`` deals the pieces by hash into groups of bounded
size, packs each by best-fit decreasing and certifies its number of bins with
dual-feasible-function lower bounds; groups above their bound release their loosest
bins, whose pieces meet those of other groups, are packed again (the better of the old
and the new bins stays) and certified again, for ``ROUNDS`` exchanges or until no gap is
left. ``certified_gap`` says of each piece how many bins above its bound the packing is
that its sequence comes from.

A null text is empty: one piece with the end id alone. Repeated rows give repeated
pieces. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SPECIAL = "<|endoftext|>"
CACHED = 400_000
ROUNDS = 3
_RUN = re.compile(r" (?:\s|\Z)")
PIECES = "piece int, start long, length long, ids_crc32 long"


class ByteEncoder:
    """Ids of a byte-level BPE as little-endian 32-bit bytes, remembered by space-led chunk.

    The vocabulary's pattern never joins what precedes a single space and a
    non-space, so chunks are encoded on their own. Texts that hold the special
    token's string go through the tokenizer itself.
    """

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json_path, self.known, self.whole = json_path, {}, None
        self.plain = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json_path)
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        if not text:
            return b""
        parts = text.split(" ")
        if _RUN.search(text):
            chunks = parts[:1]
            for p in parts[1:]:
                if not p or p[0].isspace():  # a space that white space or the end follows stays with the chunk before
                    chunks[-1] += " " + p
                else:
                    chunks.append(" " + p)
        else:
            chunks = [parts[0], *[" " + p for p in parts[1:]]]
        known = self.known
        if len(known) > CACHED:
            known.clear()
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            for c in chunks:
                if c not in known:
                    known[c] = np.array(self.plain.encode_ordinary(c), "<u4").tobytes()
            return b"".join([known[c] for c in chunks])


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only a longer one is cut, and its first piece may be short."""
    n = len(ids) // 4
    count = max(1, -(-n // capacity))
    first = n - capacity * (count - 1)
    start = 0
    for k in range(count):
        length = first if k == 0 else capacity
        yield k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start += length


_encoders: dict[str, ByteEncoder] = {}


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, materialised."""
    end = int(end_id).to_bytes(4, "little")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if json_path not in _encoders:  # kept by the worker process: later tasks know the chunks of earlier ones
            _encoders[json_path] = ByteEncoder(json_path, ranks_path)
        encoder = _encoders[json_path]
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for p in cut(encoder.encode(text or "") + end, capacity):
                    at.append(i)
                    found.append(p)
            cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, f"doc_id {kind}, {PIECES}")
    return materialise(out, "pieces")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of three families of dual feasible functions over the lengths: no packing has fewer bins."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, 21):  # x -> floor((k+1)x/C)/k, and x itself where (k+1)x/C is whole
        scaled = (k + 1) * x
        f = np.where(scaled % capacity == 0, k * x, capacity * (scaled // capacity))
        best = max(best, -(-int((count * f).sum()) // (capacity * k)))
    total, n = np.cumsum(count * x), np.cumsum(count)
    for e in range(1, capacity // 2 + 1):  # over C-e: 1; under e: 0
        large = n[-1] - n[capacity - e]
        middle = total[capacity - e] - total[e - 1]
        best = max(best, int(large) + -(-int(middle) // capacity))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: (bin, offset) of each item, and the number of bins."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_spaces, used = 0, 0  # one bit per space that some bin has left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_spaces >> size
        if fits:
            space = size + ((fits & -fits).bit_length() - 1)
            b = by_space[space].pop()
            if not by_space[space]:
                open_spaces ^= 1 << space
        else:
            space, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - space
        left = space - size
        if left:
            if not by_space[left]:
                open_spaces |= 1 << left
            by_space[left].append(b)
    return bins, offsets, used


def _released(lengths: np.ndarray, bins: np.ndarray, used: int, capacity: int) -> tuple[int, np.ndarray]:
    """The gap between the bins used and their lower bound, and of each item whether its bin is released: the loosest bins,
    which hold the gap's space several times over."""
    gap = used - lower_bound(lengths, capacity)
    loose = np.zeros(used, bool)
    if gap > 0:
        loose[np.argsort(np.bincount(bins, lengths, minlength=used), kind="stable")[: min(used, 8 * gap + 8)]] = True
    return gap, loose[bins]


def _pack_group(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Best-fit decreasing of a group; where its pieces have bins already, the better of the two packings."""
        order = np.argsort(pd.util.hash_pandas_object(pdf[["doc_id", "piece", "ids_crc32"]], index=False).to_numpy(), kind="stable")
        pdf = pdf.iloc[order]
        lengths = pdf["length"].to_numpy()
        bins, offsets, used = best_fit(lengths, capacity)
        if pdf["bin"].iloc[0] >= 0:
            old = pdf.groupby(["grp", "bin"], sort=False).ngroup().to_numpy()
            if used > old.max() + 1:
                bins, offsets, used = old, pdf["offset"].to_numpy(), int(old.max()) + 1
        gap, released = _released(lengths, bins, used, capacity)
        return pdf.assign(grp=pdf["again"], bin=bins, offset=offsets, certified_gap=gap, released=released)

    return run


def pack(pieces: DataFrame, capacity: int = 2048, per_group: int = 50_000, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with sequence_id, offset and certified_gap. Groups are dealt by hash, so none outgrows a task."""
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {PIECES}, grp int, bin long, offset long, certified_gap long, released boolean, again int"
    n_groups = max(1, -(-pieces.count() // per_group))
    dealt = pieces.withColumn("again", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_groups)).cast("int"))
    blank = dealt.withColumns({"grp": F.lit(-1), "bin": F.lit(-1).cast("long"), "offset": F.lit(0).cast("long"), "certified_gap": F.lit(0).cast("long"), "released": F.lit(False)})
    out = None
    for step in range(rounds + 1):
        now = materialise(blank.groupBy("again").applyInPandas(_pack_group(capacity), schema), "packed")
        loose = now.where("released")
        n_loose = loose.count() if step < rounds else 0
        number = F.shiftleft(F.col("grp").cast("long") * (rounds + 1) + F.lit(step), 32) + F.col("bin")
        done = (now.where("NOT released") if n_loose else now).withColumn("sequence_id", number).select(*pieces.columns, "offset", "sequence_id", "certified_gap")
        out = done if out is None else out.unionByName(done)
        if not n_loose:
            break
        # whole bins are dealt, so each new group knows how many bins it replaces
        blank = loose.withColumn("again", F.pmod(F.xxhash64("grp", "bin", F.lit(step)), F.lit(max(1, -(-n_loose // per_group)))).cast("int"))
    return out
