"""Operator 5: removal of repeated 100-byte strings with a logarithmic family of suffix arrays.

A text's suffixes are sampled where every window of ``WINDOW`` bytes has its least
``SEED``-byte hash (leftmost on ties), so equal windows sample the same suffix, and a
suffix stands for the run of windows that chose it. A suffix array is the table of
sampled suffixes in the order of (seed hash, hash of the run's bytes): suffixes with
long common parts are neighbours. The index is a family of such arrays: a batch of
newer documents gets its own array and is merge-scanned with the existing levels (one
sorted pass over batch and levels); a level as large as the batch becomes one level
with it, of the next rank, in that same pass, and so on up.

The scan settles whole runs: an equal run that starts earlier makes all its windows
repeats. Runs that share only their seed are compared window by window, which is
exact at the ends of matches. What repeats inside one task is settled there, so a
passage of any number of copies sends one suffix per task; a seed with more than
``HOT`` different surroundings is dealt out by its windows.

Matches lie within documents; a null or empty text has no bytes. Earlier means a
smaller id, or the same document and an earlier start. Rows of one id with different
texts are documents of their own, in the order of their texts' hashes; rows without an
id come after all others; rows equal in id and text are one document, kept or cut
alike. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .textkernel import chunks, packed, prefix_sums, span_hash, unpack

WINDOW = 100
SEED = 36  # long enough that prose seldom repeats one by chance
HELD = 600_000  # suffixes held by a task before it settles repeats among them
HOT = 1000  # runs of one seed that one task compares at most
#: Shares of the documents after which a new batch begins, and the ranks of the batches: each is as large as all before it.
BATCHES = (0.125, 0.25, 0.5)
RANKS = (0, 0, 1, 2)


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[j:j+width] for each j, by doubling."""
    span, y = 1, x
    while 2 * span <= width:
        y = op(y[:-span], y[span:])
        span *= 2
    rest = width - span
    return op(y[: len(y) - rest], y[rest:]) if rest else y


def sample(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(seed hash, run hash, document, first window, last window) of every sampled suffix; places in the chunk."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < WINDOW:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    sums = prefix_sums(data)
    at = np.arange(n - SEED + 1)
    seed = span_hash(sums, at, at + SEED)
    width = WINDOW - SEED + 1
    least = _sliding(seed, width, np.minimum)  # of the window that starts at j
    starts, ends = offsets[:-1], offsets[1:]
    mark = np.zeros(n + 1, np.int32)
    whole = ends - starts >= WINDOW
    np.add.at(mark, starts[whole], 1)
    np.add.at(mark, ends[whole] - WINDOW + 1, -1)
    valid = np.cumsum(mark)[: n - WINDOW + 1] > 0
    windows = np.flatnonzero(valid)
    if not len(windows):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    value = least[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (value[1:] != value[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = windows[new]
    last = windows[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(windows) - 1]])]
    value = value[new]
    # a place is sampled if it is the least of some valid window, that is of the one whose least is greatest
    padded = np.zeros(n - SEED + 1 + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(least)] = np.where(valid, least, 0)
    picked = np.flatnonzero((_sliding(padded, width, np.maximum) == seed) & (seed > 0))
    run = np.searchsorted(first, picked, "right") - 1
    off = np.flatnonzero(value[run] != seed[picked])
    while len(off):
        run[off] -= 1
        off = off[value[run[off]] != seed[picked[off]]]
    lo, hi = np.maximum(first[run], picked - width + 1), np.minimum(last[run], picked)
    tie = np.zeros(len(picked), bool)  # the left of two equal seeds has the windows that hold both
    tie[1:] = (seed[picked[1:]] == seed[picked[:-1]]) & (picked[:-1] >= lo[1:])
    lo[tie] = picked[np.flatnonzero(tie) - 1] + 1
    keep = lo <= hi
    picked, lo, hi = picked[keep], lo[keep], hi[keep]
    runs = span_hash(sums, lo, hi + WINDOW) + (picked - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    doc = np.searchsorted(offsets, lo, "right") - 1
    return seed[picked], runs, doc, lo - offsets[doc], hi - offsets[doc]


def _merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted, merged spans per document."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    reach = np.maximum.accumulate(b + np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * (1 << 40))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (a[1:] > reach[:-1] - np.cumsum(doc[1:] != doc[:-1]) * (1 << 40))
    at = np.flatnonzero(new)
    return doc[at], a[at], np.maximum.reduceat(b, at)


_ROWS = "kmer long, run long, doc_id long, lo long, n int"


def _rows(kmer, run, doc, lo, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kmer.view(np.int64)), pa.array(run.view(np.int64)), pa.array(doc), pa.array(lo), pa.array(n.astype(np.int32))], names=["kmer", "run", "doc_id", "lo", "n"])


def _settle(key1: np.ndarray, key2: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of equal keys only the earliest goes on (n = its windows); the others are repeats: spans with n = -1 and their end as run."""
    order = np.lexsort((lo, doc, key2, key1))
    key1, key2, doc, lo, hi = key1[order], key2[order], doc[order], lo[order], hi[order]
    new = np.ones(len(doc), bool)
    new[1:] = (key1[1:] != key1[:-1]) | (key2[1:] != key2[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc != doc[head]) | (lo != lo[head])
    yield _rows(key1[new], key2[new], doc[new], lo[new], (hi - lo + 1)[new])
    d, a, b = _merged(doc[later], lo[later], hi[later] + WINDOW)
    # spread by place, so that repeats of one passage do not meet in one task
    yield _rows(span_key(d, a), b.astype(np.int64), d, a, np.full(len(d), -1))


def span_key(doc: np.ndarray, a: np.ndarray) -> np.ndarray:
    x = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + a.astype(np.uint64)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for first, _, data, offsets in chunks(batch, 1):
            kmer, run, doc, lo, hi = sample(data, offsets)
            held.append((kmer, run, ids[first + doc].astype(np.int64), lo, hi))
            if sum(len(h[0]) for h in held) > HELD:
                yield from _settle(*map(np.concatenate, zip(*held, strict=True)))
                held = []
    if held:
        yield from _settle(*map(np.concatenate, zip(*held, strict=True)))


_CONTEXTS = "kmer long, doc_id long, lo long, n int, context binary"


def _hot_windows(kmer: list[int], doc: list[int], lo: list[int], part: list[bytes]) -> tuple[list, list, list, list, list]:
    """Columns of ``_CONTEXTS`` for runs of hot seeds: each window under a key of its own. Of windows that are equal within
    the batch only the earliest goes on, the others are spans (n is less than 0: their length)."""
    n = np.array([len(x) - WINDOW + 1 for x in part])
    data = np.frombuffer(b"".join(part), np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum([0, *map(len, part)])[:-1], n) + step
    h = span_hash(prefix_sums(data), at, at + WINDOW) ^ np.array(kmer, np.int64).view(np.uint64)[row]
    d, j = np.array(doc, np.int64)[row], np.array(lo, np.int64)[row] + step
    order = np.lexsort((j, d, h))
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = order[(d[order] != d[head]) | (j[order] != j[head])]
    first = order[new]
    sd, sa, sb = _merged(d[later], j[later], j[later] + WINDOW)
    windows = [data[x : x + WINDOW].tobytes() for x in at[first].tolist()]
    keys = np.concatenate([h[first], span_key(sd, sa)]).view(np.int64).tolist()
    return keys, [*d[first].tolist(), *sd.tolist()], [*j[first].tolist(), *sa.tolist()], [1] * len(first) + (sa - sb).tolist(), windows + [b""] * len(sd)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, z, size, runs) to the bytes that each run's windows cover."""
    for batch in batches:
        kmer, doc, lo, n, context = [], [], [], [], []
        hot: tuple[list, list, list, list] = ([], [], [], [])
        texts = unpack(batch.column(1), batch.column(2)).to_pylist()
        for d, raw, runs in zip(batch.column(0).to_pylist(), texts, batch.column(3).to_pylist(), strict=True):
            for r in runs:
                part = raw[r["lo"] : r["lo"] + r["n"] - 1 + WINDOW]
                if len(part) < WINDOW:
                    continue
                if r["hot"]:
                    for values, v in zip(hot, (r["kmer"], d, r["lo"], part), strict=True):
                        values.append(v)
                else:
                    kmer.append(r["kmer"])
                    doc.append(d)
                    lo.append(r["lo"])
                    n.append(len(part) - WINDOW + 1)
                    context.append(part)
        if hot[0]:
            for values, more in zip((kmer, doc, lo, n, context), _hot_windows(*hot), strict=True):
                values += more
        yield pa.RecordBatch.from_arrays([pa.array(kmer, pa.int64()), pa.array(doc, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int32()), pa.array(context, pa.binary())], names=["kmer", "doc_id", "lo", "n", "context"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in the order (kmer, doc_id, lo) to the spans of windows that were seen with the same seed before.

    Between batches only the hashes of the last seed's windows are kept.
    """
    last, seen = None, np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        kmers, docs, los, ns = (batch.column(i).to_numpy() for i in range(4))
        col = batch.column(4).cast(pa.large_binary())
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        settled, ns = np.flatnonzero(ns < 0), np.maximum(ns, 0)
        ready = (docs[settled], los[settled], los[settled] - batch.column(3).to_numpy()[settled])
        row = np.repeat(np.arange(len(ns)), ns)
        step = np.arange(len(row)) - np.repeat(np.cumsum(ns) - ns, ns)
        at = (offsets[:-1] - offsets[0])[row] + step
        h = span_hash(prefix_sums(data), at, at + WINDOW)
        k, d, j = kmers[row], docs[row], los[row] + step
        order = np.lexsort((j, d, h, k))
        h, k, d, j = h[order], k[order], d[order], j[order]
        new = np.ones(len(h), bool)
        new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (d != d[head]) | (j != j[head])
        if last is not None:
            later |= (k == last) & np.isin(h, seen)
        doc, a, b = _merged(d[later], j[later], j[later] + WINDOW)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip((doc, a, b), ready, strict=True)], names=["doc_id", "a", "b"])
        now = np.unique(h[k == kmers[-1]])
        seen = np.union1d(seen, now) if last == kmers[-1] else now
        last = kmers[-1]


class SuffixIndex:
    """The family of levels; each level is a table (kmer, run, doc_id, lo, n) of the earliest suffix of each kind.

    Keys of different levels are disjoint: what an older level holds is a repeat in a newer one.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []  # (rank, table)

    def add(self, docs: DataFrame, keep: bool = True, rank: int = 0) -> tuple[DataFrame, DataFrame]:
        """Add documents whose ids exceed those added before; ``rank`` says how large the batch is (2^rank of the unit).

        Returns the spans (doc_id, a, b) of whole runs that repeat what is earlier, and
        the runs (doc_id, kmer, lo, n), new and old, that share a seed but not a run:
        ``edges`` compares these. With ``keep=False`` the batch is only scanned.
        """
        merging = []
        while keep and self.levels and self.levels[-1][0] == rank:
            merging.append(self.levels.pop()[1])
            rank += 1
        texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        scan = texts.mapInArrow(_suffixes, _ROWS).withColumns({"new": F.lit(True), "stays": F.lit(keep)})
        for level, stays in [(x, True) for x in merging] + [(x, False) for _, x in self.levels]:
            scan = scan.unionByName(level.withColumns({"new": F.lit(False), "stays": F.lit(stays)}))
        ordered = scan.repartition("kmer").sortWithinPartitions("kmer", "run", "doc_id", "lo")
        same_seed = Window.partitionBy("kmer")
        same_run = Window.partitionBy("kmer", "run").orderBy("doc_id", "lo")
        flagged = ordered.select(
            "*",
            ((F.min("run").over(same_seed) < F.max("run").over(same_seed)) & F.max("new").over(same_seed)).alias("mixed"),
            F.first(F.struct("doc_id", "lo")).over(same_run).alias("head"),
        ).withColumn("later", (F.col("n") > 0) & (F.col("head") < F.struct("doc_id", "lo"))).drop("head")
        found = materialise(flagged.where("(new AND n < 0) OR later OR mixed OR stays"), "suffix-array")
        if keep:
            self.levels.append((rank, found.where("stays AND n > 0 AND NOT later").select("kmer", "run", "doc_id", "lo", "n")))
        whole = found.where("new AND n < 0").select("doc_id", F.col("lo").alias("a"), F.col("run").alias("b")).unionByName(
            found.where("new AND later").select("doc_id", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1 + WINDOW).alias("b"))
        )
        return whole, found.where("n > 0 AND mixed AND NOT later").select("doc_id", "kmer", "lo", "n")


def edges(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Spans (doc_id, a, b) of the windows of ``runs`` that start earlier elsewhere; ``texts`` is ``packed`` and holds their documents."""
    runs = materialise(runs.distinct(), "suffix-runs")
    hot = runs.groupBy("kmer").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > HOT).select("kmer", F.lit(True).alias("hot"))
    by_doc = runs.join(hot, "kmer", "left").groupBy("doc_id").agg(F.collect_list(F.struct("kmer", "lo", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"))
    context = texts.join(by_doc, "doc_id").select("doc_id", "z", "size", "runs").mapInArrow(_contexts, _CONTEXTS)
    return context.repartition("kmer").sortWithinPartitions("kmer", "doc_id", "lo").mapInArrow(_edges, "doc_id long, a long, b long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw, spans in zip(unpack(batch.column(1), batch.column(2)).to_pylist(), batch.column(3).to_pylist(), strict=True):
            kept, at, n_spans = [], 0, 0
            last = -1
            for s in sorted((s["a"], s["b"]) for s in spans or []):
                a, b = s[0], min(s[1], len(raw))
                if a > last:
                    n_spans += 1
                if a > at:
                    kept.append(raw[at:a])
                at, last = max(at, b), max(last, b)
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((len(raw), len(raw) - len(rest), n_spans, hashlib.sha256(rest).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` (doc_id, text) under ids that differ for different rows and keep the order, and those ids' own doc_id.

    Ids that are unique stay as they are (None). Else (id, hash of the text) pairs are
    sorted by range and numbered, whatever part of the rows one id has.
    """
    facts = rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    if facts["rows"] == facts["ids"]:
        return rows, None
    keyed = rows.withColumn("hash", F.xxhash64("text"))
    order = keyed.select("doc_id", "hash").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "hash")
    order = materialise(order.withColumn("number", F.monotonically_increasing_id()), "suffix-rows")
    met = keyed.join(order.withColumnsRenamed({"doc_id": "own", "hash": "own_hash"}), F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("hash") == F.col("own_hash")))
    return met.select(F.col("number").alias("doc_id"), "text"), order.select("number", F.col("doc_id").alias("own"))


def remove_repeats(docs: DataFrame, shares: tuple[float, ...] = BATCHES, ranks: tuple[int, ...] = RANKS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    The documents are added to the index in batches by id, parted at the given
    shares of the ids; the last batch is only scanned, since none follows it.
    """
    rows, own = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    bounds = sorted(set((rows.agg(F.percentile_approx("doc_id", list(shares)).alias("q")).first().q or []) if shares else []))
    family, spans, mixed = SuffixIndex(), None, None
    for k in range(len(bounds) + 1):
        part = rows
        if k:
            part = part.where(F.col("doc_id") > bounds[k - 1])
        if k < len(bounds):
            part = part.where(F.col("doc_id") <= bounds[k])
        whole, runs = family.add(part, keep=k < len(bounds), rank=ranks[k] if k < len(ranks) else 0)
        spans = whole if spans is None else spans.unionByName(whole)
        mixed = runs if mixed is None else mixed.unionByName(runs)
    texts = packed(rows)  # goes through one shuffle by id, for the edges and for the cut
    spans = spans.unionByName(edges(texts, mixed))
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut = texts.join(by_doc, "doc_id", "left").select("doc_id", "z", "size", "spans").mapInArrow(_cut, schema)
    if own is None:
        return cut
    named = cut.join(own, F.col("doc_id") == F.col("number"))
    return named.select(F.col("own").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
