"""Ranked lexical search with pair-bound MaxScore over an inverted index that Spark holds as tables.

``index`` writes one row for each shard and term: its documents and counts. ``search``
takes the global statistics from it, and precomputes for every shard the greatest
impact of each query term and, for terms that are neighbours in a query's order of
weights, the list of documents that hold both with their greatest joint impact. Bounds
of a query's light terms are combined from single and joint maxima; documents, terms
and shards whose bound is below the score to beat are skipped. The result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise
from .terms import NOT_ALPHANUMERIC, Counted, blobs
from .textkernel import chunks

#: Text of a shard, in bytes; its documents are numbered in 16 bits.
SHARD_BYTES = 8 << 20
SHARD_DOCS = 1 << 16
#: (query, term) rows that are broadcast at once, about 50 MB; longer query sets run in blocks.
QUERY_TERMS = 1 << 19
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"

INDEX = "shard long, term string, docs binary, tfs binary, ids array<long>, lengths array<long>"
_WIDTH = {1: np.dtype(np.uint8), 2: np.dtype("<u2"), 4: np.dtype("<u4"), 8: np.dtype("<u8")}


def _shard(shard: int, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    found = Counted(data, offsets, NOT_ALPHANUMERIC)
    names = [f.split()[0] for f in INDEX.split(", ")]
    none = lambda kind, n: pa.nulls(n, kind)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    yield pa.RecordBatch.from_arrays([pa.array([shard]), none(pa.string(), 1), none(pa.binary(), 1), none(pa.binary(), 1), one(ids), one(pa.array(found.lengths))], names=names)
    kind = next(t for w, t in _WIDTH.items() if not len(found.tf) or int(found.tf.max()) < 1 << 8 * w)
    n, docs, tfs, text = len(found.hash), found.doc.astype("<u2"), found.tf.astype(kind), found.text()
    for a in range(0, n, 20_000):
        b = min(a + 20_000, n)
        cuts = found.term_at[a : b + 1]
        x, y = cuts[0], cuts[-1]
        lists = pa.nulls(b - a, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, shard)), text[a:b], blobs(docs[x:y], cuts - x), blobs(tfs[x:y], cuts - x), lists, lists], names=names)


def index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The inverted index of (doc_id, text) as a written table. For each shard and term: ``docs`` (16-bit numbers within the
    shard, ascending) and ``tfs`` (of one width in a shard); for each shard a row without term: ``ids`` and ``lengths``
    (terms with repeats) of its documents by number. Null texts have no terms. A map only: shards are runs of documents.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = count = 0

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                lengths = np.concatenate([np.diff(o) for _, _, o in held])
                yield from _shard(first + made, pa.concat_arrays([i for i, _, _ in held]), np.concatenate([d for _, d, _ in held]), np.concatenate([[0], np.cumsum(lengths)]))
                held.clear()

        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in chunks(batch, 1, shard_bytes // 8 + 1):
                if held and (size + len(data) > shard_bytes or count + b - a > SHARD_DOCS):
                    yield from close()
                    made, size, count = made + 1, 0, 0
                for x in range(a, b, SHARD_DOCS):
                    y = min(x + SHARD_DOCS, b)
                    if x > a:
                        yield from close()
                        made, size, count = made + 1, 0, 0
                    cut = offsets[x - a : y - a + 1]
                    held.append((ids.slice(x, y - x), data[cut[0] : cut[-1]].copy(), cut - cut[0]))
                    size, count = size + int(cut[-1] - cut[0]), count + y - x
        yield from close()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(texts.mapInArrow(rows, INDEX), "lexical-index")


def terms(text: Column) -> Column:
    """The terms of a text, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), 1)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass
class Block:
    """A block of queries as tasks see it: each query's terms by ascending weight (the chain), the score to beat, and the corpus."""

    chains: list[list[int]]  # term numbers
    weights: np.ndarray  # by term number
    numbers: dict[str, int]
    documents: int
    total: int
    least: list[int]

    def pairs(self) -> set[tuple[int, int]]:
        """Neighbours of the chains."""
        return {p for c in self.chains for p in zip(c, c[1:], strict=False)}


class Shard:
    """A shard's postings of the query terms."""

    def __init__(self, block: Block, rows: pa.Table):
        self.ids, self.postings = pa.array([], pa.int64()), {}
        lengths = np.zeros(0, np.int64)
        for term, docs, tfs, ids, n in zip(*(rows.column(c).to_pylist() if c != "ids" else rows.column(c) for c in ("term", "docs", "tfs", "ids", "lengths")), strict=True):
            if term is None:
                self.ids, lengths = ids.values, np.array(n, np.int64)
            else:
                at = np.frombuffer(docs, "<u2").astype(np.int64)
                self.postings[block.numbers[term]] = at, np.frombuffer(tfs, _WIDTH[len(tfs) // len(at)]).astype(np.int64)
        # 50 * n * N is within 64 bits for any corpus whose longest document has under 10**17 / N terms
        self.twenty_m = 20 * (50 + 50 * lengths * block.documents // max(block.total, 1))
        self.block = block
        self.neighbours = block.pairs()
        self.read = 0  # postings whose impact was computed

    def impact(self, term: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a term; only those of the ascending documents ``of``, if given."""
        docs, tf = self.postings[term]
        if of is not None:
            at = np.searchsorted(docs, of)
            at = at[docs[np.minimum(at, len(docs) - 1)] == of]
            docs, tf = docs[at], tf[at]
        self.read += len(docs)
        return docs, int(self.block.weights[term]) * (1_000_000_000 * tf // (1000 * tf + self.twenty_m[docs]))


def chain_bounds(single: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """``out[i]``: the bound of the first i terms of a chain. Each step takes a term alone (``single[i]``) or with the one
    before it (``joint[i - 1]``, the greatest sum of both in one document), whichever gives the lower bound."""
    out = np.zeros(len(single) + 1, np.int64)
    for i in range(1, len(out)):
        out[i] = out[i - 1] + single[i - 1]
        if i > 1:
            out[i] = min(out[i], out[i - 2] + joint[i - 2])
    return out


def shard_bounds(shard: Shard) -> tuple[dict[int, int], dict[tuple[int, int], tuple[int, np.ndarray]], dict[int, np.ndarray]]:
    """Greatest impact by term; by pair of neighbours the greatest joint impact and the documents that hold both; impacts."""
    scored = {t: shard.impact(t) for t in shard.postings}
    most = {t: int(x.max()) for t, (_, x) in scored.items()}
    both = {}
    place = np.full(len(shard.twenty_m), -1, np.int64)
    for a, b in sorted(shard.neighbours):
        if a in scored and b in scored:
            (da, xa), (db, xb) = scored[a], scored[b]
            place[da] = np.arange(len(da))
            at = place[db]
            common = at >= 0
            place[da] = -1
            if common.any():
                both[a, b] = int((xa[at[common]] + xb[common]).max()), db[common]
    return most, both, scored


def joint_of(most: dict[int, int], both: dict, a: int, b: int) -> int:
    """The greatest sum of two terms' impacts in one document of the shard, whether it holds one or both."""
    return max(most.get(a, 0), most.get(b, 0), both[a, b][0] if (a, b) in both else 0)


def best_of(shard: Shard, chain: list[int], most: dict[int, int], both: dict, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) with a score of at least ``least`` that may be among the ``k`` best of the shard, all ties with the
    last one included."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    chain = [t for t in chain if most.get(t, 0) > 0]
    single = np.array([most[t] for t in chain], np.int64)
    # the chain's stored pairs are of terms that were neighbours in the query; where a term is missing here, its neighbours stand alone
    joint = np.array([joint_of(most, both, a, b) if (a, b) in shard.neighbours else most[a] + most[b] for a, b in zip(chain, chain[1:], strict=False)], np.int64)
    bound = chain_bounds(single, joint)
    if not chain or bound[-1] < least:
        return none
    got = np.zeros(len(shard.twenty_m), np.int64)
    held = np.zeros(len(got), bool)
    i = len(chain)
    # essential terms, heaviest first, until what is left can't reach the score to beat
    while i and bound[i] >= least:
        docs, x = shard.impact(chain[i - 1])
        got[docs] += x
        held[docs] = True
        i -= 1
        if i and bound[i] >= least and held.sum() >= k:
            # what these documents have already is a score to beat for the others
            least = max(least, int(np.partition(got[held], -k)[-k]))
    docs = np.flatnonzero(held)
    while i:
        # the light terms: a document outside a pair's list has one of both at most
        docs = docs[got[docs] + bound[i] >= least]
        if i > 1 and bound[i] == bound[i - 2] + joint[i - 2] and (chain[i - 2], chain[i - 1]) in shard.neighbours:
            alone = max(single[i - 2], single[i - 1])
            listed = both.get((chain[i - 2], chain[i - 1]), (0, none[0]))[1]
            reach = np.where(np.isin(docs, listed, assume_unique=True), joint[i - 2], alone)
            docs = docs[got[docs] + bound[i - 2] + reach >= least]
            for t in (chain[i - 1], chain[i - 2]):
                at, x = shard.impact(t, docs)
                got[at] += x
            i -= 2
        else:
            at, x = shard.impact(chain[i - 1], docs)
            got[at] += x
            i -= 1
        if len(docs) >= k:
            least = max(least, int(np.partition(got[docs], -k)[-k]))
    docs = docs[got[docs] >= max(least, 1)]
    return docs, got[docs]


def seeds(shard: Shard, chain: list[int], scored: dict, k: int) -> list[int]:
    """Scores of at least ``k`` documents, if so many hold a term: those of the heaviest terms. Each is a score of a document, so
    the k-th best over all shards is one to beat."""
    got, held = np.zeros(len(shard.twenty_m), np.int64), np.zeros(len(shard.twenty_m), bool)
    for t in reversed(chain):
        if t in scored:
            docs, x = scored[t]
            got[docs] += x
            if held.sum() < k:
                held[docs] = True
    x = got[held]
    x = x[x > 0]
    return (np.partition(x, -k)[-k:] if len(x) > k else x).tolist()


def _floor(score: int) -> int:
    """The score with its ten leading bits."""
    return score >> max(score.bit_length() - 10, 0) << max(score.bit_length() - 10, 0)


BOUNDS = "shard long, a int, b int, most long, docs binary, seen long"


def bounds(postings: DataFrame, block: Block, k: int) -> DataFrame:
    """The precomputed table of a block of queries, written. For each shard and term ``a`` its greatest impact ``most``; for pairs
    (a, b) the greatest joint impact and the list of documents with both; for queries ``a`` (b is -2) how many documents were
    ``seen`` with a score of ``most`` or little more."""

    def rows(group: pa.Table) -> pa.Table:
        shard = Shard(block, group)
        most, both, scored = shard_bounds(shard)
        out = [(t, -1, x, None, 0) for t, x in most.items()] + [(a, b, x, docs.astype("<u2").tobytes(), 0) for (a, b), (x, docs) in both.items()]
        for q, chain in enumerate(block.chains):
            found = sorted(map(_floor, seeds(shard, chain, scored, k)))
            out += [(q, -2, x, None, found.count(x)) for x in dict.fromkeys(found)]
        a, b, x, docs, seen = zip(*out, strict=True) if out else [()] * 5
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()] * len(a), pa.int64()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "most": pa.array(x, pa.int64()), "docs": pa.array(docs, pa.binary()), "seen": pa.array(seen, pa.int64())})

    return materialise(postings.groupBy("shard").applyInArrow(rows, BOUNDS), "lexical-bounds")


def scores_to_beat(table: DataFrame, n_queries: int, k: int) -> list[int]:
    """For each query a score that ``k`` documents reach; 1 where fewer were seen."""
    counts = table.where("b = -2").groupBy("a", "most").agg(F.sum("seen").alias("n"))
    reached = counts.withColumn("n", F.sum("n").over(Window.partitionBy("a").orderBy(F.desc("most")))).where(F.col("n") >= k)
    out = [1] * n_queries
    for r in reached.groupBy("a").agg(F.max("most").alias("most")).collect():
        out[r.a] = max(1, r.most)
    return out


def candidates(postings: DataFrame, table: DataFrame, block: Block, k: int) -> DataFrame:
    """(query, doc_id, score, read): what each shard has of the ``k`` best, ties with the last included; ``read`` counts, on the
    first row of a shard's query, the postings whose impact was computed."""

    def rows(group: pa.Table, known: pa.Table) -> pa.Table:
        shard = Shard(block, group)
        most, both = {}, {}
        for a, b, x, docs in zip(*(known.column(c).to_pylist() for c in ("a", "b", "most", "docs")), strict=True):
            if b == -1:
                most[a] = x
            elif b >= 0:
                both[a, b] = x, np.frombuffer(docs, "<u2").astype(np.int64)
        queries, at, scores, read = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, chain in enumerate(block.chains):
            before = shard.read
            docs, x = best_of(shard, chain, most, both, k, block.least[q])
            if len(docs) > k:
                keep = x >= np.partition(x, -k)[-k]
                docs, x = docs[keep], x[keep]
            if not len(docs) and shard.read > before:
                docs, x = np.array([-1]), np.array([0])
            queries.append(np.full(len(docs), q, np.int32))
            at.append(docs)
            scores.append(x)
            read.append(np.where(np.arange(len(docs)) == 0, shard.read - before, 0))
        at = np.concatenate(at)
        ids = shard.ids.take(pa.array(at, mask=at < 0))
        return pa.table({"query": pa.array(np.concatenate(queries)), "doc_id": ids, "score": pa.array(np.concatenate(scores)), "read": pa.array(np.concatenate(read))})

    return postings.groupBy("shard").cogroup(table.where("b > -2").groupBy("shard")).applyInArrow(rows, "query int, doc_id long, score long, read long")


def _search_block(inverted: DataFrame, rows: list, documents: int, total: int, k: int) -> DataFrame:
    """``candidates`` for the collected (query, term) rows of one block."""
    spark = inverted.sparkSession
    numbers = {t: i for i, t in enumerate(dict.fromkeys(r[1] for r in rows))}
    words = F.broadcast(spark.createDataFrame([(t,) for t in numbers], "term string"))
    found = inverted.where("term IS NOT NULL").select("term", (F.octet_length("docs") / 2).cast("long").alias("n")).join(words, "term").groupBy("term").agg(F.sum("n").alias("df")).collect()
    weights = np.zeros(len(numbers), np.int64)
    for r in found:
        weights[numbers[r.term]] = weight(documents, r.df)
    chains: list[list[int]] = [[] for _ in range(max(r[0] for r in rows) + 1)]
    for q, t in rows:
        if weights[numbers[t]] > 0:
            chains[q].append(numbers[t])
    for c in chains:
        c.sort(key=lambda t: (weights[t], t))
    block = Block(chains, weights, numbers, documents, total, [1] * len(chains))
    postings = inverted.where("term IS NULL").unionByName(inverted.join(words, "term", "left_semi"))
    table = bounds(postings, block, k)
    block.least = scores_to_beat(table, len(chains), k)
    return candidates(postings, table, block, k)


def search(inverted: DataFrame, queries: DataFrame, k: int = 50, query_id: str = "item_id", text: str = "text", block_terms: int = QUERY_TERMS, keep_read: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` best documents of ``index`` for each query, equal scores by ascending doc_id (rows
    without one last). With ``keep_read`` the candidates of all shards instead, with ``read``.

    Rows of one id (or of none) are one query. Null and empty texts, and queries whose terms no document has, give no
    rows; so does an empty index. Query sets run in blocks of about ``block_terms`` (query, term) rows, which are
    broadcast; postings meet by shard, and only the shards' best reach the last shuffle.
    """
    spark = inverted.sparkSession
    asked = materialise(queries.select(F.col(query_id).alias("id"), F.explode(terms(F.col(text).cast("string"))).alias("term")).distinct(), "lexical-queries")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("term")).alias("chars")).first()
    blocks = max(1, -(-max(2 * size.n if size.n > block_terms else size.n, (size.chars or 0) // 32) // block_terms))
    lengths = inverted.where("term IS NULL")
    corpus = lengths.agg(F.sum(F.size(F.filter("lengths", lambda n: n > 0))).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n)).alias("total")).first()
    parts = []
    kind = queries.schema[query_id].dataType.simpleString()
    for b in range(blocks if size.n and corpus.total else 0):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        ids = list(dict.fromkeys(r.id for r in rows))
        if ids:
            number = {x: i for i, x in enumerate(ids)}
            found = _search_block(inverted, [(number[r.id], r.term) for r in rows], corpus.n, corpus.total, k)
            names = spark.createDataFrame(list(enumerate(ids)), f"query int, {query_id} {kind}")
            parts.append(found.join(F.broadcast(names), "query"))
    if not parts:
        parts = [spark.createDataFrame([], f"query int, doc_id long, score long, read long, {query_id} {kind}")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    if keep_read:
        return every.drop("query")
    best = Window.partitionBy(query_id).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return every.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(query_id, "rank", "doc_id", "score")
