"""Source divergence audit: how the sources of each language differ in their use of terms.

Stripes are folded in the mappers: a task folds whole documents into term -> (document
frequency, counts by source), spills when it holds too many and Spark merges the
spilled stripes by (lang, term). The merged stripes of the kept terms are written once;
group totals and both reports come from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .terms import NOT_LETTER, Counted
from .textkernel import chunks

SCALE = 1_000_000_000
#: Entries (group and term) that a task holds before it spills, and bytes of terms: about 150 MB.
SPILL = 1 << 20
SPILL_BYTES = 64 << 20
#: Sources to a side of a tile of the pair report.
TILE = 256

STRIPE = "lang string, term string, sources array<string>, dfs array<long>, counts array<long>"


class Stripes:
    """The stripes that a task holds: for each (group, term hash) the documents and the occurrences, and each term's string."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.seen: dict[int, int] = {}  # documents by group
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.names: list[tuple[np.ndarray, pa.Array]] = []
        self.held = self.bytes = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, langs: list, sources: list) -> None:
        found = Counted(data, offsets, NOT_LETTER)
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], np.int64)
        for g, n in zip(*np.unique(group, return_counts=True), strict=True):
            self.seen[int(g)] = self.seen.get(int(g), 0) + int(n)
        rank = np.repeat(np.arange(len(found.hash)), np.diff(found.term_at))
        self._push(group[found.doc], found.hash[rank], np.ones(len(rank), np.int64), found.tf)
        self._name(found.hash, found.text())

    def _name(self, term: np.ndarray, text: pa.Array) -> None:
        self.names.append((term, text))
        self.bytes += text.nbytes

    def _push(self, group: np.ndarray, term: np.ndarray, df: np.ndarray, count: np.ndarray) -> None:
        order = np.lexsort((group, term))
        group, term = group[order], term[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (group[1:] != group[:-1])
        at = np.flatnonzero(new)
        if len(at):
            self.parts.append((group[at], term[at], np.add.reduceat(df[order], at), np.add.reduceat(count[order], at)))
            self.held += len(at)

    def fold(self) -> None:
        """Merge what the chunks gave."""
        parts, names = self.parts, self.names
        self.clear()
        if parts:
            self._push(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            h, first = np.unique(np.concatenate([x for x, _ in names]), return_index=True)
            self._name(h, pa.concat_arrays([x for _, x in names]).take(pa.array(first)))

    def spilled(self) -> Iterator[pa.RecordBatch]:
        """One row for each language and term, then nothing is held."""
        self.fold()
        if not self.parts:
            return
        (group, term, df, count), (known, text) = self.parts[0], self.names[0]
        keys = list(self.groups)
        lang_of = {lang: i for i, lang in enumerate(dict.fromkeys(k[0] for k in keys))}
        lang = np.array([lang_of[k[0]] for k in keys], np.int64)[group]
        source = pa.array([k[1] for k in keys], pa.string())
        order = np.lexsort((group, term, lang))
        lang, term, group, df, count = lang[order], term[order], group[order], df[order], count[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])
        at = np.concatenate([np.flatnonzero(new), [len(term)]])
        langs = pa.array(list(lang_of), pa.string()).take(pa.array(lang[at[:-1]]))
        texts = text.take(pa.array(np.searchsorted(known, term[at[:-1]])))
        self.clear()
        for a in range(0, len(at) - 1, 10_000):
            b = min(a + 10_000, len(at) - 1)
            cut, x, y = pa.array(at[a : b + 1] - at[a], pa.int32()), at[a], at[b]
            lists = (pa.ListArray.from_arrays(cut, v) for v in (source.take(pa.array(group[x:y])), pa.array(df[x:y]), pa.array(count[x:y])))
            yield pa.RecordBatch.from_arrays([langs[a:b], texts[a:b], *lists], names=["lang", "term", "sources", "dfs", "counts"])

    def occurring(self) -> Iterator[pa.RecordBatch]:
        """A row without term for each group that occurred, with its documents."""
        keys = [(*k, self.seen[g]) for k, g in self.groups.items()]
        if keys:
            yield pa.RecordBatch.from_pylist(
                [{"lang": k, "term": None, "sources": [s], "dfs": [n], "counts": [0]} for k, s, n in keys],
                pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("dfs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]),
            )


def stripes(docs: DataFrame, spill: int = SPILL) -> DataFrame:
    """(lang, term, sources, dfs, counts): stripes as the tasks spill them, and rows without term for the groups.

    Null text, language or source is ''. A chunk's terms are held until ``spill``
    entries are, so a task's memory is bounded by that and its longest document.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stripes()
        folded = size = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, data, offsets in chunks(batch, 2):
                held.add(data, offsets, langs[a:b], sources[a:b])
                if held.held - folded > spill // 2 or held.bytes - size > SPILL_BYTES // 2:
                    held.fold()
                    if held.held > spill or held.bytes > SPILL_BYTES:
                        yield from held.spilled()
                    folded, size = held.held, held.bytes
        yield from held.spilled()
        yield from held.occurring()

    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]).mapInArrow(rows, STRIPE)


def merged(spilled: DataFrame, least: int = 10) -> DataFrame:
    """(lang, term, df, total, cells[source, n]) of the terms in at least ``least`` documents of the language; for the rows
    without term the groups. One shuffle, by (lang, term): a key has a row for each spill, and a cell for each source."""
    dealt = spilled.repartition("lang", "term")
    cell = dealt.select("lang", "term", F.explode(F.arrays_zip("sources", "dfs", "counts")).alias("c"))
    cells = cell.groupBy("lang", "term", F.col("c.sources").alias("source")).agg(F.sum("c.dfs").alias("df"), F.sum("c.counts").alias("n"))
    return cells.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells")).where(
        F.col("term").isNull() | (F.col("df") >= least)
    )


def scaled(count: Column, size: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (size + 2 * kinds)), three decimal digits at a time, so that nothing exceeds 64 bits."""
    rest, total, of = count + 2, F.lit(0).cast("long"), size + 2 * kinds
    div = lambda a: F.call_function("div", a, of)
    whole, rest = div(rest), F.pmod(rest, of)
    for _ in range(3):
        total, rest = total * 1000 + div(rest * 1000), F.pmod(rest * 1000, of)
    return whole * SCALE + total + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over terms for each pair of sources of a tile. Rows come sorted by tile, the row with its sources first."""
    key, names, base, bare, total, cells, cut = None, [], None, None, None, [], 0

    def fold() -> None:
        """Add what the terms at hand differ by from terms that no source has."""
        if cells:
            p = np.repeat(base[None, :], len(cells), 0)
            for i, row in enumerate(cells):
                for x in row:
                    p[i, x["place"]] = x["p"]
            cells.clear()
            for i in range(cut if cut < len(base) else len(base) - 1):
                a = cut if cut < len(base) else i + 1
                d, s = p[:, a:] - p[:, i : i + 1], p[:, a:] + p[:, i : i + 1]
                total[i, a:] += (d * d // s - bare[i, a:]).sum(0)

    def close() -> Iterator[pa.RecordBatch]:
        if key is not None:
            fold()
            r, c = np.nonzero(total)
            at = pa.array(names, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(r), pa.string()), at.take(pa.array(r)), at.take(pa.array(c)), pa.array(total[r, c])], names=["lang", "source", "item", "value"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["head"] is None:
                cells.append(row["cells"])
                if len(cells) >= 1024:
                    fold()
                continue
            yield from close()
            key, names, base = (row["lang"], row["i"], row["j"]), [x["source"] for x in row["head"]], np.array([x["p"] for x in row["head"]], np.int64)
            cut = len(base) if row["i"] == row["j"] else sum(x["part"] == row["i"] for x in row["head"])
            d, s = base[None, :] - base[:, None], base[None, :] + base[:, None]
            wanted = np.triu(np.ones(d.shape, bool), 1) if cut == len(base) else (np.arange(len(base)) < cut)[:, None] & (np.arange(len(base)) >= cut)[None, :]
            bare = np.where(wanted, d * d // s, 0)
            total = bare * row["kinds"]
    yield from close()


def pair_sums(cells: DataFrame, groups: DataFrame, tile: int = TILE, salts: int = 32) -> DataFrame:
    """(lang, source, item, value) once for each two sources of a language: the sum of ``gap`` over all kept terms, where it
    isn't 0. Terms that neither source has count too.

    ``cells`` has lang, source, term, p; ``groups`` lang, source, zero (p without an
    occurrence), kinds (terms kept). Sources are dealt into tiles; a term's cells go to
    the tiles of its language, salted, behind a row with the tile's sources. A task holds
    one tile's sums and 1,024 terms.
    """
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    g = groups.select("lang", "source", "zero", "kinds", F.floor(at / tile).alias("part"), F.pmod(at, F.lit(tile)).cast("int").alias("at"))
    g = materialise(g, "divergence-sources")
    last = g.groupBy("lang").agg(F.max("part").alias("last"))
    spread = lambda df: df.join(last, "lang").withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).select(*df.columns, F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"))
    entry = F.struct("part", "at", "source", F.col("zero").alias("p"), "kinds")
    head = spread(g).groupBy("lang", "i", "j").agg(F.array_sort(F.collect_list(entry)).alias("head"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    head = head.select("lang", "i", "j", salt.alias("salt"), "head", F.lit(None).cast("array<struct<place:int,p:bigint>>").alias("cells"))
    head = head.withColumn("kinds", F.when(F.col("salt") == 0, F.col("head")[0]["kinds"]).otherwise(0).cast("long"))
    # a source's place in its tile: after those of the first part, if it is of the second
    sizes = g.groupBy("lang", F.col("part").alias("i")).agg(F.count(F.lit(1)).cast("int").alias("n_first"))
    placed = spread(cells.join(g.select("lang", "source", "part", "at"), ["lang", "source"])).join(sizes, ["lang", "i"])
    place = (F.col("at") + F.when((F.col("part") == F.col("j")) & (F.col("i") < F.col("j")), F.col("n_first")).otherwise(0)).alias("place")
    rows = placed.groupBy("lang", "i", "j", "term").agg(F.collect_list(F.struct(place, "p")).alias("cells"))
    rows = rows.select("lang", "i", "j", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int").alias("salt"), F.lit(None).cast(head.schema["head"].dataType).alias("head"), "cells", F.lit(0).cast("long").alias("kinds"))
    key = ["lang", "i", "j", "salt"]
    dealt = head.unionByName(rows).repartition(*key).sortWithinPartitions(*key, F.col("head").isNull())
    return dealt.mapInArrow(_tiles, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = 10, top: int = 10, spill: int = SPILL, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: each other source of the language with the two sources' divergence
    over all kept terms. Part ``term``: the ``top`` terms by which a source exceeds its
    language. Counts are smoothed and scaled by ``scaled``; all arithmetic is exact.
    Null lang, source and text are ''; a group without terms has pairs (a language
    without kept terms has value 0) and no term rows; an empty table gives no rows.
    """
    both = materialise(merged(stripes(docs, spill), least), "divergence-stripes")
    kept = both.where("term IS NOT NULL")
    cell = kept.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "term", "total", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    whole = kept.groupBy("lang").agg(F.sum("total").alias("lang_size"), F.count(F.lit(1)).alias("kinds"))
    sizes = cell.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    here = both.where("term IS NULL").select("lang", F.explode("cells.source").alias("source"))
    groups = here.join(sizes, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "lang_size", "kinds")])
    groups = materialise(groups.withColumn("zero", F.when(F.col("kinds") > 0, scaled(F.lit(0).cast("long"), F.col("size"), F.col("kinds"))).otherwise(1)), "divergence-groups")
    cells = cell.join(groups, ["lang", "source"]).withColumn("p", scaled(F.col("n"), F.col("size"), F.col("kinds")))
    value = gap(F.col("p"), F.col("q"))
    above = cells.withColumn("q", scaled(F.col("total"), F.col("lang_size"), F.col("kinds"))).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    once = pair_sums(cells.select("lang", "source", "term", "p"), groups, tile)
    twice = once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(twice, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = above.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(best)
