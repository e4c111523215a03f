"""Operator 10: URL rules, and a list of canonical URLs behind a blocked Bloom filter.

``parse`` splits a URL into host and path. ``longest_rule`` finds, of a small table of
(host, path, verdict) rules, the longest that fits. ``listed`` decides whether a
canonical URL is in a list of any size: the list is hashed into a blocked Bloom filter
(256-bit blocks, built by a distributed bitwise-or aggregation and sized by the list's
count), which passes possible hits to an exact hash join that removes the false
positives. The filter of up to ``MAX_LISTED`` URLs is broadcast; that of a longer list is
dealt out by block, each task with its segment of the filter, and pages meet it there.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is
not listed. Repeated rows are judged alike; an empty table gives an empty result, an
empty list lists nothing. The input's columns may have any names; one of the name of
the verdict column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise

WORDS = 4  # of 64 bits in a block
PROBES = 6
URLS_A_BLOCK = 16  # 16 bits a URL
MAX_LISTED = 1 << 21  # a broadcast filter is at most 131,072 blocks of 32 bytes
SALTS = 8  # tasks among which the pages of one block, or of one listed URL, are dealt


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def canonical(url: Column) -> Column:
    """The form in which URLs are listed: host, path without trailing slashes, and the query without ``utm_`` parameters.

    Scheme and fragment go, the rest of the query stays in its order. Null where there is no host.
    """
    host, path = parse(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&+", "")
    return F.when(host != "", F.concat(host, F.regexp_replace(path, r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct(rule, verdict) of the longest fitting rule, or null.

    A rule fits its host and all subdomains, if the path starts with its path.
    The longest is the one with the most characters of host and path together.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _probe(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """Block number of a key, and the bits it sets in each word of the block."""
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")
    h = F.xxhash64(F.lit(7), key)
    words: list[Column] = [F.lit(0).cast("long")] * WORDS
    for k in range(PROBES):
        at = F.shiftrightunsigned(h, k * 8).bitwiseAND(F.lit(255))
        for w in range(WORDS):
            bit = F.when(F.floor(at / 64) == w, F.expr("1L")).otherwise(F.lit(0).cast("long"))
            words[w] = words[w].bitwiseOR(F.call_function("shiftleft", bit, F.pmod(at, F.lit(64)).cast("int")))
    return block, words


def build_filter(urls: DataFrame, n_blocks: int) -> DataFrame:
    """Blocked Bloom filter of column ``url``: block, w0..w3; at most ``n_blocks`` rows."""
    block, words = _probe(F.col("url"), n_blocks)
    keyed = urls.where(F.col("url").isNotNull()).select(block.alias("block"), *[w.alias(f"w{k}") for k, w in enumerate(words)])
    return keyed.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def n_blocks_for(n_listed: int) -> int:
    """Blocks of the filter of so many URLs: a power of two with ``URLS_A_BLOCK`` in each at most."""
    return 1 << max(0, -(-n_listed // URLS_A_BLOCK) - 1).bit_length()


def _dealt(rows: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """Left join of many rows with one row for each key at most, both by key and salt, so that a hot key is ``SALTS`` tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    every = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, [on, "salt"], "left").drop("salt")


def possible(pages: DataFrame, urls: DataFrame, key: str, n_blocks: int, broadcast: bool = True) -> DataFrame:
    """(row, key, maybe) of each page: all its columns in a struct, its key, and whether the filter of ``urls.url`` holds it.
    The filter's blocks are broadcast, or else dealt out with the pages by block."""
    block, words = _probe(F.col("key"), n_blocks)
    parts = build_filter(urls, n_blocks).select("block", F.struct(*[F.col(f"w{k}") for k in range(WORDS)]).alias("bits"))
    whole = pages.select(F.struct("*").alias("row"), F.col(key).alias("key")).withColumn("block", block)
    tested = whole.join(F.broadcast(parts), "block", "left") if broadcast else _dealt(whole, parts, "block")
    hit = F.col("key").isNotNull() & F.col("bits").isNotNull()
    for k, w in enumerate(words):
        hit = hit & (F.col(f"bits.w{k}").bitwiseAND(w) == w)
    return tested.select("row", "key", F.coalesce(hit, F.lit(False)).alias("maybe"))


def listed(pages: DataFrame, urls: DataFrame, key: str, name: str = "is_listed", max_listed: int = MAX_LISTED) -> DataFrame:
    """``pages`` with boolean ``name``: column ``key`` is in ``urls.url``. Rows stay one to one.

    The possible hits alone are joined by URL, with those of the list that some page may
    hit. Up to ``max_listed`` URLs all other pages stay where they are; for that the pages'
    key is tested again, which costs less than to shuffle them.
    """
    exact = urls.where(F.col("url").isNotNull()).select("url").distinct()
    n = exact.count()
    tested = possible(pages, exact, key, n_blocks_for(n), n <= max_listed)
    if n > max_listed:
        tested = materialise(tested, "url-tested")
    hit = tested.where("maybe").select("key").distinct()
    true = exact.withColumnRenamed("url", "key").join(hit, "key", "left_semi").withColumn("in_list", F.lit(True))
    hits = _dealt(tested.where("maybe"), true, "key")
    both = hits.select("row", F.coalesce("in_list", F.lit(False)).alias("in_list")).unionByName(tested.where("NOT maybe").select("row", F.lit(False).alias("in_list")))
    return both.select(*[F.col("row")[c].alias(c) for c in pages.columns if c.lower() != name.lower()], F.col("in_list").alias(name))
