"""Operator 3: quality rules as a bitmask ledger (native DataFrame functions only).

``ledger`` evaluates every rule once and stores the measurements and one bit per
failed rule; ``apply_policy`` applies a versioned policy (a mask of rules that
count) without measuring again; ``ablation`` says, by bitwise aggregation over
the ledger, how many documents each rule rejects and how many it rejects alone.
``stored`` writes the ledger, so that any number of policies and ablations read it.

Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words, no lines
and fails ``few_words``. Rows are never dropped; repeated rows and ties give
equal results; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, materialise

SYMBOLS = "#*$%&|<>"
SPLIT = r"[\x20\x09-\x0D]+"

#: Rules in bit order: name -> condition under which a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)",
    "upper_case": "word_chars > 0 AND 100 * n_upper > 50 * word_chars",
    "exclamations": "10 * n_exclaim > n_words",
}
#: Versioned policies: the rules that decide beside the two base rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}
BASE = ("few_words", "repeated_words")


def mask(names: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    order = list(RULES)
    return sum(1 << order.index(n) for n in names)


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(grams: Column, n_grams: Column) -> Column:
    """Positions inside a 3-word window that occurs twice or more; ``grams`` are hashes by position."""
    placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    after = F.slice(placed, 2, F.greatest(n_grams, F.lit(1)))
    twins = F.zip_with(
        placed, after, lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))
    )
    starts = F.array_distinct(F.flatten(twins))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))
    return F.when(F.size(F.array_distinct(grams)) == n_grams, F.lit(0)).otherwise(F.size(covered)).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Measurements and ``failed_bits`` of each document; one row per input row.

    ``carry`` names columns of the input to pass along, so that filtering by the
    verdict needs no join.
    """
    text = F.coalesce(F.col("t"), F.lit(""))
    kept = [F.col("_in")] if carry else []
    row = [F.struct(*carry).alias("_in")] if carry else []
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"), *row)
    df = df.select(
        "doc_id",
        *kept,
        text.alias("t"),
        F.filter(F.split(text, SPLIT), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, SEPARATORS, " ")) != "").alias("lines"),
    )
    squeezed = F.translate(F.col("t"), SEPARATORS, "")
    df = df.select(
        "doc_id",
        *kept,
        F.size("w").cast("long").alias("n_words"),
        F.length(squeezed).cast("long").alias("word_chars"),
        _without(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZÁÉÍÓÚÑÄÖÜÀÈÇÊ").cast("long").alias("n_upper"),
        _without(F.col("t"), "!").cast("long").alias("n_exclaim"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    n_grams = F.greatest(F.size("h") - 2, F.lit(0))
    pairs = F.zip_with(F.col("h"), F.slice("h", 2, F.greatest(F.size("h"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    grams = F.zip_with(pairs, F.slice("h", 3, F.greatest(F.size("h"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("n_grams", n_grams).withColumn("grams", F.slice(grams, 1, F.col("n_grams")))
    df = df.withColumn("n_repeat_words", _repeat_words(F.col("grams"), F.col("n_grams")))
    # one row out of each row: a filter on the measurements cannot move below and measure again
    measured = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim"]
    df = df.select("doc_id", *kept, F.inline(F.array(F.struct(*measured))))
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return df.select("doc_id", *measured, failed.cast("int").alias("failed_bits"), *[F.col(f"_in.{c}").alias(c) for c in carry if c != "doc_id"])


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The ledger, written to the shared folder and read again: texts are measured once."""
    return materialise(ledger(docs, id_col, text_col, carry), "rule-ledger")


def apply_policy(led: DataFrame, version: str = "v2") -> DataFrame:
    """Add ``base_failed`` and ``kept`` under a policy; a base failure always rejects."""
    base, counted = mask(BASE), mask(POLICIES[version]) | mask(BASE)
    bits = F.col("failed_bits")
    return led.withColumn("base_failed", bits.bitwiseAND(F.lit(base)) != 0).withColumn(
        "kept", bits.bitwiseAND(F.lit(counted)) == 0
    )


def ablation(led: DataFrame, version: str = "v2") -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that only it rejects."""
    counted = mask(POLICIES[version])
    bits = F.col("failed_bits").bitwiseAND(F.lit(counted))
    by_bits = led.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    order = list(RULES)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << order.index(r)).alias("bit")) for r in POLICIES[version]])
    return (
        by_bits.select("bits", "n", F.explode(rows).alias("r"))
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("rejects"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejects_alone"),
        )
    )
