"""A corpus pipeline: quality rules, exact dedup, near-duplicate dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies the
stages to ``documents``, each result written to the shared folder and read again. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import exact_dedup, jaccard_join, packing, pii, rules
from cadenza.llm.common import materialise, table
from cadenza.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the base rules or the policy reject go."""
    verdicts = rules.apply_policy(rules.ledger(docs, carry=COLUMNS), "v2")
    return verdicts.where("kept").select(*COLUMNS)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of equal texts the largest doc_id stays; where none of them has an id, one of them (the least row) stays."""
    stays = exact_dedup.exact_groups(docs, keep="max").where("kept").select("doc_id", "text_sha256")
    keyed = docs.withColumn("text_sha256", exact_dedup.text_digest("text"))
    known = keyed.where("doc_id IS NOT NULL").join(stays, ["doc_id", "text_sha256"], "left_semi")
    nameless = keyed.where("doc_id IS NULL").join(stays.where("doc_id IS NULL"), "text_sha256", "left_semi")
    one = nameless.groupBy("text_sha256").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return known.select(*COLUMNS).unionByName(one)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: five-word shingles, similarity 0.8; one document of each group stays, that with the smallest doc_id.

    Rows without an id come after all others of their group, rows of one id (or without
    one) are taken by the hash of id and text, and of rows equal in both one stays. Rows
    without words stay, but for repeated ones. Nothing is broadcast or kept but one key a group.
    """
    groups = jaccard_join.linked_groups(docs, k=5, num=80, den=100)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")
    stays = materialise(groups.groupBy("group").agg(first).select("first.row_key").join(groups, "row_key").groupBy("row_key").agg(F.count(F.lit(1)).alias("rows")), "near-kept")
    kept = docs.withColumn("row_key", jaccard_join.row_key()).join(stays, "row_key")
    return kept.where("rows = 1").select(*COLUMNS).unionByName(kept.where("rows > 1").dropDuplicates(["row_key"]).select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: every span is replaced by its kind; n_chars follows the text."""
    return pii.redacted(docs, carry=("lang", "source")).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: sequences of at most 2048 tokens."""
    pieces = packing.token_pieces(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))
    return packing.pack(pieces)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", packed),
]
#: Tokens and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
