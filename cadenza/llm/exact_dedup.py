"""Operator 6: exact duplicates by 128-bit content hash (native DataFrame functions only).

Texts are equal when identical after lower-casing A-Z only; a null text counts as
empty. Documents are grouped by a 128-bit hash of the normalised text; the bytes
inside each group are compared (the least and the greatest text of a group are
equal, or the group holds a collision). Collided groups, if there are any, are
regrouped by the texts themselves. The aggregation combines on the map side, so a
group of any size sends one row per task.

Rows with equal ids and ties: the largest id stays (``keep='max'``) or the
smallest (``keep='min'``). An empty table gives an empty result. Only the id and
text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise


def normalised(text_col: str) -> Column:
    """The text that is compared: A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)


def text_digest(text_col: str) -> Column:
    """SHA-256 of the compared text, as in ``text_sha256``."""
    return F.sha2(F.encode(normalised(text_col), "UTF-8"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digits: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. ``digits`` hexadecimal ones of the hash are the key."""
    pick = F.max if keep == "max" else F.min
    norm, sha = normalised(text_col), text_digest(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("t"))
    keyed = rows.select("doc_id", "t", F.sha2(F.encode("t", "UTF-8"), 256).alias("text_sha256"))
    # 128 bits: the first 32 hexadecimal digits, as bytes
    keyed = keyed.withColumn("h", F.unhex(F.substring("text_sha256", 1, digits)))
    groups = keyed.groupBy("h").agg(
        pick("doc_id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
        (F.min("t") == F.max("t")).alias("same"),
    )
    groups = materialise(groups, "exact-groups")
    narrow = docs.select(F.col(id_col).alias("doc_id"), sha.alias("text_sha256")).withColumn(
        "h", F.unhex(F.substring("text_sha256", 1, digits))
    )
    out = narrow.join(groups.where("same").drop("same"), "h")
    collided = groups.where("NOT same").select("h")
    if not collided.isEmpty():
        again = keyed.join(collided, "h", "left_semi")
        by_text = again.groupBy("t").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(again.join(by_text, "t").drop("t"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
