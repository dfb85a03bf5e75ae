"""Exact duplicates by content hash, confirmed on the bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii


def exact_groups(
    docs: DataFrame, content: Column, id_col: str = "doc_id", keep: str = "min"
) -> DataFrame:
    """One row per document with the row of its group that stays.

    Rows are grouped by the 128-bit hash of ``content`` and, inside a hash, by the bytes
    themselves, so texts that only share a hash stay apart. Both keys enter a hash
    aggregation with map-side combining: a group that holds a third of all rows sends one
    row per task. The group is then joined back by two short digests.

    ``keep`` names the id that stays, the smallest (``min``) or the largest (``max``).

    Result: id, keep_id, group_size, kept, content_sha256. Null content counts as empty. A null id
    never stays unless the whole group has none; its keep_id is then null and kept is true.
    Rows that repeat the id that stays are that document again and are kept with it.
    Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(content, F.lit("")).alias("_content"))
    groups = (
        rows.groupBy(F.md5("_content").alias("_hash"), "_content")
        .agg(best("_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("_hash", F.sha2("_content", 256).alias("_digest"), "keep_id", "group_size")
    )
    light = rows.select("_id", F.md5("_content").alias("_hash"), F.sha2("_content", 256).alias("_digest"))
    return light.join(groups, ["_hash", "_digest"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("_digest").alias("content_sha256"),
    )


def drop_copies(docs: DataFrame, content: Column | None = None, id_col: str = "doc_id", keep: str = "min") -> DataFrame:
    """The documents that stay, with all their columns."""
    content = lower_ascii(F.col("text")) if content is None else content
    stay = exact_groups(docs, content, id_col, keep).filter("kept").select(F.col(id_col).alias("_stay")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["_stay"]), "left_semi")
