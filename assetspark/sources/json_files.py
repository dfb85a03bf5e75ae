"""Large text and JSON files as rows, split by byte ranges.

Spark plans byte ranges of a file and aligns them to a separator. Lines are numbered by the lines of the ranges before
theirs. A JSON file is cut at its commas first; whether a comma parts two entries depends on everything before it, on
quotes and brackets, and is settled by running sums over the ranges and then inside a range. So no file is one row or one
task; a single entry is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PLACE = ["path", "block", "at"]


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of a text source with the file, the start of their byte range and their order in it."""
    return rows.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )


def _sum_before(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the file before each row: first over ranges, then inside a range."""
    valued = rows.withColumn("_v", value)
    totals = valued.groupBy("path", "block").agg(F.sum("_v").alias("_total"))
    ranges = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("path", "block", F.coalesce(F.sum("_total").over(ranges), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum("_v").over(inside), F.lit(0))
    return valued.join(offsets, ["path", "block"]).withColumn(out, F.col("_offset") + here).drop("_v", "_offset")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of text files; lines count from 1, blank ones too."""
    rows = _placed(spark.read.text(path))
    # the rows of a range are numbered in a row, so a range is known by its first number and its count
    ranges = rows.groupBy("path", "block").agg(F.min("at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return rows.join(starts, ["path", "block"]).select("path", (F.col("_before") + F.col("at") - F.col("_first") + 1).alias("line"), "value")


def _brackets(segments: Column, parity: int) -> Column:
    """Opened less closed brackets in every other segment between quotes."""
    text = F.array_join(F.filter(segments, lambda s, i: i % 2 == parity), "")
    opened = F.length(F.regexp_replace(text, r"[^\[{]", ""))
    return opened - F.length(F.regexp_replace(text, r"[^\]}]", ""))


def json_entries(spark: SparkSession, path: str, object_depth: int) -> DataFrame:
    """Entries of JSON files whose root is a list or an object.

    The elements of a root list come with depth 1. Of a root object the members come with ``object_depth`` 1, and the
    elements of the members that are lists with ``object_depth`` 2. Rows: path, number (order in the file), name (the
    member's name, null in a root list), container (``list``, ``member`` or ``object``: a member that is an object, cut at
    its commas), value (JSON text of the element or member) and ``damaged``, true for all rows of a file whose quotes or
    brackets don't match. Files with another root or an empty one have no entries.
    """
    pieces = cut_lineage(_placed(spark.read.option("lineSep", ",").text(path)))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    rows = pieces.withColumn("_segments", F.split(plain, '"'))
    rows = rows.withColumns({"_quotes": F.size("_segments") - 1, "_even": _brackets(F.col("_segments"), 0), "_odd": _brackets(F.col("_segments"), 1)})
    rows = _sum_before(rows.drop("_segments"), F.col("_quotes"), "_q")
    rows = rows.withColumn("_delta", F.when(F.col("_q") % 2 == 0, F.col("_even")).otherwise(F.col("_odd")))
    rows = _sum_before(rows, F.col("_delta"), "_depth")
    root = pieces.groupBy("path").agg(F.min_by(F.substring(F.ltrim(F.regexp_replace("value", r"^\s+", "")), 1, 1), F.struct("block", "at")).alias("root"))
    rows = rows.join(root, "path").filter(F.col("root").isin("[", "{"))
    deep = F.when(F.col("root") == "[", 1).otherwise(object_depth)
    outside = (F.col("_q") + F.col("_quotes")) % 2 == 0
    # the comma behind a piece ends an entry if it stands outside of strings and no deeper than the entries
    ends = outside & (F.col("_depth") + F.col("_delta") <= deep)
    rows = _sum_before(cut_lineage(rows.withColumn("_deep", deep)), ends.cast("long"), "number")

    order = F.struct("block", "at")
    entries = rows.groupBy("path", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("_parts"), F.min_by("_depth", order).alias("_from"),
        F.max_by(F.col("_depth") + F.col("_delta"), order).alias("_to"), F.first("root").alias("root"), F.first("_deep").alias("_deep"),
        F.min("block").alias("block"), F.min("at").alias("at"),
    )
    text = F.array_join(F.transform("_parts", lambda p: p["value"]), ",")
    entries = entries.select("path", "number", "block", "at", "root", "_from", "_to", "_deep", F.regexp_replace(text, r"^\s+|\s+$", "").alias("_text"))
    begins = (F.col("root") == "{") & (F.col("_from") < 2)
    head = F.regexp_replace("_text", r"^\{\s*", "")
    opened = F.when(F.col("_from") == 0, F.when(F.col("root") == "{", head).otherwise(F.regexp_replace("_text", r"^\[\s*", ""))).otherwise(F.col("_text"))
    named = r'(?s)^"((?:[^"\\]|\\.)*)"\s*:\s*(.*)$'
    entries = entries.withColumn("_open", opened).withColumns(
        {
            "_begins": begins,
            "_name": F.when(begins, F.regexp_extract("_open", named, 1)),
            "_rest": F.when(begins, F.regexp_extract("_open", named, 2)).otherwise(F.col("_open")),
        }
    )
    inner = F.when(F.col("_deep") == 2, F.when(F.col("_rest").startswith("["), "list").when(F.col("_rest").startswith("{"), "object").otherwise("member")).otherwise("member")
    entries = entries.withColumn("_kind", F.when(F.col("_begins"), inner))
    numbered = _sum_before(entries, F.col("_begins").cast("long"), "_s").withColumn("_section", F.col("_s") + F.col("_begins").cast("long"))
    sections = numbered.filter("_begins").select("path", "_section", F.col("_name").alias("name"), F.col("_kind").alias("container"))
    out = numbered.drop("_s").join(sections, ["path", "_section"], "left").withColumn("container", F.coalesce("container", F.lit("list")))
    rest = F.when(F.col("_begins") & F.col("container").isin("list", "object"), F.substring("_rest", F.lit(2), F.length("_rest"))).otherwise(F.col("_rest"))
    # the last entries of a container carry its closing brackets and those around it
    held = F.when(F.col("container") == "member", 1).when(F.col("root") == "[", 1).otherwise(2)
    closing = held - F.col("_to")
    cut = F.when(closing == 1, F.regexp_replace(rest, r"\s*[\]}]$", "")).when(closing == 2, F.regexp_replace(rest, r"\s*[\]}]\s*[\]}]$", "")).otherwise(rest)
    ended = rows.groupBy("path").agg(F.sum("_delta").alias("_d"), F.sum("_quotes").alias("_n"))
    damaged = ended.select("path", ((F.col("_d") != 0) | (F.col("_n") % 2 != 0)).alias("damaged"))
    value = F.regexp_replace(cut, r"^\s+|\s+$", "")
    return out.withColumn("value", value).filter("value <> ''").join(damaged, "path").select("path", "number", "name", "container", "value", "damaged")
