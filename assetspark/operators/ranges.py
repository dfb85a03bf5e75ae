"""Interval merging and equality outside ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arithmetic import div

BUCKET = 1 << 20


def merge_ranges(ranges: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Touching or overlapping [start, end] ranges of a group, merged.

    Equal starts collapse first, so a bucket of starts holds at most ``bucket``
    rows however many ranges a group has. The furthest end before a row is the
    larger of the ends in earlier buckets and earlier in its own bucket.
    """
    distinct = ranges.groupBy("grp", "start").agg(F.max("end").alias("end")).withColumn("b", div(F.col("start"), bucket))
    past = Window.partitionBy("grp").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("grp", "b").orderBy("start")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)

    ends = distinct.groupBy("grp", "b").agg(F.max("end").alias("m")).withColumn("past_end", F.max("m").over(past)).drop("m")
    reach = F.greatest(F.max("end").over(before), F.col("past_end"))
    marked = distinct.join(ends, ["grp", "b"]).withColumn("reach", reach)
    opened = marked.withColumn("opens", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), F.col("start")))
    heads = opened.groupBy("grp", "b").agg(F.max("opens").alias("h")).withColumn("past_open", F.max("h").over(past)).drop("h")
    labelled = opened.join(heads, ["grp", "b"]).withColumn(
        "island", F.coalesce(F.max("opens").over(upto), F.col("past_open"))
    )
    return labelled.groupBy("grp", F.col("island").alias("start")).agg(F.max("end").alias("end"))


def outside_ranges(rows: DataFrame, merged: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows (grp, pos, ...) that lie in no half-open merged range.

    Merged ranges are disjoint, so only the last range that starts at or before
    a position can hold it. Positions and starts are walked together in buckets
    of ``bucket`` positions; the last range of earlier buckets is carried over.
    """
    extra = [c for c in rows.columns if c not in ("grp", "pos")]
    marks = rows.select("grp", "pos", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("end"), *extra).unionByName(
        merged.select("grp", F.col("start").alias("pos"), F.lit(0).alias("kind"), "end"), allowMissingColumns=True
    ).withColumn("b", div(F.col("pos"), bucket))
    last = merged.withColumn("b", div(F.col("start"), bucket)).groupBy("grp", "b").agg(F.max("end").alias("end"))
    slots = marks.select("grp", "b").distinct().join(last, ["grp", "b"], "left")
    past = Window.partitionBy("grp").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("grp", "b", F.max("end").over(past).alias("carried"))
    walk = Window.partitionBy("grp", "b").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.greatest(F.max("end").over(walk), F.col("carried"))
    return (
        marks.join(carried, ["grp", "b"])
        .withColumn("reach", reach)
        .filter((F.col("kind") == 1) & (F.col("reach").isNull() | (F.col("pos") >= F.col("reach"))))
        .select("grp", "pos", *extra)
    )


def differences_outside(before: DataFrame, after: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows outside the ranges that exist or differ on one side only.

    The two sides are compared first, so only the rows that differ are walked along the ranges, and once.
    """
    left = before.select("grp", "pos", F.col("value").alias("b_value"))
    right = after.select("grp", "pos", F.col("value").alias("a_value"))
    differing = left.join(right, ["grp", "pos"], "full").filter(~F.col("b_value").eqNullSafe(F.col("a_value")))
    return outside_ranges(differing, merged)
