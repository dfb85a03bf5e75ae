"""Numbering of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_by_rows(df: DataFrame, group: str, major: str, minor: list[str], out: str) -> DataFrame:
    """1-based position by (major, minor) inside each group, in two levels.

    ``major`` is a bounded integer (a pixel row): counts per major value are
    summed first, then rows are numbered inside one major value.
    """
    counts = df.groupBy(group, major).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy(major).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(group, major).orderBy(*minor)
    return (
        df.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [group, major])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_inside", "_offset")
    )
