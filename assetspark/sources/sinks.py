"""Result files, summaries, run records and the texture catalog."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .json_files import numbered_lines


def write_results(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Deterministic JSONL: columns by name, rows by (asset_id, source)."""
    ordered = results.select(*sorted(results.columns)).orderBy("asset_id", "representative_source")
    ordered.write.mode(mode).option("ignoreNullFields", "false").json(path)


def summary_rows(results: DataFrame, detections: DataFrame, references: DataFrame) -> DataFrame:
    """Flat report rows: joined texts, distinct asset types and groups.

    Detections are already limited per asset; types and groups are distinct
    before they are joined, and references are only counted.
    """
    texts = detections.filter("text <> ''").groupBy("asset_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda e: e["text"]), " | ").alias("ocr_text")
    )
    per = references.groupBy("asset_id", "asset_type", "group").agg(F.count("*").alias("n")).groupBy("asset_id").agg(
        F.sum("n").alias("reference_count"),
        F.array_join(F.array_sort(F.collect_set("asset_type")), "|").alias("asset_types"),
        F.array_join(F.array_sort(F.collect_set("group")), "|").alias("groups"),
    )
    return (
        results.join(texts, "asset_id", "left").join(per, "asset_id", "left")
        .withColumn("ocr_text", F.coalesce("ocr_text", F.lit("")))
        .withColumn("reference_count", F.coalesce("reference_count", F.lit(0)))
    )


def write_summary(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.orderBy("asset_id").write.mode(mode).option("header", "true").csv(path)


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """(position, value) of the lines of a folder of text files, files by name, positions from 1."""
    lines = numbered_lines(spark, path)
    counts = lines.groupBy("path").agg(F.count("*").alias("_n"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = counts.select("path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(starts, "path").select((F.col("_before") + F.col("line")).alias("position"), "value")


def run_record(
    run_id: str, started_at: Column, finished_at: Column, inputs: list[str], config: dict, plan: DataFrame, summary: DataFrame
) -> DataFrame:
    """The record of a run as one row; ``finished_at`` is null while it is in progress.

    ``plan`` and ``summary`` are counters (counter, name, n), a few rows by type or reason, kept as maps
    ``counter/name -> n``; ``config`` is written as JSON with sorted keys.
    """

    def counters(rows: DataFrame, out: str) -> DataFrame:
        entry = F.struct(F.concat_ws("/", "counter", "name").alias("key"), F.col("n").cast("long").alias("value"))
        return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(out)).withColumn("_one", F.lit(1))

    both = counters(plan, "plan").join(counters(summary, "summary"), "_one")  # one row each
    packed = json.dumps(config, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return both.select(
        F.lit(run_id).alias("run_id"), F.lit(1).alias("schema_version"), started_at.alias("started_at"), finished_at.alias("finished_at"),
        F.array(*[F.lit(i) for i in inputs]).cast("array<string>").alias("inputs"), F.lit(packed).alias("config"), "plan", "summary",
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """Pointer to the last finished run per collection."""
    return runs.groupBy("collection").agg(
        F.max_by("run_id", F.struct("finished_at", "run_id")).alias("run_id"), F.max("finished_at").alias("finished_at"), F.count("*").alias("runs")
    )


def append_run(run: DataFrame, path: str) -> None:
    run.write.mode("append").parquet(path)


def write_catalog(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Catalog rows partitioned by root and folder.

    Rows are spread by (root, folder, asset hash), so one large folder is
    written by several tasks.
    """
    spread = F.pmod(F.xxhash64("asset_id"), F.lit(64))
    rows.repartition("root", "folder", spread).write.mode(mode).partitionBy("root", "folder").parquet(path)
