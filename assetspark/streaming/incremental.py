"""Incremental tables fed by Structured Streaming.

Each table is a folder of deltas, one per micro-batch, so a repeated batch after a
failure writes the same delta again and no batch rewrites earlier rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import REVIEWABLE, latest_by


def _fresh(batch: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    return latest_by(batch, keys, at, values)


class VersionedTable:
    """Latest rows per key in ``path``, one sub-folder per micro-batch."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], at: str, values: list[str]):
        self.spark, self.path = spark, path
        self.keys, self.at, self.values = keys, at, values

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Write the batch's latest rows as its own delta; safe to repeat."""
        fresh = _fresh(batch, self.keys, self.at, self.values)
        fresh.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def current(self) -> DataFrame:
        """Latest row per key over all deltas."""
        rows = self.spark.read.parquet(self.path)
        return latest_by(rows, self.keys, self.at, self.values)

    def compact(self, target: str) -> None:
        """Rewrite the current rows elsewhere, for a swap by the caller."""
        self.current().write.mode("overwrite").parquet(target)


def stream_into(source: DataFrame, table: VersionedTable, checkpoint: str):
    """Start a query that upserts every micro-batch of ``source``."""
    return (
        source.writeStream.foreachBatch(table.upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def review_table(spark: SparkSession, path: str) -> VersionedTable:
    """Review decisions; the latest one wins and ``clear`` hides the asset."""
    return VersionedTable(spark, path, ["asset_id"], "reviewed_at", ["decision", "reviewer"])


def visible_reviews(table: VersionedTable) -> DataFrame:
    return table.current().filter(F.col("decision").isin(REVIEWABLE))


def allowed_reviews(log: DataFrame) -> DataFrame:
    return log.filter(F.col("decision").isin([*REVIEWABLE, "clear"]))


def result_table(spark: SparkSession, path: str) -> VersionedTable:
    """Recognition results; only rows with status ok may be stored."""
    return VersionedTable(spark, path, ["cache_key"], "created_at", ["result_json"])


def storable_results(results: DataFrame) -> DataFrame:
    return results.filter("status = 'ok'")


class BundleIndex:
    """Texture names of bundles, (name, bundle_key), kept up to date by scans.

    ``path`` holds deltas, one folder per batch with the scanned bundles only, and bases, whole indexes as of a batch. The
    newest scan of a bundle decides its names, so a batch rewrites nothing and a repeated batch replaces its own delta.
    """

    START = -1

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, kind: str) -> list[int]:
        """Versions that were written to their end."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return []
        inside = [f.getPath() for f in store.listStatus(folder) if f.isDirectory() and f.getPath().getName().startswith("version=")]
        return sorted(int(p.getName()[len("version="):]) for p in inside if store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, kind: str, versions: list[int]) -> DataFrame:
        rows = self.spark.createDataFrame([], "name string, bundle_key string, version long")
        for version in versions:
            part = self.spark.read.schema("name string, bundle_key string").parquet(f"{self.path}/{kind}/version={version}")
            rows = rows.unionByName(part.withColumn("version", F.lit(version).cast("long")))
        return rows

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        rows.select("name", "bundle_key").distinct().write.mode("overwrite").parquet(f"{self.path}/{kind}/version={version}")

    def start(self, names: DataFrame) -> None:
        """The index to start from; without it the index starts empty."""
        self._write(names, "base", self.START)

    def apply(self, scans: DataFrame, batch_id: int) -> None:
        """Take in the scans of a batch: name, bundle_key; a bundle without names is one row with a null name.

        A batch that a base already contains changes nothing.
        """
        if batch_id > max(self._versions("base"), default=self.START):
            self._write(scans, "delta", batch_id)

    def current(self) -> DataFrame:
        """The index after all batches."""
        base = self._versions("base")[-1:]
        rows = self._read("base", base).unionByName(self._read("delta", [v for v in self._versions("delta") if not base or v > base[0]]))
        newest = rows.groupBy("bundle_key").agg(F.max("version").alias("version"))
        return rows.join(newest, ["bundle_key", "version"], "left_semi").filter("name is not null").select("name", "bundle_key")

    def compact(self) -> None:
        """Write the index as of the newest batch as a base; older folders are no longer read."""
        versions = self._versions("delta")
        if versions and versions[-1] > max(self._versions("base"), default=self.START):
            self._write(self.current(), "base", versions[-1])


def refresh_index_stream(scans: DataFrame, index: BundleIndex, checkpoint: str):
    """Start a query that brings an index up to date with every micro-batch of scans (name, bundle_key)."""
    return (
        scans.writeStream.foreachBatch(index.apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
