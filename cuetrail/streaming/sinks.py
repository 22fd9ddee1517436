"""Sinks for foreachBatch that a repeated batch doesn't change: what a batch writes is named after the batch and replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete, exists, names


class Totals:
    """Sums by key, one published version a batch: the version before it plus the batch's signed changes. Versions without a `_SUCCESS` file
    count as unwritten; all but the last KEPT are deleted, so the folder doesn't grow with the stream."""

    KEPT = 3

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], value: str):
        self.spark, self.path, self.keys, self.value = spark, path, keys, value

    def _versions(self) -> list[int]:
        found = [int(n.split("=")[1]) for n in names(self.spark, self.path) if n.startswith("version=")]
        return sorted(v for v in found if exists(self.spark, f"{self.path}/version={v}/_SUCCESS"))

    def publish(self, changes: DataFrame, batch_id: int) -> None:
        """The foreachBatch function."""
        before = [v for v in self._versions() if v < batch_id]
        rows = changes.select(*self.keys, self.value)
        if before:
            rows = rows.unionByName(changes.sparkSession.read.parquet(f"{self.path}/version={before[-1]}").select(*self.keys, self.value))
        sums = rows.groupBy(*self.keys).agg(F.sum(self.value).alias(self.value)).where(F.col(self.value) != 0)
        sums.write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")
        for v in before[: 1 - self.KEPT]:
            delete(self.spark, f"{self.path}/version={v}")

    def read(self) -> DataFrame:
        """The last published version."""
        return self.spark.read.parquet(f"{self.path}/version={self._versions()[-1]}")


class KeyedLog:
    """The last row of each key. Batches are kept as folders until `compact` folds them into one."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...]):
        self.spark, self.path, self.keys = spark, path, keys

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The foreachBatch function, for update mode."""
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame:
        log = self.spark.read.option("basePath", self.path).parquet(self.path)
        rest = [c for c in log.columns if c not in (*self.keys, "batch")]
        last = log.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
        return last.select(*self.keys, "last.*")

    def compact(self) -> None:
        """Fold all batches into the last one; the stream must stand still."""
        batches = sorted(int(n.split("=")[1]) for n in names(self.spark, self.path) if n.startswith("batch="))
        if len(batches) > 1:
            self.read().write.parquet(f"{self.path}/_folded")  # hidden from readers
            self.spark.read.parquet(f"{self.path}/_folded").write.mode("overwrite").parquet(f"{self.path}/batch={batches[-1]}")
            for b in batches[:-1]:
                delete(self.spark, f"{self.path}/batch={b}")
            delete(self.spark, f"{self.path}/_folded")
