"""W25 over a stored log: repairs are merged into the partitions they touch, the others stay as they are.

A log is stored by model and by bucket of its id.  A merge reads the touched partitions only, writes their new rows down, and then
swaps these partitions in one dynamic overwrite.  As rows keep the outcome they came with (``success_before``), a merge that is
run twice, or again after it was killed, gives the same rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.workload import merge_back

BUCKET = "_bucket"


@dataclass(frozen=True)
class StoredLog:
    """The log under ``path``, in ``buckets`` parts of each model."""

    path: str
    model: str = "model"
    key: str = "id"
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def write(self, log: DataFrame, gen: str = "generated_sql") -> None:
        """Stores a log whose rows were not repaired yet, in place of what was there."""
        fresh = log.withColumns({
            "success_before": F.col("success"), "validation_applied": F.lit(False), "final_query": F.col(gen), BUCKET: self.bucket()})
        self._gathered(fresh).write.mode("overwrite").partitionBy(self.model, BUCKET).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop(BUCKET)

    def _gathered(self, rows: DataFrame) -> DataFrame:
        """Rows of a partition come together, in several tasks where it is large: a task holds what the advisory size allows."""
        return rows.hint("rebalance", self.model, BUCKET)

    def touched(self, repaired: DataFrame) -> Column | None:
        """The partitions that repairs belong to, as a filter on partition columns; None where there are no repairs.

        At most models x buckets rows reach the driver.
        """
        found: dict[str | None, list[int]] = {}
        for row in repaired.select(F.col(self.model).alias("model"), self.bucket()).distinct().collect():
            found.setdefault(row["model"], []).append(row[BUCKET])
        tests = [F.col(self.model).eqNullSafe(F.lit(model)) & F.col(BUCKET).isin(sorted(parts)) for model, parts in found.items()]
        return reduce(lambda a, b: a | b, tests) if tests else None

    def merge(self, repaired: DataFrame, gen: str = "generated_sql", order: str | None = None) -> str | None:
        """Merges repaired rows (see ``merge_back``); the folder that holds the new rows, which ``swap`` puts in place once more if need be."""
        spark = repaired.sparkSession
        touched = self.touched(repaired)
        if touched is None:
            return None
        base = spark.read.parquet(self.path).where(touched)
        merged = merge_back(base, repaired, gen, order, [self.model, self.key]).select(*base.columns)
        folder = f"{self.path.rstrip('/')}-merged-{uuid.uuid4().hex}"
        merged.write.parquet(folder)
        self.swap(spark, folder)
        return folder

    def swap(self, spark: SparkSession, folder: str) -> None:
        """Puts merged rows in place of the partitions they came from; needed by hand only where a merge was killed while it did so."""
        rows = spark.read.parquet(folder)
        self._gathered(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.model, BUCKET).parquet(self.path)
