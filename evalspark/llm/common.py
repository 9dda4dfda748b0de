"""What several operators need: table reading, lineage cuts, fold tests, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a new local one only where the whole session is one machine."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = sc.getCheckpointDir()
        if base is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            base = tempfile.mkdtemp(prefix="llm-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder; a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python BATCH_ROWS at a time at most; a smaller setting is kept.

    With Spark's own 10,000 a batch of whole texts takes tens of MB in the executor and as much again in its Python worker.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``_name``, ``__name``, ... that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Every round takes the smallest label among the neighbours and then the label of that label, so the number of
    rounds grows with the logarithm of the longest path.  Labels are cut off in the shared folder after each round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.filter("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("root").alias("near"))
        nearest = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        moved = labels.join(nearest, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = cut(moved.join(jump, "root", "left").select("node", "old", F.coalesce("far", "root").alias("root")))
        labels = moved.select("node", "root")
        if moved.filter("old <> root").isEmpty():
            return labels
