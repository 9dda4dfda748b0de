"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the operators count on.  AQE picks broadcast or shuffle joins
# from measured sizes and splits shuffle partitions that one hot key fills, so no
# operator hints a broadcast for a side whose size it cannot bound.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Shuffles start in this many parts at least, which AQE merges where they are small: with few, what a task sorts grows with the
# table.  Up to 200 parts a map task writes its rows without sorting them in memory.
INITIAL_PARTS = 200
_PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

# AQE merges parts up to this many MB as they are written, compressed; sorted or hashed in memory, a log's texts take some eleven
# times as much.  With Spark's own 64 MB a task's memory keeps growing with the table until it holds that.
ADVISORY_MB = 8
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _megabytes(size: str) -> float:
    """A size as Spark's settings name it (bytes, where no unit is given)."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", size.lower()).groups()
    return int(number) * 1024.0 ** (" kmgtp".index(unit or " ") - 2)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    known = [spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(_PARTS, None)]
    spark.conf.set(_PARTS, str(max(INITIAL_PARTS, *[int(n) for n in known if n])))
    advisory = spark.conf.get(_ADVISORY, None)
    if advisory is None or _megabytes(advisory) > ADVISORY_MB:
        spark.conf.set(_ADVISORY, f"{ADVISORY_MB}m")
    return spark


def local_session(cpus: int | str = "*", app: str = "evalspark", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="evalspark-"))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Written tables must outlive any executor, so a machine-local folder (one per session) is only
    used when the whole session runs on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        own = spark.sparkContext.applicationId
        if own not in _own_folders:
            _own_folders[own] = tempfile.mkdtemp(prefix="evalspark-")
        base = _own_folders[own]
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
