"""A store of scores: what a pair of queries, of results and of plans scored is worked out once and read by every later step.

Scores depend on the texts alone, while logs grow and are summarised again and again.  The store is an append-only set of
parquet files, partitioned by model.  A row is keyed by a 128-bit hash of the model and of all inputs of its measures, so
a run scores only the inputs that no earlier run saw (a left anti join), and a summary joins the log with what is there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import digest
from ..session import work_path

VERSION = "1"  # to be raised with every change of a measure's meaning
KEY = "_score_key"


@dataclass(frozen=True)
class ScoreStore:
    """Scores under ``path``; ``model`` names the column of the log that parts them.

    Runs may overlap, fail, or be repeated: rows reach the folder when their run is committed, and a key that two runs wrote
    counts once.  Scores of another version, or of measures with other columns, live in a folder of their own.  The store is
    never broadcast: by the size of a few columns' files Spark would take millions of keys for a small table.
    """

    path: str
    model: str = "model"
    version: str = VERSION

    def folder(self, schema: StructType) -> str:
        shape = hashlib.md5(f"{self.version} {schema.jsonValue()}".encode()).hexdigest()[:16]
        return f"{self.path.rstrip('/')}/scores-{shape}"

    def read(self, spark: SparkSession, schema: StructType, models: list[str] | None = None) -> DataFrame | None:
        """All scores (key, model, measures), each key once; None where nothing was ever scored.

        ``models`` reads the folders of those models only.
        """
        stored = self._stored(spark, schema)
        if stored is None:
            return None
        if models is not None:
            stored = stored.where(F.col("_model").isin(models))
        return stored.drop("run").dropDuplicates([KEY])

    def _stored(self, spark: SparkSession, schema: StructType) -> DataFrame | None:
        fields = [StructField(KEY, StringType()), *schema.fields, StructField("run", StringType()), StructField("_model", StringType())]
        try:
            return spark.read.schema(StructType(fields)).parquet(self.folder(schema))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def update(self, rows: DataFrame, inputs: list[str], measure: Callable[[DataFrame], DataFrame], schema: StructType | None = None) -> bool:
        """Scores what ``rows`` hold and no run has seen, and appends it; whether there was any.

        The inputs not seen before are written down once and shuffled when they are read, so that scoring is spread over all cores
        and what a task sorts to part it by model does not grow with the splits of the files.  The rows are worked out once: after
        the join that leaves out what is known, repeated inputs are already in one place.
        Where there are none, no measure is started and nothing reaches the store.
        """
        spark = rows.sparkSession
        schema = schema or self.measures(rows, inputs, measure)
        wanted, key = rows.select(self._model(rows), *inputs), digest("_model", *inputs)
        known = self._stored(spark, schema)
        if known is None:
            wanted = wanted.distinct().withColumn(KEY, key)
        else:
            wanted = wanted.withColumn(KEY, key).join(known.select(KEY).hint("merge"), KEY, "left_anti").distinct()
        pending = work_path(spark, "unscored")
        wanted.write.parquet(pending)
        unscored = spark.read.schema(wanted.schema).parquet(pending)
        if unscored.isEmpty():
            return False
        scored = measure(unscored.repartition(KEY)).select(KEY, "_model", *schema.names)
        scored.write.partitionBy("_model").parquet(f"{self.folder(schema)}/run={uuid.uuid4().hex}")
        return True

    def scored(self, rows: DataFrame, inputs: list[str], measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``rows`` with the columns that ``measure`` adds to its ``inputs``, scored now or by an earlier run."""
        schema = self.measures(rows, inputs, measure)
        self.update(rows, inputs, measure, schema)
        stored = self.read(rows.sparkSession, schema)
        if stored is None:  # no rows at all
            return measure(rows)
        keyed = rows.withColumn("_model", self._model(rows)).withColumn(KEY, digest("_model", *inputs)).drop("_model")
        return keyed.join(stored.drop("_model").hint("merge"), KEY, "left").drop(KEY)

    def _model(self, rows: DataFrame):
        name = F.col(self.model).cast("string") if self.model in rows.columns else F.lit(None).cast("string")
        return name.alias("_model")

    def measures(self, rows: DataFrame, inputs: list[str], measure: Callable[[DataFrame], DataFrame]) -> StructType:
        """The columns that ``measure`` adds; only the plan is looked at."""
        added = measure(rows.select(*inputs)).schema
        return StructType([StructField(f.name, f.dataType) for f in added if f.name not in inputs])
