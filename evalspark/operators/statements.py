"""Run a table of Spark SQL statements and record each outcome."""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIME_LIMIT = 20.0


_RAW = (
    "statement string, success boolean, execution_time double, error string, result_columns array<string>, "
    "execution_plan string"
)


def _distinct_names(names: list[str]) -> list[str]:
    """Repeated result columns get a running number, so a row fits one JSON object."""
    return [n if names.index(n) == i else f"{n}:{names[:i].count(n)}" for i, n in enumerate(names)]


def _run_one(spark: SparkSession, statement: str, query: str, rows_path: str, limit: float) -> tuple:
    """Plan, run and write one statement; a time limit cancels its Spark jobs."""
    started = time.time()
    timer = threading.Timer(limit, spark.sparkContext.cancelJobsWithTag, [statement])
    spark.sparkContext.addJobTag(statement)
    timer.start()
    try:
        # only queries can stand in brackets, so the parser refuses text that would change or drop tables
        bracketed = f"SELECT * FROM (\n{query.rstrip().rstrip(';')}\n)"
        df = spark.sql(bracketed)
        lines = "\n".join(r[0] for r in spark.sql(f"EXPLAIN {bracketed}").collect()).split("\n")
        plan = json.dumps([{"id": i, "parent": 0, "detail": x.lstrip(" :+-*")} for i, x in enumerate(lines) if x.strip()])
        names = _distinct_names(df.columns)
        (
            df.toDF(*names)
            .select(F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"}).alias("row"))
            .withColumn("statement", F.lit(statement))
            .write.mode("append").partitionBy("statement").parquet(rows_path)
        )
        return statement, True, time.time() - started, None, names, plan
    except Exception as error:  # a bad statement is an outcome, not a failure of the run
        late = time.time() - started >= limit
        message = "execution time limit reached" if late else str(error).split("\n")[0]
        return statement, False, time.time() - started, message, None, None
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(statement)


def run_statements(
    statements: DataFrame, path: str, query: str = "true_query", text_limit: int | None = None,
    time_limit: float = TIME_LIMIT, batch: int = 200,
) -> tuple[DataFrame, DataFrame]:
    """Run a table of (id, statement); return (outcomes by id, result rows by statement).

    Equal texts run once.  The driver only plans: distinct texts reach it a
    partition at a time, result rows are written by Spark under ``path/rows`` as
    (statement, row JSON), outcomes under ``path/outcomes`` every ``batch``
    statements.  A NULL text counts as success, an empty one as not provided.
    Texts run whole; ``text_limit=500`` cuts them as the published runs did.
    """
    spark = statements.sparkSession
    rows_path, outcomes_path = f"{path}/rows", f"{path}/outcomes"
    text = F.col(query) if text_limit is None else F.substring(query, 1, text_limit)
    keyed = statements.select("id", text.alias("query")).withColumn("statement", F.sha2("query", 256))
    spark.createDataFrame([], "row string").write.mode("overwrite").parquet(f"{rows_path}/statement=none")
    spark.createDataFrame([], _RAW).write.mode("overwrite").parquet(outcomes_path)
    pending: list[tuple] = []

    def flush() -> None:
        if pending:
            spark.createDataFrame(pending, _RAW).coalesce(1).write.mode("append").parquet(outcomes_path)
            pending.clear()

    for row in keyed.where("query <> ''").select("statement", "query").distinct().toLocalIterator():
        pending.append(_run_one(spark, row["statement"], row["query"], rows_path, time_limit))
        if len(pending) >= batch:
            flush()
    flush()
    result_rows = spark.read.schema("row string, statement string").parquet(rows_path)
    counts = result_rows.groupBy("statement").agg(F.count("*").alias("row_count"))
    runs = spark.read.schema(_RAW).parquet(outcomes_path).join(counts, "statement", "left")
    ran = F.col("query").isNotNull() & (F.col("query") != "")
    outcomes = keyed.join(runs, "statement", "left").withColumns({
        "success": F.when(ran, F.col("success")).otherwise(F.col("query").isNull()),
        "row_count": F.coalesce("row_count", F.lit(0)),
        "error": F.when(F.col("query") == "", "No query provided").otherwise(F.col("error")),
    })
    return outcomes, result_rows
