"""Query logs, clinical tables, model registry, result folders, sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "id string, question string, true_query string, generated_sql string"
REQUIRED_LOG_COLUMNS = ("id", "question", "true_query")
REGISTRY_SCHEMA = "`Model Name` string, Quant string, Link string, Path string, Chosen int, `Chosen-2` int"


def _csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    # multi-line fields make a CSV file unsplittable; write_results offers parquet for large logs
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
    )


def require_columns(df: DataFrame, columns=REQUIRED_LOG_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def read_query_log(
    spark: SparkSession, path: str, schema: str = LOG_SCHEMA, required=REQUIRED_LOG_COLUMNS
) -> DataFrame:
    """CSV of questions and SQL; quoted fields may span lines and hold doubled quotes."""
    return require_columns(_csv(spark, path, schema), required)


def read_tables(spark: SparkSession, folder: str, names: list[str], views: bool = False) -> dict[str, DataFrame]:
    """Parquet tables by name; ``views`` also registers them for SQL."""
    tables = {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in names}
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def list_tables(spark: SparkSession) -> list[str]:
    """Names of the tables and views in the session."""
    return sorted(t.name for t in spark.catalog.listTables())


def read_model_registry(spark: SparkSession, path: str, flag: str | None = None) -> DataFrame:
    """Model list with padded fields; ``flag`` keeps the models chosen by that column."""
    df = (
        spark.read.schema(REGISTRY_SCHEMA).option("header", True)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    )
    return df.where(F.col(f"`{flag}`") != 0) if flag else df


def model_of_file(path: Column, suffix: str = "_results.csv") -> Column:
    """Model named by a result file, or by a folder of part files (also of a partition column): suffix off, underscores as blanks."""
    named = F.regexp_extract(F.url_decode(path), f"([^/=]*?){re.escape(suffix)}", 1)
    return F.translate(named, "_", " ")


def read_result_dir(
    spark: SparkSession, folder: str, schema: str, suffix: str = "_results.csv", required=REQUIRED_LOG_COLUMNS
) -> DataFrame:
    """All result files of a folder in one scan, with the model each came from."""
    df = _csv(spark, f"{folder.rstrip('/')}/*{suffix}", schema)
    return require_columns(df, required).withColumn("model", model_of_file(F.input_file_name(), suffix))


def write_results(df: DataFrame, path: str, by: list[str] = ("model",), csv: bool = False) -> None:
    """Results as parquet partitioned by model, or as CSV with quoted fields."""
    writer = df.write.mode("overwrite").partitionBy(*[c for c in by if c in df.columns])
    if csv:
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Metrics, samples or sensitivity tables as JSON lines."""
    df.write.mode("overwrite").json(path)
