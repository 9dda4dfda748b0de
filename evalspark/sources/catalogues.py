"""Schema and dictionary JSON as one row per column or code column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMN = (
    "struct<type: string, null: boolean, primary_key: boolean, foreign_key: boolean, relation: string, "
    "description: string>"
)
_SCHEMA = f"map<string, struct<name: string, columns: map<string, {_COLUMN}>>>"
_DICTIONARY = (
    "map<string, array<struct<code_column: string, dict_table: string, dict_code_column: string, "
    "dict_desc_column: string>>>"
)


def read_schema_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """S3: one row per table and column; positions keep the order of the file.

    Each file holds one JSON map of tables, or with ``lines`` each line does.
    """
    files = spark.read.text(path, wholetext=not lines)
    tables = files.select(F.posexplode(F.from_json("value", _SCHEMA)).alias("table_position", "file", "t"))
    columns = tables.select(
        F.regexp_replace("file", r"\.json$", "").alias("table"), "table_position",
        F.posexplode("t.columns").alias("position", "column", "c"),
    )
    return columns.select(
        "table", "table_position", "column", "position", "c.type", F.col("c.null").alias("nullable"), "c.primary_key", "c.foreign_key",
        "c.relation", "c.description",
    )


def read_dictionary_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per coded column of a fact table and the dictionary that explains it."""
    files = spark.read.text(path, wholetext=not lines)
    entries = files.select(F.explode(F.from_json("value", _DICTIONARY)).alias("fact_table", "entries"))
    return entries.select("fact_table", F.inline("entries"))


def catalog_of_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """A catalogue read off the schemas of loaded tables."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, at, f.name, i, f.dataType.simpleString(), f.nullable)
        for at, (name, df) in enumerate(tables.items()) for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "table string, table_position int, column string, position int, type string, nullable boolean")
