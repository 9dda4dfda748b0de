"""Family S: each reader over what its writer wrote from the whole log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_path
from ..sources import tables as s
from .base import over_log, query_log, register, table

_LOG = "id bigint, question string, true_query string, generated_sql string, success boolean, error string"


def _columns(log):
    return log.select("id", "question", "true_query", "generated_sql", "success", "error")


# a line break, a comma and doubled quotes in one field
_ODD = "concat(question, chr(10), '\"quoted\", and, more')"


@register("S1_read_query_log", over_log(f"SELECT id, {_ODD} AS question, true_query, nullif(generated_sql, '') AS generated_sql, success, error FROM log"))
def s1(spark, sf):
    path = work_path(spark, "log-csv")
    odd = _columns(query_log(spark, sf)).withColumn("question", F.expr(_ODD.replace('\\"', '"')))
    s.write_results(odd, path, by=[], csv=True)
    return s.read_query_log(spark, path, _LOG)


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
           "benchmark", "labels", "conversations"]


@register("S2_read_tables", " UNION ALL ".join(f"""SELECT '{t}' AS "table", COUNT(*) AS n FROM {t}""" for t in _TABLES))
def s2(spark, sf):
    counts = [
        df.agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, df in s.read_tables(spark, sf, _TABLES).items()]
    return reduce(DataFrame.unionByName, counts)


@register("S5_read_model_registry", """SELECT DISTINCT concat('Type ', event_type) AS "Model Name", concat('Q', event_type) AS "Quant",
  concat(event_type, '.gguf') AS "Path" FROM events WHERE event_type IN ('view', 'click')""")
def s5(spark, sf):
    """A registry with padded fields, one row per event type; two are chosen."""
    kinds = table(spark, sf, "events").select("event_type").distinct()
    kind = F.col("event_type")
    chosen = kind.isin("view", "click").cast("int")
    line = F.concat_ws(
        ",", F.concat(F.lit("Type "), kind), F.concat(F.lit(" Q"), kind), F.lit(" https://host/x"),
        F.concat(kind, F.lit(".gguf")), chosen.cast("string"), F.lit("0"))
    path = work_path(spark, "registry")
    header = spark.createDataFrame([("Model Name,Quant,Link,Path,Chosen,Chosen-2",)], "value string")
    rows = header.withColumn("at", F.lit(0)).unionByName(kinds.select(line.alias("value"), F.lit(1).alias("at")))
    rows.coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)
    return s.read_model_registry(spark, path, "Chosen").select("Model Name", "Quant", "Path")


@register("S6_read_result_dir", over_log(
    """SELECT concat('model ', model_name, ' x') AS model, id, true_query, nullif(generated_sql, '') AS generated_sql FROM log"""))
def s6(spark, sf):
    """One folder of result files per model, read back in one scan."""
    folder = work_path(spark, "results")
    log = query_log(spark, sf)
    named = F.concat(F.lit("model_"), "model_name", F.lit("_x_results.csv"))
    s.write_results(log.select(*_columns(log).columns, named.alias("file")), folder, by=["file"], csv=True)
    read = s.read_result_dir(spark, folder, _LOG)
    return read.select("model", "id", "true_query", "generated_sql")


@register("S7_write_results", over_log(
    "SELECT id, question, true_query, generated_sql, success, error, model_name FROM log"))
def s7(spark, sf):
    path = work_path(spark, "log-parquet")
    s.write_results(_columns(query_log(spark, sf)).withColumn("model_name", F.concat(F.lit("m"), (F.col("id") % 3).cast("string"))), path, by=["model_name"])
    return spark.read.schema(_LOG + ", model_name string").parquet(path)


@register("S8_write_metrics_json", over_log(
    "SELECT model_name, COUNT(*) AS n, COUNT(*) FILTER (success) AS ok FROM log GROUP BY model_name"))
def s8(spark, sf):
    path = work_path(spark, "metrics-json")
    counts = query_log(spark, sf).groupBy("model_name").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"))
    s.write_json(counts, path)
    return spark.read.schema("model_name string, n bigint, ok bigint").json(path)
