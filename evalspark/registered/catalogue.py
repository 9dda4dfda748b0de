"""Family C: over the tables and columns that the log's queries use, and over the shipped tables.

The catalogue of the workload is found by reading every query of the log, so
its cost grows with the log.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as c
from ..session import work_path
from ..sources.catalogues import read_dictionary_map, read_schema_catalog
from .base import joined, over_log, query_log, register, table

# (table, column) for every dotted name in the true and generated SQL, with how often it is used
_USED = """used AS (SELECT split_part(ref, '.', 1) AS "table", split_part(ref, '.', 2) AS "column", COUNT(*) AS uses FROM (
  SELECT unnest(regexp_extract_all(regexp_replace(coalesce(q, ''), '''[^'']*''', '', 'g'), '([a-zA-Z_][a-zA-Z0-9_]*\\.[a-zA-Z_][a-zA-Z0-9_]*)', 1)) AS ref
  FROM (SELECT true_query AS q FROM log UNION ALL SELECT generated_sql FROM log)) GROUP BY ALL)"""
# the same with each event type as a table: its own key, the user, and the key of a type it may follow
_KEYED = """keyed AS (SELECT DISTINCT event_type AS "table", unnest([concat(event_type, '_id'), 'user_id',
  concat(CASE event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'signup' ELSE 'view' END, '_id')]) AS "column" FROM events)"""
# events in the clinical naming: table names the summary knows, columns it takes as keys
_CLINICAL = """clinical AS (SELECT DISTINCT CASE event_type WHEN 'view' THEN 'patients' WHEN 'click' THEN 'd_icd_diagnoses'
  WHEN 'signup' THEN 'd_items' WHEN 'purchase' THEN 'chartevents' ELSE 'transfers' END AS "table",
  CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'subject_id' WHEN 1 THEN 'itemid' WHEN 2 THEN 'icd_code' ELSE 'label' END AS "column" FROM events)"""


def _used(spark, sf):
    log = query_log(spark, sf)
    texts = log.select(F.explode(F.array("true_query", "generated_sql")).alias("q"))
    bare = F.regexp_replace(F.coalesce("q", F.lit("")), "'[^']*'", "")
    name = "[a-zA-Z_][a-zA-Z0-9_]*"
    refs = texts.select(F.explode(F.regexp_extract_all(bare, F.lit(f"({name}\\.{name})"), F.lit(1))).alias("ref"))
    parts = F.split("ref", r"\.")
    return refs.groupBy(parts[0].alias("table"), parts[1].alias("column")).agg(F.count("*").alias("uses"))


def _keyed(spark, sf):
    kind = F.col("event_type")
    follows = F.when(kind == "view", "click").when(kind == "click", "signup").otherwise("view")
    columns = F.array(F.concat(kind, F.lit("_id")), F.lit("user_id"), F.concat(follows, F.lit("_id")))
    return table(spark, sf, "events").select(kind.alias("table"), F.explode(columns).alias("column")).distinct()


def _clinical(spark, sf):
    kind, slot = F.col("event_type"), F.col("user_id") % 4
    name = (
        F.when(kind == "view", "patients").when(kind == "click", "d_icd_diagnoses").when(kind == "signup", "d_items")
        .when(kind == "purchase", "chartevents").otherwise("transfers"))
    column = F.when(slot == 0, "subject_id").when(slot == 1, "itemid").when(slot == 2, "icd_code").otherwise("label")
    return table(spark, sf, "events").select(name.alias("table"), column.alias("column")).distinct()


@register("C1_join_paths", over_log(
    """SELECT a."table" AS t1, b."table" AS t2, array_to_string(list_sort(list_distinct(list(a."column"))), '|') AS columns
      FROM used a JOIN used b ON a."column" = b."column" AND a."table" <> b."table" GROUP BY 1, 2""", _USED))
def c1(spark, sf):
    return c.join_paths(c.join_classes(_used(spark, sf))).withColumn("columns", joined("columns"))


@register("C1_column_links", over_log(
    """SELECT "column", CAST(COUNT(*) AS BIGINT) AS n_tables, COUNT(DISTINCT cols) AS n_classes, COUNT(*) * (COUNT(*) - 1) AS links
      FROM used JOIN (SELECT "table", list_sort(list("column")) AS cols FROM used GROUP BY "table") USING ("table")
      GROUP BY "column" HAVING COUNT(*) > 1""", _USED))
def c1_links(spark, sf):
    return c.column_links(c.join_classes(_used(spark, sf)))


@register("C1_paths_of_table", over_log(
    """SELECT a."table" AS t1, b."table" AS t2, array_to_string(list_sort(list_distinct(list(a."column"))), '|') AS columns
      FROM used a JOIN used b ON a."column" = b."column" AND a."table" <> b."table" WHERE a."table" IN ('customer', 'lineitem') GROUP BY 1, 2""", _USED))
def c1_paths(spark, sf):
    return c.join_paths(c.join_classes(_used(spark, sf)), ["customer", "lineitem"]).withColumn("columns", joined("columns"))


@register("C2_pk_fk_edges", "WITH " + _KEYED + """ SELECT a."table", b."table" AS other, a."column",
  CASE WHEN a."column" = concat(a."table", '_id') THEN 'incoming' ELSE 'outgoing' END AS direction
  FROM keyed a JOIN keyed b ON a."column" = b."column" AND a."table" <> b."table" WHERE a."column" LIKE '%\\_id' ESCAPE '\\'
  AND a."column" IN (concat(a."table", '_id'), concat(b."table", '_id'))""")
def c2(spark, sf):
    return c.key_edges(_keyed(spark, sf))


@register("C3_tables_with_column", over_log("""SELECT DISTINCT "table" FROM used WHERE "column" = 'o_custkey'""", _USED))
def c3(spark, sf):
    return c.tables_with_column(c.join_classes(_used(spark, sf)), "o_custkey")


@register("C3_join_columns", over_log(
    """SELECT 'orders' AS t1, b."table" AS t2, b."column" FROM used a JOIN used b ON a."column" = b."column"
      AND a."table" <> b."table" WHERE a."table" = 'orders'""", _USED))
def c3_joins(spark, sf):
    return c.join_paths(c.join_classes(_used(spark, sf)), ["orders"]).select("t1", "t2", F.explode("columns").alias("column"))


@register("C4_column_info", over_log(
    """SELECT concat('used ', CASE WHEN uses > 1000 THEN 'often' ELSE 'seldom' END) AS type, concat(uses, ' uses') AS description
      FROM used WHERE "table" = 'orders' AND "column" = 'o_orderdate'""", _USED))
def c4(spark, sf):
    described = _used(spark, sf).withColumns({
        "type": F.concat(F.lit("used "), F.when(F.col("uses") > 1000, "often").otherwise("seldom")),
        "description": F.concat(F.col("uses").cast("string"), F.lit(" uses"))})
    return c.column_info(described, "orders", "o_orderdate")


@register("S3_read_schema_catalog", over_log(
    """SELECT "table", "column", CAST(uses AS VARCHAR) AS type, concat('column ', "column") AS description FROM used""", _USED))
def s3(spark, sf):
    """The workload's catalogue as nested JSON maps, a table to a line, read back as rows."""
    path = work_path(spark, "schema-json")
    column = F.struct(
        F.col("uses").cast("string").alias("type"), F.lit(True).alias("null"), F.lit(False).alias("primary_key"),
        F.lit(False).alias("foreign_key"), F.lit("").alias("relation"),
        F.concat(F.lit("column "), "column").alias("description"))
    tables = _used(spark, sf).groupBy("table").agg(
        F.map_from_entries(F.collect_list(F.struct("column", column))).alias("columns"))
    entry = F.create_map(F.concat("table", F.lit(".json")), F.struct(F.col("table").alias("name"), "columns"))
    tables.select(F.to_json(entry).alias("value")).write.text(path)
    return read_schema_catalog(spark, path, lines=True).select("table", "column", "type", "description")


@register("S4_read_dictionary_map", over_log(
    """SELECT "table" AS fact_table, "column" AS code_column, concat('d_', "table") AS dict_table, "column" AS dict_code_column,
      'label' AS dict_desc_column FROM used WHERE "column" LIKE '%key'""", _USED))
def s4(spark, sf):
    path = work_path(spark, "dictionary-json")
    entry = F.struct(
        F.col("column").alias("code_column"), F.concat(F.lit("d_"), "table").alias("dict_table"),
        F.col("column").alias("dict_code_column"), F.lit("label").alias("dict_desc_column"))
    coded = _used(spark, sf).where(F.endswith("column", F.lit("key")))
    tables = coded.groupBy("table").agg(F.collect_list(entry).alias("entries"))
    tables.select(F.to_json(F.create_map("table", "entries")).alias("value")).write.text(path)
    return read_dictionary_map(spark, path, lines=True)


_STORE = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"], "pages": ["page_id", "url", "html"], "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn", "role", "text"],
}


def _text_sql(column: str) -> str:
    if column == "embedding":
        return "concat('[', array_to_string(list_transform(embedding, lambda x: coalesce(CAST(CAST(x AS DECIMAL(38, 6)) AS VARCHAR), 'NULL')), ', '), ']')"
    return f"CAST({column} AS VARCHAR)"


def _sample_sql(n: int, order: str = "value") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", CAST(coalesce(position, 1) AS INT) AS position, coalesce(value, '<To_Fill>') AS value
        FROM (SELECT 1) LEFT JOIN (SELECT value, ROW_NUMBER() OVER (ORDER BY {order}) AS position FROM (
        SELECT DISTINCT {_text_sql(c)} AS value FROM {t} WHERE {c} IS NOT NULL)) ON true WHERE coalesce(position, 1) <= {n}"""
        for t, columns in _STORE.items() for c in columns)


def _store(spark, sf):
    return {t: table(spark, sf, t) for t in _STORE}


@register("C5_sample_column_values", _sample_sql(150))
def c5(spark, sf):
    return c.sample_tables(_store(spark, sf))


@register("C5_sample_of_catalogue", over_log(
    f"""SELECT * FROM ({_sample_sql(20)}) WHERE "table" IN (SELECT "table" FROM used)""", _USED))
def c5_catalogue(spark, sf):
    """The tables that the queries of the log name, as its catalogue has them."""
    return c.sample_tables(_store(spark, sf), _used(spark, sf), 20)


@register("C5_random_column_values", _sample_sql(150, "md5(concat(value, '-42')), value"))
def c5_random(spark, sf):
    return c.sample_tables(_store(spark, sf), seed=42)


@register("C4_dictionary_info", over_log(
    """SELECT "column" AS code_column, 'd_orders' AS dict_table FROM used WHERE "table" = 'orders' AND "column" LIKE '%key'""", _USED))
def c4_dictionary(spark, sf):
    coded = _used(spark, sf).where(F.endswith("column", F.lit("key"))).select(
        F.col("table").alias("fact_table"), F.col("column").alias("code_column"), F.concat(F.lit("d_"), "table").alias("dict_table"))
    return c.dictionary_info(coded, "orders").select("code_column", "dict_table")


@register("C6_random_sample_value", """SELECT o_orderpriority, arg_min(o_custkey, (o_custkey * 7919 + 13) % 10007 * 1000000000 + o_custkey)
  AS o_custkey FROM orders WHERE o_custkey NOT IN (1, 2, 3) GROUP BY o_orderpriority""")
def c6(spark, sf):
    key = (F.col("o_custkey") * 7919 + 13) % 10007
    return c.random_pick(table(spark, sf, "orders"), ["o_orderpriority"], "o_custkey", exclude=[1, 2, 3], key=key)


@register("C6_random_column", over_log(
    """SELECT "table", arg_min("column", md5(concat("column", '-7'))) AS "column" FROM used WHERE "column" <> 'o_custkey'
      GROUP BY "table" """, _USED))
def c6_column(spark, sf):
    key = F.md5(F.concat("column", F.lit("-7")))
    return c.random_pick(_used(spark, sf), ["table"], "column", exclude=["o_custkey"], key=key)


@register("C7_schema_summary", "WITH " + _CLINICAL + """ SELECT "table", CASE WHEN contains("table", 'patients') THEN 'patient demographic information'
  WHEN contains("table", 'chart') THEN 'patient vital signs and measurements' WHEN contains("table", 'diagnoses') THEN 'diagnosis records with ICD codes'
  WHEN contains("table", 'd_item') THEN 'definitions for chart items' ELSE 'related healthcare data' END AS kind,
  coalesce(string_agg("column", ', ' ORDER BY list_position(['subject_id', 'hadm_id', 'stay_id', 'itemid', 'icd_code'], "column"))
  FILTER ("column" <> 'label'), '') AS key_columns FROM clinical GROUP BY "table" """)
def c7(spark, sf):
    return c.schema_summary(_clinical(spark, sf)).select("table", "kind", "key_columns")


