"""The registry, table loading, and the query log both engines derive from ``events``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Add a query (and, where SQL can express it, its SQL)."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str, **columns: str) -> DataFrame:
    """A shipped table, optionally narrowed to ``new_name="old_name"`` columns."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*[F.col(old).alias(new) for new, old in columns.items()]) if columns else df


# --- the shipped tables in their clinical roles --------------------------------

def patients(spark, sf_dir):
    return table(spark, sf_dir, "customer", subject_id="c_custkey", segment="c_mktsegment")


def admissions(spark, sf_dir):
    return table(
        spark, sf_dir, "orders", hadm_id="o_orderkey", subject_id="o_custkey", admittime="o_orderdate",
        admission_type="o_orderpriority", cost="o_totalprice")


def events(spark, sf_dir):
    return table(
        spark, sf_dir, "lineitem", hadm_id="l_orderkey", line="l_linenumber", itemid="l_partkey",
        charttime="l_shipdate", valuenum="l_quantity", icd_code="l_returnflag")


def items(spark, sf_dir):
    return table(spark, sf_dir, "part", itemid="p_partkey", label="p_name")


def vitals(spark, sf_dir):
    return table(
        spark, sf_dir, "events", event_id="event_id", subject_id="user_id", charttime="ts", vital="event_type",
        valuenum="value")


# --- the derived query log ------------------------------------------------------
# The same expressions run in Spark and in DuckDB.

_BASE = [
    "event_id AS id", "CAST(user_id AS STRING) AS uid", "event_type AS et", "value AS v",
    "CAST(event_id % 8 AS INT) AS k", "CAST(event_id % 5 AS INT) AS g",
]
_TEXTS = [
    "id", "g", "k", "v",
    """CASE k
      WHEN 0 THEN concat('has customer ', uid, ' ordered a ', et, ' item?')
      WHEN 1 THEN concat('how many orders did customer ', uid, ' place')
      WHEN 2 THEN 'what are the top five most frequent parts'
      WHEN 3 THEN concat('when was the last order of customer ', uid)
      WHEN 4 THEN concat('list the priorities of customer ', uid)
      WHEN 5 THEN concat('what was the average quantity for customer ', uid)
      WHEN 6 THEN concat('which customers spent more than customer ', uid)
      ELSE concat('why should i avoid ', et, '?') END AS question""",
    """CASE k
      WHEN 0 THEN concat('SELECT COUNT(*)>0 FROM lineitem WHERE lineitem.l_orderkey IN ( SELECT orders.o_orderkey FROM orders WHERE orders.o_custkey = ', uid, ' )')
      WHEN 1 THEN concat('SELECT COUNT( DISTINCT orders.o_orderkey ) FROM orders WHERE orders.o_custkey = ', uid)
      WHEN 2 THEN 'SELECT T1.l_partkey FROM ( SELECT lineitem.l_partkey, DENSE_RANK() OVER ( ORDER BY COUNT(*) DESC ) AS C1 FROM lineitem GROUP BY lineitem.l_partkey ) AS T1 WHERE T1.C1 <= 5'
      WHEN 3 THEN concat('SELECT orders.o_orderdate FROM orders WHERE orders.o_custkey = ', uid, ' ORDER BY orders.o_orderdate DESC LIMIT 1')
      WHEN 4 THEN concat('SELECT DISTINCT orders.o_orderpriority FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE customer.c_custkey = ', uid, ' AND customer.c_mktsegment = ', chr(39), 'FROM HOUSEHOLD', chr(39))
      WHEN 5 THEN concat('SELECT AVG(lineitem.l_quantity) AS q FROM lineitem JOIN orders ON lineitem.l_orderkey = orders.o_orderkey WHERE orders.o_custkey = ', uid, ' GROUP BY orders.o_custkey HAVING COUNT(*) > 1')
      WHEN 6 THEN concat('SELECT * FROM customer WHERE customer.c_acctbal > ( SELECT c_acctbal FROM customer WHERE c_custkey = ', uid, ' )')
      ELSE NULL END AS true_query""",
]
_LOG = [
    "id", "question", "true_query",
    """CASE g WHEN 0 THEN true_query
         WHEN 1 THEN replace(true_query, 'o_custkey', 'cust_id')
         WHEN 2 THEN concat('Sure. [', coalesce(replace(true_query, 'orders', 'order_facts'), ''), '] done')
         WHEN 3 THEN concat('Fixed SQL query: ', coalesce(true_query, 'No Answer query'), '; trailing')
         ELSE '' END AS generated_sql""",
    "concat('m', CAST(id % 3 AS STRING)) AS model_name",
    "CASE WHEN k = 7 AND g < 3 THEN true WHEN g IN (0, 3) THEN true ELSE false END AS success",
    """CASE WHEN g = 1 THEN 'no such column: orders.cust_id' WHEN g = 2 THEN 'no such table: order_facts'
       WHEN g = 4 THEN 'incomplete input' ELSE NULL END AS error""",
    "CASE WHEN g IN (0, 3) THEN k % 3 ELSE 0 END AS row_count",
    """CASE WHEN g IN (0, 3) AND k % 3 = 1 THEN concat('[{"n": ', CAST(CAST(floor(v) AS INT) AS STRING), '}]')
       WHEN g IN (0, 3) AND k % 3 = 2 THEN concat('[{"n": ', CAST(CAST(floor(v) AS INT) AS STRING), '}, {"n": 1}]')
       ELSE NULL END AS results""",
    "CAST(id % 7 AS DOUBLE) / 4 AS execution_time",
    """CASE WHEN g IN (0, 3) THEN concat('[{"id": 1, "parent": 0, "detail": "SCAN t', CAST(k AS STRING),
       '"}, {"id": 2, "parent": 1, "detail": "USE INDEX ', CAST(g AS STRING), '"}]') ELSE NULL END AS execution_plan""",
]
# what the true queries gave: rows in another order, and other values for some ids
_TRUTH = [
    "id", "question", "true_query", "true AS success", "k % 3 AS row_count", "CAST(NULL AS STRING) AS error",
    "CAST(id % 5 AS DOUBLE) / 2 AS execution_time",
    """CASE WHEN k % 3 = 1 THEN concat('[{"n": ', CAST(CAST(floor(v) AS INT) + CAST(id % 7 = 0 AS INT) AS STRING), '}]')
       WHEN k % 3 = 2 THEN concat('[{"n": 1}, {"n": ', CAST(CAST(floor(v) AS INT) + CAST(id % 11 = 0 AS INT) AS STRING), '}]')
       ELSE '[]' END AS results""",
    """concat('[{"id": 1, "parent": 0, "detail": "SCAN t', CAST(k AS STRING),
       '"}, {"id": 2, "parent": 1, "detail": "USE INDEX 0"}]') AS execution_plan""",
]


def _texts(spark, sf_dir):
    scan = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    # a file has few splits, whose rows grow many times over as texts: the short rows are dealt to all cores first
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scan = scan.repartition(parts, "event_id", "user_id", "event_type", "value")
    return scan.selectExpr(*_BASE).selectExpr(*_TEXTS)


def query_log(spark, sf_dir) -> DataFrame:
    return _texts(spark, sf_dir).selectExpr(*_LOG)


def truth_runs(spark, sf_dir) -> DataFrame:
    return _texts(spark, sf_dir).selectExpr(*_TRUTH)


def _list(exprs: list[str]) -> str:
    return ",\n  ".join(exprs)


LOG_SQL = (
    f"b AS (SELECT {_list(_BASE)} FROM events),\nt AS (SELECT {_list(_TEXTS)} FROM b),\n"
    f"log AS (SELECT {_list(_LOG)} FROM t),\ntruth AS (SELECT {_list(_TRUTH)} FROM t)"
)


def over_log(select: str, *ctes: str) -> str:
    """Oracle SQL over ``log`` and ``truth``."""
    return "WITH " + ",\n".join([LOG_SQL, *ctes]) + "\n" + select


def with_ctes(select: str, *ctes: str) -> str:
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + select


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Engines add floats in another order; compare them to six places."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def joined(column: str):
    """A sorted array as text, for engines that show arrays in other ways."""
    return F.array_join(column, "|")
