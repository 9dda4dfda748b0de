"""W4, W5 by scope: aliases, shadows, derived tables and names that nothing explains."""

import pytest
from pyspark.sql import functions as F

from evalspark.functions.scopes import DERIVED, resolved_names
from evalspark.operators.workload import unresolved_share

CASES = [
    ("SELECT p.name FROM patients p WHERE p.age > 3", [(0, "p", "name", "patients"), (0, "p", "age", "patients")]),
    ("select A.x from t1 AS a join t2 b on a.id = B.id", [(0, "a", "x", "t1"), (0, "a", "id", "t1"), (0, "b", "id", "t2")]),
    # the inner alias hides the outer one; outer names are seen from inside
    ("SELECT a.x FROM t1 a WHERE a.y IN (SELECT a.z FROM t2 a WHERE a.w = 1)",
     [(0, "a", "x", "t1"), (0, "a", "y", "t1"), (1, "a", "z", "t2"), (1, "a", "w", "t2")]),
    ("SELECT a.x FROM t1 a WHERE EXISTS (SELECT 1 FROM t2 b WHERE b.id = a.id)", [(0, "a", "x", "t1"), (1, "b", "id", "t2"), (1, "a", "id", "t1")]),
    # an aliased table has no other name, and a sibling's alias is not seen
    ("SELECT orders.x FROM orders o", [(0, "orders", "x", None)]),
    ("SELECT (SELECT b.x FROM t2 b), (SELECT b.y FROM t3 c) FROM t1", [(1, "b", "x", "t2"), (2, "b", "y", None)]),
    ("SELECT T1.x FROM ( SELECT lineitem.x FROM lineitem ) AS T1 WHERE T1.x < 5", [(0, "t1", "x", DERIVED), (0, "t1", "x", DERIVED), (1, "lineitem", "x", "lineitem")]),
    ("SELECT a.x, b.y FROM t1 a, t2 b WHERE f(a.x, b.z) = 'c.d FROM t9'", [(0, "a", "x", "t1"), (0, "b", "y", "t2"), (0, "a", "x", "t1"), (0, "b", "z", "t2")]),
    ("SELECT a.x FROM t1 a LEFT JOIN t2 ON (a.id = t2.id AND f(a.u, t2.v) > 0) JOIN t3 USING (id) WHERE t3.k = t4.k",
     [(0, "a", "x", "t1"), (0, "a", "id", "t1"), (0, "t2", "id", "t2"), (0, "a", "u", "t1"), (0, "t2", "v", "t2"), (0, "t3", "k", "t3"), (0, "t4", "k", None)]),
    ("SELECT c.x FROM (SELECT b.x FROM (SELECT a.x FROM t a) b) c", [(0, "c", "x", DERIVED), (1, "b", "x", DERIVED), (2, "a", "x", "t")]),
    ("SELECT x FROM t WHERE y = 1.5", []), ("", []), (None, []), ("SELECT a.b FROM (SELECT 1", [(0, "a", "b", None)]),
]


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(CASES)], "i int, q string")
    out = df.select("i", resolved_names(F.col("q")).alias("n"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    return {r.i: [tuple(n) for n in r.n] for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_names_by_scope(read, i):
    assert read[i] == CASES[i][1]


def test_unresolved_share_per_model(spark):
    df = spark.createDataFrame([("a", "SELECT t.x, u.y FROM t"), ("a", None), ("b", "SELECT 1"), ("c", "SELECT t.x FROM t")], "model string, generated_sql string")
    got = {r.model: (r.names, r.unresolved, r.share) for r in unresolved_share(df).collect()}
    assert got == {"a": (2, 1, 0.5), "b": (0, 0, None), "c": (1, 0, 0.0)}
