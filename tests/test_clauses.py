"""Native clause splitting against a plain reader, and the tree of sub-selects; W9: the order of plans."""

import functools
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.functions import similarity
from evalspark.functions.clauses import CLAUSES, split_clauses, subselect_tree

PIECES = ["SELECT", "select ", "FROM", " FROM ", " WHERE ", "(", ")", "(SELECT ", "( select", "'", '"', "\\'", " GROUP BY ", " having ", " ORDER  BY ", "\tLIMIT\n",
          "a", "b.c", " = ", ", ", "x1", " ", "FROMAGE", "é", "(1)", "') (SELECT", " SUBQUERY_0 ", "*", "5"]


def _native(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string")
    rows = df.select("i", split_clauses(F.col("q")).alias("c"), subselect_tree(F.col("q")).alias("t")).orderBy("i").collect()
    return [(r.c.asDict(recursive=True), [tuple(n) for n in r.t]) for r in rows]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=150, max_size=200))
def test_clauses_equal_the_plain_reader(spark, texts):
    for text, (got, _) in zip(texts, _native(spark, texts)):
        assert got == similarity.split_clauses(text), text


def plain_tree(text):
    text = " ".join(text.split())
    spans = [(h.start(), e) for h in similarity._SUBQUERY.finditer(text) if (e := similarity._closing(text, h.start())) >= 0]
    out = []
    for i, (a, e) in enumerate(spans):
        around = [j for j, (b, f) in enumerate(spans) if b < a and e <= f]
        out.append((i, around[-1] if around else None, len(around) + 1, text[a + 1:e - 1]))
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=150, max_size=200))
def test_trees_equal_a_plain_one(spark, texts):
    for text, (_, tree) in zip(texts, _native(spark, texts)):
        assert tree == plain_tree(text), text


def test_depths_quotes_and_unclosed_brackets(spark):
    deep = "SELECT a FROM (SELECT b FROM (SELECT c FROM t WHERE x = ')') u WHERE y IN ( SELECT z FROM v)) w ORDER BY a LIMIT 3"
    none, empty, unclosed, nested = None, "", "SELECT a FROM (SELECT b FROM t WHERE c IN (SELECT d FROM e)", deep
    got = _native(spark, [none, empty, unclosed, nested])
    assert all(v == "" for k, v in got[0][0].items() if k != "subqueries") and got[0] == got[1] and got[0][1] == []
    assert got[2][0]["subqueries"] == ["SELECT d FROM e"] and got[2][1] == [(0, None, 1, "SELECT d FROM e")]
    clauses, tree = got[3]
    assert [(i, parent, depth) for i, parent, depth, _ in tree] == [(0, None, 1), (1, 0, 2), (2, 0, 2)]
    assert tree[1][3] == "SELECT c FROM t WHERE x = ')'" and tree[2][3] == " SELECT z FROM v"
    assert clauses["order_by_clause"] == "a" and clauses["limit_clause"] == "3" and clauses["select_clause"] == "a"


def test_no_python_and_a_long_query(spark):
    df = spark.createDataFrame([("SELECT " + ", ".join(f"f(c{i})" for i in range(3_000)) + " FROM t WHERE a IN (SELECT 1)",)], "q string")
    out = df.select(split_clauses(F.col("q")).alias("c"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.first().c.where_clause == "a IN (SELECT SELECT 1)" and len(CLAUSES) == 7


def _plan(draw, n):
    return [{"id": i + 1, "parent": draw.randint(0, i), "detail": draw.choice(["SCAN t", "SEARCH u", "SORT", "USE é"])} for i in range(n)]


def plain_order(a, b):
    if a is None or b is None:
        return None if a is None and b is None else 0.0

    def steps(plan):
        level = {}
        for s in sorted(plan, key=lambda s: s["id"]):
            level[s["id"]] = level.get(s["parent"], -1) + 1
        return [(level[s["id"]], s["detail"]) for s in sorted(plan, key=lambda s: s["id"])]

    x, y = steps(a), steps(b)

    @functools.lru_cache(None)
    def common(i, j):
        if i == len(x) or j == len(y):
            return 0
        return 1 + common(i + 1, j + 1) if x[i] == y[j] else max(common(i + 1, j), common(i, j + 1))

    return 2 * common(0, 0) / (len(x) + len(y)) if x or y else 1.0


def test_plan_order_of_varied_plans(spark):
    draw = random.Random(4)
    pairs = [(None, None), (None, []), ([], []), ([], _plan(draw, 2))]
    for _ in range(200):
        a = _plan(draw, draw.randint(0, 12))
        b = [dict(s) for s in a if draw.random() < 0.8] if draw.random() < 0.6 else _plan(draw, draw.randint(0, 12))
        draw.shuffle(b)  # ids, not places, give the order
        pairs.append((a, b))
    df = spark.createDataFrame([(i, a and json.dumps(a) if a != [] else "[]", b and json.dumps(b) if b != [] else "[]") for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    out = df.select("i", similarity.plan_order_similarity(F.col("a"), F.col("b")).alias("s"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.s for r in out.collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == (None if (w := plain_order(a, b)) is None else w), (a, b)
