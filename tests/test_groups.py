"""Components and splits that keep them whole."""

import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import prep
from evalspark.operators.groups import components, question_key, split_components, sql_form, with_component


def _plain(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    draw = random.Random(kind)
    links = {
        "random": [(draw.randrange(400), draw.randrange(400)) for _ in range(260)],
        "chain": [(i, i + 1) for i in draw.sample(range(300), 300)],
        "star": [(7, i) for i in range(500)] + [(1000, 1001)],
        "none": [(3, 3)],
    }[kind]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: r for x, r in _plain([(a, b) for a, b in links if a != b]).items()}


def test_keys(spark):
    texts = [("What  was it?", "SELECT a1 FROM t WHERE b = 12.5 AND c = 'x y'"), (" what was IT", "select  a1 from t where b = 7 and c = 'z'"), (None, None)]
    rows = spark.createDataFrame(texts, "q string, s string").select(question_key(F.col("q")).alias("q"), sql_form(F.col("s")).alias("s")).collect()
    assert rows[0] == rows[1] == ("what was it", "select a1 from t where b = ? and c = ?") and tuple(rows[2]) == (None, None)


def _rows(seed, n=3_000):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        q, s = draw.randrange(2 * n), draw.randrange(2 * n)
        question = None if i % 97 == 0 else "the same for many" if i % 40 == 0 else f"Question {q}?"
        rows.append((i, question, None if i % 31 == 0 else f"SELECT c{s} FROM t WHERE x = {i}"))
    return rows


@pytest.mark.parametrize("share", [0.1, 0.3])
def test_no_leaks_and_the_share_is_met(spark, share):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "id long, question string, true_query string").repartition(5)
    got = {r.id: r for r in prep.split_without_leaks(df, share).collect()}
    assert len(got) == len(rows)
    sides, links = {}, []
    for i, question, query in rows:
        keys = [("q", question.lower().rstrip("?"))] if question else []
        keys += [("s", query.split(" WHERE")[0])] if query else []
        links += [(str(keys[0]), str(k)) for k in keys[1:]]
        for k in keys:
            sides.setdefault(k, set()).add(got[i].part)
    assert all(len(s) == 1 for s in sides.values())
    root = _plain(links)
    groups = {}
    for i, question, query in rows:
        first = str(("q", question.lower().rstrip("?"))) if question else str(("s", query.split(" WHERE")[0])) if query else f"row {i}"
        groups.setdefault(root.get(first, first), set()).add(got[i].component)
    assert all(len(c) == 1 for c in groups.values()) and len({c for g in groups.values() for c in g}) == len(groups)
    assert abs(sum(r.part == "validation" for r in got.values()) / len(rows) - share) <= 0.01


def test_large_components_and_no_rows(spark):
    df = spark.range(10_000).select("id", F.when(F.col("id") < 6_000, "big").when(F.col("id") < 6_400, "fits").otherwise(F.col("id").cast("string")).alias("component"))
    parts = {(r.component, r.part) for r in split_components(df, 0.1).where("component IN ('big', 'fits')").collect()}
    assert parts == {("big", "train"), ("fits", "validation")}
    assert abs(split_components(df, 0.1).where("part = 'validation'").count() - 1_000) <= 100
    assert split_components(df.limit(0)).collect() == []
    same = with_component(spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, k string"), [F.col("k")])
    assert same.select("component").distinct().count() == 3
