"""Tables that share columns, by classes; C5: samples of column values that are cut to size in each task."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import catalogue as c


def _table(spark, rows=20_000, parts=7):
    return spark.range(rows).repartition(parts).select(
        F.col("id").alias("number"), (F.col("id") % 3).alias("few"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("é "), F.col("id") % 1000)).alias("text"),
        F.when(F.col("id") % 5 > 0, F.array(F.col("id") / 7, F.lit(None))).alias("list"))


def _texts(spark):
    rows = _table(spark).collect()
    text = {"number": lambda r: str(r.number), "few": lambda r: str(r.few), "none": lambda r: None, "text": lambda r: r.text,
            "list": lambda r: r["list"] and f"[{round(r['list'][0], 6):.6f}, NULL]"}
    return {name: {v for r in rows if (v := of(r)) is not None} for name, of in text.items()}


@pytest.mark.parametrize("seed", [None, 5])
def test_samples_are_the_first_values(spark, seed):
    got = {}
    for r in c.sample_column_values(_table(spark), "t", 40, seed).collect():
        got.setdefault(r.column, {})[r.position] = r.value
    order = (lambda v: v.encode()) if seed is None else (lambda v: (hashlib.md5(f"{v}-{seed}".encode()).hexdigest(), v.encode()))
    for name, values in _texts(spark).items():
        want = sorted(values, key=order)[:40] or [c.NO_VALUES]
        assert [got[name][i + 1] for i in range(len(got[name]))] == want


@pytest.mark.parametrize("seed", [None, 5])
def test_a_task_sends_at_most_n_values_of_a_column(spark, seed):
    df = _table(spark, 50_000, 4)
    texts = df.select(*[c.value_text(df, name).alias(name) for name in df.columns])
    sent = texts.mapInArrow(c._least_values(df.columns, 9, seed), "column string, value string")
    per_task = sent.groupBy(F.spark_partition_id().alias("task"), "column").count().collect()
    assert per_task and max(r["count"] for r in per_task) <= 9
    plan = c.sample_column_values(df, "t", 9, seed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("MapInArrow")  # nothing is made distinct or ranked before the tasks have cut


def test_an_empty_table_and_a_catalogue(spark):
    empty = _table(spark).limit(0)
    got = c.sample_column_values(empty, "t", 5).collect()
    assert {r.column for r in got} == set(empty.columns) and all((r.position, r.value) == (1, c.NO_VALUES) for r in got)
    known = spark.createDataFrame([("b", "x")], "table string, column string")
    tables = {"a": _table(spark), "b": spark.range(3).toDF("x")}
    assert {(r.table, r.value) for r in c.sample_tables(tables, known).collect()} == {("b", "0"), ("b", "1"), ("b", "2")}


# --- join paths ----------------------------------------------------------------

def _catalogue(spark, seed):
    draw = random.Random(seed)
    columns = ["item_id", "items_id", "t3_id", "t4_id", "a", "b", "c"]
    rows = [(t, col) for t in ["item", "items", "t3", "t3s", "t4", *(f"x{i}" for i in range(15))] for col in columns if draw.random() < 0.4]
    return rows, spark.createDataFrame(rows + rows[:5], "table string, column string")


@pytest.mark.parametrize("seed", range(3))
def test_classes_give_all_pairs(spark, seed):
    rows, catalogue = _catalogue(spark, seed)
    of = {}
    for t, col in rows:
        of.setdefault(t, set()).add(col)
    want = {(a, b): sorted(of[a] & of[b]) for a in of for b in of if a != b and of[a] & of[b]}
    classes = c.join_classes(catalogue)
    assert {(r.t1, r.t2): r.columns for r in c.join_paths(classes).collect()} == want
    some = {(r.t1, r.t2): r.columns for r in c.join_paths(classes, ["t3", "x1", "none"]).collect()}
    assert some == {k: v for k, v in want.items() if k[0] in ("t3", "x1")}
    holders = {col: [t for t in of if col in of[t]] for _, col in rows}
    links = {r.column: (r.n_tables, r.n_classes, r.links) for r in c.column_links(classes).collect()}
    assert links == {col: (len(ts), len({frozenset(of[t]) for t in ts}), len(ts) * (len(ts) - 1)) for col, ts in holders.items() if len(ts) > 1}
    assert sum(n for _, _, n in links.values()) == sum(map(len, want.values()))
    assert {r.table for r in c.tables_with_column(classes, "a").collect()} == set(holders.get("a", []))
    assert {r.column for r in c.join_columns(classes, "t3", "t4").collect()} == of.get("t3", set()) & of.get("t4", set())
    assert {r.table for r in c.joinable_tables(classes, "t3").collect()} == {b for a, b in want if a == "t3"}
    for singular in (False, True):
        def named(t, col):
            return col == f"{t}_id" or singular and col == f"{t.removesuffix('s')}_id"
        edges = {(a, b, col, "incoming" if named(a, col) else "outgoing") for (a, b), cols in want.items() for col in cols
                 if col.endswith("_id") and (named(a, col) or named(b, col))}
        got = [tuple(r) for r in c.key_edges(catalogue, singular).collect()]
        assert len(got) == len(set(got)) and set(got) == edges


def test_a_column_that_every_table_has(spark):
    """3,000 tables of two classes: 9 million pairs, of which none is made."""
    catalogue = spark.range(3_000).select(
        F.concat(F.lit("t"), "id").alias("table"), F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit("id"), F.lit("x"))).otherwise(F.array(F.lit("id")))).alias("column"))
    classes = c.join_classes(catalogue)
    assert {tuple(r) for r in c.column_links(classes).collect()} == {("id", 3_000, 2, 8_997_000), ("x", 1_000, 1, 999_000)}
    assert classes.columns.count() == 3
    assert c.join_paths(classes, ["t0"]).count() == 2_999
