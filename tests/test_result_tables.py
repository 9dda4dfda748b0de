"""W11 over results as tables: fingerprints first, rows only where they differ."""

import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import workload as w
from evalspark.plans.evaluation import compare_queries


def _plain(true_rows, gen_rows, statements):
    """(statement: true rows, generated rows, rows on one side only, least row of the true side alone, equal)"""
    out = {}
    for key in statements:
        a = [r for k, r in true_rows if k == key]
        b = [r for k, r in gen_rows if k == key]
        apart = set(a) ^ set(b)
        out[key] = (len(a), len(b), len(apart), min(set(a) - set(b), default=None), len(a) == len(b) and not apart)
    return out


def _exchanged(df):
    """Rows each shuffle of the finished plan wrote."""
    def nodes(plan):
        yield plan
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            below = [plan.executedPlan()]
        elif "QueryStage" in name:
            below = [plan.plan()]
        else:
            children = plan.children()
            below = [children.apply(i) for i in range(children.size())]
        for child in below:
            yield from nodes(child)

    df.collect()
    found = []
    for node in nodes(df._jdf.queryExecution().executedPlan()):
        metric = node.metrics().get("shuffleRecordsWritten")
        if node.nodeName() == "Exchange" and metric.isDefined():
            found.append(metric.get().value())
    return found


@pytest.mark.parametrize("seed", range(3))
def test_against_a_plain_version(spark, seed):
    draw = random.Random(seed)
    true_rows = [(draw.choice([None, 1, 2, 3, 4]), draw.choice("abcd")) for _ in range(60)]
    gen_rows = [(k, r) if draw.random() < 0.9 else (k, r + "x") for k, r in true_rows if k != 4]
    true_rows += [(7, f"r{i}") for i in range(100)]  # one statement has most rows, and they are equal in another order
    gen_rows += [(7, f"r{i}") for i in reversed(range(100))]
    true_rows += [(8, "a"), (8, "a"), (8, "b"), (10, "only")]
    gen_rows += [(8, "a"), (8, "b"), (8, "b"), (9, "only")]  # equal as sets, with other repeats
    frames = [spark.createDataFrame(rows, "k long, row string").repartition(5) for rows in (true_rows, gen_rows)]
    got = {r.k: (r.true_rows, r.gen_rows, r.diff_count, r.example_diff_row, r.equal) for r in w.compare_result_tables(*frames, "k", "row").collect()}
    assert got == _plain(true_rows, gen_rows, {k for k, _ in true_rows + gen_rows})
    assert got[8][4] and got[7] == (100, 100, 0, None, True)


def test_rows_of_equal_results_are_not_shuffled(spark):
    """Statement 0 owns a third of all rows and is equal, so no row of it is exchanged."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.concat(F.lit("row "), F.col("id")).alias("row"))
    same = w.compare_result_tables(rows, rows.repartition(7), "k", "row")
    assert max(_exchanged(same), default=0) < 1_000  # fingerprints are done by now
    assert all(r.equal for r in same.collect())
    changed = rows.withColumn("row", F.when(F.col("k") == 7, F.concat("row", F.lit("!"))).otherwise(F.col("row")))
    apart = w.compare_result_tables(rows, changed, "k", "row")
    assert max(_exchanged(apart)) < 3_000  # rows of statement 7; not the 30,000
    assert {r.k for r in apart.collect() if not r.equal} == {7}


def test_true_results_stand_for_every_model(spark):
    true_rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, row string")
    gen_rows = spark.createDataFrame([("x", 1, "b"), ("x", 1, "a"), ("y", 1, "a"), ("y", 1, "z"), ("y", 2, "c")], "model string, id long, row string")
    log = spark.createDataFrame(
        [(i, m, "SELECT a FROM t", "SELECT a FROM t", m != "y" or i != 2, None, None) for i in (1, 2, 3) for m in ("x", "y")],
        "id long, model string, true_query string, generated_sql string, success boolean, row_count long, error string")
    out = {(r.model, r.id): r for r in compare_queries(log, text_similarity=False, result_tables=(true_rows, gen_rows)).collect()}
    assert len(out) == 6
    assert out["x", 1].results_match == 1 and out["x", 1].result_reason.startswith("Results are identical")
    assert (out["y", 1].results_match, out["y", 1].result_diff_count, out["y", 1].result_diff_percentage, out["y", 1].result_example_diff_row) == (0, 2, 100.0, "b")
    assert out["x", 2].result_reason == "Second result is empty, first has data" and out["x", 2].gen_empty_result
    assert out["y", 2].results_match == 0 and out["y", 2].result_reason == "Generated query failed to execute"
    assert out["x", 3].both_empty and out["x", 3].results_match == 1
    assert out["x", 1].composite_score == pytest.approx(0.3 + 0.2 + 0.2)


def test_no_rows_at_all(spark):
    none = spark.createDataFrame([], "k long, row string")
    assert w.compare_result_tables(none, none, "k", "row").collect() == []
    alone = w.compare_result_tables(none, none, "k", "row", spark.createDataFrame([(5,)], "k long")).first()
    assert alone.equal and alone.reason == "Both results are empty"


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_rows_of_results_of_other_lengths_are_not_shuffled(spark):
    """Statement 0 has all but a few rows and one too many: a log's row says so without a look at them."""
    rows = spark.range(20_000).select(F.when(F.col("id") < 19_990, 0).otherwise(F.col("id")).alias("id"), F.concat(F.lit("row "), F.col("id")).alias("row"))
    more = rows.union(spark.createDataFrame([(0, "more")], "id long, row string")).withColumn(
        "row", F.when(F.col("id") == 19_995, "other").otherwise(F.col("row")))
    log = rows.select("id").distinct().withColumn("success", F.lit(True))
    out = w.with_result_tables_match(log, "success", rows, more)
    assert max(_exchanged(out), default=0) < 1_000
    got = {r.id: r for r in out.collect()}
    assert (got[0].true_result_rows, got[0].gen_result_rows, got[0].result_reason, got[0].results_match) == (19_990, 19_991, "Different number of rows", 0)
    assert (got[19_995].result_diff_count, got[19_995].result_example_diff_row) == (2, "row 19995")
    assert sum(r.results_match for r in got.values()) == 9
    # asked for by themselves, the rows are counted as before
    alone = {r.id: r.diff_count for r in w.compare_result_tables(rows, more, "id", "row").collect()}
    assert alone[0] == 1 and alone[19_995] == 2


def test_marks_leave_out_rows_before_the_shuffle(spark, no_broadcast, monkeypatch):
    """Where the statements that differ are too many to be broadcast, the rows of the others still are not shuffled."""
    monkeypatch.setattr(w, "MARKED", 1, raising=False)
    rows = spark.range(30_000).selectExpr("id % 50 AS k", "concat('row ', id) AS row")
    changed = rows.withColumn("row", F.when(F.col("k") == 7, F.concat("row", F.lit("!"))).otherwise(F.col("row")))
    apart = w.compare_result_tables(rows, changed, "k", "row")
    assert max(_exchanged(apart)) < 3_000
    assert {r.k: r.diff_count for r in apart.collect() if not r.equal} == {7: 1_200}


@pytest.mark.parametrize("marked", [1, 100_000])
def test_null_keys_of_several_columns(spark, no_broadcast, monkeypatch, marked):
    monkeypatch.setattr(w, "MARKED", marked, raising=False)
    draw = random.Random(marked)
    keys = [(i, m) for i in (None, 0, 1, 2, -1) for m in (None, "", "x")]
    gen_rows = [(*draw.choice(keys), draw.choice("ab")) for _ in range(60)]
    true_rows = [(draw.choice(keys)[0], draw.choice("ab")) for _ in range(20)]
    gen = spark.createDataFrame(gen_rows, "id long, model string, row string").repartition(5)
    true = spark.createDataFrame(true_rows, "id long, row string").repartition(5)
    log = spark.createDataFrame(keys, "id long, model string")
    got = {(r.id, r.model): (r.true_rows, r.gen_rows, r.diff_count, r.example_diff_row, r.equal) for r in w.compare_result_tables(true, gen, ["id", "model"], "row", log).collect()}
    want = _plain([((i, m), r) for i, r in true_rows for m in (None, "", "x")], [((i, m), r) for i, m, r in gen_rows], keys)
    assert got == want


def test_fingerprints_are_joined_where_they_lie(spark, no_broadcast, monkeypatch):
    """One shuffle each for the statements and the fingerprints of both sides."""
    plans, written = [], w._written
    monkeypatch.setattr(w, "_written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    rows = spark.range(100).selectExpr("id % 9 AS k", "nullif(concat('m', id % 2), 'm1') AS model", "concat('row ', id) AS row")
    w.compare_result_tables(rows, rows, ["k", "model"], "row", rows.select("k", "model"))
    assert plans[0].count("Exchange hashpartitioning") == 3


def test_each_pair_of_queries_is_read_once(spark, monkeypatch):
    texts = [None, "", "SELECT a FROM t", "SELECT b FROM u WHERE c = 1"]
    log = spark.createDataFrame(
        [(i, m, a, b, True, None, None) for i, (a, b) in enumerate((a, b) for a in texts for b in texts for _ in range(3)) for m in "xyz"],
        "id long, model string, true_query string, generated_sql string, success boolean, row_count long, error string")
    rows = spark.createDataFrame([(1, "a")], "id long, row string")
    counts, read = [], w.with_access_overlap
    monkeypatch.setattr(w, "with_access_overlap", lambda df, *args, **more: counts.append(df.count()) or read(df, *args, **more))
    out = compare_queries(log, text_similarity=False, result_tables=(rows, rows.withColumn("model", F.lit("x"))))
    assert counts[-1] == len(texts) ** 2
    added = [c for c in out.columns if "tables" in c or "columns" in c or c.endswith("accuracy")]
    want = read(log).select("id", "model", *added)
    assert out.count() == log.count() and out.select("id", "model", *added).exceptAll(want).isEmpty()
