"""The score store: equal results, nothing scored twice, runs that overlap."""

import os
import shutil

from pyspark.sql import functions as F

from evalspark.plans.evaluation import compare_queries, score_models
from evalspark.plans.scores import KEY, ScoreStore
from tests import oracle

LOG = ("id long, question string, true_query string, generated_sql string, model string, success boolean, row_count long, error string, "
       "results string, execution_time double, execution_plan string, success_true boolean, row_count_true long, results_true string, "
       "execution_time_true double, execution_plan_true string")


def _row(i, true="SELECT a FROM t", gen="SELECT a FROM t", model="m1", results='[{"a": 1}]'):
    plan = '[{"id": 1, "parent": 0, "detail": "SCAN t"}]'
    return (i, f"q{i}", true, gen, model, True, 1, None, results, 1.0, plan, True, 1, '[{"a": 1}]', 2.0, plan)


def _log(spark, extra=()):
    rows = [_row(i, gen=f"SELECT a FROM t{i % 3}", model=f"m{i % 2}") for i in range(12)]
    rows += [_row(20, None, None, None), _row(21, "", "", ""), _row(22, None, "", None), _row(23, "ab", "c"), _row(24, "a", "bc"), _row(24, "a", "bc")]
    return spark.createDataFrame([*rows, *extra], LOG)


def _files(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def _plain(df):
    return oracle.spark_rows(df.withColumns({f.name: F.to_json(f.name) for f in df.schema if f.dataType.typeName() == "array"}))


def test_equal_with_and_without_a_store(spark, tmp_path):
    store = ScoreStore(str(tmp_path / "s"))
    want = _plain(compare_queries(_log(spark)))
    assert _plain(compare_queries(_log(spark), store=store)) == want
    assert _plain(compare_queries(_log(spark), store=store)) == want
    assert _plain(score_models(_log(spark), store=store)) == _plain(score_models(_log(spark)))


def test_a_second_run_scores_nothing(spark, tmp_path):
    store = ScoreStore(str(tmp_path / "s"))
    compare_queries(_log(spark), store=store)
    before = _files(tmp_path)
    again = compare_queries(_log(spark), store=store)
    assert _files(tmp_path) == before
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "levenshtein" not in plan
    assert "Python" in compare_queries(_log(spark))._jdf.queryExecution().executedPlan().toString()


def test_only_what_is_new_is_scored(spark, tmp_path):
    store = ScoreStore(str(tmp_path / "s"))
    compare_queries(_log(spark), store=store)
    first = set(os.listdir(next((tmp_path / "s").iterdir())))
    new = [_row(30, "SELECT z FROM t", "SELECT y FROM t", "m9"), _row(31, "SELECT z FROM t", "SELECT y FROM t", "m9"), _row(32)]
    both = _log(spark, new)
    assert _plain(compare_queries(both, store=store)) == _plain(compare_queries(both))
    folder = next((tmp_path / "s").iterdir())
    added = [r for r in set(os.listdir(folder)) - first if r.startswith("run=")]
    assert len(added) == 1
    rows = spark.read.parquet(str(folder / added[0]))
    assert rows.count() == 2 and {r["_model"] for r in rows.select("_model").distinct().collect()} == {"m1", "m9"}


def test_runs_that_overlap_and_models_without_a_name(spark, tmp_path):
    """Two runs that scored the same count once; NULL and empty model names, texts and results are told apart."""
    log = _log(spark, [_row(40, model=None), _row(41, model=""), _row(42, results="")])
    store = ScoreStore(str(tmp_path / "s"))
    want = _plain(compare_queries(log))
    compare_queries(log, store=store)
    folder = next((tmp_path / "s").iterdir())
    run = next(p for p in folder.iterdir() if p.name.startswith("run="))
    shutil.copytree(run, folder / "run=again")
    assert _plain(compare_queries(log, store=store)) == want
    inputs = ["true_query", "generated_sql"]
    measure = lambda rows: rows.withColumn("same", F.col("true_query").eqNullSafe(F.col("generated_sql")))
    small = ScoreStore(str(tmp_path / "t"))
    assert small.update(log, inputs, measure) and not small.update(log, inputs, measure)
    read = small.read(spark, small.measures(log, inputs, measure))
    assert read.count() == log.select("model", *inputs).distinct().count() == read.select(KEY).distinct().count()
    only = small.read(spark, small.measures(log, inputs, measure), models=["m1"])
    assert 0 < only.count() < read.count()


def test_another_version_and_an_empty_log(spark, tmp_path):
    log, path = _log(spark), str(tmp_path / "s")
    compare_queries(log, store=ScoreStore(path))
    compare_queries(log, store=ScoreStore(path, version="2"))
    assert len(os.listdir(path)) == 2
    empty = compare_queries(log.limit(0), store=ScoreStore(str(tmp_path / "e")))
    assert empty.collect() == [] and set(empty.columns) == set(compare_queries(log).columns)
