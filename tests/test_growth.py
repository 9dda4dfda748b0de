"""Tables that grow: work and memory of one task stay bounded, with the results of before."""

import difflib
import os
import random

from pyspark.sql import functions as F

from evalspark.functions.similarity import edit_distance, text_ratio
from evalspark.operators import workload as w
from evalspark.plans.evaluation import compare_queries
from evalspark.plans.scores import KEY, ScoreStore
from evalspark.plans.stored_log import StoredLog
from evalspark.registered.base import query_log, truth_runs
from evalspark.session import ADVISORY_MB, INITIAL_PARTS, configure


def _texts(r, letters, size):
    a = "".join(r.choice(letters) for _ in range(r.randrange(size)))
    b = list(a)
    for _ in range(r.randrange(6)):
        at = r.randrange(len(b) + 1)
        b[at:at + r.randrange(4)] = [r.choice(letters) for _ in range(r.randrange(5))]
    return a, "".join(b) if r.random() < 0.7 else "".join(r.choice(letters) for _ in range(r.randrange(size)))


def test_text_ratio_is_difflibs():
    r = random.Random(5)
    for letters in ("ab", "abcde \x01", "abcdefghijklmnopqrstuvwxyz _.=()é😀"):
        for _ in range(400):
            a, b = _texts(r, letters, 300)
            want = 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0
            assert text_ratio(a, b) == want, (a, b)


def test_edit_distance_is_levenshteins(spark):
    r = random.Random(6)
    pairs = [_texts(r, letters, 40) for letters in ("ab", "abc é😀") for _ in range(400)]
    pairs += [("", ""), ("", "abc"), ("aa", "aaa"), ("aba", "ababa"), ("x" * 9000, "x" * 9001 + "y")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", edit_distance(F.col("a"), F.col("b")).alias("got"), F.levenshtein("a", "b").alias("want"))
    assert rows.where("got IS DISTINCT FROM want").collect() == []


def test_shuffles_start_in_many_parts(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert int(configure(spark).conf.get(name)) >= INITIAL_PARTS


def test_a_large_partition_of_a_stored_log_is_written_by_several_tasks(spark, tmp_path):
    log = spark.range(0, 20000, 1, 8).selectExpr(
        "id", "'m' AS model", "sha2(CAST(id AS STRING), 512) AS generated_sql", "id % 3 > 0 AS success", "CAST(NULL AS STRING) AS error")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "256k")
    try:
        stored = StoredLog(str(tmp_path / "log"), buckets=1)
        stored.write(log)
        stored.merge(log.where("NOT success").selectExpr("id", "model", "true AS success", "generated_sql AS valid_sql", "error"))
    finally:
        spark.conf.unset(size)
    files = [f for _, _, names in os.walk(stored.path) for f in names if f.endswith(".parquet")]
    assert len(files) > 1
    assert stored.read(spark).count() == 20000 and stored.read(spark).where("success AND validation_applied").count() == 6667


def test_the_store_is_never_broadcast(spark, tmp_path):
    log = spark.createDataFrame([(i, f"SELECT {i}", f"m{i % 2}") for i in range(20)], "id long, q string, model string")
    store = ScoreStore(str(tmp_path / "s"))
    measure = lambda rows: rows.withColumn("n", F.length("q"))
    for _ in range(2):
        scored = store.scored(log, ["q"], measure)
        assert "Broadcast" not in scored._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["id"], r["n"]) for r in scored.collect()) == [(i, len(f"SELECT {i}")) for i in range(20)]


def test_a_file_of_one_split_is_read_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 1).selectExpr("id AS event_id", "id % 7 AS user_id", "'view' AS event_type", "CAST(id AS DOUBLE) AS value")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    tasks = query_log(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_merged_parts_of_a_shuffle_are_small(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    try:
        for before, after in ((None, f"{ADVISORY_MB}m"), ("64MB", f"{ADVISORY_MB}m"), (str(1 << 30), f"{ADVISORY_MB}m"), ("16k", "16k"), ("1048576b", "1048576b")):
            spark.conf.unset(name)
            if before:
                spark.conf.set(name, before)
            assert configure(spark).conf.get(name) == after
    finally:
        spark.conf.unset(name)


def test_splits_of_files_are_shuffled_before_they_are_scored(spark, tmp_path):
    log = spark.createDataFrame([(i, f"SELECT {i % 15}", f"m{i % 2}") for i in range(40)], "id long, q string, model string")
    store, plans = ScoreStore(str(tmp_path / "s")), []

    def measure(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows.withColumn("n", F.length("q"))

    scored = store.scored(log, ["q"], measure)
    assert f"Exchange hashpartitioning({KEY}" in plans[-1]
    assert sorted((r["id"], r["n"]) for r in scored.collect()) == [(i, len(f"SELECT {i % 15}")) for i in range(40)]


def test_rows_of_one_pair_of_plans_go_to_many_tasks(spark):
    step = '[{"id": 1, "parent": 0, "detail": "SCAN t"}]'
    log = spark.range(0, 2000, 1, 4).selectExpr(
        "id", "concat('SELECT ', id) AS true_query", "concat('SELECT ', id % 7) AS generated_sql", "'m' AS model", "true AS success",
        "1 AS row_count", "CAST(NULL AS STRING) AS error", "'[]' AS results", "'[]' AS results_true", "1.0 AS execution_time",
        f"'{step}' AS execution_plan", f"CASE WHEN id < 1990 THEN '{step}' END AS execution_plan_true")
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in changed}
    for name, value in changed.items():
        spark.conf.set(name, value)
    try:
        scored = compare_queries(log, text_similarity=False)
        tasks = scored.where("plan_similarity = 1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(r["count"] for r in tasks) == 1990
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in tasks) < 1000


def test_spread_pairs_of_plans_keep_their_rows(spark):
    plans = [None, "", "[]", '[{"id": 1, "parent": 0, "detail": "SCAN t"}]', '[{"id": 1, "parent": 0, "detail": "SCAN u"}]']
    rows = [(i % 9 or None, a, b) for i in range(70) for a in plans for b in plans]
    rows = spark.createDataFrame(rows, "id int, a string, b string")
    alone, dealt = w.with_plan_comparison(rows, "a", "b"), w.with_plan_comparison(rows, "a", "b", spread=["id"])
    assert alone.columns == dealt.columns and alone.count() == dealt.count() == len(plans) ** 2 * 70
    assert alone.exceptAll(dealt).isEmpty()


def test_the_truth_is_never_broadcast(spark, tmp_path):
    rows = spark.range(0, 300, 1, 1).selectExpr("id AS event_id", "id % 7 AS user_id", "'view' AS event_type", "CAST(id AS DOUBLE) AS value")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    log, truth = query_log(spark, str(tmp_path)), truth_runs(spark, str(tmp_path))
    joined = w.truth_join(log, truth)
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # rows without a query keep their truth: NULL keys match
    assert joined.count() == 300 and joined.where("true_query IS NULL AND success_true").count() == log.where("true_query IS NULL").count() > 0
