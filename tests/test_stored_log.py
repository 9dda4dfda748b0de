"""W25 over a stored log: only touched partitions are rewritten, and a merge may run twice."""

import os

from evalspark.operators import workload as w
from evalspark.plans.stored_log import StoredLog
from tests import oracle


def _log(spark):
    rows = [(i, m, f"SELECT {i}", i % 3 > 0, None if i % 3 else "broken") for i in range(60) for m in ("a", "b", None)]
    return spark.createDataFrame(rows, "id long, model string, generated_sql string, success boolean, error string")


def _repaired(spark, ids, model, good=True):
    rows = [(i, model, good, f"SELECT fixed {i}", None if good else "still broken") for i in ids]
    return spark.createDataFrame(rows, "id long, model string, success boolean, valid_sql string, error string")


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_untouched_files_keep_their_names(spark, tmp_path):
    stored = StoredLog(str(tmp_path / "log"), buckets=4)
    stored.write(_log(spark))
    before = _files(stored.path)
    stored.merge(_repaired(spark, [3], "b"))
    after = _files(stored.path)
    changed = {os.path.dirname(f) for f in before ^ after}
    assert len(changed) == 1 and "model=b" in next(iter(changed))
    assert stored.merge(_repaired(spark, [], "b")) is None and _files(stored.path) == after


def test_merged_rows_and_a_second_run(spark, tmp_path):
    log, stored = _log(spark), StoredLog(str(tmp_path / "log"), buckets=4)
    stored.write(log)
    repaired = _repaired(spark, range(0, 20), "a").union(_repaired(spark, range(10, 30), "b", False)).union(_repaired(spark, [0, 6], None))
    want = oracle.spark_rows(w.merge_back(log.fillna("none", ["model"]), repaired.fillna("none", ["model"])).drop("model"))
    folder = stored.merge(repaired)
    assert oracle.spark_rows(stored.read(spark).fillna("none", ["model"]).drop("model"))[1] != []
    once = oracle.spark_rows(stored.read(spark))
    known = [r for r in stored.read(spark).where("model IS NOT NULL").collect()]
    plain = {(r.id, r.model): r for r in w.merge_back(log, repaired).where("model IS NOT NULL").collect()}
    assert len(known) == len(plain) == 120
    for r in known:
        p = plain[r.id, r.model]
        assert (r.success, r.error, r.final_query, r.success_before, r.validation_applied) == (
            p.success, p.error, p.final_query, p.success_before, p.validation_applied)
    assert len(want[1]) == 180
    stored.merge(repaired)  # again
    assert oracle.spark_rows(stored.read(spark)) == once
    stored.swap(spark, folder)  # as after a merge that was killed
    assert oracle.spark_rows(stored.read(spark)) == once


def test_repairs_of_a_later_round(spark, tmp_path):
    """What the first round left broken may be mended by the second; rates still tell what generation did."""
    stored = StoredLog(str(tmp_path / "log"), buckets=2)
    stored.write(_log(spark))
    stored.merge(_repaired(spark, range(0, 30), "a", False))
    stored.merge(_repaired(spark, range(0, 15), "a", True))
    rates = w.phase_rates(stored.read(spark).where("model = 'a'")).first()
    assert (rates["total"], rates["generated_ok"], rates["routed"], rates["repaired_ok"], rates["final_ok"]) == (60, 40, 20, 5, 45)
