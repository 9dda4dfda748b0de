"""What is handed to Python and back at once stays small, with the results of before."""

import random
import time

import __spark_entry__  # noqa: F401  (code travels with the tasks)
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException

from evalspark.llm import common, repeats


def test_every_stage_hands_small_batches_to_python(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, "10000")
            with pytest.raises((AttributeError, AnalysisException)):  # no rows are given
                stage(spark, None, "")
            assert int(spark.conf.get(name)) == common.BATCH_ROWS
        sizes = spark.range(0, 5000, 1, 1).mapInArrow(
            lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
        assert sum(r["n"] for r in sizes) == 5000 and max(r["n"] for r in sizes) <= common.BATCH_ROWS
        spark.conf.set(name, "100")
        common.small_batches(spark)
        assert spark.conf.get(name) == "100"
    finally:
        spark.conf.set(name, before)


def test_written_steps_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f.split("/")[-1] for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, found = names(), []
    for k in range(3):
        rows = spark.range(0, 5000, 1, 4).selectExpr(f"id % {500 + k} AS k").groupBy("k").count()
        kept = repeats._written(rows, "counts")
        found.append(names() - before)
        assert kept.count() == 500 + k and kept.exceptAll(rows).isEmpty()
        before |= names()
    assert found == [set()] * 3
    assert spark.conf.get(repeats._CLEANUP, None) is None


def _brute(data: bytes, length: int) -> list[int]:
    places, hashes = repeats.window(length), repeats.rolling(data) >> np.uint64(24)
    return [i + int(np.argmin(hashes[i:i + places])) for i in range(len(data) - length + 1)]


def test_a_trigger_depends_on_its_string_alone():
    r = random.Random(2)
    for _ in range(100):
        data = bytes(r.choice(b"abc") for _ in range(r.randrange(60, 900)))
        assert repeats.triggers(data, 40).tolist() == _brute(data, 40)
    part = bytes(r.choice(b"ab") for _ in range(5000))
    huge = part + b"\0" * (1 << 24) + part  # its hashes and places do not fit one number
    got = repeats.triggers(huge, 40)
    own = repeats.triggers(part, 40)
    assert got[:len(own)].tolist() == own.tolist() and (got[-len(own):] - (len(huge) - len(part))).tolist() == own.tolist()


def _texts(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefg") for _ in range(6)) for _ in range(400)]
    passage = " ".join(r.choice(words) for _ in range(200))
    texts = [" ".join(r.choice(words) for _ in range(40)) + passage[r.randrange(300):900 + r.randrange(300)] + str(i) for i in range(30)]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], "", None, "ab" * 900])], "doc_id int, text string").coalesce(1)


def test_small_hands_give_the_same_removals(spark, monkeypatch):
    _, docs = _texts(spark)
    whole = sorted(repeats.without_repeats(docs).collect(), key=lambda x: x["doc_id"])
    monkeypatch.setattr(repeats, "ROWS", 7)
    assert sorted(repeats.without_repeats(docs).collect(), key=lambda x: x["doc_id"]) == whole
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    seen = {}
    for t in rows.values():
        for i in range(len(t) - 399):
            seen[t[i:i + 400]] = seen.get(t[i:i + 400], 0) + 1
    for row in whole:
        t = rows[row["doc_id"]]
        gone = {j for i in range(len(t) - 399) if seen[t[i:i + 400]] > 1 for j in range(i, i + 400)}
        assert bytes(row["kept"]).decode() == "".join(c for j, c in enumerate(t) if j not in gone)
