"""The most frequent words of each group without counting the whole vocabulary: two passes with a proof.

Each task keeps a Misra-Gries summary: at most so many counters per group, and when there are more, the greatest count that does not fit is
taken from all.  Summaries merge by adding up, counters and losses alike, so a word's true count lies between its merged counter and that
plus the merged loss.  Words that may reach the k-th place by these bounds are counted exactly in a second pass; if
a word without a counter might, the summaries are too small, and wider ones are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_path
from .ranking import first_rows

_FLUSH = 500_000  # words counted together before they enter a summary


class Summary:
    """Counters of one group in one task; ``lost`` is what a count may miss."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.counts, self.lost = capacity, {}, 0

    def add(self, counts: Iterator[tuple[str, int]]) -> None:
        for word, n in counts:
            self.counts[word] = self.counts.get(word, 0) + n
        if len(self.counts) > self.capacity:
            over = np.partition(np.fromiter(self.counts.values(), np.int64, len(self.counts)), -self.capacity - 1)[-self.capacity - 1]
            self.counts = {w: n - int(over) for w, n in self.counts.items() if n > over}
            self.lost += int(over)


def _summaries(capacity: int, stop_words: frozenset[str]):
    """Rows (group number, words) of a task as (group number, word, n), and one with a NULL word for the loss of each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, Summary] = {}
        held: list[pa.Table] = []

        def flush() -> None:
            if held:
                counts = pa.concat_tables(held).group_by(["group", "word"]).aggregate([([], "count_all")]).to_pydict()
                held.clear()
                per_group: dict[str, list[tuple[str, int]]] = {}
                for group, word, n in zip(counts["group"], counts["word"], counts["count_all"]):
                    if word is not None and word not in stop_words:
                        per_group.setdefault(group, []).append((word, n))
                for group, found in per_group.items():
                    kept.setdefault(group, Summary(capacity)).add(found)

        waiting = 0
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            group = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            held.append(pa.table({"group": group, "word": lists.flatten()}))
            waiting += int(sizes.sum())
            if waiting >= _FLUSH:
                flush()
                waiting = 0
        flush()
        for group, summary in kept.items():
            words = [*summary.counts, None]
            yield pa.RecordBatch.from_arrays([
                pa.array([group] * len(words), pa.string()), pa.array(words, pa.string()),
                pa.array([*summary.counts.values(), summary.lost], pa.int64())], names=["group", "word", "n"])

    return run


def candidates(df: DataFrame, by: list[str], words: str, k: int, stop_words: list[str], capacity: int) -> tuple[DataFrame, bool]:
    """(group, word) for every word that may be among the ``k`` most frequent of its group, and whether no other can.

    ``group`` is the JSON text of the group's columns.  Summaries are written down: at most ``capacity`` words of a group leave a task.
    """
    spark = df.sparkSession
    slim = df.select(_group(by), words)
    sums = slim.mapInArrow(_summaries(capacity, frozenset(stop_words)), "group string, word string, n long").groupBy("group", "word").agg(F.sum("n").alias("n"))
    path = work_path(spark, "summaries")
    sums.write.parquet(path)
    sums = spark.read.schema(sums.schema).parquet(path)
    lost = sums.where("word IS NULL").select(F.col("group").alias("_g"), F.col("n").alias("lost"))
    level = first_rows(sums.where("word IS NOT NULL"), ["group"], [F.desc("n"), F.asc("word")], k, rank="_place")
    level = level.groupBy("group").agg(F.min("n").alias("level"), F.count("*").alias("found")).select(F.col("group").alias("_h"), "level", "found")
    bounds = lost.join(level, F.col("_g") == F.col("_h")).drop("_h")
    safe = bounds.where((F.col("lost") > 0) & ((F.col("lost") >= F.col("level")) | (F.col("found") < k))).isEmpty()
    known = sums.where("word IS NOT NULL").join(bounds, F.col("group") == F.col("_g"))
    return known.where((F.col("n") + F.col("lost") >= F.col("level")) | (F.col("found") < k)).select("group", "word"), safe


def _group(by: list[str]):
    fields = [F.col(c) for c in by]
    return (F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}) if by else F.lit("")).alias("group")


def most_frequent(df: DataFrame, by: list[str], words: str, k: int, stop_words: list[str] = (), capacity: int = 1024) -> DataFrame:
    """(by, word, n, position): the ``k`` most frequent entries of array column ``words`` per group with exact counts, ties by word.

    ``capacity`` counters per group and task to begin with; they are made four times as many until the bounds prove that
    nothing else can come in, at the latest when they hold every word.
    """
    spark, capacity = df.sparkSession, max(capacity, k)
    while True:
        wanted, safe = candidates(df, by, words, k, stop_words, capacity)
        if safe:
            break
        capacity *= 4
    path = work_path(spark, "candidates")
    wanted.write.parquet(path)  # a table of its own, so that its size is known when the recount is planned
    wanted = spark.read.schema(wanted.schema).parquet(path)
    each = df.select(*by, _group(by), F.explode(words).alias("word")).join(wanted, ["group", "word"], "left_semi")
    counts = each.groupBy(*by, "word").agg(F.count("*").alias("n"))
    return first_rows(counts, list(by), [F.desc("n"), F.asc("word")], k, rank="position")
