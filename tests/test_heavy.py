"""Most frequent words by merged summaries and an exact recount."""

import collections
import random

import pytest

from evalspark.operators.heavy import Summary, candidates, most_frequent


def _rows(seed, vocabulary=3_000, texts=400):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) ** draw.choice([0.5, 1.0, 1.5]) for i in range(vocabulary)]
    return [(draw.choice(["a", "a", "a", "b", None]), draw.choices(words, weights, k=draw.randint(0, 60))) for _ in range(texts)]


def _plain(rows, k, stop=()):
    counts = {}
    for g, words in rows:
        counts.setdefault(g, collections.Counter()).update(w for w in words or [] if w not in stop)
    return {(g, w): (n, i + 1) for g, c in counts.items() for i, (w, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k])}


@pytest.mark.parametrize("capacity", [16, 64, 100_000])
def test_exact_for_every_capacity(spark, capacity):
    rows = _rows(capacity) + [("ties", [f"t{i}" for i in range(50)]), ("few", ["x"]), ("none", []), ("null", None)]
    df = spark.createDataFrame(rows, "g string, words array<string>").repartition(6)
    got = most_frequent(df, ["g"], "words", 15, ["w0", "w3"], capacity).collect()
    assert {(r.g, r.word): (r.n, r.position) for r in got} == _plain(rows, 15, ("w0", "w3"))


def test_bounds_hold_and_few_rows_leave_a_task(spark):
    rows = [(g, words) for g, words in _rows(1, 20_000, 1_500) if g]
    df = spark.createDataFrame(rows, "g string, words array<string>").repartition(4)
    wanted, safe = candidates(df, ["g"], "words", 5, [], 64)
    distinct = sum(len({w for h, ws in rows if h == g for w in ws}) for g in "ab")
    words = {(r.group, r.word) for r in wanted.collect()}
    assert len(words) <= 4 * 2 * 64 < distinct / 5
    if safe:
        assert {(f'{{"g":"{g}"}}', w) for g, w in _plain(rows, 5)} <= words


def test_summaries_lose_no_more_than_they_say():
    draw = random.Random(2)
    summary, truth = Summary(20), collections.Counter()
    for _ in range(30):
        part = collections.Counter(draw.choices(range(200), [1 / (i + 1) for i in range(200)], k=300))
        truth.update(part)
        summary.add(part.items())
        assert len(summary.counts) <= 20
        for word, n in truth.items():
            assert summary.counts.get(word, 0) <= n <= summary.counts.get(word, 0) + summary.lost
    assert summary.lost <= sum(truth.values()) / 21


def test_no_groups_and_no_rows(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["b", "c"],)], "words array<string>")
    assert [(r.word, r.n) for r in most_frequent(df, [], "words", 2).orderBy("position").collect()] == [("a", 2), ("b", 2)]
    assert most_frequent(df.limit(0), [], "words", 2).collect() == []
