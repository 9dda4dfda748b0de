"""Ordered operators against brute force, with keys that hold most of the rows."""

import datetime as dt
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from evalspark.functions.times import in_years, julian_day_diff, moment, shift, shift_overflow
from evalspark.operators import clinical as c
from evalspark.operators import workload as w
from evalspark.operators.ranking import exact_quantiles, first_rows, ordered_bits, top_k_with_ties, weight_before


def _times(n, seed, hot_share=0.6):
    rnd = random.Random(seed)
    start = dt.datetime(2100, 1, 1)
    return [(0 if rnd.random() < hot_share else rnd.randrange(1, 6), start + dt.timedelta(minutes=rnd.randrange(0, 3000))) for _ in range(n)]


@pytest.mark.parametrize("bucket, hot", [(600, 0), (60, 300), (10**9, 300)])
def test_weight_before(spark, bucket, hot):
    """Also with one instant that holds most rows."""
    instant = [(0, dt.datetime(2100, 1, 1, 7))] * hot
    points, probes = _times(300, 1) + instant, _times(200, 2) + instant
    p = spark.createDataFrame([(k, t, 1 + i % 3) for i, (k, t) in enumerate(points)], "k int, t timestamp_ntz, w int")
    q = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(probes)], "i int, k int, t timestamp_ntz")
    got = {r["i"]: r["out"] for r in weight_before(q, p, ["k"], "t", "w", "out", bucket).collect()}
    want = {
        i: sum(1 + j % 3 for j, (kk, tt) in enumerate(points) if kk == k and tt < t) for i, (k, t) in enumerate(probes)}
    assert got == want


def test_frequent_within_months(spark):
    index, events = _times(60, 3), _times(150, 4)
    events = [(k, t + dt.timedelta(days=i % 50), i % 4) for i, (k, t) in enumerate(events)]
    a = spark.createDataFrame(index, "p int, t timestamp_ntz")
    b = spark.createDataFrame(events, "p int, t timestamp_ntz, code int")
    got = {r["code"]: r["n"] for r in c.frequent_within_months_after(a, b, "p", "t", "code", 1).collect()}
    want = {}
    for p1, t1 in index:
        end = t1.replace(month=2) if t1.day <= 28 else t1.replace(month=2, day=28)
        for p2, t2, code in events:
            if p1 == p2 and t1 < t2 <= end:
                want[code] = want.get(code, 0) + 1
    assert got == want


def test_same_day_after(spark):
    index, events = _times(80, 5), _times(80, 6)
    a = spark.createDataFrame(index, "k int, t timestamp_ntz")
    b = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(events)], "i int, k int, t timestamp_ntz")
    got = {r["i"]: r["n_before"] for r in c.same_day_after(a, b, "k", "t").collect()}
    want = {i: sum(k1 == k and t1 < t and t1.date() == t.date() for k1, t1 in index) for i, (k, t) in enumerate(events)}
    assert got == {i: n for i, n in want.items() if n}


def test_top_k_keeps_all_ties(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5, 5, 4, 3, 3, 3, 2, 1])], "i int, n int")
    assert sorted((r["n"], r["rank"]) for r in top_k_with_ties(df, "n", 3).collect()) == [
        (3, 3), (3, 3), (3, 3), (4, 2), (5, 1), (5, 1)]
    low = top_k_with_ties(df, "n", 2, descending=False).collect()
    assert sorted((r["n"], r["rank"]) for r in low) == [(1, 1), (2, 2)]


def test_first_rows_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    plan = first_rows(df, ["g"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_exact_quantiles(spark):
    rnd = random.Random(7)
    odd = [0.0, -0.0, 1e-320, -1e-320, 5e-324, 1e300, -1e300, math.inf, 2.0, math.nextafter(2.0, 0), math.nextafter(2.0, 3)]
    rows = [("a" if rnd.random() < 0.8 else "b", round(rnd.gauss(0, 50), 1)) for _ in range(2000)]
    rows += [(None, rnd.choice(odd)) for _ in range(300)] + [("one", -7.25), ("none", None), ("c", 1.0), ("c", None)]
    rows += [("near", 1.0 + i * 2.0 ** -52) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {"a", "b", None, "one", "c", "near"}
    for g, values in got.items():
        held = sorted(v for k, v in rows if k == g and v is not None)
        want = []
        for share in shares:
            place = len(held) * share - share
            low, part = held[math.floor(place)], place - math.floor(place)
            want.append(low if part == 0 else (1 - part) * low + part * held[math.ceil(place)])
        assert got[g] == want


def test_bits_keep_the_order(spark):
    rnd = random.Random(1)
    values = [struct.unpack("<d", rnd.randbytes(8))[0] for _ in range(4000)] + [0.0, -0.0, 5e-324, math.inf, -math.inf, 2.0 ** -1022]
    values += [x for e in range(-1074, 1024, 7) for p in [2.0 ** e] for x in (p, -p, math.nextafter(p, 0), math.nextafter(p, math.inf))]
    values = [v for v in values if v == v]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_bits(F.col("v")).alias("b")).collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.b == (-bits if r.v < 0 else bits)
    assert spark.createDataFrame([(math.nan,)], "v double").select(ordered_bits(F.col("v"))).first()[0] == 2**63 - 1


def test_quantiles_shuffle_counters_only(spark):
    """200,000 different values of one group: no sort of values, and the last pass counts those of one digit alone."""
    df = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") * 1.000001).alias("v"))
    out = exact_quantiles(df, ["g"], "v", [0.5])
    assert out.first()["quantiles"] == [pytest.approx(99_999.5 * 1.000001)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan


def test_result_tables(spark):
    true_rows = [(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "x"), (5, "p"), (5, "q")]
    gen_rows = [(1, "b"), (1, "a"), (2, "a"), (4, "y"), (5, "p"), (5, "r")]
    a, b = (spark.createDataFrame(x, "id int, row string") for x in (true_rows, gen_rows))
    got = {r["id"]: (r["equal"], r["reason"]) for r in w.compare_result_tables(a, b, "id", "row").collect()}
    assert got == {
        1: (True, "Results are identical (same rows, possibly different order)"), 2: (False, "Different number of rows"),
        3: (False, "Second result is empty, first has data"), 4: (False, "First result is empty, second has data"),
        5: (False, "2 rows differ between results")}


def test_month_shifts(spark):
    row = spark.range(1).select(
        shift(moment("2100-01-31 10:00:00"), 1).alias("clamped"), shift_overflow(moment("2100-01-31 10:00:00"), 1).alias("rolled"),
        shift(moment("2100-03-31 00:00:00"), -1).alias("back"), shift_overflow(moment("2096-02-29 00:00:00"), 12).alias("leap"),
        julian_day_diff(moment("2100-01-02 12:00:00"), moment("2100-01-01 00:00:00")).alias("days")).first()
    assert row["clamped"] == dt.datetime(2100, 2, 28, 10) and row["rolled"] == dt.datetime(2100, 3, 3, 10)
    assert row["back"] == dt.datetime(2100, 2, 28) and row["leap"] == dt.datetime(2097, 3, 1)
    assert row["days"] == 1.5


def test_year_filter_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = orders.where(in_years(F.col("o_orderdate"), 1998, 1998))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_outcome_rate_rank(spark):
    events = spark.createDataFrame([
        (1, "x", "2100-01-01"), (1, "x", "2100-05-01"), (2, "x", "2100-01-01"), (3, "y", "2100-01-01"), (4, "y", "2100-12-30"),
    ], "p int, code string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    outcomes = spark.createDataFrame([(1, "2100-03-01"), (2, None), (3, "2100-02-01"), (4, "2100-12-31")], "p int, dod string")
    outcomes = outcomes.withColumn("dod", F.col("dod").cast("timestamp_ntz"))
    got = c.outcome_rate_rank(events, outcomes, "p", "code", "t", "dod", days=182, k=1).collect()
    # x: one of two free; y: only the old event counts and it is not free
    assert [(r["code"], r["free_rate"], r["rank"]) for r in got] == [("y", 0.0, 1)]
