"""Ranks and ordered counts that stay distributed whatever the key sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.times import micros
from ..session import work_path


def first_rows(df: DataFrame, by: list[str], order: list[Column], k: int = 1, rank: str = "_rn") -> DataFrame:
    """The first ``k`` rows of each group.

    Spark pushes the ``row_number <= k`` limit below the shuffle, so a task sends
    at most ``k`` rows of a group however many it holds.
    """
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kept = numbered.where(F.col(rank) <= k)
    return kept.drop(rank) if rank == "_rn" else kept


def top_k_with_ties(df: DataFrame, score: str, k: int, descending: bool = True, rank: str = "rank") -> DataFrame:
    """Rows whose score has dense rank <= ``k``, with that rank.

    The ``k`` leading distinct scores are found by a per-task top-k, ranked (k
    rows), and joined back, so ties of any number never meet in one task.  The
    score must come out the same each time: a count, or a mean of whole numbers.
    """
    def level_order():
        return F.desc_nulls_last("_level") if descending else F.asc_nulls_first("_level")

    levels = (
        df.select(F.col(score).alias("_level")).distinct()
        .orderBy(level_order()).limit(k)
        .withColumn(rank, F.row_number().over(Window.orderBy(level_order())))
    )
    # broadcast: k rows at most
    return df.join(F.broadcast(levels), F.col(score).eqNullSafe(F.col("_level"))).drop("_level")


def weight_before(
    probes: DataFrame, points: DataFrame, keys: list[str], at: str, weight: str, out: str, bucket_seconds: int = 3600,
) -> DataFrame:
    """For each probe, the total weight of points with the same keys at a strictly earlier time.

    Stands in for a ``t1 < t2`` self-join without making its pairs.  Probes and points shrink to one row per key and
    instant; a running sum over buckets of time gives what earlier buckets hold, one within each bucket the rest.  The
    counts are joined back to the probes, so an instant with many probes is only a hot key of that join.  Probes
    without a time or key drop out.
    """
    def timed(df: DataFrame) -> DataFrame:
        return df.where(F.col(at).isNotNull()).dropna(subset=keys)

    kept = timed(probes)
    instants = (
        timed(points).select(*keys, at, F.col(weight).alias("_w"))
        .unionByName(kept.select(*keys, at, F.lit(0).alias("_w")))
        .groupBy(*keys, at).agg(F.sum("_w").alias("_w"))
        .withColumn("_bucket", F.floor(micros(F.col(at)) / (bucket_seconds * 1_000_000)))
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        instants.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_sum"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        instants.withColumn("_within", F.coalesce(F.sum("_w").over(within), F.lit(0)))
        .join(carried, [*keys, "_bucket"])
        .select(*keys, at, (F.col("_carried") + F.col("_within")).alias(out))
    )
    return kept.join(counted, [*keys, at])


def ordered_bits(value: Column) -> Column:
    """A double as a long in the same order: its 64 bits by arithmetic, negated below zero; NaN comes last.

    Powers of two, and products and quotients with them, are exact, so different numbers have different longs.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("int")

    def bits(g: Column) -> Column:  # the logarithm may be off by one next to a power of two
        exponent = g - F.when(F.pow(F.lit(2.0), g) > size, 1).otherwise(0) + F.when(F.pow(F.lit(2.0), g + 1) <= size, 1).otherwise(0)
        fraction = let(exponent, lambda e: (
            (e + 1023).cast("long") * F.lit(1 << 52) + ((size / F.pow(F.lit(2.0), e) - 1.0) * float(1 << 52)).cast("long")))
        return fraction

    tiny = (size * 2.0 ** 537 * 2.0 ** 537).cast("long")  # below the least normal number
    positive = F.when(size < 2.0 ** -1022, tiny).when(size > 1.7976931348623157e308, F.lit(2047 << 52)).otherwise(let(guess, bits))
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(value < 0, -positive).otherwise(positive)


_DIGIT_BITS = 16  # a digit of a 64-bit number; four passes look at one each


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact interpolated quantiles per group, for values of any variety: (by, quantiles).

    Values are read as 64-bit numbers in the same order.  Four passes count them by their next 16 bits, among those whose
    higher bits may still hold a wanted rank, so what is shuffled is counters, at most 65,536 of a group and rank
    however many values there are; no value is sorted.  The counters of a pass are written down before the next one
    starts.  NULLs do not count, and groups of them alone are left out.  (For values of a small domain, such
    as word counts, the ``percentile`` aggregate does the same in one pass.)
    """
    spark = df.sparkSession
    number = F.col(value).cast("double")
    keyed = df.where(F.col(value).isNotNull()).select(*by, number.alias("_value"), ordered_bits(number).alias("_bits"))
    same = lambda columns: [F.col(c).eqNullSafe(F.col(f"_a{c}")) for c in columns]

    def wanted(total: Column) -> Column:
        """(rank, part): the ranks from 0 that the shares ask for; part is the place between a share's two."""
        ranks = []
        for i, share in enumerate(shares):
            place = total.cast("double") * share - share
            for side, rank in enumerate((F.floor(place), F.ceil(place))):
                ranks.append(F.struct(F.lit(2 * i + side).alias("slot"), rank.alias("rank"), (place - F.floor(place)).alias("part")))
        return F.array(*ranks)

    targets = None
    for digit in range(1, 64 // _DIGIT_BITS + 1):
        prefix = F.shiftright("_bits", 64 - digit * _DIGIT_BITS)
        rows = keyed.withColumn("_prefix", prefix)
        if targets is not None:
            open_ = targets.select(*[F.col(c).alias(f"_a{c}") for c in by], F.col("_prefix").alias("_above")).distinct()
            rows = rows.withColumn("_before", F.shiftright("_prefix", _DIGIT_BITS)).join(
                open_, [*same(by), F.col("_before") == F.col("_above")], "left_semi")
        counts = rows.groupBy(*by, "_prefix").agg(F.count("*").alias("_n"), F.min("_value").alias("_value"))
        if targets is None:
            group = Window.partitionBy(*by)
            below = F.sum("_n").over(group.orderBy("_prefix")) - F.col("_n")
            placed = counts.select("*", below.alias("_below"), wanted(F.sum("_n").over(group)).alias("_targets"))
        else:
            within = Window.partitionBy(*by, F.shiftright("_prefix", _DIGIT_BITS)).orderBy("_prefix")
            asked = targets.groupBy(*by, "_prefix").agg(F.collect_list(F.struct("slot", "rank", "part")).alias("_targets"))
            asked = asked.withColumnsRenamed({**{c: f"_a{c}" for c in by}, "_prefix": "_above"})
            placed = counts.withColumns({"_below": F.sum("_n").over(within) - F.col("_n"), "_before": F.shiftright("_prefix", _DIGIT_BITS)}).join(
                asked, [*same(by), F.col("_before") == F.col("_above")])
        here = F.filter("_targets", lambda t: (F.col("_below") <= t["rank"]) & (t["rank"] < F.col("_below") + F.col("_n")))
        found = placed.select(*by, "_prefix", "_below", "_value", F.explode(here).alias("_t")).select(
            *by, "_prefix", "_value", F.col("_t.slot").alias("slot"), (F.col("_t.rank") - F.col("_below")).alias("rank"), F.col("_t.part").alias("part"))
        path = work_path(spark, "ranks")
        found.write.parquet(path)
        targets = spark.read.schema(found.schema).parquet(path)

    def quantile(i: int) -> Column:
        low, high = (F.max(F.when(F.col("slot") == 2 * i + side, F.col("_value"))) for side in (0, 1))
        part = F.max(F.when(F.col("slot") == 2 * i, F.col("part")))
        return F.when(part == 0, low).otherwise((1 - part) * low + part * high)

    return targets.groupBy(*by).agg(F.array(*[quantile(i) for i in range(len(shares))]).alias("quantiles"))
