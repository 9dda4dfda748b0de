"""Patient-and-event queries (family Q).

Column names default to the usual clinical ones (``subject_id``, ``hadm_id``,
``itemid``, ``charttime`` ...); pass others for other tables.  "Now" is always
an argument, never the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import VITAL_RANGES
from ..functions.times import CLOCK, moment, shift, since
from .ranking import first_rows, top_k_with_ties, weight_before


def lookup(facts: DataFrame, code: str, dim: DataFrame, dim_code: str, labelled: Column) -> DataFrame:
    """Q1: facts whose code carries a label.  A label may own many codes, so this is a semi join."""
    codes = dim.where(labelled).select(F.col(dim_code).alias(code))
    return facts.join(codes, code, "left_semi")


def semi_chain(df: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Q2: nested ``IN``.  Each step is (table, its key, key of the table before it)."""
    if not steps:
        return df
    (table, key, outer_key), *rest = steps
    inner = semi_chain(table, *rest).select(F.col(key).alias("_key"))
    return df.join(inner, F.col(outer_key) == F.col("_key"), "left_semi")


def any_rows(df: DataFrame, out: str = "found") -> DataFrame:
    """Q3: one row saying whether there is any row at all."""
    return df.agg((F.count("*") > 0).alias(out))


def has_rows(subjects: DataFrame, rows: DataFrame, key: str, out: str = "found") -> DataFrame:
    """Q3 per subject: whether each subject owns any of the rows."""
    owners = rows.select(key).distinct().withColumn(out, F.lit(True))
    return subjects.join(owners, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def extreme_then_latest(
    df: DataFrame, value: str, at: str, by: list[str] | None = None, tie: list[str] = (), smallest: bool = True
) -> DataFrame:
    """Q4: row with the least (or greatest) value, the latest of them, per group or overall."""
    first = F.asc_nulls_first(value) if smallest else F.desc_nulls_last(value)
    order = [first, F.desc_nulls_last(at), *[F.asc(t) for t in tie]]
    return first_rows(df, by, order) if by else df.orderBy(*order).limit(1)


def latest(df: DataFrame, at: str, by: list[str] | None = None, tie: list[str] = ()) -> DataFrame:
    """Q19 and the tail of Q5: latest row per group, or overall."""
    order = [F.desc_nulls_last(at), *[F.asc(t) for t in tie]]
    return first_rows(df, by, order) if by else df.orderBy(*order).limit(1)


def latest_since(
    df: DataFrame, at: str, months: int, as_of: str = CLOCK, by: list[str] | None = None, tie: list[str] = ()
) -> DataFrame:
    """Q5: latest row no older than ``months`` before ``as_of``."""
    return latest(df.where(since(F.col(at), as_of, months)), at, by, tie)


def frequent(df: DataFrame, code: str, k: int, n: str = "n") -> DataFrame:
    """Q6: the codes with the ``k`` highest counts, ties included."""
    return top_k_with_ties(df.groupBy(code).agg(F.count("*").alias(n)), n, k)


def frequent_within_months_after(
    index: DataFrame, events: DataFrame, patient: str, at: str, code: str, months: int, k: int | None = None
) -> DataFrame:
    """Q8: codes of events later than an index event of the patient and within ``months`` of it.

    Counts (index, event) pairs: index events before the event, less those whose
    window had closed before it.  Both are running sums, so no pair is built.
    """
    opened = F.struct(F.col(at).alias(at), F.lit(1).alias("w"))
    closed = F.struct(shift(F.col(at), months).alias(at), F.lit(-1).alias("w"))
    windows = index.select(patient, F.inline(F.array(opened, closed)))
    probes = events.groupBy(patient, at, code).agg(F.count("*").alias("_n"))
    live = weight_before(probes, windows, [patient], at, "w", "_live")
    counted = (
        live.where(F.col("_live") > 0)
        .groupBy(code).agg(F.sum(F.col("_n") * F.col("_live")).alias("n"))
    )
    return counted if k is None else top_k_with_ties(counted, "n", k)


def same_day_after(index: DataFrame, events: DataFrame, key: str, at: str, out: str = "n_before") -> DataFrame:
    """Q9: events that follow an index event of the same key on the same calendar day.

    Each event comes once, with the number of index events before it that day.
    """
    def with_day(df: DataFrame) -> DataFrame:
        return df.withColumn("_day", F.to_date(at))

    points = with_day(index.select(key, at)).withColumn("w", F.lit(1))
    after = weight_before(with_day(events), points, [key, "_day"], at, "w", out)
    return after.where(F.col(out) > 0).drop("_day")


def first_occurrence(df: DataFrame, by: list[str], at: str, carry: list[str] = ()) -> DataFrame:
    """Q10: earliest time per group, with other columns of that row.  NULL times drop out.

    Of rows at the earliest time the one with the least carried values counts, all of them from that one row.
    """
    seen = df.where(F.col(at).isNotNull())
    first = seen.groupBy(*by).agg(F.min(F.struct(at, *carry)).alias("_first"))
    return first.select(*by, *[F.col(f"_first.{c}").alias(c) for c in (at, *carry)])


def outcome_rate_rank(
    events: DataFrame, outcomes: DataFrame, patient: str, code: str, at: str, outcome_at: str,
    days: int, k: int, as_of: str = CLOCK,
) -> DataFrame:
    """Q11: codes by the share of patients without the outcome within ``days`` of first having the code.

    Only events at least ``days`` before the clock count; a patient without an
    outcome time counts as free of it.  Lowest share first, dense rank <= ``k``.
    """
    old = events.where(F.col(at) <= shift(moment(as_of), days=-days))
    firsts = first_occurrence(old, [patient, code], at)
    free = F.when(F.col(outcome_at) < shift(F.col(at), days=days), 0).otherwise(1)
    rates = (
        firsts.join(outcomes.select(patient, outcome_at), patient)
        .groupBy(code).agg(F.avg(free).alias("free_rate"))
    )
    return top_k_with_ties(rates, "free_rate", k, descending=False)


def conditional_ratio(
    df: DataFrame, condition: Column, by: list[str] = (), out: str | None = "percent", whole: str | None = None
) -> DataFrame:
    """Q12: percent of rows meeting a condition, as ``out``; divided as integers, as ``whole``.  NULL is a group."""
    hits, total = F.sum(F.when(condition, 1).otherwise(0)), F.count("*")
    percents = []
    if out:
        percents.append(F.try_divide(hits * 100, total).alias(out))
    if whole:
        percents.append(F.when(total > 0, F.call_function("div", hits * 100, total)).alias(whole))
    return df.groupBy(*by).agg(*percents)


def decode(
    facts: DataFrame, code: str, dim: DataFrame, dim_code: str, label: str, out: str | None = None
) -> DataFrame:
    """Q13: add the label of a code; facts without one keep NULL."""
    labels = dim.select(F.col(dim_code).alias(code), F.col(label).alias(out or label))
    return facts.join(labels, code, "left")


def decode_all(facts: DataFrame, table: str, mapping: dict, dims: dict[str, DataFrame]) -> DataFrame:
    """Q13 by a dictionary map: every mapped code column of ``table`` gets its label."""
    out = facts
    for entry in mapping.get(table, []):
        label = entry["dict_desc_column"]
        name = label if label not in out.columns else f"{entry['code_column']}_{label}"
        out = decode(out, entry["code_column"], dims[entry["dict_table"]], entry["dict_code_column"], label, name)
    return out


def join_on(left: DataFrame, *others: tuple[DataFrame, list[str]], how: str = "inner") -> DataFrame:
    """Q14: the common equi-joins (patients-admissions-stays-events), in turn."""
    for right, keys in others:
        left = left.join(right, keys, how)
    return left


def in_range(df: DataFrame, kind: str, value: str, ranges: dict[str, tuple[float, float]] = VITAL_RANGES) -> DataFrame:
    """Q15: rows whose value lies in the fixed range of its kind, with the range."""
    table = df.sparkSession.createDataFrame(
        [(name, float(lo), float(hi)) for name, (lo, hi) in ranges.items()], f"{kind} string, lower double, upper double"
    )
    # broadcast: one row per named range
    return df.join(F.broadcast(table), kind).where(F.col(value).between(F.col("lower"), F.col("upper")))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Q20: distinct non-null values."""
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def query_to_table(spark: SparkSession, statement: str, keep_index: bool = False, args: dict | None = None) -> DataFrame:
    """Q21: the table a statement gives, without a column called ``index`` unless asked for."""
    df = spark.sql(statement, args=args)
    return df if keep_index else df.drop("index")
