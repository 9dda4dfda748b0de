"""Family Q over the shipped tables in their clinical roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import in_years, julian_day_diff, moment, shift, shift_overflow
from ..operators import clinical as c
from .base import admissions, events, items, patients, register, rounded, table, vitals, with_ctes

AS_OF = "2001-08-01 00:00:00"

_EVENTS = """e AS (SELECT l_orderkey AS hadm_id, l_linenumber AS line, l_partkey AS itemid, l_shipdate AS charttime,
  l_quantity AS valuenum, l_returnflag AS icd_code FROM lineitem)"""
_ADM = """a AS (SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, o_orderdate AS admittime,
  o_orderpriority AS admission_type, o_totalprice AS cost FROM orders)"""
_ITEMS = "i AS (SELECT p_partkey AS itemid, p_name AS label FROM part)"
_PAT = "p AS (SELECT c_custkey AS subject_id, c_mktsegment AS segment FROM customer)"
_VITALS = """v AS (SELECT event_id, user_id AS subject_id, ts AS charttime, event_type AS vital, value AS valuenum
  FROM events)"""


@register("Q1_code_lookup", with_ctes(
    "SELECT itemid, hadm_id, line, charttime FROM e WHERE itemid IN (SELECT itemid FROM i WHERE label = 'red plate')",
    _EVENTS, _ITEMS))
def q1(spark, sf):
    hits = c.lookup(events(spark, sf), "itemid", items(spark, sf), "itemid", F.col("label") == "red plate")
    return hits.select("itemid", "hadm_id", "line", "charttime")


@register("Q2_nested_semi_chain", with_ctes(
    """SELECT hadm_id, line, itemid FROM e WHERE hadm_id IN (SELECT hadm_id FROM a WHERE subject_id IN
       (SELECT subject_id FROM p WHERE segment = 'HOUSEHOLD')) AND itemid IN
       (SELECT itemid FROM i WHERE label = 'small widget')""", _EVENTS, _ADM, _PAT, _ITEMS))
def q2(spark, sf):
    chosen = c.semi_chain(
        events(spark, sf),
        (admissions(spark, sf), "hadm_id", "hadm_id"),
        (patients(spark, sf).where("segment = 'HOUSEHOLD'"), "subject_id", "subject_id"),
    )
    return c.lookup(
        chosen, "itemid", items(spark, sf), "itemid", F.col("label") == "small widget"
    ).select("hadm_id", "line", "itemid")


@register("Q3_existence", with_ctes(
    """SELECT subject_id, subject_id IN (SELECT a.subject_id FROM a JOIN e USING (hadm_id)
       WHERE e.itemid IN (SELECT itemid FROM i WHERE label = 'red plate')) AS found FROM p""",
    _EVENTS, _ADM, _PAT, _ITEMS))
def q3(spark, sf):
    hits = c.lookup(events(spark, sf), "itemid", items(spark, sf), "itemid", F.col("label") == "red plate")
    owned = admissions(spark, sf).join(hits, "hadm_id", "left_semi")
    return c.has_rows(patients(spark, sf).select("subject_id"), owned, "subject_id")


@register("Q3_existence_overall", with_ctes(
    "SELECT COUNT(*) > 0 AS found FROM e WHERE itemid IN (SELECT itemid FROM i WHERE label = 'no such label')",
    _EVENTS, _ITEMS))
def q3_overall(spark, sf):
    return c.any_rows(
        c.lookup(events(spark, sf), "itemid", items(spark, sf), "itemid", F.col("label") == "no such label"))


def _owned(rows, spark, sf):
    return c.join_on(rows, (admissions(spark, sf).select("hadm_id", "subject_id"), ["hadm_id"]))


@register("Q4_extreme_then_latest", with_ctes(
    """SELECT subject_id, valuenum, charttime, hadm_id, line FROM (
       SELECT a.subject_id, e.*, ROW_NUMBER() OVER (PARTITION BY a.subject_id ORDER BY valuenum ASC NULLS FIRST,
       charttime DESC NULLS LAST, e.hadm_id, line, itemid) AS rn FROM e JOIN a USING (hadm_id)) WHERE rn = 1""",
    _EVENTS, _ADM))
def q4(spark, sf):
    # the least row of each admission first: it is all the join needs
    tie = ["hadm_id", "line", "itemid"]
    local = c.extreme_then_latest(events(spark, sf), "valuenum", "charttime", ["hadm_id"], tie)
    owned = _owned(local, spark, sf)
    best = c.extreme_then_latest(owned, "valuenum", "charttime", ["subject_id"], tie)
    return best.select("subject_id", "valuenum", "charttime", "hadm_id", "line")


@register("Q4_extreme_overall", with_ctes(
    """SELECT hadm_id, line, valuenum, charttime FROM e ORDER BY valuenum ASC NULLS FIRST, charttime DESC NULLS LAST,
       hadm_id, line, itemid LIMIT 1""", _EVENTS))
def q4_overall(spark, sf):
    best = c.extreme_then_latest(events(spark, sf), "valuenum", "charttime", tie=["hadm_id", "line", "itemid"])
    return best.select("hadm_id", "line", "valuenum", "charttime")


@register("Q5_latest_since", with_ctes(
    f"""SELECT subject_id, hadm_id, cost, admittime FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id
       ORDER BY admittime DESC, hadm_id) AS rn FROM a
       WHERE admittime >= TIMESTAMP '{AS_OF}' - INTERVAL 14 MONTH) WHERE rn = 1""", _ADM))
def q5(spark, sf):
    rows = c.latest_since(admissions(spark, sf), "admittime", 14, AS_OF, ["subject_id"], ["hadm_id"])
    return rows.select("subject_id", "hadm_id", "cost", "admittime")


@register("Q6_top_k_with_ties", with_ctes(
    """SELECT label, itemid, n, rank FROM (SELECT itemid, COUNT(*) AS n, DENSE_RANK() OVER (ORDER BY COUNT(*) DESC)
       AS rank FROM e GROUP BY itemid) JOIN i USING (itemid) WHERE rank <= 5""", _EVENTS, _ITEMS))
def q6(spark, sf):
    top = c.frequent(events(spark, sf), "itemid", 5)
    return c.decode(top, "itemid", items(spark, sf), "itemid", "label").select("label", "itemid", "n", "rank")


@register("Q7_year_filter", with_ctes(
    """SELECT itemid, COUNT(*) AS n FROM e WHERE strftime(charttime, '%Y') = '1999' GROUP BY itemid
       UNION ALL SELECT -1 AS itemid, COUNT(*) AS n FROM e WHERE strftime(charttime, '%Y') >= '2000'""", _EVENTS))
def q7(spark, sf):
    rows = events(spark, sf)
    within = rows.where(in_years(F.col("charttime"), 1999, 1999)).groupBy("itemid").agg(F.count("*").alias("n"))
    later = rows.where(in_years(F.col("charttime"), 2000)).agg(F.lit(-1).cast("bigint").alias("itemid"), F.count("*").alias("n"))
    return within.unionByName(later)


@register("Q8_within_n_months_after", with_ctes(
    """SELECT itemid, n, rank FROM (SELECT t2.itemid, COUNT(*) AS n, DENSE_RANK() OVER (ORDER BY COUNT(*) DESC) AS rank
       FROM (SELECT subject_id, admittime FROM a WHERE admission_type = '1-URGENT') t1
       JOIN (SELECT a.subject_id, e.charttime, e.itemid FROM e JOIN a USING (hadm_id)
             WHERE e.charttime >= TIMESTAMP '1997-01-01') t2 ON t1.subject_id = t2.subject_id
       WHERE t1.admittime < t2.charttime AND t2.charttime <= t1.admittime + INTERVAL 2 MONTH
       GROUP BY t2.itemid) WHERE rank <= 5""", _EVENTS, _ADM))
def q8(spark, sf):
    index = (
        admissions(spark, sf).where("admission_type = '1-URGENT'")
        .select("subject_id", F.col("admittime").alias("charttime"))
    )
    later = _owned(events(spark, sf).where(in_years(F.col("charttime"), 1997)), spark, sf)
    return c.frequent_within_months_after(index, later, "subject_id", "charttime", "itemid", 2, 5)


@register("Q9_same_day_after", with_ctes(
    """SELECT t2.event_id, t2.subject_id, COUNT(*) AS n_before FROM (SELECT * FROM v WHERE vital = 'error') t1
       JOIN (SELECT * FROM v WHERE vital = 'purchase') t2 ON t1.subject_id = t2.subject_id
       AND date_trunc('day', t1.charttime) = date_trunc('day', t2.charttime) AND t1.charttime < t2.charttime
       GROUP BY ALL""", _VITALS))
def q9(spark, sf):
    rows = vitals(spark, sf)
    after = c.same_day_after(rows.where("vital = 'error'"), rows.where("vital = 'purchase'"), "subject_id", "charttime")
    return after.select("event_id", "subject_id", "n_before")


@register("Q10_first_occurrence", with_ctes(
    """SELECT subject_id, icd_code, charttime, hadm_id, itemid, line FROM (SELECT a.subject_id, e.icd_code, e.charttime, e.hadm_id,
       e.itemid, e.line, ROW_NUMBER() OVER (PARTITION BY a.subject_id, e.icd_code ORDER BY e.charttime, e.hadm_id, e.itemid, e.line) AS rn
       FROM e JOIN a USING (hadm_id) WHERE e.charttime IS NOT NULL) WHERE rn = 1""", _EVENTS, _ADM))
def q10(spark, sf):
    # whole days, so that many rows tie; one row per admission and code before the join, so a hot admission is small by then
    local = c.first_occurrence(events(spark, sf), ["hadm_id", "icd_code"], "charttime", ["itemid", "line"])
    return c.first_occurrence(_owned(local, spark, sf), ["subject_id", "icd_code"], "charttime", ["hadm_id", "itemid", "line"])


@register("Q11_outcome_rate_rank", with_ctes(
    f"""SELECT itemid, round(free_rate, 6) AS free_rate, rank FROM (SELECT itemid, free_rate, DENSE_RANK() OVER
       (ORDER BY free_rate ASC) AS rank FROM (SELECT f.itemid, AVG(CASE WHEN epoch(o.outcome) - epoch(f.charttime)
       < 182 * 86400 THEN 0 ELSE 1 END) AS free_rate
       FROM (SELECT a.subject_id, e.itemid, MIN(e.charttime) AS charttime FROM e JOIN a USING (hadm_id)
             WHERE epoch(TIMESTAMP '{AS_OF}') - epoch(e.charttime) >= 182 * 86400 GROUP BY ALL) f
       JOIN (SELECT subject_id, MAX(admittime) AS outcome FROM a GROUP BY ALL) o USING (subject_id)
       GROUP BY f.itemid)) WHERE rank <= 4""", _EVENTS, _ADM))
def q11(spark, sf):
    outcome = admissions(spark, sf).groupBy("subject_id").agg(F.max("admittime").alias("outcome"))
    # the first of each item per admission is all the join needs
    old = events(spark, sf).where(F.col("charttime") <= shift(moment(AS_OF), days=-(365 // 2)))
    local = c.first_occurrence(old, ["hadm_id", "itemid"], "charttime")
    ranked = c.outcome_rate_rank(
        _owned(local, spark, sf), outcome, "subject_id", "itemid", "charttime", "outcome",
        days=365 // 2, k=4, as_of=AS_OF)
    return rounded(ranked, "free_rate")


@register("Q12_conditional_ratio", with_ctes(
    """SELECT admission_type, round(SUM(CASE WHEN cost > 200000 THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 6) AS percent,
       CAST(SUM(CASE WHEN cost > 200000 THEN 1 ELSE 0 END) * 100 // COUNT(*) AS BIGINT) AS whole_percent
       FROM (SELECT CASE WHEN admission_type NOT LIKE '5%' THEN admission_type END AS admission_type, cost FROM a) GROUP BY admission_type""", _ADM))
def q12(spark, sf):
    """Admissions of one type count as of unknown type, so one group is NULL."""
    known = F.when(~F.col("admission_type").startswith("5"), F.col("admission_type"))
    rows = admissions(spark, sf).withColumn("admission_type", known)
    return rounded(c.conditional_ratio(rows, F.col("cost") > 200000, ["admission_type"], whole="whole_percent"), "percent")


@register("Q13_decode_codes", """SELECT s.s_suppkey, s.s_acctbal, n.n_name, r.r_name, COUNT(l.l_orderkey) AS n_lines
    FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey JOIN lineitem l ON l.l_suppkey = s.s_suppkey GROUP BY ALL""")
def q13(spark, sf):
    mapping = {"supplier": [
        {"code_column": "s_nationkey", "dict_table": "nation", "dict_code_column": "n_nationkey", "dict_desc_column": "n_name"},
        {"code_column": "s_nationkey", "dict_table": "nation", "dict_code_column": "n_nationkey", "dict_desc_column": "n_regionkey"},
    ]}
    coded = c.decode_all(table(spark, sf, "supplier"), "supplier", mapping, {"nation": table(spark, sf, "nation")})
    named = c.decode(coded, "n_regionkey", table(spark, sf, "region"), "r_regionkey", "r_name")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_lines"))
    return named.join(lines, "s_suppkey").select("s_suppkey", "s_acctbal", "n_name", "r_name", "n_lines")


@register("Q14_common_joins", with_ctes(
    """SELECT p.segment, a.admission_type, i.label, COUNT(*) AS n, round(SUM(e.valuenum), 6) AS total
       FROM p JOIN a USING (subject_id) JOIN e USING (hadm_id) JOIN i USING (itemid) GROUP BY ALL""",
    _EVENTS, _ADM, _PAT, _ITEMS))
def q14(spark, sf):
    # events collapse to one row per admission and item before they meet the wider tables
    per_item = events(spark, sf).groupBy("hadm_id", "itemid").agg(F.count("*").alias("n"), F.sum("valuenum").alias("total"))
    full = c.join_on(
        per_item,
        (admissions(spark, sf).select("hadm_id", "subject_id", "admission_type"), ["hadm_id"]),
        (patients(spark, sf), ["subject_id"]), (items(spark, sf), ["itemid"]))
    out = full.groupBy("segment", "admission_type", "label").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return rounded(out, "total")


_RANGES = {"view": (35.5, 38.1), "click": (60.0, 100.0), "purchase": (12.0, 18.0), "signup": (90.0, 120.0), "error": (60.0, 90.0)}


@register("Q15_vital_range", with_ctes(
    "SELECT v.event_id, v.vital, v.valuenum, r.lower, r.upper FROM v JOIN r USING (vital) "
    "WHERE v.valuenum BETWEEN r.lower AND r.upper", _VITALS,
    "r(vital, lower, upper) AS (VALUES " + ", ".join(
        f"('{k}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for k, (lo, hi) in _RANGES.items()) + ")"))
def q15(spark, sf):
    kept = c.in_range(vitals(spark, sf), "vital", "valuenum", _RANGES)
    return kept.select("event_id", "vital", "valuenum", "lower", "upper")


@register("Q16_relative_clock", with_ctes(
    """SELECT hadm_id, date_diff('day', admittime, TIMESTAMP '2100-12-31 23:59:00') AS days_before_now,
       admittime >= TIMESTAMP '2100-12-31 23:59:00' - INTERVAL 1212 MONTH AS recent FROM a""", _ADM))
def q16(spark, sf):
    from ..functions.times import CLOCK, since
    at = F.col("admittime")
    return admissions(spark, sf).select(
        "hadm_id", F.date_diff(moment(CLOCK).cast("date"), at.cast("date")).cast("bigint").alias("days_before_now"),
        since(at, CLOCK, 1212).alias("recent"))


@register("Q17_date_shift", with_ctes(
    """SELECT hadm_id, admittime + INTERVAL 1 MONTH AS next_month, admittime - INTERVAL 1 YEAR AS last_year,
       admittime - INTERVAL 10 DAY AS ten_days_before,
       CAST(date_trunc('month', admittime) AS TIMESTAMP) + INTERVAL 1 MONTH + (day(admittime) - 1) * INTERVAL 1 DAY
         + (admittime - date_trunc('day', admittime)) AS next_month_rolled FROM a""", _ADM))
def q17(spark, sf):
    at = F.col("admittime")
    return admissions(spark, sf).select(
        "hadm_id", shift(at, 1).alias("next_month"), shift(at, -12).alias("last_year"),
        shift(at, days=-10).alias("ten_days_before"), shift_overflow(at, 1).alias("next_month_rolled"))


@register("Q18_julian_day_diff", with_ctes(
    """SELECT event_id, round((epoch_us(TIMESTAMP '2024-02-01 12:00:00') - epoch_us(charttime)) / 86400e6, 6) AS days
       FROM v""", _VITALS))
def q18(spark, sf):
    days = julian_day_diff(moment("2024-02-01 12:00:00"), F.col("charttime"))
    return rounded(vitals(spark, sf).select("event_id", days.alias("days")), "days")


@register("Q19_latest_code_for_patient", with_ctes(
    """SELECT subject_id, itemid, charttime FROM (SELECT a.subject_id, e.itemid, e.charttime, ROW_NUMBER() OVER
       (PARTITION BY a.subject_id ORDER BY e.charttime DESC NULLS LAST, e.hadm_id, e.line, e.itemid) AS rn
       FROM e JOIN a USING (hadm_id)) WHERE rn = 1""", _EVENTS, _ADM))
def q19(spark, sf):
    tie = ["hadm_id", "line", "itemid"]
    local = c.latest(events(spark, sf), "charttime", ["hadm_id"], tie)
    owned = _owned(local, spark, sf)
    return c.latest(owned, "charttime", ["subject_id"], tie).select("subject_id", "itemid", "charttime")


@register("Q20_distinct_project", "SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL")
def q20(spark, sf):
    return c.distinct_values(table(spark, sf, "part"), "p_type")


@register("Q21_query_to_table", """SELECT o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders
    WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_orderpriority""")
def q21(spark, sf):
    statement = f"""SELECT o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS top, MIN(o_orderkey) AS index
        FROM parquet.`{sf.rstrip('/')}/orders.parquet`
        WHERE o_orderdate >= CAST(:since AS TIMESTAMP_NTZ) GROUP BY o_orderpriority"""
    return c.query_to_table(spark, statement, args={"since": "1998-01-01 00:00:00"})


@register("Q2_Q6_flagship", with_ctes(
    """SELECT itemid, label, n, rank FROM (SELECT itemid, COUNT(*) AS n, DENSE_RANK() OVER (ORDER BY COUNT(*) DESC)
       AS rank FROM e WHERE hadm_id IN (SELECT hadm_id FROM a WHERE subject_id IN
       (SELECT subject_id FROM p WHERE segment = 'BUILDING')) GROUP BY itemid) JOIN i USING (itemid) WHERE rank <= 5""",
    _EVENTS, _ADM, _PAT, _ITEMS))
def flagship(spark, sf):
    """The most frequent items of one patient segment, top five with ties."""
    chosen = c.semi_chain(
        events(spark, sf),
        (admissions(spark, sf), "hadm_id", "hadm_id"),
        (patients(spark, sf).where("segment = 'BUILDING'"), "subject_id", "subject_id"),
    )
    return c.decode(c.frequent(chosen, "itemid", 5), "itemid", items(spark, sf), "itemid", "label").select(
        "itemid", "label", "n", "rank")
