"""Hand cases of the SQL text expressions."""

import pytest
from pyspark.sql import functions as F

from evalspark.functions import sqltext as sql
from evalspark.functions.similarity import split_clauses

NESTED = (
    "SELECT COUNT(*)>0 FROM procedures_icd WHERE procedures_icd.icd_code = ( SELECT d_icd_procedures.icd_code FROM "
    "d_icd_procedures WHERE d_icd_procedures.long_title = 'placed from . a b.c' ) AND procedures_icd.hadm_id IN "
    "( SELECT admissions.hadm_id FROM admissions WHERE admissions.subject_id = 10014078 )"
)
RANKED = (
    "SELECT T1.itemid, max(a, b) AS m FROM ( SELECT labevents.itemid, DENSE_RANK() OVER ( ORDER BY n DESC ) AS C1 "
    "FROM labevents GROUP BY labevents.itemid ) AS T1 WHERE T1.C1 <= 5 ORDER BY T1.itemid LIMIT 3"
)


def value(spark, fn, *texts):
    row = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
    return row.select(fn(*[F.col(c) for c in row.columns]).alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [
    (None, ""), ("", ""), ("Sure: [SELECT 1] and [SELECT 2]", "SELECT 1"), ("[No Answer query]", ""),
    ("No Answer query but SELECT 1", "No Answer query but SELECT 1"), ("half [open", "half open"), ("a [b\nc] d", "b\nc"),
    ("no answer query", "no answer query"),
])
def test_clean_query(spark, text, want):
    assert value(spark, sql.clean_query, text) == want


@pytest.mark.parametrize("text, want", [
    (None, "ERROR"), ("", ""), ("[ ]", ""), ("x [SELECT 1\nFROM t] y", "SELECT 1 FROM t;"),
    ("Select 0; Fixed SQL query: SELECT 1 FROM t; more", "SELECT 1 FROM t;"),
    ("Here:\n```sql\nSELECT a\nFROM t\n``` done", "SELECT a FROM t;"), ("select a\n\nselect b", "select a;"),
    ("nothing to do", "nothing to do;"), ("```SQL\nWITH x``` ", "WITH x;"), (" SELECT 1 ", "SELECT 1;"),
])
def test_extract_sql(spark, text, want):
    assert value(spark, sql.extract_sql, text) == want


@pytest.mark.parametrize("text, want", [
    (None, "ERROR"), (" [ SELECT 1 ] x", "SELECT 1"), ("[SELECT\n1]", "[SELECT\n1]"), ("SELECT 2 ", "SELECT 2"),
])
def test_first_bracket(spark, text, want):
    assert value(spark, sql.first_bracket, text) == want


@pytest.mark.parametrize("text, want", [
    ("  a  > =  b\n and c ! = d ", "a >= b and c != d"),
    ("DATE_SUB(NOW(), INTERVAL 1 YEAR)", "datetime('2100-12-31 23:59:00', '-1 year')"),
    ("DATE_ADD('2100-01-01', INTERVAL 14 MONTH)", "datetime('2100-01-01', '+14 months')"),
    ("DATE_ADD('2100-01-01', INTERVAL 11 DAY)", "datetime('2100-01-01', '+11 days')"),
    ("strftime('%j', current_time) - strftime('%y', current_date)",
     "strftime('%J', '2100-12-31 23:59:00') - strftime('%Y', '2100-12-31')"),
    ("datetime('now') CURDATE() CURTIME()", "datetime('2100-12-31 23:59:00') '2100-12-31' '23:59:00'"),
    ("x between systolic_bp_lower and systolic_bp_upper or y > systolic_bp_lower",
     "x between 90.0 and 120.0 or y > 90.0"),
    ("x between heart_rate_lower and sao2_upper", "x between heart_rate_lower and sao2_upper"),
    ("x > pulse_lower and x < pulse_upper", "x > pulse_lower and x < pulse_upper"),
])
def test_normalise(spark, text, want):
    assert value(spark, sql.normalise_query, text) == want


@pytest.mark.parametrize("text, want", [
    (None, []), ("", []), (NESTED, ["admissions", "d_icd_procedures", "procedures_icd"]),
    (RANKED, ["T1", "labevents"]), ("select a from\n b join c on x.y = 1", ["b", "c", "x"]),
])
def test_table_refs(spark, text, want):
    assert value(spark, sql.table_refs, text) == want


@pytest.mark.parametrize("text, want", [
    (None, []),
    (NESTED, [
        "*", "admissions.hadm_id", "admissions.subject_id", "d_icd_procedures.icd_code", "d_icd_procedures.long_title",
        "icd_code", "long_title", "procedures_icd.hadm_id", "procedures_icd.icd_code",
        "subject_id"]),
    (RANKED, ["C1", "DENSE_RANK", "T1.C1", "T1.itemid", "labevents.itemid", "max"]),
    ("SELECT a, f(b, c), (d) x WHERE e >= 1 AND g<2", ["a", "d", "e", "f", "g"]),
])
def test_column_refs(spark, text, want):
    assert value(spark, sql.column_refs, text) == want


@pytest.mark.parametrize("error, want", [
    (None, "No error"), ("", "No error"), ("near X: SYNTAX ERROR", "syntax"), ("no such table: t", "schema"),
    ("missing function", "syntax"), ("UNIQUE broken", "constraint"), ("SQL syntax", "other"), ("timeout", "timeout"),
    ("misuse of aggregate", "function"), ("access denied", "permission"), ("datatype mismatch", "type"),
])
def test_error_class(spark, error, want):
    assert value(spark, sql.categorise_error, error) == want


def test_component_counts(spark):
    query = "SELECT a, b.c AS d FROM t INNER JOIN u ON t.x = u.x WHERE a = 1 GROUP BY a ORDER BY a LIMIT 2"
    row = spark.createDataFrame([(query,), (None,)], "q string").select(
        *[c.alias(n) for n, c in sql.component_counts(F.col("q")).items()])
    first, second = row.withColumn("score", sql.complexity_score()).collect()
    assert first.asDict() == {
        "select_count": 1, "from_count": 1, "where_count": 1, "join_count": 2, "group_by_count": 1, "order_by_count": 1,
        "limit_count": 1, "distinct_count": 0, "subquery_count": 0, "table_count": 2, "column_count": 3,
        "score": 1 + 1 + 1.5 + 4 + 1.5 + 1 + 0.5 + 3 + 1.5}
    assert set(second.asDict().values()) == {0, 0.0}


def test_overlap_is_symmetric_and_bounded(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), ([], []), (["x", "y"], ["z"]), (["q"], ["q"])], "a array<string>, b array<string>")
    rows = df.select(sql.set_overlap(F.col("a"), F.col("b")), sql.set_overlap(F.col("b"), F.col("a"))).collect()
    assert [tuple(r) for r in rows] == [(0.5, 0.5), (0.0, 0.0), (0.0, 0.0), (1.0, 1.0)]


def test_split_clauses():
    parts = split_clauses(RANKED)
    inner = (
        " SELECT labevents.itemid, DENSE_RANK() OVER ( ORDER BY n DESC ) AS C1 FROM labevents GROUP BY labevents.itemid ")
    assert parts["subqueries"] == [inner]
    assert parts["select_clause"] == "T1.itemid, max(a, b) AS m"
    assert parts["from_clause"] == f"(SELECT {inner}) AS T1"
    assert parts["where_clause"] == "T1.C1 <= 5"
    assert (parts["order_by_clause"], parts["limit_clause"]) == ("T1.itemid", "3")
    assert (parts["group_by_clause"], parts["having_clause"]) == ("", "")


def test_split_clauses_with_quoted_and_open_brackets():
    quoted = split_clauses("SELECT a FROM t WHERE b IN (SELECT c FROM u WHERE d = ')' ) LIMIT 1")
    assert quoted["subqueries"] == ["SELECT c FROM u WHERE d = ')' "]
    assert quoted["limit_clause"] == "1"
    cut_off = split_clauses("SELECT a FROM t WHERE b IN (SELECT c FROM u")
    assert cut_off["subqueries"] == [] and cut_off["where_clause"] == "b IN (SELECT c FROM u"
    assert split_clauses(None)["select_clause"] == ""
