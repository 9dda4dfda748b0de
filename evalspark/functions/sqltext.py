"""What a SQL text says, read with native expressions.

All of these are plain projections: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, all_groups, contains_any, count_of, found, let, strip
from .times import CLOCK, CLOCK_DATE, CLOCK_TIME

_WORD = "[a-zA-Z0-9_]+"
_NAME = "[a-zA-Z_][a-zA-Z0-9_]*"
# A word that does not match from its first letter does not match from a later one either: start once per
# word and (with a + after the pattern) never give letters back.
_WORD_START = "(?<![a-zA-Z0-9_])"
_NAME_START = "(?<![a-zA-Z_])"

# fixed values: normal range of each vital sign
VITAL_RANGES = {
    "temperature": (35.5, 38.1),
    "sao2": (95.0, 100.0),
    "heart rate": (60.0, 100.0),
    "respiration": (12.0, 18.0),
    "systolic bp": (90.0, 120.0),
    "diastolic bp": (60.0, 90.0),
    "mean bp": (60.0, 110.0),
}

# fixed values: weight of each counted SQL part in the complexity score
COMPLEXITY_WEIGHTS = {
    "select_count": 1.0,
    "from_count": 1.0,
    "where_count": 1.5,
    "join_count": 2.0,
    "group_by_count": 1.5,
    "order_by_count": 1.0,
    "limit_count": 0.5,
    "distinct_count": 1.0,
    "subquery_count": 3.0,
    "table_count": 1.5,
    "column_count": 0.5,
}


# --- W1, W2, W2b: the SQL inside a model response -----------------------------

def clean_query(text: Column) -> Column:
    """Bracketed SQL if any, else the text without brackets; refusals become ''."""
    bracket = r"\[([^\]]+)\]"
    body = (
        F.when(found(text, bracket), F.regexp_extract(text, bracket, 1))
        .otherwise(F.translate(text, "[]", ""))
    )
    refusal = (
        F.contains(text, F.lit("No")) & F.contains(text, F.lit("Answer")) & F.contains(text, F.lit("query"))
    )
    has_sql = F.contains(F.upper(text), F.lit("SELECT"))
    return F.coalesce(F.when(refusal & ~has_sql, "").otherwise(body), F.lit(""))


def extract_sql(response: Column) -> Column:
    """SQL of a repair response: brackets, then the labelled SELECT, then any SELECT, then all.

    No response is ERROR.
    """
    return F.coalesce(let(strip(response), _extracted), F.lit("ERROR"))


def _extracted(text: Column) -> Column:
    bracket = r"(?s)\[(.*?)\]"
    until = r"(?:\z|```|;|\n\n)"
    labelled = f"(?is)Fixed SQL query:{WS}*(SELECT.*?){until}"
    plain = f"(?is)(SELECT.*?){until}"
    sql = (
        F.when(found(text, bracket), strip(F.regexp_extract(text, bracket, 1)))
        .when(found(text, labelled), strip(F.regexp_extract(text, labelled, 1)))
        .when(found(text, plain), strip(F.regexp_extract(text, plain, 1)))
        .otherwise(text)
    )
    sql = F.regexp_replace(sql, f"(?i)^```sql{WS}*", "")
    sql = F.regexp_replace(sql, f"^```{WS}*", "")
    sql = F.regexp_replace(sql, f"{WS}*```\\z", "")
    sql = F.translate(strip(sql), "\n", " ")
    return let(sql, lambda s: F.when((s == "") | F.endswith(s, F.lit(";")), s).otherwise(F.concat(s, F.lit(";"))))


def first_bracket(response: Column) -> Column:
    """SQL of a generation response: first one-line bracket, else the text; no response is ERROR."""
    bracket = r"\[([^\n]*?)\]"
    sql = let(strip(response), lambda text: F.when(
        found(text, bracket), strip(F.regexp_extract(text, bracket, 1))).otherwise(text))
    return F.coalesce(sql, F.lit("ERROR"))


# --- W3: one spelling for dates, clocks, operators and vital ranges -----------

def normalise_query(query: Column) -> Column:
    sql = F.regexp_replace(F.translate(query, "\n", " "), " +", " ")
    sql = strip(sql)
    for split_op, op in (("> =", ">="), ("< =", "<="), ("! =", "!=")):
        sql = F.replace(sql, F.lit(split_op), F.lit(op))
    sql = let(sql, lambda s: F.when(F.contains(s, F.lit("DATE_")), _date_calls(s)).otherwise(s))
    for word, value in (
        ("current_time", CLOCK), ("current_date", CLOCK_DATE), ("'now'", CLOCK),
        ("NOW()", CLOCK), ("CURDATE()", CLOCK_DATE), ("CURTIME()", CLOCK_TIME),
    ):
        sql = F.replace(sql, F.lit(word), F.lit(f"'{value}'"))
    sql = let(sql, lambda s: F.when(F.contains(s, F.lit("_lower")), _fill_vital_range(s)).otherwise(s))
    sql = F.replace(sql, F.lit("%y"), F.lit("%Y"))
    return F.replace(sql, F.lit("%j"), F.lit("%J"))


def _date_calls(sql: Column) -> Column:
    for func, sign in (("DATE_SUB", "-"), ("DATE_ADD", "+")):
        for unit in ("MONTH", "YEAR", "DAY"):
            call = func + r"\(([\p{L}\p{N}_]+\(\)|'[^']+')[, ]+ INTERVAL "
            one = f"datetime($1, '{sign}1 {unit.lower()}')"
            many = f"datetime($1, '{sign}$2 {unit.lower()}s')"
            sql = F.regexp_replace(sql, f"{call}1 {unit}\\)", one)
            sql = F.regexp_replace(sql, f"{call}([0-9]+) {unit}\\)", many)
    return sql


def _fill_vital_range(sql: Column) -> Column:
    """Put the range of the one vital that the text names as ``<vital>_lower`` and ``<vital>_upper``."""
    bounds = F.array(
        F.regexp_extract(sql, f" +({_WORD}_lower)", 1), F.regexp_extract(sql, f" +({_WORD}_upper)", 1))

    def fill(pair: Column) -> Column:
        lower, upper = pair[0], pair[1]
        name = F.regexp_replace(lower, "_lower$", "")
        same = (lower != "") & (name == F.regexp_replace(upper, "_upper$", ""))
        vital = F.translate(name, "_", " ")
        filled = sql
        for key, (low, high) in VITAL_RANGES.items():
            text = F.replace(F.replace(sql, lower, F.lit(str(low))), upper, F.lit(str(high)))
            filled = F.when(same & (vital == key), text).otherwise(filled)
        return filled

    return let(bounds, fill)


# --- W4, W5: tables and columns -----------------------------------------------

def _without_strings(query: Column) -> Column:
    return F.regexp_replace(F.coalesce(query, F.lit("")), "'[^']*'", "")


def table_refs(query: Column) -> Column:
    """Sorted names after FROM/JOIN plus the prefixes of dotted names (so aliases count)."""
    sql = _without_strings(query)
    named = all_groups(sql, f"(?i)(?:FROM|JOIN){WS}+({_NAME})")
    dotted = all_groups(sql, f"{_NAME_START}({_NAME}+)\\.{_NAME}")
    return F.sort_array(F.array_union(named, dotted))


def _top_level_parts(clause: Column) -> Column:
    """Split on commas outside parentheses, by the bracket balance of the pieces so far."""
    def step(acc, piece):
        opens = F.length(piece) - F.length(F.replace(piece, F.lit("("), F.lit("")))
        closes = F.length(piece) - F.length(F.replace(piece, F.lit(")"), F.lit("")))
        starts = acc["depth"] == 0
        return F.struct(
            (acc["depth"] + opens - closes).cast("int").alias("depth"),
            F.when(starts, F.concat(acc["parts"], F.array(acc["open"]))).otherwise(acc["parts"]).alias("parts"),
            F.when(starts, piece).otherwise(F.concat(acc["open"], F.lit(","), piece)).alias("open"),
        )

    start = F.struct(
        F.lit(0).alias("depth"),
        F.array().cast("array<string>").alias("parts"),
        F.lit("").alias("open"),
    )
    return F.aggregate(
        F.split(clause, ","), start, step,
        lambda acc: F.concat(acc["parts"], F.array(acc["open"])),
    )


def _select_items(clause: Column) -> Column:
    """First token of each item of a SELECT list; any star leaves only the star."""
    tokens = F.transform(_top_level_parts(clause), lambda p: F.regexp_extract(p, "([a-zA-Z0-9_.*]+)", 1))
    return (
        F.when(F.contains(clause, F.lit("*")), F.array(F.lit("*")))
        .otherwise(F.filter(tokens, lambda t: t != ""))
    )


def select_columns(texts: Column) -> Column:
    """Column tokens of the first SELECT list of each text of an array."""
    clauses = F.transform(
        texts, lambda t: strip(F.regexp_extract(t, f"(?is)SELECT{WS}+(.*?)(?:FROM|\\z)", 1)))
    return F.flatten(F.transform(clauses, _select_items))


def where_columns(texts: Column) -> Column:
    """Identifiers right before a comparison in the first WHERE of each text of an array."""
    clauses = F.transform(
        texts, lambda t: F.regexp_extract(t, f"(?is)WHERE{WS}+(.*?)(?:GROUP BY|ORDER BY|LIMIT|\\z)", 1))
    return F.flatten(F.transform(clauses, lambda c: all_groups(c, f"{_WORD_START}({_WORD}+){WS}*[=<>]")))


def column_refs(query: Column) -> Column:
    """Sorted column references of the query and of its parenthesised sub-selects."""
    return let(_without_strings(query), _column_refs)


def _column_refs(sql: Column) -> Column:
    subs = all_groups(sql, f"(?is)(\\({WS}*SELECT{WS}+.+?FROM.+?\\))")
    dotted = all_groups(sql, f"{_NAME_START}({_NAME}+\\.{_NAME})")
    inner = let(F.concat(F.array(sql), subs), lambda texts: F.concat(select_columns(texts), where_columns(texts)))
    return F.sort_array(F.array_union(dotted, inner))


def set_overlap(a: Column, b: Column) -> Column:
    """Shared over all members; 0 when neither side has any."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(0.0)


# --- D7, D8: counted parts ----------------------------------------------------

def component_counts(query: Column) -> dict[str, Column]:
    """Counts of clauses, tables and columns; all 0 where there is no query."""
    sql = F.lower(F.coalesce(query, F.lit("")))
    counts = {
        "select_count": count_of(sql, "select"),
        "from_count": count_of(sql, "from"),
        "where_count": count_of(sql, "where"),
        "join_count": sum(
            (count_of(sql, j) for j in (" inner join ", " left join ", " right join ")), count_of(sql, " join ")
        ),
        "group_by_count": count_of(sql, "group by"),
        "order_by_count": count_of(sql, "order by"),
        "limit_count": count_of(sql, "limit"),
        "distinct_count": count_of(sql, "distinct"),
        "subquery_count": count_of(sql, "(select"),
    }
    tables = F.array_union(
        all_groups(sql, f"from{WS}+([a-z0-9_]+)"), all_groups(sql, f"join{WS}+([a-z0-9_]+)")
    )
    listed = F.regexp_extract(sql, f"select{WS}+([^\\n]*?){WS}+from", 1)
    chosen = all_groups(listed, f"([a-z0-9_.]+)(?:{WS}*,|{WS}*\\z|{WS}+as)")
    chosen = F.when(F.contains(listed, F.lit("*")), F.array().cast("array<string>")).otherwise(chosen)
    tested = all_groups(sql, f"where{WS}+([a-z0-9_.]+){WS}*[=<>]")
    counts["table_count"] = F.size(tables)
    counts["column_count"] = F.size(F.array_union(chosen, tested))
    return counts


def complexity_score(counts: dict[str, Column] | None = None) -> Column:
    """Weighted sum of the counts (by default of columns named as they are)."""
    if counts is None:
        counts = {name: F.col(name) for name in COMPLEXITY_WEIGHTS}
    return sum((counts[n] * F.lit(w) for n, w in COMPLEXITY_WEIGHTS.items()), F.lit(0.0))


# --- W10: error classes -------------------------------------------------------

# fixed values: error classes in order of precedence, matched on lower-cased text
ERROR_CLASSES = {
    "syntax": ("syntax error", "parse error", "SQL syntax", "unexpected", "missing"),
    "schema": ("no such table", "no such column", "ambiguous", "not recognized"),
    "constraint": ("constraint", "unique", "foreign key", "not null", "check constraint"),
    "type": ("datatype", "type mismatch", "incompatible types", "cannot convert"),
    "function": ("function", "procedure", "aggregate", "window function"),
    "timeout": ("timeout", "query interrupted", "execution time", "too long"),
    "permission": ("permission", "access", "privilege"),
}


def categorise_error(error: Column) -> Column:
    text = F.lower(error)
    out = F.when(error.isNull() | (error == ""), "No error")
    for name, pieces in ERROR_CLASSES.items():
        out = out.when(contains_any(text, pieces), name)
    return out.otherwise("other")
