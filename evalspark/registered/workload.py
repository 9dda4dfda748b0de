"""Family W over the query log derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import results as res
from ..functions import sqltext as sql
from ..functions.clauses import CLAUSES, split_clauses, subselect_tree
from ..functions.similarity import compare_plans, plan_order_similarity
from ..functions.text import concat_all
from ..operators import workload as w
from ..operators.profile import sql_components
from ..operators.statements import run_statements
from ..plans.evaluation import compare_queries, repair_round, score_models
from ..plans.scores import ScoreStore
from ..plans.stored_log import StoredLog
from ..session import shared_folder, work_path
from .profile import complexity_ctes
from .base import joined, over_log, query_log, register, rounded, table, truth_runs

# --- SQL pieces of the oracles --------------------------------------------------

_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_WS}+|{_WS}+\\z', '', 'g')"


def _clean(text: str) -> str:
    return f"""coalesce(CASE WHEN NOT contains(upper({text}), 'SELECT') AND contains({text}, 'No')
      AND contains({text}, 'Answer') AND contains({text}, 'query') THEN ''
      WHEN regexp_matches({text}, '\\[([^\\]]+)\\]') THEN regexp_extract({text}, '\\[([^\\]]+)\\]', 1)
      ELSE translate({text}, '[]', '') END, '')"""


def _bare(text: str) -> str:
    return f"regexp_replace(coalesce({text}, ''), '''[^'']*''', '', 'g')"


def _tables(text: str) -> str:
    return f"""list_sort(list_distinct(regexp_extract_all({_bare(text)},
      '(?i)(?:FROM|JOIN){_WS}+([a-zA-Z_][a-zA-Z0-9_]*)', 1)
      || regexp_extract_all({_bare(text)}, '([a-zA-Z_][a-zA-Z0-9_]*)\\.[a-zA-Z_][a-zA-Z0-9_]*', 1)))"""


# columns of a list of texts: dotted names of the first, SELECT items and WHERE names of all
def _columns(text: str) -> str:
    bare = _bare(text)
    texts = f"([{bare}] || regexp_extract_all({bare}, '(?is)(\\({_WS}*SELECT{_WS}+.+?FROM.+?\\))', 1))"
    clause = _strip(f"regexp_extract(s, '(?is)SELECT{_WS}+(.*?)(?:FROM|\\z)', 1)")
    depth = (
        "list_sum(list_transform(p[1:i], lambda q: "
        "(length(q) - length(replace(q, '(', ''))) - (length(q) - length(replace(q, ')', '')))))"
    )
    # pieces between commas; a new item starts where the brackets so far balance
    items = f"""list_transform(list_transform([string_split({clause}, ',')], lambda p: list_transform(
        list_filter(range(0, len(p)), lambda i: i = 0 OR {depth} = 0),
        lambda s0: array_to_string(p[s0 + 1 : coalesce(list_min(list_filter(range(s0 + 1, len(p)),
          lambda i: {depth} = 0)), len(p))], ','))), lambda l: l)[1]"""
    listed = f"""CASE WHEN contains({clause}, '*') THEN ['*'] ELSE list_filter(list_transform({items},
        lambda x: regexp_extract(x, '([a-zA-Z0-9_.*]+)', 1)), lambda x: x <> '') END"""
    tested = (
        f"regexp_extract_all(regexp_extract(s, '(?is)WHERE{_WS}+(.*?)(?:GROUP BY|ORDER BY|LIMIT|\\z)', 1), "
        f"'([a-zA-Z0-9_]+)(?:{_WS}*[=<>])', 1)"
    )
    return f"""list_sort(list_distinct(regexp_extract_all({bare}, '([a-zA-Z_][a-zA-Z0-9_]*\\.[a-zA-Z_][a-zA-Z0-9_]*)', 1)
      || flatten(list_transform({texts}, lambda s: ({listed}) || {tested}))))"""


def _overlap(a: str, b: str) -> str:
    return f"""CASE WHEN len(list_distinct({a} || {b})) > 0
      THEN len(list_intersect({a}, {b})) / len(list_distinct({a} || {b})) ELSE 0.0 END"""


def _error_class(error: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({error}), '{p}')" for p in pieces) + f" THEN '{name}'"
        for name, pieces in sql.ERROR_CLASSES.items())
    return f"CASE WHEN {error} IS NULL OR {error} = '' THEN 'No error' {cases} ELSE 'other' END"


def _rows(json: str) -> str:
    return f"coalesce(len(json_extract({json}, '$[*]')), 0)"


def _row_set(json: str) -> str:
    """Rows of the log's results have the one column n."""
    return f"list_distinct(coalesce(json_extract_string({json}, '$[*].n'), []))"


def _diff(a: str, b: str) -> str:
    return (
        f"(len({_row_set(a)}) + len({_row_set(b)}) - 2 * len(list_intersect({_row_set(a)}, {_row_set(b)})))"
    )


def _reason(a: str, b: str) -> str:
    return f"""CASE WHEN {_rows(a)} = 0 AND {_rows(b)} = 0 THEN 'Both results are empty'
      WHEN {_rows(a)} = 0 THEN 'First result is empty, second has data'
      WHEN {_rows(b)} = 0 THEN 'Second result is empty, first has data'
      WHEN {_rows(a)} <> {_rows(b)} THEN 'Different number of rows'
      WHEN {_diff(a, b)} = 0 THEN 'Results are identical (same rows, possibly different order)'
      ELSE concat({_diff(a, b)}, ' rows differ between results') END"""


def _equal(a: str, b: str) -> str:
    return f"({_rows(a)} = {_rows(b)} AND {_diff(a, b)} = 0)"


_EDIT = """CASE WHEN greatest(length(coalesce(true_query, '')), length(coalesce(generated_sql, ''))) = 0 THEN 1.0
  ELSE 1.0 - levenshtein(coalesce(true_query, ''), coalesce(generated_sql, ''))
  / greatest(length(coalesce(true_query, '')), length(coalesce(generated_sql, ''))) END"""

# the log beside its truth, and the measures SQL can express
_PAIRS = """pairs AS (SELECT log.*, truth.success AS success_true, truth.row_count AS row_count_true,
  truth.results AS results_true, truth.execution_time AS execution_time_true,
  truth.execution_plan AS execution_plan_true FROM log LEFT JOIN truth ON log.id IS NOT DISTINCT FROM truth.id
  AND log.question IS NOT DISTINCT FROM truth.question AND log.true_query IS NOT DISTINCT FROM truth.true_query)"""
# plans are equal or share one of three steps and all but one of the 26 characters of their written lists
_PLAN = """CASE WHEN execution_plan = execution_plan_true THEN 1.0 WHEN execution_plan IS NULL THEN 0.0
  ELSE (1 / 3 + 25 / 26) / 2 END"""
_MEASURES = f"""measures AS (SELECT *, {_tables('true_query')} AS tt, {_tables('generated_sql')} AS gt,
  {_columns('true_query')} AS tc, {_columns('generated_sql')} AS gc,
  CASE WHEN success THEN CAST({_equal('results_true', 'results')} AS INT) ELSE 0 END AS results_match,
  {_rows('results_true')} = 0 AS true_empty_result, {_rows('results')} = 0 AS gen_empty_result,
  {_EDIT} AS edit_similarity, {_PLAN} AS plan_similarity FROM pairs)"""
_SCORED = f"""scored AS (SELECT *, {_overlap('tt', 'gt')} AS table_access_accuracy,
  {_overlap('tc', 'gc')} AS column_access_accuracy, true_empty_result AND gen_empty_result AS both_empty,
  0.3 * results_match + 0.2 * ({_overlap('tt', 'gt')}) + 0.2 * ({_overlap('tc', 'gc')}) + 0.1 * edit_similarity
  + 0.2 * plan_similarity AS composite_score FROM measures)"""
SCORED_SQL = (_PAIRS, _MEASURES, _SCORED)


def native_scores(spark, sf, gen="generated_sql"):
    """The log with its truth and every measure; all are the shipped ones but for the ratio of the texts.

    In its place stands the native edit measure, so that SQL can repeat the scores.
    """
    def extra(rows):
        return w.with_edit_similarity(rows, "true_query", gen).withColumn("query_similarity", F.col("edit_similarity"))

    return compare_queries(
        query_log(spark, sf), truth_runs(spark, sf), gen, text_similarity=False, store=score_store(spark), extra=extra)


def score_store(spark) -> ScoreStore:
    """The scores of this session's queries: what one has scored, the others read."""
    return ScoreStore(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}", "model_name")


# --- per-row operators ----------------------------------------------------------

@register("W1_clean_query", over_log(f"SELECT id, {_clean('generated_sql')} AS cleaned FROM log"))
def w1(spark, sf):
    return query_log(spark, sf).select("id", sql.clean_query(F.col("generated_sql")).alias("cleaned"))


_UNTIL = "(?:\\z|```|;|\\n\\n)"


# answers in the shapes models give: labelled, fenced, bracketed over lines, and bare
_RESPONSE = """CASE WHEN id % 3 = 0 THEN concat('  ```sql', chr(10), 'SELECT ', CAST(id AS STRING), chr(10), ' FROM t', chr(10), '```  ')
  WHEN id % 11 = 0 THEN concat('[SELECT', chr(10), '1] or [2]') WHEN id % 13 = 0 THEN 'ERROR' ELSE generated_sql END"""


@register("W2_extract_sql", over_log(
    f"""SELECT id, CASE WHEN sql IS NULL THEN 'ERROR' WHEN sql = '' OR ends_with(sql, ';') THEN sql
      ELSE concat(sql, ';') END AS sql FROM (
      SELECT id, translate({_strip(f"regexp_replace(regexp_replace(regexp_replace(sql, '(?i)^```sql{_WS}*', ''), '^```{_WS}*', ''), '{_WS}*```\\z', '')")}, chr(10), ' ') AS sql
      FROM (SELECT id, CASE WHEN regexp_matches(r, '(?s)\\[(.*?)\\]') THEN {_strip("regexp_extract(r, '(?s)\\[(.*?)\\]', 1)")}
      WHEN regexp_matches(r, '(?is)Fixed SQL query:{_WS}*(SELECT.*?){_UNTIL}')
        THEN {_strip(f"regexp_extract(r, '(?is)Fixed SQL query:{_WS}*(SELECT.*?){_UNTIL}', 1)")}
      WHEN regexp_matches(r, '(?is)(SELECT.*?){_UNTIL}') THEN {_strip(f"regexp_extract(r, '(?is)(SELECT.*?){_UNTIL}', 1)")}
      ELSE r END AS sql FROM (SELECT id, {_strip(_RESPONSE)} AS r FROM log)))"""))
def w2(spark, sf):
    responses = query_log(spark, sf).selectExpr("id", f"{_RESPONSE} AS response")
    return responses.select("id", sql.extract_sql(F.col("response")).alias("sql"))


@register("W2b_first_bracket", over_log(
    f"""SELECT id, coalesce(CASE WHEN regexp_matches(r, '\\[([^\\n]*?)\\]')
      THEN {_strip("regexp_extract(r, '\\[([^\\n]*?)\\]', 1)")} ELSE r END, 'ERROR') AS sql
      FROM (SELECT id, {_strip(_RESPONSE)} AS r FROM log)"""))
def w2b(spark, sf):
    responses = query_log(spark, sf).selectExpr("id", f"{_RESPONSE} AS response")
    return responses.select("id", sql.first_bracket(F.col("response")).alias("sql"))


# texts with split operators, date calls, clock words and vital ranges
_ODD = """concat(coalesce(true_query, 'SELECT'), '   WHERE t > = 1 AND d < =', chr(10),
  CASE WHEN id % 4 = 0 THEN 'DATE_SUB(NOW(), INTERVAL 1 YEAR)' WHEN id % 4 = 1 THEN concat('DATE_ADD(''2100-01-01'', INTERVAL ',
  CAST(id % 9 AS STRING), ' MONTH)') WHEN id % 4 = 2 THEN 'strftime(''%y'', current_time) ! = CURDATE()'
  ELSE 'v between heart_rate_lower and heart_rate_upper' END)"""


def _oracle_normalise(text: str) -> str:
    out = _strip(f"regexp_replace(translate({text}, chr(10), ' '), ' +', ' ', 'g')")
    for a, b in (("> =", ">="), ("< =", "<="), ("! =", "!=")):
        out = f"replace({out}, '{a}', '{b}')"
    for call, sign in (("DATE_SUB", "-"), ("DATE_ADD", "+")):
        for unit in ("MONTH", "YEAR", "DAY"):
            head = f"{call}\\(([\\p{{L}}\\p{{N}}_]+\\(\\)|''[^'']+'')[, ]+ INTERVAL "
            low = unit.lower()
            out = f"regexp_replace({out}, '{head}1 {unit}\\)', 'datetime(\\1, ''{sign}1 {low}'')', 'g')"
            out = f"regexp_replace({out}, '{head}([0-9]+) {unit}\\)', 'datetime(\\1, ''{sign}\\2 {low}s'')', 'g')"
    for word, value in (
        ("current_time", "2100-12-31 23:59:00"), ("current_date", "2100-12-31"), ("''now''", "2100-12-31 23:59:00"),
        ("NOW()", "2100-12-31 23:59:00"), ("CURDATE()", "2100-12-31"), ("CURTIME()", "23:59:00"),
    ):
        out = f"replace({out}, '{word}', '''{value}''')"
    out = f"replace(replace({out}, 'heart_rate_lower', '60.0'), 'heart_rate_upper', '100.0')"
    return f"replace(replace({out}, '%y', '%Y'), '%j', '%J')"


@register("W3_normalise_query", over_log(f"SELECT id, {_oracle_normalise(_ODD)} AS normalised FROM log"))
def w3(spark, sf):
    # DuckDB and Spark quote a quote differently: '' there, \' here
    odd = query_log(spark, sf).selectExpr("id", f"{_ODD.replace(chr(39) * 2, chr(92) + chr(39))} AS odd")
    return odd.select("id", sql.normalise_query(F.col("odd")).alias("normalised"))


@register("W4_table_refs", over_log(
    f"""SELECT id, array_to_string({_tables('true_query')}, '|') AS true_tables,
      array_to_string({_tables('generated_sql')}, '|') AS gen_tables FROM log"""))
def w4(spark, sf):
    return query_log(spark, sf).select(
        "id", joined(sql.table_refs(F.col("true_query"))).alias("true_tables"),
        joined(sql.table_refs(F.col("generated_sql"))).alias("gen_tables"))


@register("W5_column_refs", over_log(
    f"""SELECT id, array_to_string({_columns('true_query')}, '|') AS true_columns,
      array_to_string({_columns('generated_sql')}, '|') AS gen_columns FROM log"""))
def w5(spark, sf):
    return query_log(spark, sf).select(
        "id", joined(sql.column_refs(F.col("true_query"))).alias("true_columns"),
        joined(sql.column_refs(F.col("generated_sql"))).alias("gen_columns"))


# for every other id the orders have an alias, while names still call them by their own
_ALIASED = "CASE WHEN id % 2 = 0 THEN replace(generated_sql, 'FROM orders', 'FROM orders AS o') ELSE generated_sql END"


@register("W5_unresolved_names", over_log(
    f"""SELECT model_name, CAST(SUM(len(refs)) AS BIGINT) AS names, CAST(SUM(len(bad)) AS BIGINT) AS unresolved,
      round(SUM(len(bad)) / SUM(len(refs)), 6) AS share FROM (SELECT model_name, refs, CASE WHEN contains(q, 'FROM orders AS o')
      THEN list_filter(refs, lambda r: starts_with(r, 'orders.')) ELSE [] END AS bad FROM (SELECT model_name, q,
      regexp_extract_all({_bare('q')}, '([a-zA-Z_][a-zA-Z0-9_]*\\.[a-zA-Z_][a-zA-Z0-9_]*)', 1) AS refs
      FROM (SELECT model_name, {_ALIASED} AS q FROM log))) GROUP BY model_name"""))
def w5_unresolved(spark, sf):
    aliased = query_log(spark, sf).selectExpr("model_name", f"{_ALIASED} AS generated_sql")
    return rounded(w.unresolved_share(aliased, ["model_name"]), "share")


# the log's queries hold at most one sub-select, whose brackets nest no deeper than three
_SUB = "\\([ ]*SELECT(?:[^()]|\\((?:[^()]|\\([^()]*\\))*\\))*\\)"
_STOPS = {
    "select": ["FROM"], "from": ["WHERE", "GROUP BY", "HAVING", "ORDER BY", "LIMIT"],
    "where": ["GROUP BY", "HAVING", "ORDER BY", "LIMIT"], "group_by": ["HAVING", "ORDER BY", "LIMIT"],
    "having": ["ORDER BY", "LIMIT"], "order_by": ["LIMIT"], "limit": [],
}


def _clause(name: str, side: str) -> str:
    stops = "".join(f"[ ]+{stop}\\b|" for stop in _STOPS[name])
    text = f"regexp_extract({side}_o, '(?is){name.replace('_', ' ').upper()}[ ]+(.*?)(?:{stops}\\z)', 1)"
    return f"replace(trim({text}), 'SUBQUERY_0', concat('SELECT ', {side}_s[2:-2])) AS {side}_{name}_clause"


def _split_sql(side: str, query: str) -> str:
    return f"""SELECT id, {side}_s, CASE WHEN {side}_s = '' THEN q ELSE replace(q, {side}_s, '(SUBQUERY_0)') END AS {side}_o FROM (
      SELECT id, q, regexp_extract(q, '{_SUB}') AS {side}_s FROM (SELECT id, coalesce({query}, '') AS q FROM log))"""


@register("W6_split_clauses", over_log(
    "SELECT id, " + ", ".join(_clause(c, side) for side in ("true", "gen") for c in CLAUSES)
    + f", true_s[2:-2] AS true_subqueries, gen_s[2:-2] AS gen_subqueries FROM ({_split_sql('true', 'true_query')}) "
      f"JOIN ({_split_sql('gen', 'generated_sql')}) USING (id)"))
def w6(spark, sf):
    rows = query_log(spark, sf).select(
        "id", split_clauses(F.col("true_query")).alias("true"), split_clauses(F.col("generated_sql")).alias("gen"))
    return rows.select("id", *[F.col(f"{side}.{c}_clause").alias(f"{side}_{c}_clause") for side in ("true", "gen") for c in CLAUSES],
                       *[joined(f"{side}.subqueries").alias(f"{side}_subqueries") for side in ("true", "gen")])


# each query two levels deep, so that its own sub-select is on the third
_DEEP = "concat('SELECT a FROM (SELECT b FROM (', {0}, ') x WHERE c > 0) y')"


@register("W6_subselect_tree", over_log(
    f"""SELECT query_id, CAST(n AS INT) AS id, CASE WHEN n > 0 THEN CAST(n - 1 AS INT) END AS parent, CAST(n + 1 AS INT) AS depth, text FROM (
      SELECT id AS query_id, unnest(range(0, len(texts))) AS n, unnest(texts) AS text FROM (
      SELECT id, [concat('SELECT b FROM (', true_query, ') x WHERE c > 0'), true_query]
        || CASE WHEN s = '' THEN CAST([] AS VARCHAR[]) ELSE [s[2:-2]] END AS texts
      FROM (SELECT id, true_query, regexp_extract(true_query, '{_SUB}') AS s FROM log WHERE true_query IS NOT NULL)))"""))
def w6_tree(spark, sf):
    deep = query_log(spark, sf).where("true_query IS NOT NULL").select(F.col("id").alias("query_id"), F.expr(_DEEP.format("true_query")).alias("q"))
    return deep.select("query_id", F.inline(subselect_tree(F.col("q"))))


@register("W7_set_overlap", over_log(
    """SELECT id, round(table_access_accuracy, 6) AS table_access_accuracy,
      round(column_access_accuracy, 6) AS column_access_accuracy,
      array_to_string(list_sort(list_distinct(tt || gt)), '|') AS tables_union,
      array_to_string(list_sort(list_intersect(tc, gc)), '|') AS columns_intersection FROM scored""", *SCORED_SQL))
def w7(spark, sf):
    df = w.with_access_overlap(query_log(spark, sf))
    return rounded(df, "table_access_accuracy", "column_access_accuracy").select(
        "id", "table_access_accuracy", "column_access_accuracy", joined("tables_union").alias("tables_union"),
        joined("columns_intersection").alias("columns_intersection"))


@register("W8_text_similarity")
def w8(spark, sf):
    pairs = query_log(spark, sf).select("id", "true_query", "generated_sql")
    return w.with_text_similarity(pairs).drop("true_query", "generated_sql")


@register("W8_edit_similarity", over_log(f"SELECT id, round({_EDIT}, 6) AS edit_similarity FROM log"))
def w8_edit(spark, sf):
    df = w.with_edit_similarity(query_log(spark, sf), "true_query", "generated_sql")
    return rounded(df.select("id", "edit_similarity"), "edit_similarity")


_DETAILS = "coalesce(json_extract_string({}, '$[*].detail'), [])"
_TRUE_STEPS, _GEN_STEPS = _DETAILS.format("execution_plan_true"), _DETAILS.format("execution_plan")


@register("W9_plan_overlap", over_log(
    f"""SELECT id, CASE WHEN len({_TRUE_STEPS}) > 0 AND len({_GEN_STEPS}) > 0
      THEN round({_overlap(_TRUE_STEPS, _GEN_STEPS)}, 6) ELSE 0.0 END AS operation_match,
      CASE WHEN len({_TRUE_STEPS}) > 0 AND len({_GEN_STEPS}) > 0
      THEN array_to_string(list_sort(list_filter({_TRUE_STEPS}, lambda x: NOT list_contains({_GEN_STEPS}, x))), '|') END AS only_in_true
      FROM pairs""", _PAIRS))
def w9(spark, sf):
    pairs = w.truth_join(query_log(spark, sf), truth_runs(spark, sf))
    plans = compare_plans(F.col("execution_plan_true"), F.col("execution_plan"), with_sequence=False)
    return rounded(pairs.select(
        "id", plans["operation_match"].alias("operation_match"), joined(plans["only_in_true"]).alias("only_in_true")),
        "operation_match")


@register("W9_plan_similarity", over_log(
    f"""SELECT id, round(CASE WHEN execution_plan = execution_plan_true THEN 1.0 WHEN execution_plan IS NULL THEN 0.0 ELSE 1 / 3 END, 6)
      AS operation_match, round(CASE WHEN execution_plan = execution_plan_true THEN 1.0 WHEN execution_plan IS NOT NULL THEN 25 / 26 END, 6)
      AS sequence_similarity, round({_PLAN}, 6) AS plan_similarity FROM pairs""", _PAIRS))
def w9_full(spark, sf):
    pairs = w.truth_join(query_log(spark, sf), truth_runs(spark, sf))
    return rounded(w.with_plan_comparison(pairs, "execution_plan_true", "execution_plan", spread=["id"]).select(
        "id", "operation_match", "sequence_similarity", "plan_similarity"),
        "operation_match", "sequence_similarity", "plan_similarity")


# plans of 1 to 7 steps; the second leaves out, changes and swaps some of the first
_STEPS = """concat('[', array_join(transform(sequence(1, 1 + CAST({0} % 7 AS INT)), i -> concat('{{"id": ', i, ', "parent": ', i div 2,
  ', "detail": "', CASE WHEN ({0} * i) % 5 = 0 THEN 'SCAN' WHEN (i + {0}) % 3 = 0 THEN 'SEARCH' ELSE 'SORT' END, ' t', i % 4, '"}}')), ', '), ']')"""


@register("W9_plan_order")
def w9_order(spark, sf):
    """The order of plans of varied lengths, from neighbouring ids of the log."""
    plans = query_log(spark, sf).select("id", F.expr(_STEPS.format("id")).alias("a"), F.expr(_STEPS.format("(id div 3)")).alias("b"))
    return rounded(plans.select("id", plan_order_similarity(F.col("a"), F.col("b")).alias("order_similarity")), "order_similarity")


# the log's errors and some of every other class
_ERROR = """CASE WHEN id % 17 = 0 THEN 'near "FROM": Syntax Error' WHEN id % 19 = 0 THEN 'UNIQUE violated'
  WHEN id % 23 = 0 THEN 'datatype mismatch' WHEN id % 29 = 0 THEN 'misuse of aggregate' WHEN id % 31 = 0
  THEN 'worker process timeout' WHEN id % 37 = 0 THEN 'access denied' WHEN id % 41 = 0 THEN 'SQL syntax' ELSE error END"""


@register("W10_categorise_error", over_log(
    f"SELECT id, {_error_class('e')} AS category FROM (SELECT id, {_ERROR} AS e FROM log)"))
def w10(spark, sf):
    return query_log(spark, sf).selectExpr("id", f"{_ERROR} AS e").select(
        "id", sql.categorise_error(F.col("e")).alias("category"))


@register("W11_result_equivalence", over_log(
    f"""SELECT id, {_equal('results_true', 'results')} AS equal, {_reason('results_true', 'results')} AS reason,
      CASE WHEN {_rows('results_true')} = {_rows('results')} AND {_diff('results_true', 'results')} > 0
      THEN round({_diff('results_true', 'results')} / {_rows('results_true')} * 100, 6) END AS diff_percentage
      FROM pairs""", _PAIRS))
def w11(spark, sf):
    pairs = w.truth_join(query_log(spark, sf), truth_runs(spark, sf))
    cmp = pairs.select("id", res.compare_results(F.col("results_true"), F.col("results")).alias("c"))
    return rounded(cmp.select("id", "c.equal", "c.reason", "c.diff_percentage"), "diff_percentage")


# results of other shapes on both sides; what is no list of rows equals nothing
_SHAPED = """CASE WHEN {0} % 11 = 0 THEN '{{"n": 1}}' WHEN {0} % 7 = 0 THEN '[1, 2]' WHEN {0} % 13 = 0 THEN 'not json'
  WHEN {0} % 5 = 0 THEN '[{{"n": 1}}, 5]' WHEN {0} % 3 = 0 THEN '' WHEN {0} % 2 = 0 THEN '[]' ELSE '[1]' END"""
_N_ENTRIES = """CASE WHEN {0} = '' THEN 0 WHEN {0} IN ('{{"n": 1}}', 'not json') THEN NULL WHEN {0} = '[]' THEN 0 WHEN {0} = '[1]' THEN 1 ELSE 2 END"""


@register("W11_result_shapes", over_log(
    """SELECT id, coalesce(n1 = 0 AND n2 = 0, false) AS equal, CASE WHEN n1 = 0 AND n2 = 0 THEN 'Both results are empty'
      WHEN n1 = 0 THEN 'First result is empty, second has data' WHEN n2 = 0 THEN 'Second result is empty, first has data'
      WHEN n1 <> n2 THEN 'Different number of rows' ELSE 'Not a list of rows' END AS reason,
      CAST(coalesce(n1, 0) AS INT) AS true_rows, CAST(coalesce(n2, 0) AS INT) AS gen_rows """
    f"FROM (SELECT id, {_N_ENTRIES.format('a')} AS n1, {_N_ENTRIES.format('b')} AS n2 FROM "
    f"(SELECT id, {_SHAPED.format('id')} AS a, {_SHAPED.format('(id // 4)')} AS b FROM log))"))
def w11_shapes(spark, sf):
    shaped = query_log(spark, sf).selectExpr("id", f"{_SHAPED.format('id')} AS a", f"{_SHAPED.format('(id div 4)')} AS b")
    return shaped.select("id", res.compare_results(F.col("a"), F.col("b")).alias("c")).select(
        "id", "c.equal", "c.reason", "c.true_rows", "c.gen_rows")


# true rows: lines of an order; generated rows: the same lines, untaxed ones changed, undiscounted first ones left out
@register("W11_result_tables", """WITH t AS (SELECT l_orderkey AS id, concat(l_partkey, '/', l_linenumber) AS row FROM lineitem),
  g AS (SELECT l_orderkey AS id, concat(l_partkey + CAST(l_tax = 0 AS INT), '/', l_linenumber) AS row
        FROM lineitem WHERE l_discount > 0 OR l_linenumber > 1),
  n AS (SELECT id, row, SUM(t) AS t, SUM(g) AS g FROM (SELECT id, row, 1 AS t, 0 AS g FROM t UNION ALL
        SELECT id, row, 0 AS t, 1 AS g FROM g) GROUP BY id, row),
  q AS (SELECT id, CAST(SUM(t) AS BIGINT) AS true_rows, CAST(SUM(g) AS BIGINT) AS gen_rows,
        COUNT(*) FILTER (t = 0 OR g = 0) AS diff_count, MIN(row) FILTER (g = 0) AS example_diff_row FROM n GROUP BY id)
  SELECT *, true_rows = gen_rows AND diff_count = 0 AS equal, CASE
    WHEN true_rows = 0 THEN 'First result is empty, second has data'
    WHEN gen_rows = 0 THEN 'Second result is empty, first has data'
    WHEN true_rows <> gen_rows THEN 'Different number of rows'
    WHEN diff_count = 0 THEN 'Results are identical (same rows, possibly different order)'
    ELSE concat(diff_count, ' rows differ between results') END AS reason FROM q""")
def w11_tables(spark, sf):
    lines = table(
        spark, sf, "lineitem", id="l_orderkey", part="l_partkey", line="l_linenumber", discount="l_discount", tax="l_tax")
    true_rows = lines.select("id", concat_all(F.col("part"), "/", F.col("line")).alias("row"))
    changed = F.col("part") + (F.col("tax") == 0).cast("int")
    gen_rows = lines.where("discount > 0 OR line > 1").select(
        "id", concat_all(changed, "/", F.col("line")).alias("row"))
    return w.compare_result_tables(true_rows, gen_rows, "id", "row")


# results as tables: lines of the order that has the id; the first model changes untaxed lines, the second leaves out first ones
# and gives the others twice, the third gives all
_GEN_ROWS = """CASE i WHEN 0 THEN [concat(part + CAST(tax = 0 AS INT), '/', line)] WHEN 1 THEN
  CASE WHEN line > 1 THEN [concat(part, '/', line), concat(part, '/', line)] ELSE CAST([] AS VARCHAR[]) END ELSE [concat(part, '/', line)] END"""
_TABLE_RUN = f"""answers_run AS (SELECT id, model_name, true_query, generated_sql, i <> 2 OR id % 4 > 0 AS success FROM (
    SELECT *, concat('m', i) AS model_name FROM (SELECT id, true_query, generated_sql, unnest([0, 1, 2]) AS i FROM log))),
  lines AS (SELECT l_orderkey AS id, l_partkey AS part, l_linenumber AS line, l_tax AS tax FROM lineitem),
  tr AS (SELECT id, concat(part, '/', line) AS row FROM lines),
  gr AS (SELECT id, concat('m', i) AS model_name, unnest({_GEN_ROWS}) AS row FROM lines, (SELECT unnest([0, 1, 2]) AS i)),
  tn AS (SELECT id, COUNT(*) AS n FROM tr GROUP BY id), gn AS (SELECT id, model_name, COUNT(*) AS n FROM gr GROUP BY ALL),
  sides AS (SELECT id, model_name, row, MAX(t) AS t, MAX(g) AS g FROM (SELECT tr.id, a.model_name, tr.row, 1 AS t, 0 AS g FROM tr
    JOIN answers_run a USING (id) UNION ALL SELECT id, model_name, row, 0, 1 FROM gr) GROUP BY ALL),
  apart AS (SELECT id, model_name, COUNT(*) AS n, MIN(row) FILTER (t = 1) AS example FROM sides WHERE t <> g GROUP BY ALL),
  run AS (SELECT a.*, coalesce(tn.n, 0) AS true_n, coalesce(gn.n, 0) AS gen_n, coalesce(apart.n, 0) AS apart_n, apart.example FROM answers_run a
    LEFT JOIN tn USING (id) LEFT JOIN gn USING (id, model_name) LEFT JOIN apart USING (id, model_name))"""


@register("W15_compare_result_tables", over_log(
    f"""SELECT id, model_name, CASE WHEN success THEN CAST(true_n = gen_n AND apart_n = 0 AS INT) ELSE 0 END AS results_match,
      CASE WHEN NOT success THEN 'Generated query failed to execute' WHEN true_n = 0 AND gen_n = 0 THEN 'Both results are empty'
        WHEN true_n = 0 THEN 'First result is empty, second has data' WHEN gen_n = 0 THEN 'Second result is empty, first has data'
        WHEN true_n <> gen_n THEN 'Different number of rows' WHEN apart_n = 0 THEN 'Results are identical (same rows, possibly different order)'
        ELSE concat(apart_n, ' rows differ between results') END AS result_reason,
      true_n AS true_result_rows, gen_n AS gen_result_rows,
      CASE WHEN success AND true_n = gen_n AND apart_n > 0 THEN round(apart_n / true_n * 100, 6) END AS result_diff_percentage,
      CASE WHEN success AND true_n = gen_n AND apart_n > 0 THEN example END AS result_example_diff_row,
      round(0.3 * CASE WHEN success THEN CAST(true_n = gen_n AND apart_n = 0 AS INT) ELSE 0 END
        + 0.2 * ({_overlap(_tables('true_query'), _tables('generated_sql'))}) + 0.2 * ({_overlap(_columns('true_query'), _columns('generated_sql'))}), 6)
      AS composite_score FROM run""", _TABLE_RUN))
def w15_tables(spark, sf):
    """Every id answered by three models, true results once per id; no text of a query or plan is compared."""
    models = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    log = query_log(spark, sf).select("id", "true_query", "generated_sql", models.alias("i")).select(
        "id", "true_query", "generated_sql", F.concat(F.lit("m"), "i").alias("model_name"), F.expr("i <> 2 OR id % 4 > 0").alias("success"),
        F.lit(None).cast("bigint").alias("row_count"), F.lit(None).cast("string").alias("error"))
    lines = table(spark, sf, "lineitem", id="l_orderkey", part="l_partkey", line="l_linenumber", tax="l_tax")
    same = concat_all(F.col("part"), "/", F.col("line"))
    true_rows = lines.select("id", same.alias("row"))
    changed = concat_all(F.col("part") + (F.col("tax") == 0).cast("int"), "/", F.col("line"))
    given = (F.when(F.col("i") == 0, F.array(changed)).when((F.col("i") == 1) & (F.col("line") > 1), F.array(same, same))
             .when(F.col("i") == 2, F.array(same)).otherwise(F.array().cast("array<string>")))
    gen_rows = lines.withColumn("i", models).select("id", F.concat(F.lit("m"), "i").alias("model_name"), F.explode(given).alias("row"))
    scored = compare_queries(log, text_similarity=False, result_tables=(true_rows, gen_rows))
    return rounded(scored.select(
        "id", "model_name", "results_match", "result_reason", "true_result_rows", "gen_result_rows", "result_diff_percentage",
        "result_example_diff_row", "composite_score"), "result_diff_percentage", "composite_score")


@register("W12_outcome_compare", over_log(
    """SELECT id, CAST(success_true = success AS INT) AS execution_success_match,
      CAST(row_count_true = row_count AS INT) AS row_count_match,
      round(CASE WHEN row_count_true > 0 AND row_count > 0 THEN row_count / row_count_true ELSE 0.0 END, 6) AS row_count_ratio,
      round(CASE WHEN execution_time_true > 0 AND execution_time > 0 THEN execution_time / execution_time_true ELSE 0.0 END, 6)
      AS execution_time_ratio FROM pairs""", _PAIRS))
def w12(spark, sf):
    pairs = w.truth_join(query_log(spark, sf), truth_runs(spark, sf))
    c = F.col
    measures = w.outcome_measures(
        c("success_true"), c("success"), c("row_count_true"), c("row_count"), c("execution_time_true"), c("execution_time"))
    out = pairs.select("id", *[m.alias(name) for name, m in measures.items()])
    return rounded(out, "row_count_ratio", "execution_time_ratio")


@register("W13_composite_score", over_log("SELECT id, round(composite_score, 6) AS composite_score FROM scored", *SCORED_SQL))
def w13(spark, sf):
    return rounded(native_scores(spark, sf).select("id", "composite_score"), "composite_score")


@register("W14_truth_join", over_log(
    """SELECT id, question, true_query, generated_sql, success, success_true, row_count, row_count_true, results,
      results_true FROM pairs""", _PAIRS))
def w14(spark, sf):
    return w.truth_join(query_log(spark, sf), truth_runs(spark, sf)).select(
        "id", "question", "true_query", "generated_sql", "success", "success_true", "row_count", "row_count_true",
        "results", "results_true")


@register("W15_compare_queries")
def w15(spark, sf):
    wide = compare_queries(query_log(spark, sf), truth_runs(spark, sf), store=score_store(spark))
    arrays = [f.name for f in wide.schema.fields if f.dataType.typeName() == "array"]
    return wide.withColumns({a: joined(a) for a in arrays})


@register("W15_compare_queries_native", over_log(
    f"""SELECT id, CAST(true_query IS NULL AS INT) AS null_query, success AS gen_success,
      CAST(success_true = success AS INT) AS execution_success_match, {_error_class('error')} AS gen_error_category,
      results_match, both_empty, array_to_string(gt, '|') AS gen_tables, array_to_string(gc, '|') AS gen_columns,
      round(table_access_accuracy, 6) AS table_access_accuracy, round(composite_score, 6) AS composite_score,
      coalesce(generated_sql <> '', false) AS answered FROM scored""", *SCORED_SQL))
def w15_native(spark, sf):
    return rounded(native_scores(spark, sf).select(
        "id", "null_query", "gen_success", "execution_success_match", "gen_error_category", "results_match", "both_empty",
        joined("gen_tables").alias("gen_tables"), joined("gen_columns").alias("gen_columns"), "table_access_accuracy",
        "composite_score", "answered"), "table_access_accuracy", "composite_score")


# --- summaries ------------------------------------------------------------------

_METRICS = """metrics AS (SELECT model_name, COUNT(*) AS total_queries, AVG(CAST(success AS INT)) AS execution_success_rate,
  AVG(results_match) AS result_match_rate, AVG(CAST(success_true = success AS INT)) AS execution_success_match_rate,
  AVG(CAST(row_count_true = row_count AS INT)) AS row_count_match_rate,
  AVG(table_access_accuracy) AS avg_table_access_accuracy, AVG(column_access_accuracy) AS avg_column_access_accuracy,
  AVG(edit_similarity) AS avg_query_similarity, AVG(composite_score) AS avg_composite_score,
  COUNT(*) FILTER (both_empty) AS empty_results_both FROM scored GROUP BY model_name)"""
_RATES = [
    "execution_success_rate", "result_match_rate", "execution_success_match_rate", "row_count_match_rate",
    "avg_table_access_accuracy", "avg_column_access_accuracy", "avg_query_similarity", "avg_composite_score"]


def _metrics(spark, sf, gen="generated_sql"):
    return w.model_metrics(native_scores(spark, sf, gen), ["model_name"])


@register("W16_model_metrics", over_log(
    "SELECT model_name, total_queries, empty_results_both, "
    + ", ".join(f"round({r}, 6) AS {r}" for r in _RATES) + " FROM metrics", *SCORED_SQL, _METRICS))
def w16(spark, sf):
    return rounded(_metrics(spark, sf), *_RATES)


@register("W16_score_models")
def w16_full(spark, sf):
    return score_models(query_log(spark, sf), truth_runs(spark, sf), "model_name", experiment="derived log", store=score_store(spark))


@register("W17_error_distribution", over_log(
    f"SELECT model_name, {_error_class('error')} AS category, COUNT(*) AS n FROM log GROUP BY ALL"))
def w17(spark, sf):
    df = query_log(spark, sf).withColumn("category", sql.categorise_error(F.col("error")))
    return w.error_distribution(df, ["model_name"], "category")


_CLASSES = [*sql.ERROR_CLASSES, "other", "No error"]


@register("W17_error_matrix", over_log(
    "SELECT model_name, " + ", ".join(f"COUNT(*) FILTER (c = '{x}') AS \"{x}\"" for x in _CLASSES)
    + f" FROM (SELECT model_name, {_error_class('e')} AS c FROM (SELECT model_name, {_ERROR} AS e FROM log)) GROUP BY model_name"))
def w17_matrix(spark, sf):
    errors = query_log(spark, sf).selectExpr("model_name", f"{_ERROR} AS e")
    return w.error_matrix(errors.withColumn("category", sql.categorise_error(F.col("e"))), ["model_name"], "category")


_BIN = """CASE WHEN query_complexity <= 0 THEN NULL WHEN query_complexity <= 5 THEN 'Simple' WHEN query_complexity <= 10
  THEN 'Moderate' WHEN query_complexity <= 15 THEN 'Complex' ELSE 'Very Complex' END"""


@register("W18_match_by_complexity", over_log(
    f"""SELECT model_name, {_BIN} AS complexity_bin, round(AVG(results_match), 6) AS match_rate FROM complexity
      WHERE {_BIN} IS NOT NULL GROUP BY ALL""", *SCORED_SQL, *complexity_ctes("scored")))
def w18(spark, sf):
    df = sql_components(native_scores(spark, sf), "true_query")
    return rounded(w.match_by_complexity(df, ["model_name"]), "match_rate")


@register("W19_empty_breakdown", over_log(
    """SELECT model_name, category, round(proportion, 6) AS proportion FROM (UNPIVOT (SELECT model_name,
      AVG(CAST(both_empty AS INT)) AS "Both Empty", AVG(CAST(true_empty_result AND NOT gen_empty_result AS INT)) AS "True Empty Only",
      AVG(CAST(NOT true_empty_result AND gen_empty_result AS INT)) AS "Generated Empty Only",
      AVG(CAST(NOT true_empty_result AND NOT gen_empty_result AND results_match = 1 AS INT)) AS "Correct Non-empty"
      FROM scored GROUP BY model_name) ON COLUMNS(* EXCLUDE model_name) INTO NAME category VALUE proportion)""", *SCORED_SQL))
def w19(spark, sf):
    return rounded(w.empty_breakdown(native_scores(spark, sf), ["model_name"]), "proportion")


@register("W20_unpivot_metrics", over_log(
    """SELECT model_name, replace(replace(metric, 'avg_', ''), '_', ' ') AS metric, round(value, 6) AS value FROM (UNPIVOT
      (SELECT model_name, avg_table_access_accuracy, avg_column_access_accuracy, avg_query_similarity FROM metrics)
      ON COLUMNS(* EXCLUDE model_name) INTO NAME metric VALUE value)""", *SCORED_SQL, _METRICS))
def w20(spark, sf):
    return rounded(w.unpivot_metrics(_metrics(spark, sf), "structural", ["model_name"]), "value")


_STAGES = """stages AS (SELECT 'zeroshot' AS experiment, 1 AS stage_rank, 'Zero-Shot' AS display_stage, * FROM metrics
  UNION ALL SELECT 'schema_aware', 3, 'Schema-Aware', model_name, total_queries, execution_success_rate / 2,
  result_match_rate / 2, execution_success_match_rate, row_count_match_rate, avg_table_access_accuracy,
  avg_column_access_accuracy, avg_query_similarity, avg_composite_score, empty_results_both FROM metrics)"""


def _stages(spark, sf):
    first = _metrics(spark, sf)
    third = first.withColumns({m: F.col(m) / 2 for m in ("execution_success_rate", "result_match_rate")})
    return w.stage_union({"zeroshot": first, "schema_aware": third})


@register("W21_stage_union", over_log(
    """SELECT experiment, stage_rank, display_stage, model_name, total_queries,
      round(execution_success_rate, 6) AS execution_success_rate FROM stages""", *SCORED_SQL, _METRICS, _STAGES))
def w21(spark, sf):
    return rounded(_stages(spark, sf), "execution_success_rate").select(
        "experiment", "stage_rank", "display_stage", "model_name", "total_queries", "execution_success_rate")


@register("W21_stage_lines", over_log(
    """SELECT experiment, stage_rank, display_stage, model_name, CASE metric WHEN 'execution_success_rate' THEN 'Execution Success Rate'
      WHEN 'avg_table_access_accuracy' THEN 'Table Access Accuracy' ELSE 'Composite Score' END AS metric, round(value, 6) AS value
      FROM (UNPIVOT (SELECT experiment, stage_rank, display_stage, model_name, execution_success_rate, avg_table_access_accuracy,
      avg_composite_score FROM stages) ON execution_success_rate, avg_table_access_accuracy, avg_composite_score
      INTO NAME metric VALUE value)""", *SCORED_SQL, _METRICS, _STAGES))
def w21_lines(spark, sf):
    wanted = ("execution_success_rate", "avg_table_access_accuracy", "avg_composite_score")
    return rounded(w.stage_lines(_stages(spark, sf), wanted, "model_name"), "value")


_AVERAGED = [
    "execution_success_rate", "result_match_rate", "avg_table_access_accuracy", "avg_column_access_accuracy",
    "avg_query_similarity", "avg_composite_score"]


@register("W22_stage_averages", over_log(
    "SELECT experiment, " + ", ".join(f"round(AVG({m}), 6) AS {m}" for m in _AVERAGED)
    + " FROM stages GROUP BY experiment", *SCORED_SQL, _METRICS, _STAGES))
def w22(spark, sf):
    return rounded(w.stage_averages(_stages(spark, sf)), *_AVERAGED)


# --- the repair round -----------------------------------------------------------

@register("W23_route_failures", over_log("SELECT id, generated_sql, error FROM log WHERE NOT success"))
def w23(spark, sf):
    return w.route_failures(query_log(spark, sf)).select("id", "generated_sql", "error")


# every id answered by three models, of which some fail on it
_ANSWERS = [
    "id", "question", "true_query", "generated_sql", "concat('m', CAST(i AS STRING)) AS model_name",
    "(id + i) % 3 <> 0 AND (id + i) % 5 <> 0 AS success",
    "CASE WHEN (id + i) % 3 = 0 OR (id + i) % 5 = 0 THEN concat('broken ', CAST(i AS STRING)) END AS error"]
_ROUND = f"answers AS (SELECT {', '.join(_ANSWERS)} FROM (SELECT *, unnest([0, 1, 2]) AS i FROM log))"
# repair answers: most give back the true query, some fail, some are missing
_ANSWER = """CASE WHEN id % 13 = 0 THEN 'ERROR' WHEN id % 17 = 0 THEN 'I cannot'
  ELSE concat(coalesce(true_query, 'select 1'), ' ', model_name, ';') END"""
_FIXES = f"""{_ROUND}, fixes AS (SELECT id, model_name, {_ANSWER} AS fixed_query FROM answers WHERE NOT success AND question NOT LIKE 'list%')"""
_FIXED = """fixed AS (SELECT log.id, log.model_name, CASE WHEN upper(fixed_query) LIKE 'SELECT%' THEN fixed_query ELSE generated_sql END
  AS valid_sql, CAST(coalesce(upper(fixed_query) LIKE 'SELECT%', false) AS INT) AS validated FROM log
  LEFT JOIN fixes USING (id, model_name) WHERE NOT success)""".replace("FROM log", "FROM answers AS log")
_MERGED = """merged AS (SELECT log.id, log.model_name, log.success AS success_before, CASE WHEN fixed.id IS NULL THEN log.success
  ELSE validated = 1 END AS success, CASE WHEN fixed.id IS NULL THEN generated_sql ELSE valid_sql END AS final_query,
  CASE WHEN fixed.id IS NULL THEN error WHEN validated = 1 THEN NULL ELSE 'still broken' END AS error,
  fixed.id IS NOT NULL AS validation_applied FROM answers AS log LEFT JOIN fixed USING (id, model_name))"""


def _answers(spark, sf):
    log = query_log(spark, sf).drop("success", "error", "model_name")
    return log.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).selectExpr(*_ANSWERS)


def _fixes(log):
    return w.route_failures(log).where("question NOT LIKE 'list%'").selectExpr("id", "model_name", f"{_ANSWER} AS fixed_query")


def _rerun(fixed):
    """Outcomes of the repaired SQL: a taken fix runs, anything else fails again."""
    ok = F.col("validated") == 1
    return fixed.withColumns({"success": ok, "error": F.when(~ok, "still broken")})


def _merged(spark, sf):
    log = _answers(spark, sf)
    return repair_round(log, _fixes(log), _rerun)


@register("W24_apply_fix", over_log("SELECT id, model_name, valid_sql, validated FROM fixed", _FIXES, _FIXED))
def w24(spark, sf):
    log = _answers(spark, sf)
    return w.apply_fix(w.route_failures(log), _fixes(log)).select("id", "model_name", "valid_sql", "validated")


@register("W25_merge_back", over_log(
    "SELECT id, model_name, success_before, success, final_query, error, validation_applied FROM merged", _FIXES, _FIXED, _MERGED))
def w25(spark, sf):
    return _merged(spark, sf).select("id", "model_name", "success_before", "success", "final_query", "error", "validation_applied")


@register("W25_merge_stored", over_log(
    "SELECT id, model_name, success_before, success, final_query, error, validation_applied FROM merged", _FIXES, _FIXED, _MERGED))
def w25_stored(spark, sf):
    """The log stored by model and bucket, its repairs merged in place, in two parts and one of them twice."""
    log = _answers(spark, sf)
    stored = StoredLog(work_path(spark, "log"), "model_name", buckets=4)
    stored.write(log)
    repaired = _rerun(w.apply_fix(w.route_failures(log), _fixes(log)))
    for part in ("model_name = 'm0'", "model_name <> 'm0'", "model_name = 'm0'"):
        stored.merge(repaired.where(part))
    return stored.read(spark).select("id", "model_name", "success_before", "success", "final_query", "error", "validation_applied")


@register("W26_phase_rates", over_log(
    """SELECT model_name, COUNT(*) AS total, COUNT(*) FILTER (success_before) AS generated_ok,
      round(COUNT(*) FILTER (success_before) / COUNT(*), 6) AS generation_rate, COUNT(*) FILTER (NOT success_before) AS routed,
      COUNT(*) FILTER (validation_applied AND success) AS repaired_ok,
      round(COUNT(*) FILTER (validation_applied AND success) / COUNT(*) FILTER (NOT success_before), 6) AS repair_rate,
      COUNT(*) FILTER (success) AS final_ok, round(COUNT(*) FILTER (success) / COUNT(*), 6) AS final_rate
      FROM merged GROUP BY model_name""", _FIXES, _FIXED, _MERGED))
def w26(spark, sf):
    return rounded(w.phase_rates(_merged(spark, sf), ["model_name"]), "generation_rate", "repair_rate", "final_rate")


@register("W27_attach_truth_result", over_log(
    "SELECT log.id, log.generated_sql, truth.results AS true_result FROM log LEFT JOIN truth USING (id) WHERE truth.id IS NOT NULL"))
def w27(spark, sf):
    return w.attach_truth_result(
        query_log(spark, sf), truth_runs(spark, sf), "results").select("id", "generated_sql", "true_result")


@register("W28_run_statements", """SELECT c_mktsegment AS id, c_mktsegment NOT IN ('BUILDING', 'FURNITURE') AS success,
  CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY') THEN 0 ELSE COUNT(DISTINCT o_orderpriority) END AS row_count,
  c_mktsegment IN ('BUILDING', 'FURNITURE') AS failed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def w28(spark, sf):
    """One statement per segment over the order tables, one broken, one empty, one missing."""
    folder = sf.rstrip("/")
    segments = table(spark, sf, "customer").select("c_mktsegment").distinct()
    good = F.concat(
        F.lit(f"SELECT o_orderpriority, COUNT(*) AS n, SUM(o_totalprice) AS total FROM parquet.`{folder}/orders.parquet` "
              f"JOIN parquet.`{folder}/customer.parquet` ON o_custkey = c_custkey WHERE c_mktsegment = '"),
        "c_mktsegment", F.lit("' GROUP BY o_orderpriority"))
    text = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.replace(good, F.lit("COUNT(*)"), F.lit("COUNT(no_column)")))
        .when(F.col("c_mktsegment") == "FURNITURE", "").when(F.col("c_mktsegment") != "MACHINERY", good))
    statements = segments.select(F.col("c_mktsegment").alias("id"), text.alias("true_query"))
    outcomes, _ = run_statements(statements, work_path(spark, "statements"), time_limit=600.0)
    return outcomes.select("id", "success", "row_count", F.col("error").isNotNull().alias("failed"))

