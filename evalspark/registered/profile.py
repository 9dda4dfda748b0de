"""Family D over the derived query log, and over conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqltext as sql
from ..operators import profile as p
from .base import over_log, query_log, register, rounded, table

_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_HAS = "CASE WHEN true_query IS NOT NULL THEN 'With SQL' ELSE 'Without SQL' END"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_WS}+'), lambda w: w <> '')"


_FEATURES = f"""features AS (SELECT *, {_HAS} AS has_sql, CAST(length(question) AS INT) AS question_length,
  CAST(len({_words('question')}) AS INT) AS question_word_count,
  CASE WHEN {_words('lower(question)')}[1] IN ({_quoted(p.QUESTION_STARTERS)}) THEN {_words('lower(question)')}[1]
  ELSE 'other' END AS question_type FROM log)"""


def _features(spark, sf):
    return p.question_features(query_log(spark, sf)).withColumn("has_sql", p.has_sql())


@register("D1_null_share", over_log(
    """SELECT COUNT(*) FILTER (true_query IS NULL) AS null_count, COUNT(true_query) AS non_null_count,
      round(COUNT(*) FILTER (true_query IS NULL) * 100 / COUNT(*), 6) AS null_percent,
      round(COUNT(true_query) * 100 / COUNT(*), 6) AS non_null_percent FROM log"""))
def d1(spark, sf):
    return rounded(p.null_share(query_log(spark, sf)), "null_percent", "non_null_percent")


@register("D2_question_features", over_log(
    "SELECT id, question_length, question_word_count, question_type FROM features", _FEATURES))
def d2(spark, sf):
    return _features(spark, sf).select("id", "question_length", "question_word_count", "question_type")


# whole texts of another table, with line breaks and other scripts
@register("D2_question_features_conversations", f"""SELECT conv_id, turn, CAST(length(text) AS INT) AS question_length,
  CAST(len({_words('text')}) AS INT) AS question_word_count, CASE WHEN {_words('lower(text)')}[1] IN
  ({_quoted(p.QUESTION_STARTERS)}) THEN {_words('lower(text)')}[1] ELSE 'other' END AS question_type
  FROM conversations WHERE role = 'user'""")
def d2_conversations(spark, sf):
    asked = table(spark, sf, "conversations").where("role = 'user'")
    return p.question_features(asked, "text").select(
        "conv_id", "turn", "question_length", "question_word_count", "question_type")


@register("D3_length_histogram", over_log(
    """SELECT has_sql, CAST(floor(question_length / 10) * 10 AS BIGINT) AS bin_start, COUNT(*) AS n FROM features
      GROUP BY ALL""", _FEATURES))
def d3(spark, sf):
    return p.length_histogram(_features(spark, sf), ["has_sql"])


@register("D4_word_count_box", over_log(
    """SELECT has_sql, CAST(MIN(question_word_count) AS DOUBLE) AS minimum, quantile_cont(question_word_count, 0.25) AS q1,
      quantile_cont(question_word_count, 0.5) AS median, quantile_cont(question_word_count, 0.75) AS q3,
      CAST(MAX(question_word_count) AS DOUBLE) AS maximum, round(AVG(question_word_count), 6) AS mean FROM features
      GROUP BY has_sql""", _FEATURES))
def d4(spark, sf):
    return rounded(p.five_numbers(_features(spark, sf), ["has_sql"]), "mean")


_STOP_WORDS = [
    "a", "an", "the", "of", "for", "to", "in", "on", "was", "were", "is", "are", "be", "by", "and", "or", "not", "what",
    "when", "which", "who", "why", "how", "did", "do", "does", "has", "have", "i", "than", "most", "should", "more"]


def _frequency(by: str, text: str, source: str) -> str:
    clean = f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]', '', 'g')"
    return f"""SELECT {by}, word, n, CAST(position AS INT) AS position FROM (SELECT *, ROW_NUMBER() OVER
      (PARTITION BY {by} ORDER BY n DESC, word) AS position FROM (SELECT {by}, word, COUNT(*) AS n FROM
      (SELECT {by}, unnest({_words(clean)}) AS word FROM {source}) WHERE word NOT IN ({_quoted(_STOP_WORDS)})
      GROUP BY ALL)) WHERE position <= 15"""


@register("D5_word_frequency", over_log(_frequency("has_sql", "question", "features"), _FEATURES))
def d5(spark, sf):
    log = query_log(spark, sf).withColumn("has_sql", p.has_sql())
    return p.word_frequency(log, ["has_sql"], "question", _STOP_WORDS).withColumn("position", F.col("position").cast("int"))


@register("D5_word_frequency_documents", _frequency("lang", "text", "documents"))
def d5_documents(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "text")
    return p.word_frequency(docs, ["lang"], "text", _STOP_WORDS).withColumn("position", F.col("position").cast("int"))


@register("D6_type_percent", over_log(
    """SELECT has_sql, question_type, round(COUNT(*) * 100 / SUM(COUNT(*)) OVER (PARTITION BY has_sql), 6) AS percentage
      FROM features GROUP BY has_sql, question_type""", _FEATURES))
def d6(spark, sf):
    return rounded(p.type_percent(_features(spark, sf), ["has_sql"]), "percentage")


def _count(piece: str) -> str:
    return f"CAST((length(q) - length(replace(q, '{piece}', ''))) // {len(piece)} AS INT)"


_LISTED = f"regexp_extract(q, 'select{_WS}+([^\\n]*?){_WS}+from', 1)"
_PARTS = f"""{_count('select')} AS select_count, {_count('from')} AS from_count,
  {_count('where')} AS where_count, {_count(' join ')} + {_count(' inner join ')} + {_count(' left join ')}
  + {_count(' right join ')} AS join_count, {_count('group by')} AS group_by_count, {_count('order by')} AS order_by_count,
  {_count('limit')} AS limit_count, {_count('distinct')} AS distinct_count, {_count('(select')} AS subquery_count,
  CAST(len(list_distinct(regexp_extract_all(q, 'from{_WS}+([a-z0-9_]+)', 1)
    || regexp_extract_all(q, 'join{_WS}+([a-z0-9_]+)', 1))) AS INT) AS table_count,
  CAST(len(list_distinct(CASE WHEN contains({_LISTED}, '*') THEN [] ELSE
    regexp_extract_all({_LISTED}, '([a-z0-9_.]+)(?:{_WS}*,|{_WS}*\\z|{_WS}+as)', 1) END
    || regexp_extract_all(q, 'where{_WS}+([a-z0-9_.]+){_WS}*[=<>]', 1))) AS INT) AS column_count"""


def complexity_ctes(source: str) -> tuple[str, str]:
    """Counted parts and weighted score of the true queries of a CTE; no query counts as nothing."""
    counts = f"counts AS (SELECT *, {_PARTS} FROM (SELECT *, lower(coalesce(true_query, '')) AS q FROM {source}))"
    score = " + ".join(f"{n} * CAST({w} AS DOUBLE)" for n, w in sql.COMPLEXITY_WEIGHTS.items())
    return counts, f"complexity AS (SELECT *, {score} AS query_complexity FROM counts)"


_COUNTS, _SCORES = complexity_ctes("(SELECT * FROM log WHERE true_query IS NOT NULL)")
_LEVEL = """CASE WHEN query_complexity < 5 THEN 'Simple' WHEN query_complexity < 10 THEN 'Moderate'
  WHEN query_complexity < 15 THEN 'Complex' ELSE 'Very Complex' END"""


def _components(spark, sf):
    return p.sql_components(query_log(spark, sf).where("true_query IS NOT NULL"))


@register("D7_sql_component_counts", over_log(
    "SELECT id, " + ", ".join(sql.COMPLEXITY_WEIGHTS) + " FROM counts", _COUNTS))
def d7(spark, sf):
    return _components(spark, sf).select("id", *sql.COMPLEXITY_WEIGHTS)


@register("D8_complexity_score", over_log("SELECT id, query_complexity FROM complexity", _COUNTS, _SCORES))
def d8(spark, sf):
    return _components(spark, sf).select("id", "query_complexity")


@register("D9_complexity_level", over_log(
    f"""SELECT {_LEVEL} AS complexity_level, COUNT(*) AS n, CAST(list_position(['Simple', 'Moderate', 'Complex',
      'Very Complex'], {_LEVEL}) AS BIGINT) AS level_rank FROM complexity GROUP BY ALL""", _COUNTS, _SCORES))
def d9(spark, sf):
    return p.complexity_level_counts(_components(spark, sf))


def _describe(value: str) -> str:
    return f"""COUNT({value}) AS count, round(AVG({value}), 6) AS mean, round(stddev_samp({value}), 6) AS std,
      MIN({value}) AS min, quantile_cont({value}, 0.25) AS p25, quantile_cont({value}, 0.5) AS p50,
      quantile_cont({value}, 0.75) AS p75, MAX({value}) AS max"""


@register("D10_describe", over_log(f"SELECT {_describe('query_complexity')} FROM complexity", _COUNTS, _SCORES))
def d10(spark, sf):
    return rounded(p.describe(_components(spark, sf), "query_complexity"), "mean", "std")


@register("D10_describe_orders", f"SELECT o_orderpriority, {_describe('o_totalprice')} FROM orders GROUP BY o_orderpriority"
          .replace("quantile_cont(o_totalprice, 0.25)", "round(quantile_cont(o_totalprice, 0.25), 6)")
          .replace("quantile_cont(o_totalprice, 0.5)", "round(quantile_cont(o_totalprice, 0.5), 6)")
          .replace("quantile_cont(o_totalprice, 0.75)", "round(quantile_cont(o_totalprice, 0.75), 6)"))
def d10_orders(spark, sf):
    return rounded(
        p.describe(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"], wide=True), "mean", "std", "p25", "p50", "p75")


@register("D10_describe_lineitem", f"SELECT l_returnflag, {_describe('l_extendedprice')} FROM lineitem GROUP BY l_returnflag"
          .replace("quantile_cont(l_extendedprice, 0.25)", "round(quantile_cont(l_extendedprice, 0.25), 6)")
          .replace("quantile_cont(l_extendedprice, 0.5)", "round(quantile_cont(l_extendedprice, 0.5), 6)")
          .replace("quantile_cont(l_extendedprice, 0.75)", "round(quantile_cont(l_extendedprice, 0.75), 6)"))
def d10_lineitem(spark, sf):
    return rounded(
        p.describe(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"], wide=True), "mean", "std", "p25", "p50", "p75")


@register("D11_component_means", over_log(
    "SELECT component, round(average, 6) AS average FROM (UNPIVOT (SELECT "
    + ", ".join(f"AVG({c}) AS {c}" for c in p.MEAN_COMPONENTS)
    + " FROM counts) ON COLUMNS(*) INTO NAME component VALUE average)", _COUNTS))
def d11(spark, sf):
    return rounded(p.component_means(_components(spark, sf)), "average")


def _intent(question: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({question}), '{x}')" for x in phrases) + f" THEN '{intent}'"
        for intent, phrases in p.INTENTS.items())
    firsts = " ".join(
        f"WHEN {_words(f'lower({question})')}[1] = '{w}' THEN '{i}'" for w, i in p.FIRST_WORD_INTENTS.items())
    return f"CASE {cases} {firsts} ELSE 'General Query' END"


@register("D12_question_intent", over_log(
    f"SELECT {_intent('question')} AS intent, COUNT(*) AS n FROM log GROUP BY ALL"))
def d12(spark, sf):
    return p.intent_counts(query_log(spark, sf))


@register("D12_question_intent_conversations", f"SELECT conv_id, turn, {_intent('text')} AS intent FROM conversations")
def d12_conversations(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", p.question_intent(F.col("text")).alias("intent"))


# the log's results, and results of other shapes
_SHAPES = """CASE WHEN id % 11 = 0 THEN '{"n": 1}' WHEN id % 13 = 0 THEN '[1, 2]' WHEN id % 17 = 0 THEN 'not json'
  WHEN id % 19 = 0 THEN '[{"Max_price": 3, "b": null}]' WHEN id % 23 = 0 THEN '[{"a": 3, "b": 1}, {"a": 3, "b": 2}]'
  WHEN id % 29 = 0 THEN '[]' ELSE results END"""
_STRUCTURE = f"""shaped AS (SELECT id, CAST(r AS INT) AS result_row_count, CAST(CASE WHEN r = 0 THEN 0 WHEN k IS NULL THEN 1
  ELSE len(k) END AS INT) AS result_column_count, r = 0 AS result_is_empty, coalesce(r > 0 AND
  len(list_filter(k, lambda c: regexp_matches(lower(c), 'count|sum|avg|min|max|distinct'))) > 0, false) AS result_has_aggregation,
  CASE WHEN r = 0 THEN 'empty' WHEN k IS NULL THEN 'non_standard' WHEN r = 1 AND len(k) = 1 THEN 'single_value' WHEN r = 1 THEN 'single_row'
  WHEN len(k) = 1 THEN 'single_column' ELSE 'table' END AS result_type FROM (SELECT id,
  CASE WHEN json_valid(s) AND json_type(s) = 'ARRAY' THEN json_array_length(s) ELSE 0 END AS r,
  CASE WHEN json_valid(s) AND json_type(s, '$[0]') = 'OBJECT' THEN json_keys(s, '$[0]') END AS k
  FROM (SELECT id, {_SHAPES} AS s FROM log)))"""


@register("D13_result_structure", over_log("SELECT * FROM shaped", _STRUCTURE))
def d13(spark, sf):
    shaped = query_log(spark, sf).selectExpr("id", f"{_SHAPES} AS s")
    return p.with_result_structure(shaped, "s").drop("s")


@register("D14_result_type_counts", over_log("SELECT result_type, COUNT(*) AS n FROM shaped GROUP BY ALL", _STRUCTURE))
def d14(spark, sf):
    return p.result_type_counts(query_log(spark, sf).selectExpr("id", f"{_SHAPES} AS s"), "s")


# the order is the seed's; the rows are those of the log
@register("D15_shuffle", over_log("SELECT id, question FROM log"))
def d15(spark, sf):
    return p.shuffled(query_log(spark, sf).select("id", "question"))
