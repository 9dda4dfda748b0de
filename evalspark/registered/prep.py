"""Family P over the derived query log."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import prep as p
from ..sources.catalogues import catalog_of_tables
from .base import over_log, query_log, register, table

# the schema paragraph of the shipped tables
_TABLES = ("customer", "orders", "lineitem", "part")
_SCHEMA = "\n".join([
    "Tables:",
    *[f"- {t} table: Contains related healthcare data" for t in _TABLES],
    "", "Usual joins:", *[f"- {a} and {b} by {', '.join(columns)}" for a, b, columns in p.COMMON_JOINS], "", p.NOTES])

_EXAMPLES = [
    {"question": "how many orders did customer 7 place", "sql": "SELECT COUNT(*) FROM orders WHERE o_custkey = 7"},
    {"question": "what should i eat", "sql": "No SQL query can answer this."},
]
_REPAIRS = [
    {"question": "how many orders did customer 7 place", "original_sql": "SELECT COUNT(*) FROM order_facts",
     "error": "no such table: order_facts", "fixed_sql": "SELECT COUNT(*) FROM orders WHERE o_custkey = 7;"},
    {"question": "list the priorities", "original_sql": "SELECT priority", "error": "",
     "fixed_sql": "SELECT DISTINCT o_orderpriority FROM orders;"},
]


def _schema(spark, sf):
    return p.schema_text(catalog_of_tables({t: table(spark, sf, t) for t in _TABLES}))


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chat(system: str, user: str, assistant: str) -> str:
    return (
        f"concat({_lit('<|im_start|>system' + chr(10))}, {system}, {_lit('<|im_end|>' + chr(10) + '<|im_start|>user' + chr(10))}, "
        f"{user}, {_lit('<|im_end|>' + chr(10) + '<|im_start|>assistant' + chr(10))}, {assistant}, '<|im_end|>')"
    )


def _sql(template: str, **values: str) -> str:
    """A template as SQL: names in braces are replaced by SQL expressions."""
    parts = re.split(r"\{(\w+)\}", template)
    return "concat(" + ", ".join(values[x] if i % 2 else _lit(x) for i, x in enumerate(parts) if i % 2 or x) + ")"


def _error(column: str) -> str:
    return f"CASE WHEN {column} <> '' THEN {_sql(p.ERROR_LINE, error=column)} ELSE '' END"


@register("P1_chat_rows", over_log("SELECT id, " + _chat(
    _sql(p.CHAT_SYSTEM, database="'clinical'", schema=_lit(_SCHEMA)),
    "question", f"CASE WHEN true_query IS NULL OR trim(true_query) = '' THEN {_lit(p.REFUSAL)} ELSE true_query END")
    + " AS text FROM log"))
def p1(spark, sf):
    return p.chat_rows(query_log(spark, sf), _schema(spark, sf)).select("id", "text")


_USABLE = """examples AS (SELECT id, question, generated_sql AS original_query, error AS error_info, true_query AS fixed_query
  FROM log WHERE NOT success AND question IS NOT NULL AND generated_sql IS NOT NULL AND true_query <> '' AND error IS NOT NULL)"""


@register("P2_repair_examples", over_log("SELECT * FROM examples", _USABLE))
def p2(spark, sf):
    return p.repair_examples(query_log(spark, sf))


@register("P3_repair_chat_rows", over_log("SELECT id, " + _chat(
    _lit(p.REPAIR_SYSTEM),
    _sql(p.REPAIR_USER, database="'clinical'", schema=_lit(_SCHEMA), question="question", query="original_query", error=_error("error_info")),
    "fixed_query") + " AS text FROM examples", _USABLE))
def p3(spark, sf):
    return p.repair_chat_rows(p.repair_examples(query_log(spark, sf)), _schema(spark, sf)).select("id", "text")


@register("P4_split", over_log(
    """SELECT id, question, true_query, CASE WHEN (id * 7919 + 42 * 104729) % 10007 % 10000 < 1000 THEN 'validation' ELSE 'train' END
      AS part FROM log"""))
def p4(spark, sf):
    draw = (F.col("id") * 7919 + 42 * 104729) % 10007
    return p.split(query_log(spark, sf).select("id", "question", "true_query"), draw=draw)


@register("P4_split_by_hash")
def p4_hash(spark, sf):
    return p.split(query_log(spark, sf).select("id", "question", "true_query"))


@register("P4_split_without_leaks")
def p4_leaks(spark, sf):
    """Queries with their literals: the log has few forms, each a large share of the rows."""
    return p.split_without_leaks(query_log(spark, sf).select("id", "question", "true_query"), forms=False)


_SHOWN = "".join(f"Question: {e['question']}\nQuery: [{e['sql']}]\n\n" for e in _EXAMPLES)


@register("P5_generation_prompts", over_log(f"""SELECT id, {_sql(p.ZERO_SHOT, question="question")} AS zero_shot,
  {_sql(p.FEW_SHOT, examples=_lit(_SHOWN), question="question", no_answer=_lit(p.NO_ANSWER))} AS few_shot,
  {_sql(p.SCHEMA_AWARE, schema=_lit(_SCHEMA), question="question", no_answer=_lit(p.NO_ANSWER))} AS schema_aware FROM log"""))
def p5(spark, sf):
    return query_log(spark, sf).select(
        "id", p.zero_shot_prompt().alias("zero_shot"), p.few_shot_prompt(_EXAMPLES).alias("few_shot"),
        p.schema_aware_prompt(_schema(spark, sf)).alias("schema_aware"))


_REPAIRED = "".join(
    f"({i}) Question: {e['question']}\nQuery: {e['original_sql']}\n"
    + (f"Error: {e['error']}\n" if e["error"] else "") + f"Correct query: {e['fixed_sql']}\n\n"
    for i, e in enumerate(_REPAIRS, 1))
_FAILED = {"database": "'clinical'", "question": "question", "query": "generated_sql", "error": _error("error")}
_EMPTY = f"CASE WHEN row_count = 0 THEN {_lit(p.EMPTY_LINE)} ELSE '' END"


def _maybe(prompt: str) -> str:
    return f"CASE WHEN generated_sql <> '' THEN {prompt} END"


@register("P6_repair_prompts", over_log(f"""SELECT id, {_maybe(_sql(p.ZERO_SHOT_REPAIR, **_FAILED))} AS zero_shot,
  {_maybe(_sql(p.FEW_SHOT_REPAIR, examples=_lit(_REPAIRED), empty=_EMPTY, **_FAILED))} AS few_shot,
  {_maybe(_sql(p.SCHEMA_AWARE_REPAIR, schema=_lit(_SCHEMA), **_FAILED))} AS schema_aware FROM log WHERE NOT success"""))
def p6(spark, sf):
    failed = query_log(spark, sf).where(~F.col("success"))
    return failed.select(
        "id", p.zero_shot_repair_prompt().alias("zero_shot"), p.few_shot_repair_prompt(_REPAIRS).alias("few_shot"),
        p.schema_aware_repair_prompt(_schema(spark, sf)).alias("schema_aware"))
