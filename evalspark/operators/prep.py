"""Training rows and prompts (family P).  Calling a model is left to the user.

Every text is made from a template with names in braces, which is an argument; those below are defaults.  ``database`` is
the name the texts use for the database at hand.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import concat_all, strip
from .catalogue import schema_summary
from .groups import question_key, split_components, sql_form, with_component

# fixed values: the turns of a chat text
TURN_OPEN, TURN_CLOSE = "<|im_start|>{role}\n", "<|im_end|>"
# what clean_query reads as a refusal
NO_ANSWER = "No Answer query"

REFUSAL = "There is no query for this: the database does not hold what is asked for, or the question wants medical advice."
NOTES = (
    "Some questions have no query, since they want medical advice or ask for what is not stored. Then say so, with the "
    "reason in one sentence."
)
# fixed values: tables of the clinical store that are often joined, and the columns that join them
COMMON_JOINS = (
    ("patients", "admissions", ("subject_id",)),
    ("admissions", "icustays", ("hadm_id", "subject_id")),
    ("icustays", "chartevents", ("stay_id",)),
    ("chartevents", "d_items", ("itemid",)),
    ("labevents", "d_labitems", ("itemid",)),
    ("diagnoses_icd", "d_icd_diagnoses", ("icd_code",)),
    ("procedures_icd", "d_icd_procedures", ("icd_code",)),
)
CHAT_SYSTEM = "Answer questions about the {database} database with one SQL query each.\n\n{schema}"
REPAIR_SYSTEM = "Repair SQL queries that failed."
REPAIR_USER = (
    "This query over the {database} database failed. Correct it, with an eye on its joins and filters.\n\n{schema}\n\n"
    "Question: {question}\nQuery: {query}\n{error}Correct query: "
)
ZERO_SHOT = "Write the SQL query that answers the question, in square brackets.\n\nQuestion: {question}\nQuery:"
FEW_SHOT = (
    "Write the SQL query that answers the last question, in square brackets; if there is none, write [{no_answer}].\n\n"
    "{examples}Question: {question}\nQuery:"
)
FEW_SHOT_EXAMPLE = "Question: {question}\nQuery: [{sql}]\n\n"
SCHEMA_AWARE = (
    "Write the SQL query that answers the question over the tables below, in square brackets; if there is none, write [{no_answer}].\n\n"
    "{schema}\n\nQuestion: {question}\nQuery:"
)
ZERO_SHOT_REPAIR = (
    "This query over the {database} database failed. Write a correct one.\n\nQuestion: {question}\nQuery: {query}\n{error}Correct query: "
)
FEW_SHOT_REPAIR = (
    "Write correct queries over the {database} database for those that failed, like these.\n\n{examples}"
    "Question: {question}\nQuery: {query}\n{error}{empty}Correct query: "
)
FEW_SHOT_REPAIR_EXAMPLE = "({number}) Question: {question}\nQuery: {original_sql}\n{error}Correct query: {fixed_sql}\n\n"
SCHEMA_AWARE_REPAIR = REPAIR_USER
ERROR_LINE = "Error: {error}\n"
EMPTY_LINE = "It ran, but gave no rows.\n"

_NAME = re.compile(r"\{(\w+)\}")


def rendered(template: str, **values: Column | str) -> Column:
    """The template as text, each name in braces replaced by a column or literal; a NULL reads as empty."""
    parts = _NAME.split(template)  # text and names in turn
    return concat_all(*[values[p] if i % 2 else p for i, p in enumerate(parts) if i % 2 or p])


def filled(template: str, **values) -> str:
    """The same for plain values."""
    return _NAME.sub(lambda m: str(values[m[1]]), template)


def schema_text(catalogue: DataFrame, joins: tuple = COMMON_JOINS, notes: str = NOTES) -> str:
    """The schema paragraph of the prompts: one line per table, then one per usual join, as text for a literal.

    Reads one line per table to the driver; a catalogue is metadata, not data.
    """
    summary = schema_summary(catalogue).orderBy("table_position", "table")
    lines = [r["line"] for r in summary.select("line").collect()]
    usual = [f"- {a} and {b} by {', '.join(columns)}" for a, b, columns in joins]
    return "\n".join(["Tables:", *lines, "", "Usual joins:", *usual, "", notes])


def _chat(system: Column | str, user: Column | str, assistant: Column | str) -> Column:
    turns = (("system", system), ("user", user), ("assistant", assistant))
    parts = []
    for i, (role, body) in enumerate(turns):
        parts += [("\n" if i else "") + filled(TURN_OPEN, role=role), body, TURN_CLOSE]
    return concat_all(*parts)


def chat_rows(
    df: DataFrame, schema: str, database: str = "clinical", question: str = "question", query: str = "true_query",
    system: str = CHAT_SYSTEM, refusal: str = REFUSAL,
) -> DataFrame:
    """Question and SQL (or a refusal) as one chat text."""
    blank = F.col(query).isNull() | (strip(F.col(query)) == "")
    answer = F.when(blank, refusal).otherwise(F.col(query))
    return df.withColumn("text", _chat(rendered(system, database=database, schema=schema), F.col(question), answer))


def repair_examples(df: DataFrame, gen: str = "generated_sql", query: str = "true_query") -> DataFrame:
    """Failed rows that have a question, generated SQL, a true query and an error."""
    usable = (
        F.col("question").isNotNull() & F.col(gen).isNotNull() & F.col("error").isNotNull()
        & (strip(F.coalesce(query, F.lit(""))) != "") & ~F.coalesce("success", F.lit(False))
    )
    return df.where(usable).select(
        "id", "question", F.col(gen).alias("original_query"), F.col("error").alias("error_info"),
        F.col(query).alias("fixed_query"),
    )


def _error(column: str, line: str) -> Column:
    """The error line, only where there is an error."""
    return F.when(F.col(column) != "", rendered(line, error=F.col(column)))


def repair_chat_rows(
    examples: DataFrame, schema: str, database: str = "clinical", system: str = REPAIR_SYSTEM, user: str = REPAIR_USER,
    error_line: str = ERROR_LINE,
) -> DataFrame:
    """Repair examples as chat texts; the error line only where there is an error."""
    asked = rendered(
        user, database=database, schema=schema, question=F.col("question"), query=F.col("original_query"),
        error=_error("error_info", error_line))
    return examples.withColumn("text", _chat(system, asked, F.col("fixed_query")))


def split(df: DataFrame, key: str = "id", share: float = 0.1, seed: int = 42, draw: Column | None = None) -> DataFrame:
    """Tag rows ``train`` or ``validation`` by a seeded hash of their id, whatever the partitioning.

    ``draw`` replaces the hash by another whole number, e.g. one another engine can repeat.
    """
    draw = F.xxhash64(F.col(key), F.lit(seed)) if draw is None else draw
    slot = F.pmod(draw, F.lit(10_000))
    return df.withColumn("part", F.when(slot < int(share * 10_000), "validation").otherwise("train"))


def split_without_leaks(
    df: DataFrame, share: float = 0.1, seed: int = 42, question: str = "question", query: str = "true_query", forms: bool = True,
) -> DataFrame:
    """P4 without leaks: ``component`` and ``part``, so that no question and no query of one side is found on the other.

    Questions are equal without case, punctuation and spacing; queries without case, spacing and, with ``forms``, the
    values of their literals.  What is joined over any number of such steps goes to one side.
    """
    keys = [question_key(F.col(question)), sql_form(F.col(query)) if forms else question_key(F.col(query))]
    return split_components(with_component(df, keys), share, seed)


def zero_shot_prompt(question: str = "question", template: str = ZERO_SHOT) -> Column:
    """P5."""
    return rendered(template, question=F.col(question))


def few_shot_prompt(
    examples: list[dict], question: str = "question", template: str = FEW_SHOT, example: str = FEW_SHOT_EXAMPLE,
    no_answer: str = NO_ANSWER,
) -> Column:
    """P5: each example has ``question`` and ``sql``."""
    shown = "".join(filled(example, **e) for e in examples)
    return rendered(template, examples=shown, question=F.col(question), no_answer=no_answer)


def schema_aware_prompt(schema: str, question: str = "question", template: str = SCHEMA_AWARE, no_answer: str = NO_ANSWER) -> Column:
    """P5."""
    return rendered(template, schema=schema, question=F.col(question), no_answer=no_answer)


def _with_query(gen: str, prompt: Column) -> Column:
    """No prompt for a row without generated SQL."""
    return F.when(F.coalesce(F.col(gen), F.lit("")) != "", prompt)


def zero_shot_repair_prompt(
    database: str = "clinical", gen: str = "generated_sql", template: str = ZERO_SHOT_REPAIR, error_line: str = ERROR_LINE,
) -> Column:
    """P6."""
    return _with_query(gen, rendered(
        template, database=database, question=F.col("question"), query=F.col(gen), error=_error("error", error_line)))


def few_shot_repair_prompt(
    examples: list[dict], database: str = "clinical", gen: str = "generated_sql", template: str = FEW_SHOT_REPAIR,
    example: str = FEW_SHOT_REPAIR_EXAMPLE, error_line: str = ERROR_LINE, empty_line: str = EMPTY_LINE,
) -> Column:
    """Each example has ``question``, ``original_sql``, ``error`` and ``fixed_sql``; a row that gave no rows says so."""
    shown = ""
    for i, e in enumerate(examples, 1):
        error = filled(error_line, error=e["error"]) if e.get("error") else ""
        shown += filled(example, **{**e, "number": i, "error": error})
    return _with_query(gen, rendered(
        template, examples=shown, database=database, question=F.col("question"), query=F.col(gen),
        error=_error("error", error_line), empty=F.when(F.col("row_count") == 0, empty_line)))


def schema_aware_repair_prompt(
    schema: str, database: str = "clinical", gen: str = "generated_sql", template: str = SCHEMA_AWARE_REPAIR,
    error_line: str = ERROR_LINE,
) -> Column:
    """P6."""
    return _with_query(gen, rendered(
        template, database=database, schema=schema, question=F.col("question"), query=F.col(gen), error=_error("error", error_line)))
