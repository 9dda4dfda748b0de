"""Text and plan similarity (W8, W9) in Python.

It runs as Arrow UDFs over whole columns.  Identical pairs are common in query
logs (empty answers, a popular question asked of many models), so the operators
in ``workload`` call it on distinct pairs only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .clauses import CLAUSES
from .text import let

_OPENERS = {
    "select": r"SELECT", "from": r"FROM", "where": r"WHERE", "group_by": r"GROUP\s+BY",
    "having": r"HAVING", "order_by": r"ORDER\s+BY", "limit": r"LIMIT",
}


def _clause_patterns() -> dict[str, re.Pattern]:
    """A clause runs to the next later keyword; the SELECT list runs to FROM only."""
    patterns = {}
    for i, clause in enumerate(CLAUSES):
        later = CLAUSES[1:2] if clause == "select" else CLAUSES[max(i + 1, 2):]
        stops = [rf"\s+{_OPENERS[c]}\b" for c in later]
        patterns[clause] = re.compile(
            rf"{_OPENERS[clause]}\s+(.*?)(?:{'|'.join([*stops, '$'])})", re.IGNORECASE | re.DOTALL
        )
    return patterns


_PATTERNS = _clause_patterns()
_SUBQUERY = re.compile(r"\(\s*SELECT", re.IGNORECASE)


def _closing(text: str, start: int) -> int:
    """Position just past the bracket that closes the one at ``start``; -1 if none does."""
    depth, quote = 0, ""
    for hit in re.compile(r"['\"()]").finditer(text, start):
        char = hit.group()
        if char in "'\"":
            if text[hit.start() - 1] == "\\":
                continue
            if not quote:
                quote = char
            elif quote == char:
                quote = ""
        elif not quote:
            depth += 1 if char == "(" else -1
            if depth == 0:
                return hit.end()
    return -1


def split_clauses(query: str | None) -> dict:
    """The seven clauses of the outer query, and its outermost parenthesised sub-selects, of one text.

    Scores of a pair need them beside the ratio; for columns see ``clauses.split_clauses``.  Sub-selects are taken out before the clauses are read, so their keywords do
    not end an outer clause, and put back as ``(SELECT <text>)`` afterwards.
    """
    text = re.sub(r"\s+", " ", (query or "").strip())
    subqueries: list[str] = []
    pieces, done, at = [], 0, 0
    while hit := _SUBQUERY.search(text, at):
        end = _closing(text, hit.start())
        if end < 0:
            at = hit.start() + 1
            continue
        pieces += [text[done:hit.start()], f"(SUBQUERY_{len(subqueries)})"]
        subqueries.append(text[hit.start() + 1:end - 1])
        done = at = end
    outer = "".join([*pieces, text[done:]])
    found = {}
    for clause, pattern in _PATTERNS.items():
        match = pattern.search(outer)
        body = match.group(1).strip() if match else ""
        for i, sub in enumerate(subqueries):
            body = body.replace(f"SUBQUERY_{i}", f"SELECT {sub}")
        found[f"{clause}_clause"] = body
    found["subqueries"] = subqueries
    return found


def text_ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp ratio, as ``difflib.SequenceMatcher`` gives it; two empty texts are equal."""
    a, b = a or "", b or ""
    if a == b:
        return 1.0
    return 2.0 * _matching(a, b) / (len(a) + len(b)) if a and b else 0.0


def _matching(a: str, b: str) -> int:
    """Letters in ``difflib``'s matching blocks, whose longest blocks are found by substring search.

    In a text of 200 letters and more, letters that make up over one in a hundred of it start no block, though a block may grow
    over them: in ``seeds`` they are a letter that ``a`` does not have.
    """
    seeds = b
    if len(b) >= 200:
        limit = len(b) // 100 + 1
        popular = [c for c, n in Counter(b).items() if n > limit]
        if popular:
            used = set(a)
            other = next(c for c in map(chr, range(1, 0xD800)) if c not in used)
            seeds = b.translate({ord(c): other for c in popular})
    found, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, size, at = alo, blo, 0, alo
        while at + size < ahi:  # the first longest block: another must be longer
            hit = seeds.find(a[at:at + size + 1], blo, bhi)
            if hit < 0:
                at += 1
                continue
            i, j, size = at, hit, size + 1
            while i + size < ahi and j + size < bhi and a[i + size] == seeds[j + size]:
                size += 1
        if seeds is not b:
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                size += 1
        if size:
            found += size
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi))
    return found


_POWERS = [1 << n for n in range(12, -1, -1)]


def _without_prefix(pair: Column) -> Column:
    """Texts ``x`` and ``y`` without the letters that both start with, up to some 8,000 of them."""
    x, y = pair["x"], pair["y"]

    def longer(done: Column, step: Column) -> Column:
        fits = done + step <= F.least(F.length(x), F.length(y))
        same = F.substring(x, done + 1, step) == F.substring(y, done + 1, step)
        return F.when(fits, F.when(same, done + step).otherwise(done)).otherwise(done)

    shared = F.aggregate(F.array(*map(F.lit, _POWERS)), F.lit(0), longer)
    return let(shared, lambda n: F.struct(x.substr(n + 1, F.length(x)).alias("x"), y.substr(n + 1, F.length(y)).alias("y")))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance, whose table is filled only for what differs.

    A shared start or end never changes it, and one text inside the other is as far off as they differ in length.
    """
    def distance(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        inside = F.contains(x, y) | F.contains(y, x)
        return F.when(inside, F.abs(F.length(x) - F.length(y))).otherwise(F.levenshtein(x, y))

    first = let(F.struct(a.alias("x"), b.alias("y")), _without_prefix)
    both = let(first, lambda p: F.struct(F.reverse(p["x"]).alias("x"), F.reverse(p["y"]).alias("y")))
    return let(let(both, _without_prefix), distance)


def query_ratios(true: str | None, gen: str | None) -> dict:
    """Ratio of the whole queries and of each clause."""
    if (true or "") == (gen or ""):
        return {"query_similarity": 1.0, **{f"{c}_clause_similarity": 1.0 for c in CLAUSES}}
    left, right = split_clauses(true), split_clauses(gen)
    return {
        "query_similarity": text_ratio(true, gen),
        **{f"{c}_clause_similarity": text_ratio(left[f"{c}_clause"], right[f"{c}_clause"]) for c in CLAUSES},
    }


def _struct_udf(fn: Callable[..., dict], schema: str):
    """Arrow UDF over text columns returning a struct."""
    names = [field.split()[0] for field in schema.split(", ")]

    def rows(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = [s.where(s.notna(), None) for s in batch]
            yield pd.DataFrame([fn(*texts) for texts in zip(*columns)], columns=names)

    def apply(*cols: Column) -> Column:
        if len(cols) == 1:
            def one(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
                yield from rows((s,) for s in batches)
            return F.pandas_udf(one, schema)(*cols)

        def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            yield from rows(batches)
        return F.pandas_udf(many, schema)(*cols)

    return apply


similarities = _struct_udf(
    query_ratios,
    ", ".join(["query_similarity double"] + [f"{c}_clause_similarity double" for c in CLAUSES]),
)


def _list_ratio(a, b) -> float:
    return text_ratio(str(list(a)), str(list(b)))


@F.pandas_udf(DoubleType())
def _detail_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([
        None if x is None or y is None else _list_ratio(x, y) for x, y in zip(a, b)
    ], dtype="float64")


PLAN_STEPS = "array<struct<id: int, parent: int, notused: int, detail: string>>"


def plan_steps(plan_json: Column) -> Column:
    """Detail texts of a plan given as a JSON list of steps."""
    steps = F.from_json(plan_json, PLAN_STEPS)
    return F.filter(F.transform(steps, lambda s: s["detail"]), lambda d: d.isNotNull())


def ordered_steps(plan_json: Column) -> Column:
    """(level, detail) of a plan's steps in the order of its tree: by id, which counts from the root down, each below its parent.

    The level is the length of the chain of parents that are steps of the plan; a step that names itself or a later one has none.
    """
    steps = F.sort_array(F.filter(F.from_json(plan_json, PLAN_STEPS), lambda s: s["detail"].isNotNull()))
    levels = "array<struct<id: int, level: int, detail: string>>"

    def place(done: Column, s: Column) -> Column:
        above = F.filter(done, lambda d: d["id"] == s["parent"])
        level = F.when(F.size(above) > 0, F.element_at(above, -1)["level"] + 1).otherwise(0)
        return F.concat(done, F.array(F.struct(s["id"].alias("id"), level.alias("level"), s["detail"].alias("detail"))))

    placed = F.aggregate(steps, F.array().cast(levels), place)
    return F.transform(placed, lambda s: F.concat_ws(" ", s["level"].cast("string"), s["detail"]))


def common_order(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, by one row of the dynamic program after the other."""
    zeros = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def next_row(row: Column, x: Column) -> Column:
        def cell(acc: Column, i: Column) -> Column:
            best = F.when(F.get(b, i) == x, F.get(row, i) + 1).otherwise(F.greatest(F.get(row, i + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(best))

        places = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.array(F.lit(0)), cell)

    return F.aggregate(a, zeros, next_row, lambda row: F.element_at(row, -1))


def plan_order_similarity(true_plan: Column, gen_plan: Column) -> Column:
    """How much of two plans comes in the same order and on the same levels: twice the longest common run of steps, gaps allowed, over all steps.

    Steps count as wholes, letters are not compared.  NULL when neither side has a plan, 0 when only one has; two plans without
    steps are alike.  JVM only.
    """
    def ratio(x: Column) -> Column:
        every = F.size(x["a"]) + F.size(x["b"])
        return F.when(every == 0, 1.0).otherwise(2.0 * common_order(x["a"], x["b"]) / every)

    neither = true_plan.isNull() & gen_plan.isNull()
    both = let(F.struct(ordered_steps(true_plan).alias("a"), ordered_steps(gen_plan).alias("b")), lambda x: F.when(
        x["a"].isNotNull() & x["b"].isNotNull(), ratio(x)))
    return F.coalesce(both, F.when(~neither, 0.0))


def compare_plans(true_plan: Column, gen_plan: Column, with_sequence: bool = True) -> dict[str, Column]:
    """Overlap of two plans given as JSON; NULL when neither side has one, 0 when only one has.

    A plan without steps is a plan: two of them share no operation and are equal as sequences.

    ``with_sequence=False`` leaves out the order-sensitive ratio (and the Python step it needs).
    """
    first, second = plan_steps(true_plan), plan_steps(gen_plan)
    neither = true_plan.isNull() & gen_plan.isNull()
    missing = first.isNull() | second.isNull()
    every = F.size(F.array_union(first, second))
    share = F.when(every == 0, 0.0).otherwise(F.size(F.array_intersect(first, second)) / F.greatest(every, F.lit(1)))
    match = F.when(~missing, share).when(~neither, 0.0)
    out = {
        "operation_match": match,
        "common_operations": F.when(~missing, F.sort_array(F.array_intersect(first, second))),
        "only_in_true": F.when(~missing, F.sort_array(F.array_except(first, second))),
        "only_in_generated": F.when(~missing, F.sort_array(F.array_except(second, first))),
    }
    if with_sequence:
        sequence = _detail_ratio(first, second)
        out["sequence_similarity"] = F.when(~missing, sequence)
        out["plan_similarity"] = F.when(~missing, (match + sequence) / 2).when(~neither, 0.0)
    return out
