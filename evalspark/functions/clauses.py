"""The clauses and sub-selects of a query, in native expressions.

A bracket that opens a sub-select is closed by the first bracket after it that brings the depth back to zero, brackets in quotes
apart.  Quotes are counted from that bracket on, so one that is open before it does not hide it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, let, strip

CLAUSES = ("select", "from", "where", "group_by", "having", "order_by", "limit")
_OPENS = r"(?iu)\( ?SELECT"
_TOKEN = r"""(?<!\\)['"]|[()]"""


def _spaced(query: Column) -> Column:
    """The text without outer white space, every other run of it as one blank."""
    return F.regexp_replace(strip(F.coalesce(query, F.lit(""))), f"{WS}+", " ")


def _places(text: Column, pattern: str) -> Column:
    """(at, token) for every match: its position, from 0, and its letters.  Gaps between matches give the positions."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,token:string>>").alias("found"))

    def step(acc: Column, hit: Column) -> Column:
        at = acc["end"] + hit["gap"]
        return F.struct((at + F.length(hit["token"])).alias("end"), F.concat(
            acc["found"], F.array(F.struct(at.alias("at"), hit["token"].alias("token")))).alias("found"))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("token")), lambda p: p["token"].isNotNull())
    return F.aggregate(pairs, start, step, lambda acc: acc["found"])


def _closing(tokens: Column, at: Column) -> Column:
    """The position after the bracket that closes the one at ``at``; -1 if none does."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit(-1).alias("end"))

    def step(acc: Column, token: Column) -> Column:
        char, done = token["token"], acc["end"] >= 0
        mark = char.isin("'", '"')
        quote = (F.when(~mark, acc["quote"]).when(acc["quote"] == "", char).when(acc["quote"] == char, "").otherwise(acc["quote"]))
        plain = ~mark & (acc["quote"] == "")
        depth = acc["depth"] + F.when(~plain, 0).when(char == "(", 1).otherwise(-1)
        return F.struct(
            depth.alias("depth"), quote.alias("quote"),
            F.when(done, acc["end"]).when(plain & (depth == 0), token["at"] + 1).otherwise(-1).alias("end"))

    return F.aggregate(F.filter(tokens, lambda t: t["at"] >= at), start, step, lambda acc: acc["end"])


def _subselects(text: Column) -> Column:
    """(at, end) of every bracket that opens a sub-select and is closed, in order."""
    def spans(tokens: Column) -> Column:
        found = F.transform(_places(text, _OPENS), lambda h: F.struct(h["at"].alias("at"), _closing(tokens, h["at"]).alias("end")))
        return F.filter(found, lambda s: s["end"] >= 0)

    return F.when(F.regexp_like(text, F.lit(_OPENS)), let(_places(text, _TOKEN), spans)).otherwise(
        F.array().cast("array<struct<at:int,end:int>>"))


def _between(text: Column, at: Column, end: Column) -> Column:
    return text.substr(at + 1, end - at)


def _outer(x: Column) -> Column:
    """The text with its outermost sub-selects as (SUBQUERY_n), and those sub-selects without their brackets."""
    text = x["text"]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("outer"), F.array().cast("array<string>").alias("subqueries"))

    def step(acc: Column, s: Column) -> Column:
        name = F.concat(F.lit("(SUBQUERY_"), F.size(acc["subqueries"]).cast("string"), F.lit(")"))
        taken = F.struct(
            s["end"].alias("at"), F.concat(acc["outer"], _between(text, acc["at"], s["at"]), name).alias("outer"),
            F.concat(acc["subqueries"], F.array(_between(text, s["at"] + 1, s["end"] - 1))).alias("subqueries"))
        return F.when(s["at"] >= acc["at"], taken).otherwise(acc)

    return F.aggregate(x["spans"], start, step, lambda acc: F.struct(
        F.concat(acc["outer"], _between(text, acc["at"], F.length(text))).alias("outer"), acc["subqueries"].alias("subqueries")))


def _clause_pattern(clause: str) -> str:
    """A clause runs to the next later keyword; the SELECT list runs to FROM only."""
    i = CLAUSES.index(clause)
    later = CLAUSES[1:2] if clause == "select" else CLAUSES[max(i + 1, 2):]
    stops = [rf" {name.replace('_', ' ').upper()}\b" for name in later]
    return rf"(?iusU){clause.replace('_', ' ').upper()} (.*?)(?:{'|'.join([*stops, chr(92) + 'z'])})"


def split_clauses(query: Column) -> Column:
    """Struct of the seven clauses of the outer query, and its outermost sub-selects.

    Sub-selects are taken out before the clauses are read, so their keywords do
    not end an outer clause, and put back as ``(SELECT <text>)`` afterwards.  A NULL query has empty clauses.
    """
    def put_back(body: Column, subqueries: Column) -> Column:
        numbers = F.when(F.size(subqueries) > 0, F.sequence(F.lit(0), F.size(subqueries) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(numbers, body, lambda acc, i: F.replace(
            acc, F.concat(F.lit("SUBQUERY_"), i.cast("string")), F.concat(F.lit("SELECT "), F.get(subqueries, i))))

    def clauses(o: Column) -> Column:
        found = {c: F.trim(F.regexp_extract(o["outer"], _clause_pattern(c), 1)) for c in CLAUSES}
        return F.struct(*[put_back(body, o["subqueries"]).alias(f"{c}_clause") for c, body in found.items()], o["subqueries"].alias("subqueries"))

    spans = let(_spaced(query), lambda text: F.struct(text.alias("text"), _subselects(text).alias("spans")))
    return let(let(spans, _outer), clauses)


def subselect_tree(query: Column) -> Column:
    """Array of (id, parent, depth, text): every sub-select at any depth, in the order in which they open.

    ``parent`` is the id of the innermost sub-select around it, NULL in the outer query; ``depth`` counts from 1; ``text`` is what
    stands between the brackets.
    """
    def tree(x: Column) -> Column:
        text, spans = x["text"], x["spans"]

        def node(s: Column, i: Column) -> Column:
            around = F.filter(spans, lambda p: (p["at"] < s["at"]) & (s["end"] <= p["end"]))
            parent = F.when(F.size(around) > 0, F.array_position(spans, F.element_at(around, -1)).cast("int") - 1)
            return F.struct(i.alias("id"), parent.alias("parent"), (F.size(around) + 1).alias("depth"),
                            _between(text, s["at"] + 1, s["end"] - 1).alias("text"))

        return F.transform(spans, node)

    return let(let(_spaced(query), lambda text: F.struct(text.alias("text"), _subselects(text).alias("spans"))), tree)
