"""W4, W5 by scope: which table a dotted name of a query means, in native expressions.

Every sub-select is a scope of its own.  Its FROM clause names tables and aliases; a name that it does not know is looked up in the scopes around
it, from the inside out, so an inner alias hides an outer one.  An aliased table is known by its alias alone.  The published sets of names
(``sqltext.table_refs``, ``column_refs``) stay what is scored; these tell what they mean.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clauses import _between, _spaced, _subselects
from .text import let

DERIVED = "(subquery)"  # the table that an alias of a sub-select stands for
_HOLE = "(#)"
_NAME = "[a-zA-Z_][a-zA-Z0-9_]*"
_NO_ALIAS = ("on", "using", "inner", "left", "right", "full", "cross", "natural", "outer", "join", "union", "set")
_FROM = r"(?is)\bFROM (.*?)(?:\bWHERE\b|\bGROUP BY\b|\bHAVING\b|\bORDER BY\b|\bLIMIT\b|\bUNION\b|\z)"
_ITEM = rf"^ ?({_NAME}|\(#\))(?: (?:[aA][sS] )?({_NAME}))?"


def _own_text(text: Column, start: Column, end: Column, inner: Column) -> Column:
    """The text of a scope with the sub-selects in it as holes and without string literals."""
    first = F.struct(start.alias("at"), F.lit("").alias("out"))
    filled = F.aggregate(
        inner, first,
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], _between(text, acc["at"], s["at"]), F.lit(_HOLE)).alias("out")),
        lambda acc: F.concat(acc["out"], _between(text, acc["at"], end)))
    return F.regexp_replace(filled, "'[^']*'", "''")


def _aliases(scope: Column) -> Column:
    """(alias, table) of the FROM clauses of a scope, in lower case."""
    # brackets other than holes hold conditions, whose commas part no tables
    tables = F.concat_ws(",", F.regexp_extract_all(scope, F.lit(_FROM), F.lit(1)))
    for _ in range(3):
        tables = F.regexp_replace(tables, r"\((?!#\))(?:[^()]|\(#\))*\)", "")
    items = F.split(tables, r"(?i),|\bJOIN\b")

    def entry(item: Column) -> Column:
        name, alias = F.lower(F.regexp_extract(item, _ITEM, 1)), F.lower(F.regexp_extract(item, _ITEM, 2))
        table = F.when(name == _HOLE, DERIVED).otherwise(name)
        own = F.when((alias != "") & ~alias.isin(*_NO_ALIAS), alias).when(name != _HOLE, name)
        return F.struct(own.alias("alias"), table.alias("table"))

    return F.filter(F.transform(items, entry), lambda e: (e["alias"] != "") & e["alias"].isNotNull())


def resolved_names(query: Column) -> Column:
    """Array of (scope, alias, column, table) for every dotted name of a query, scope by scope in the order in which they open.

    Scope 0 is the outer query.  ``table`` is NULL where no scope knows the alias, and ``(subquery)`` for a derived table.
    Names are in lower case; string literals hold none.
    """
    def spans(x: Column) -> Column:
        """The scopes (at, end), the outer query first."""
        whole = F.struct(F.lit(-1).alias("at"), (F.length(x["text"]) + 1).alias("end"))
        return F.struct(x["text"].alias("text"), F.concat(F.array(whole), x["spans"]).alias("scopes"))

    def read(x: Column) -> Column:
        """Each scope with its own text and aliases."""
        def scope(s: Column) -> Column:
            inside = F.filter(x["scopes"], lambda c: (c["at"] > s["at"]) & (c["end"] < s["end"]))
            direct = F.filter(inside, lambda c: ~F.exists(inside, lambda p: (p["at"] < c["at"]) & (c["end"] < p["end"])))
            own = _own_text(x["text"], s["at"] + 1, s["end"] - 1, direct)
            return let(own, lambda o: F.struct(s["at"].alias("at"), s["end"].alias("end"), o.alias("own"), _aliases(o).alias("known")))

        return F.transform(x["scopes"], scope)

    def names(scopes: Column) -> Column:
        def of_scope(s: Column, i: Column) -> Column:
            around = F.reverse(F.filter(scopes, lambda p: (p["at"] <= s["at"]) & (s["end"] <= p["end"])))
            visible = F.flatten(F.transform(around, lambda p: p["known"]))  # the innermost first
            dotted = F.regexp_extract_all(s["own"], F.lit(rf"(?<![a-zA-Z0-9_.])({_NAME}\.{_NAME})"), F.lit(1))

            def name(d: Column) -> Column:
                alias = F.lower(F.substring_index(d, ".", 1))
                hit = F.get(F.filter(visible, lambda e: e["alias"] == alias), F.lit(0))
                return F.struct(i.alias("scope"), alias.alias("alias"), F.lower(F.substring_index(d, ".", -1)).alias("column"), hit["table"].alias("table"))

            return F.transform(dotted, name)

        return F.flatten(F.transform(scopes, of_scope))

    text = let(_spaced(query), lambda t: F.struct(t.alias("text"), _subselects(t).alias("spans")))
    return let(let(let(text, spans), read), names)
