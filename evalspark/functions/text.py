"""Whitespace-exact text helpers shared by the SQL and question expressions.

The patterns stay in the subset that Java and RE2 read alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space: ASCII blanks, the four separators \x1c-\x1f, NEL and every Z category.
BLANKS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
WS = f"[{BLANKS}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+\\z", "")


def words(text: Column) -> Column:
    """Split on runs of white space; no empty words."""
    # a one-character separator spares compiling a pattern per row
    return F.filter(F.split(F.regexp_replace(text, f"{WS}+", " "), " "), lambda w: w != "")


def count_of(text: Column, piece: str) -> Column:
    """Non-overlapping occurrences of a literal piece."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))
    return (gone / len(piece)).cast("int")


def contains_any(text: Column, pieces) -> Column:
    test = F.lit(False)
    for piece in pieces:
        test = test | F.contains(text, F.lit(piece))
    return test


def found(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def all_groups(text: Column, pattern: str) -> Column:
    """Group 1 of every match."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def concat_all(*parts) -> Column:
    """Concatenate text and columns, reading NULL as empty."""
    return F.concat(*[
        F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts
    ])


def digest(*columns: str) -> Column:
    """A 128-bit hash of the columns as texts; NULL, the empty text and other divisions of the same letters differ."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it.

    Branches of CASE and lambda bodies are outside Spark's own elimination of
    common subexpressions.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
