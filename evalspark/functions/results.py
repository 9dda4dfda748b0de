"""Result sets held as JSON lists of row objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import concat_all, contains_any, let

_ROWS = "array<map<string,string>>"
NOT_ROWS = "Not a list of rows"

# fixed values: name pieces that mark an aggregated result column
AGGREGATE_NAMES = ("count", "sum", "avg", "min", "max", "distinct")


def parse_rows(results: Column) -> Column:
    """JSON list of objects as maps; anything else reads as an empty list."""
    return F.coalesce(F.from_json(results, _ROWS), F.array().cast(_ROWS))


def row_number(results: Column) -> Column:
    """Entries of a JSON list; 0 for no text at all, NULL for text that is no list."""
    return F.when(F.coalesce(F.trim(results), F.lit("")) == "", 0).otherwise(F.json_array_length(results))


def row_texts(rows: Column) -> Column:
    """One canonical text per row (entries by name), so rows compare and hash as strings."""
    return F.transform(rows, lambda r: F.to_json(F.sort_array(F.map_entries(r))))


def compare_results(true_results: Column, gen_results: Column) -> Column:
    """Struct(equal, reason, true_rows, gen_rows, diff_count, diff_percentage, example_diff_row).

    Row counts and the columns of the first rows must agree; then rows compare
    as sets of texts, in any order and without regard to repeats.  Text that is
    no list, and lists with entries that are no objects, equal nothing.
    """
    rows = F.struct(
        parse_rows(true_results).alias("a"), parse_rows(gen_results).alias("b"),
        row_number(true_results).alias("n1"), row_number(gen_results).alias("n2"))
    texts = let(rows, lambda r: F.struct(
        r["n1"].alias("n1"), r["n2"].alias("n2"),
        (_objects(r["a"], r["n1"]) & _objects(r["b"], r["n2"])).alias("objects"),
        row_texts(r["a"]).alias("texts1"), row_texts(r["b"]).alias("texts2"),
        _first_columns(r["a"]).alias("cols1"), _first_columns(r["b"]).alias("cols2")))
    parts = let(texts, lambda t: F.struct(
        t["n1"].alias("n1"), t["n2"].alias("n2"), t["objects"].alias("objects"),
        (t["cols1"] == t["cols2"]).alias("same_columns"),
        F.array_except(t["texts1"], t["texts2"]).alias("only1"),
        F.size(F.array_except(t["texts2"], t["texts1"])).alias("n_only2")))
    return let(parts, _verdict)


def _objects(rows: Column, n: Column) -> Column:
    """Whether all entries of a list were read as objects."""
    return F.coalesce((F.size(rows) == n) & ~F.exists(rows, lambda r: r.isNull()), F.lit(False))


def _first_columns(rows: Column) -> Column:
    return F.sort_array(F.map_keys(F.get(rows, F.lit(0))))


def _verdict(p: Column) -> Column:
    n1, n2 = p["n1"], p["n2"]
    diff = F.size(p["only1"]) + p["n_only2"]
    both_empty = (n1 == 0) & (n2 == 0)
    comparable = (n1 > 0) & (n1 == n2) & p["objects"] & p["same_columns"]
    differs = comparable & (diff > 0)
    reason = (
        F.when(both_empty, "Both results are empty")
        .when(n1 == 0, "First result is empty, second has data")
        .when(n2 == 0, "Second result is empty, first has data")
        .when(n1 != n2, "Different number of rows")
        .when(~p["objects"], NOT_ROWS)
        .when(~p["same_columns"], "Different columns")
        .when(diff == 0, "Results are identical (same rows, possibly different order)")
        .otherwise(concat_all(diff, " rows differ between results"))
    )
    return F.struct(
        F.coalesce(both_empty | (comparable & (diff == 0)), F.lit(False)).alias("equal"),
        reason.alias("reason"), F.coalesce(n1, F.lit(0)).alias("true_rows"), F.coalesce(n2, F.lit(0)).alias("gen_rows"),
        F.when(differs, diff).alias("diff_count"),
        F.when(differs, diff / n1 * 100).alias("diff_percentage"),
        F.when(differs, F.get(p["only1"], F.lit(0))).alias("example_diff_row"),
    )


def result_structure(results: Column) -> dict[str, Column]:
    """Shape of one JSON result: rows, columns of the first row, and a result type."""
    rows = F.coalesce(F.json_array_length(results), F.lit(0))
    names = F.json_object_keys(F.get_json_object(results, "$[0]"))
    plain = names.isNotNull()
    columns = F.when(rows == 0, 0).when(plain, F.size(names)).otherwise(1)
    kind = (
        F.when(rows == 0, "empty")
        .when(~plain, "non_standard")
        .when((rows == 1) & (columns == 1), "single_value")
        .when(rows == 1, "single_row")
        .when(columns == 1, "single_column")
        .otherwise("table")
    )
    named = F.exists(names, lambda n: contains_any(F.lower(n), AGGREGATE_NAMES))
    return {
        "row_count": rows,
        "column_count": columns,
        "is_empty": rows == 0,
        "has_aggregation": F.coalesce((rows > 0) & named, F.lit(False)),
        "result_type": kind,
    }
