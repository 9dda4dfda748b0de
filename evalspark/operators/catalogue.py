"""Tables about tables: join paths, key edges, sample values, summaries (family C).

A catalogue is a DataFrame with one row per column: ``table, column, type,
nullable, primary_key, foreign_key, relation, description``; only ``table`` and
``column`` are needed by most operators.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .ranking import first_rows

# fixed values: what a table holds, by the first matching piece of its name
TABLE_KINDS = {
    "patients": "patient demographic information",
    "admissions": "hospital admission records",
    "icustays": "ICU stay information",
    "chart": "patient vital signs and measurements",
    "lab": "laboratory test results",
    "procedures": "procedure records with ICD codes",
    "diagnoses": "diagnosis records with ICD codes",
    "d_icd": "ICD code definitions",
    "d_item": "definitions for chart items",
    "prescription": "medication prescription records",
    "micro": "microbiology test results",
    "cost": "cost information for healthcare events",
}
OTHER_KIND = "related healthcare data"
KEY_COLUMNS = ("subject_id", "hadm_id", "stay_id", "itemid", "icd_code")
NO_VALUES = "<To_Fill>"
SAMPLE_SIZE = 150


@dataclass(frozen=True)
class JoinClasses:
    """Which tables share which columns, without naming pairs of tables.

    Tables with the same columns are one class.  ``members`` has a row (table, class) per table, ``columns`` a row (class, column,
    n_tables) per column of a class; a column that every table has is one row per class, however many pairs it links.
    """

    members: DataFrame
    columns: DataFrame


def join_classes(catalogue: DataFrame) -> JoinClasses:
    """The classes of a catalogue's tables."""
    per_table = catalogue.select("table", "column").distinct().groupBy("table").agg(F.sort_array(F.collect_list("column")).alias("columns"))
    members = per_table.withColumn("class", F.md5(F.to_json("columns")))
    classes = members.groupBy("class").agg(F.any_value("columns").alias("columns"), F.count("*").alias("n_tables"))
    return JoinClasses(members.select("table", "class"), classes.select("class", F.explode("columns").alias("column"), "n_tables"))


def column_links(classes: JoinClasses) -> DataFrame:
    """One row per column that tables share: how many have it, in how many classes, and how many ordered pairs it links."""
    n = F.sum("n_tables")
    shared = classes.columns.groupBy("column").agg(n.alias("n_tables"), F.count("*").alias("n_classes"))
    return shared.where("n_tables > 1").withColumn("links", F.col("n_tables") * (F.col("n_tables") - 1))


def join_paths(classes: JoinClasses, tables: list[str] | None = None) -> DataFrame:
    """(t1, t2, columns) for tables that share columns with one of ``tables`` (default: with any), in each direction.

    Columns are compared class by class; tables are named last, so only the pairs that were asked for are made.
    """
    asked = classes.members if tables is None else classes.members.where(F.col("table").isin(tables))
    ones = asked.select(F.col("class").alias("c1")).distinct()
    twos = classes.columns.select(F.col("class").alias("c2"), "column")
    shared = (
        ones.join(classes.columns.select(F.col("class").alias("c1"), "column"), "c1").join(twos, "column")
        .groupBy("c1", "c2").agg(F.sort_array(F.collect_list("column")).alias("columns")))
    return (
        asked.select(F.col("table").alias("t1"), F.col("class").alias("c1")).join(shared, "c1")
        .join(classes.members.select(F.col("table").alias("t2"), F.col("class").alias("c2")), "c2")
        .where("t1 <> t2").select("t1", "t2", "columns"))


def _singular(table: Column) -> Column:
    return F.regexp_replace(table, "s$", "")


def key_edges(catalogue: DataFrame, singular: bool = False) -> DataFrame:
    """``*_id`` columns two tables share, when named after one of them.

    ``incoming``: the column is called after this table; ``outgoing``: after the
    other.  ``singular`` also accepts the table name without its plural s.  The tables that have a column meet the one or two
    that it is named after, not each other.
    """
    def named_after(table: str) -> Column:
        test = F.col("column") == F.concat(F.col(table), F.lit("_id"))
        return test | (F.col("column") == F.concat(_singular(F.col(table)), F.lit("_id"))) if singular else test

    held = catalogue.where(F.endswith("column", F.lit("_id"))).select("table", "column").distinct().withColumn("owns", named_after("table"))
    owners = held.where("owns").select(F.col("table").alias("owner"), "column")
    met = owners.join(held, "column").where("owner <> table")
    return met.select(F.col("owner").alias("table"), F.col("table").alias("other"), "column", F.lit("incoming").alias("direction")).unionByName(
        met.where("NOT owns").select("table", F.col("owner").alias("other"), "column", F.lit("outgoing").alias("direction")))


def tables_with_column(classes: JoinClasses, column: str) -> DataFrame:
    """Tables that have a column."""
    return classes.members.join(classes.columns.where(F.col("column") == column), "class", "left_semi").select("table")


def joinable_tables(classes: JoinClasses, table: str) -> DataFrame:
    """Tables with a join path from ``table``."""
    return join_paths(classes, [table]).select(F.col("t2").alias("table"))


def join_columns(classes: JoinClasses, t1: str, t2: str) -> DataFrame:
    """Columns that join two tables."""
    both = classes.members.where(F.col("table").isin(t1, t2)).join(classes.columns, "class")
    return both.groupBy("column").agg(F.count("*").alias("_n")).where("_n = 2").select("column")


def column_info(catalogue: DataFrame, table: str, column: str) -> DataFrame:
    """C4: type and description of a column."""
    return catalogue.where((F.col("table") == table) & (F.col("column") == column)).select("type", "description")


def dictionary_info(dictionary: DataFrame, table: str) -> DataFrame:
    """C4: code columns of a table and the dictionaries that explain them."""
    return dictionary.where(F.col("fact_table") == table)


def value_text(df: DataFrame, column: str) -> Column:
    """A value as text; arrays in brackets, their fractions to six places, which every engine writes alike."""
    value, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if not isinstance(kind, ArrayType):
        return value.cast("string")
    element = "decimal(38,6)" if isinstance(kind.elementType, (FloatType, DoubleType)) else "string"
    texts = F.transform(value, lambda x: F.coalesce(x.cast(element).cast("string"), F.lit("NULL")))
    return F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]"))


def _draw(value: str, seed: int) -> str:
    """The order key of a value in a random sample; ``sample_column_values`` states the same in SQL."""
    return hashlib.md5(f"{value}-{seed}".encode()).hexdigest()


def _least_values(columns: list[str], n: int, seed: int | None):
    """Per task, the ``n`` values of each column that come first, each once: a sample that merges with those of other tasks.

    What a batch holds is compared with the last value kept so far, so a long scan looks twice at few values only.
    """
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [pa.array([], pa.string()) for _ in columns]
        drawn: list[list[tuple[str, str]]] = [[] for _ in columns]
        for batch in batches:
            for i in range(len(columns)):
                values = batch.column(i).unique().drop_null()
                if seed is None:
                    if len(kept[i]) == n:
                        values = values.filter(pc.less(values, kept[i][-1]))
                    if len(values):
                        both = pa.concat_arrays([kept[i], values.cast(pa.string())]).unique()
                        kept[i] = both.take(pc.array_sort_indices(both)[:n])
                else:
                    last = drawn[i][-1] if len(drawn[i]) == n else None
                    new = ((_draw(v, seed), v) for v in values.to_pylist())
                    new = [pair for pair in new if last is None or pair < last]
                    if new:
                        drawn[i] = sorted({*drawn[i], *new})[:n]
        for i, column in enumerate(columns):
            values = kept[i] if seed is None else pa.array([v for _, v in drawn[i]], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([column] * len(values), pa.string()), values], names=["column", "value"])

    return least


def sample_column_values(df: DataFrame, table: str, n: int = SAMPLE_SIZE, seed: int | None = None) -> DataFrame:
    """Up to ``n`` distinct non-null values of each column, as text; a placeholder when there are none.

    The ``n`` least by text, or with a seed by md5 of text and seed (a random sample).  Each task keeps ``n`` values of a
    column while it scans and sends no others, so what is shuffled grows with tasks and columns, not with rows or values.
    """
    texts = df.select(*[value_text(df, c).alias(c) for c in df.columns])
    values = texts.mapInArrow(_least_values(df.columns, n, seed), "column string, value string").distinct()
    order = [F.asc("value")] if seed is None else [F.md5(F.concat("value", F.lit(f"-{seed}"))), F.asc("value")]
    best = first_rows(values, ["column"], order, n, rank="position")
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    return names.join(best, "column", "left").select(
        F.lit(table).alias("table"), "column",
        F.coalesce("position", F.lit(1)).alias("position"),
        F.coalesce("value", F.lit(NO_VALUES)).alias("value"),
    )


def sample_tables(tables: dict[str, DataFrame], catalogue: DataFrame | None = None, n: int = SAMPLE_SIZE, seed: int | None = None) -> DataFrame:
    """C5 over a whole store: every column of every table, of those that ``catalogue`` names if it is given."""
    if catalogue is not None:  # metadata: a row per table
        known = {r["table"] for r in catalogue.select("table").distinct().collect()}
        tables = {name: df for name, df in tables.items() if name in known}
    return reduce(DataFrame.unionByName, [sample_column_values(df, name, n, seed) for name, df in tables.items()])


def random_pick(df: DataFrame, by: list[str], value: str, seed: int = 0, exclude: list = (), key: Column | None = None) -> DataFrame:
    """One value per group by a seeded hash, leaving out the excluded ones.

    ``key`` replaces the hash, e.g. by an expression another engine can repeat.
    """
    pool = df.where(~F.col(value).isin(list(exclude))) if exclude else df
    draw = F.xxhash64(F.col(value), F.lit(seed)) if key is None else key
    return pool.groupBy(*by).agg(F.min_by(value, F.struct(draw, F.col(value))).alias(value))


def schema_summary(catalogue: DataFrame) -> DataFrame:
    """What each table holds, by its name, and which of its columns are keys.

    Key columns keep their order in the table where the catalogue has a
    ``position``, else the order of ``KEY_COLUMNS``.
    """
    kind = F.lit(OTHER_KIND)
    for piece, text in reversed(TABLE_KINDS.items()):
        kind = F.when(F.contains("table", F.lit(piece)), text).otherwise(kind)
    known = F.array_position(F.array(*map(F.lit, KEY_COLUMNS)), F.col("column"))
    at = F.col("position") if "position" in catalogue.columns else known
    keys = F.sort_array(F.collect_set(F.when(F.col("column").isin(*KEY_COLUMNS), F.struct(at.alias("at"), "column"))))
    place = F.min("table_position") if "table_position" in catalogue.columns else F.lit(0)
    joined = F.array_join(F.transform("_keys", lambda k: k["column"]), ", ")
    return (
        catalogue.groupBy("table").agg(keys.alias("_keys"), place.alias("table_position"))
        .select("table", "table_position", kind.alias("kind"), joined.alias("key_columns"))
        .withColumn("line", F.concat(
            F.lit("- "), "table", F.lit(" table: Contains "), "kind",
            F.when(F.col("key_columns") != "", F.concat(F.lit(" (key columns: "), "key_columns", F.lit(")")))
            .otherwise("")))
    )
