"""Judging generated SQL: per-row scores and per-model summaries (family W)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import results as res
from ..functions import sqltext as sql
from ..functions.scopes import resolved_names
from ..functions.similarity import compare_plans, edit_distance, similarities
from ..functions.text import digest
from ..session import work_path

# fixed values: share of each measure in the composite score
SCORE_WEIGHTS = {
    "results_match": 0.3,
    "table_access_accuracy": 0.2,
    "column_access_accuracy": 0.2,
    "query_similarity": 0.1,
    "plan_similarity": 0.2,
}

# fixed values: outcome columns a repair run replaces
OUTCOME_COLUMNS = (
    "success", "execution_time", "total_time", "row_count", "error", "results", "result_columns", "execution_plan",
)

# fixed values: measures averaged per model, and the order of prompting stages
MODEL_METRICS = {
    "execution_success_rate": "gen_success",
    "result_match_rate": "results_match",
    "execution_success_match_rate": "execution_success_match",
    "row_count_match_rate": "row_count_match",
    "avg_table_access_accuracy": "table_access_accuracy",
    "avg_column_access_accuracy": "column_access_accuracy",
    "avg_query_similarity": "query_similarity",
    "avg_select_similarity": "select_clause_similarity",
    "avg_from_similarity": "from_clause_similarity",
    "avg_where_similarity": "where_clause_similarity",
    "avg_composite_score": "composite_score",
}
STAGE_METRICS = (
    "execution_success_rate", "result_match_rate", "avg_table_access_accuracy", "avg_column_access_accuracy",
    "avg_query_similarity", "avg_select_similarity", "avg_from_similarity", "avg_where_similarity",
    "avg_composite_score",
)
STAGE_ORDER = ("zeroshot", "fewshot", "schema_aware", "finetune")
STAGE_LABELS = {
    "zeroshot": "Zero-Shot",
    "fewshot": "Few-Shot",
    "schema_aware": "Schema-Aware",
    "finetune": "Fine-Tuning\n(Evaluated on Test Data)",
}
METRIC_LABELS = {
    "execution_success_rate": "Execution Success Rate",
    "result_match_rate": "Result Match Rate",
    "avg_table_access_accuracy": "Table Access Accuracy",
    "avg_column_access_accuracy": "Column Access Accuracy",
    "avg_query_similarity": "Query Similarity",
    "avg_select_similarity": "SELECT Clause Similarity",
    "avg_from_similarity": "FROM Clause Similarity",
    "avg_where_similarity": "WHERE Clause Similarity",
    "avg_composite_score": "Composite Score",
}


# --- W14, W27: bringing the truth to the rows ---------------------------------

def truth_join(log: DataFrame, truth: DataFrame) -> DataFrame:
    """Left join on the shared part of (id, question, true_query); NULL keys match.

    Truth columns that the log has too get the suffix ``_true``.  The truth is never broadcast: texts worked out of short columns
    are many times what Spark takes them for, and every task would hold all of them.
    """
    keys = [k for k in ("id", "question", "true_query") if k in log.columns and k in truth.columns]
    if not keys:
        return log
    renamed = {c: f"{c}_true" for c in truth.columns if c not in keys and c in log.columns}
    right = truth.withColumnsRenamed({**renamed, **{k: f"_key_{k}" for k in keys}})
    match = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return log.join(right.hint("merge"), match, "left").drop(*[f"_key_{k}" for k in keys])


def attach_truth_result(log: DataFrame, truth: DataFrame, result: str = "result") -> DataFrame:
    """Add the true result by id, as ``true_result``."""
    return log.join(truth.select("id", F.col(result).alias("true_result")), "id", "left")


# --- W4, W5, W7-W13: per-row measures -----------------------------------------

def with_access_overlap(df: DataFrame, true: str = "true_query", gen: str = "generated_sql", once: bool = False) -> DataFrame:
    """Table and column sets of both queries, their union, intersection and overlap.

    With ``once`` each distinct pair is read once and its sets come back by a 128-bit hash of the pair, for logs in which pairs
    recur (several models answer one question); without it nothing is shuffled.
    """
    if once:
        pairs = df.select(F.col(true).alias("_a"), F.col(gen).alias("_b")).distinct()
        read = with_access_overlap(pairs, "_a", "_b").withColumn("_pair", digest("_a", "_b")).drop("_a", "_b")
        return df.withColumn("_pair", digest(true, gen)).join(read, "_pair").drop("_pair")
    out = df.withColumns({
        "true_tables": sql.table_refs(F.col(true)), "gen_tables": sql.table_refs(F.col(gen)),
        "true_columns": sql.column_refs(F.col(true)), "gen_columns": sql.column_refs(F.col(gen)),
    })
    added = {}
    for kind, score in (("tables", "table_access_accuracy"), ("columns", "column_access_accuracy")):
        a, b = F.col(f"true_{kind}"), F.col(f"gen_{kind}")
        added[f"{kind}_union"] = F.sort_array(F.array_union(a, b))
        added[f"{kind}_intersection"] = F.sort_array(F.array_intersect(a, b))
        added[score] = sql.set_overlap(a, b)
    return out.withColumns(added)


def unresolved_share(df: DataFrame, by: list[str] = ("model",), query: str = "generated_sql") -> DataFrame:
    """W5 by scope: dotted names per model, those whose table no scope of their query knows, and their share."""
    names = resolved_names(F.col(query))
    missing = F.size(F.filter("_names", lambda n: n["table"].isNull()))
    sums = df.select(*by, names.alias("_names")).groupBy(*by).agg(
        F.sum(F.size("_names")).alias("names"), F.sum(missing).alias("unresolved"))
    return sums.withColumn("share", F.try_divide("unresolved", "names"))


def outcome_measures(
    true_success: Column, gen_success: Column, true_rows: Column, gen_rows: Column,
    true_time: Column, gen_time: Column,
) -> dict[str, Column]:
    """Whether outcomes agree.  A missing true side gives NULL, not agreement with itself."""
    return {
        "execution_success_match": (true_success == gen_success).cast("int"),
        "row_count_match": (true_rows == gen_rows).cast("int"),
        "row_count_ratio": F.when((true_rows > 0) & (gen_rows > 0), gen_rows / true_rows).otherwise(0.0),
        "execution_time_ratio": F.when((true_time > 0) & (gen_time > 0), gen_time / true_time).otherwise(0.0),
    }


def composite_score(measures: dict[str, Column] | None = None, legacy: bool = False) -> Column:
    """Weighted sum of the measures at hand; a missing one adds nothing.

    ``legacy`` leaves the plan term out, as published scores do.
    """
    weights = {m: w for m, w in SCORE_WEIGHTS.items() if not (legacy and m == "plan_similarity")}
    if measures is None:
        measures = {m: F.col(m) for m in weights}
    terms = [F.coalesce(measures[m].cast("double"), F.lit(0.0)) * w for m, w in weights.items() if m in measures]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def with_result_match(df: DataFrame, success: str, true_results: Column, gen_results: Column) -> DataFrame:
    """W11 on each row: a failed query never matches; empties are told apart by side."""
    ran = F.coalesce(success, F.lit(False))
    true_empty = F.coalesce(res.row_number(true_results) == 0, F.lit(False))
    gen_empty = F.coalesce(res.row_number(gen_results) == 0, F.lit(False))
    return df.withColumn("_cmp", res.compare_results(true_results, gen_results)).withColumns({
        "true_empty_result": true_empty,
        "gen_empty_result": gen_empty,
        "both_empty": true_empty & gen_empty,
        "results_match": F.when(ran, F.col("_cmp.equal").cast("int")).otherwise(0),
        "result_reason": F.when(ran, F.col("_cmp.reason")).otherwise("Generated query failed to execute"),
        "result_diff_percentage": F.when(ran, F.col("_cmp.diff_percentage")),
        "true_result_rows": F.col("_cmp.true_rows"),
        "gen_result_rows": F.col("_cmp.gen_rows"),
        "result_diff_count": F.when(ran, F.col("_cmp.diff_count")),
        "result_example_diff_row": F.when(ran, F.col("_cmp.example_diff_row")),
    }).drop("_cmp")


def result_fingerprints(rows: DataFrame, keys: list[str], row: str, side: str) -> DataFrame:
    """(keys, {side}_n, {side}_0 .. {side}_3): per statement, how many rows its result has and their order-free fingerprint.

    The fingerprint is the sum of 128-bit hashes of the rows, kept as sums of four 32-bit parts, so it is combined map-side and a
    task sends one row per statement however large its result.  Equal multisets have equal sums; a sum that does not
    fit is NULL and equals none.
    """
    low = F.lit(0xFFFFFFFF)
    hashes = [F.xxhash64(row), F.xxhash64(F.lit(1), F.col(row))]
    parts = [p for h in hashes for p in (F.shiftrightunsigned(h, 32), h.bitwiseAND(low))]
    return rows.groupBy(*keys).agg(
        F.count("*").alias(f"{side}_n"), *[F.try_sum(p).alias(f"{side}_{i}") for i, p in enumerate(parts)])


def _by_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", never_null: list[str] = ()) -> DataFrame:
    """A join on equal or both NULL keys, which the left side keeps."""
    right = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    match = [F.col(k) == F.col(f"_key_{k}") if k in never_null else F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return left.join(right, match, how).drop(*[f"_key_{k}" for k in keys])


def _written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# what stands for a NULL key beside a column that says so, by type; keys of other types stay as they are
_FILL = {"string": "", "boolean": False, **dict.fromkeys(("byte", "short", "integer", "long"), 0)}


def _plain_keys(keys: list[str], *frames: DataFrame) -> list[str]:
    """The keys that are of one plain type wherever they occur."""
    kinds = {k: {df.schema[k].dataType for df in frames if k in df.columns} for k in keys}
    return [k for k, found in kinds.items() if len(found) == 1 and found.pop().typeName() in _FILL]


def _filled(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are never NULL, each beside ``_null_{key}``: rows grouped by these are joined by them without another shuffle."""
    kinds = {k: df.schema[k].dataType for k in keys}
    fill = {k: F.coalesce(k, F.lit(_FILL[kind.typeName()]).cast(kind)) for k, kind in kinds.items()}
    return df.withColumns({f"_null_{k}": F.isnull(k) for k in keys}).withColumns(fill)


# keys are marked in words of 64 bits, 2 ** MARK_BITS of them in a list, in at most MARK_LISTS lists (8 MB); fewer than MARKED are not
MARK_BITS, MARK_LISTS, MARKED = 12, 256, 100_000


def _marks(listed: DataFrame, keys: list[str]):
    """A filter that leaves out rows whose keys are surely not ``listed``, or None where there are few of those.

    A bit per hash, at 16 bits a key as long as MARK_LISTS allow, is set for each listed key.  The filter never loses a row, the join
    after it decides; rows that it leaves out are not shuffled.
    """
    n = listed.count()
    if n < MARKED:
        return None
    lists = 1
    while lists < MARK_LISTS and lists * 64 << MARK_BITS < 16 * n:
        lists *= 2
    spark, words = listed.sparkSession, lists << MARK_BITS
    keyed = F.xxhash64(*keys)
    word, bit = keyed.bitwiseAND(F.lit(words - 1)), F.shiftrightunsigned(keyed, 58).cast("int")
    marked = listed.select(word.alias("_word"), bit.alias("_bit")).selectExpr("_word", "shiftleft(1L, _bit) AS _bits")
    every = marked.union(spark.range(words).selectExpr("id", "0L")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))

    def in_order(df: DataFrame, at: str, group) -> DataFrame:
        listed_bits = F.sort_array(F.collect_list(F.struct(df.columns[0], "_bits")))
        return df.groupBy(group.alias(at)).agg(F.transform(listed_bits, lambda x: x["_bits"]).alias("_bits"))

    every = in_order(in_order(every, "_list", F.shiftright("_word", MARK_BITS)), "_all", F.lit(0))
    marks = _written(every.select("_bits"), "marks")

    def filtered(rows: DataFrame) -> DataFrame:
        at = word.cast("int")
        found = F.get(F.get(marks.scalar(), F.shiftright(at, MARK_BITS)), at.bitwiseAND(F.lit((1 << MARK_BITS) - 1)))
        return rows.where(F.getbit(found, bit) == 1)

    return filtered


def compare_result_tables(
    true_rows: DataFrame, gen_rows: DataFrame, key: str | list[str], row: str, statements: DataFrame | None = None,
    other_lengths: bool = True,
) -> DataFrame:
    """W11 for results too large for a cell: one row per result row, keyed by query.

    Fingerprints are compared and written down before this returns; the row level is left to the result.
    ``true_rows`` may lack some of the keys, such as the model: its results then stand for every model.  ``statements``
    lists the keys to compare (default: those that have rows).  Results are told apart by fingerprints first, so the rows of
    equal ones are read but never shuffled; only statements that differ go to the row level, where rows compare as sets, and there
    row texts are counted per side and text before anything is grouped by query, so a query that owns a third of all rows is
    spread over many tasks.  Where many statements differ, marks of their keys leave out the rows of the others before the shuffle.
    Without ``other_lengths`` the differing rows of results that have not as many rows as the true ones are not counted
    (``diff_count`` and ``example_diff_row`` are NULL): their lengths tell them apart.
    """
    keys = [key] if isinstance(key, str) else list(key)
    own = [k for k in keys if k in true_rows.columns]
    sides = [df for df in (true_rows, gen_rows, statements) if df is not None]
    plain = _plain_keys(keys, *sides)
    # a flag that is the same in all rows would be taken out of one side's grouping: only keys that can be NULL have one
    flagged = [k for k in plain if any(df.schema[k].nullable for df in sides if k in df.columns)]

    def filled(df: DataFrame, of: list[str], *columns: str) -> DataFrame:
        return _filled(df.select(*of, *columns), [k for k in of if k in flagged])

    def both(of: list[str]) -> list[str]:
        return [*of, *[f"_null_{k}" for k in of if k in flagged]]

    prints = {"true": result_fingerprints(filled(true_rows, own, row), both(own), row, "true"),
              "gen": result_fingerprints(filled(gen_rows, keys, row), both(keys), row, "gen")}
    if statements is None:
        named = prints["gen"].select(*both(keys))
        if own == keys:
            named = named.union(prints["true"].select(*both(keys)))
    else:
        named = filled(statements, keys)
    named = _by_keys(named.distinct(), prints["gen"], both(keys), never_null=both(plain))
    base = _by_keys(named, prints["true"], both(own), never_null=both(plain))
    base = base.withColumns({k: F.when(~F.col(f"_null_{k}"), F.col(k)) for k in flagged})
    same = [F.coalesce(F.col(f"true_{i}") == F.col(f"gen_{i}"), F.lit(False)) for i in range(4)]
    counts = {f"{side}_rows": F.coalesce(F.col(f"{side}_n"), F.lit(0)) for side in ("true", "gen")}
    alike = (counts["true_rows"] == counts["gen_rows"]) & ((counts["true_rows"] == 0) | (same[0] & same[1] & same[2] & same[3]))
    base = _written(base.select(*keys, *[c.alias(name) for name, c in counts.items()], alike.alias("_alike")), "compared")
    # as a table of its own its size is known before the join is planned: a small one goes to the rows, not the rows to it
    told = F.lit(True) if other_lengths else F.col("true_rows") == F.col("gen_rows")
    differing = _written(base.where(~F.col("_alike") & told).select(*keys), "differing")
    ones, twos = true_rows.select(*own, row), gen_rows.select(*keys, row)
    if plain == keys:  # hashes of a key are the same on all sides
        marks = _marks(differing, keys)
        if marks:
            twos = marks(twos)
            ones = (marks if own == keys else _marks(differing.select(*own), own) if own else lambda rows: rows)(ones)
    ones = _by_keys(ones, differing, own, "inner")
    twos = _by_keys(twos, differing, keys, "left_semi")
    tagged = (
        ones.select(*keys, row, F.lit(1).alias("_t"), F.lit(0).alias("_g"))
        .unionByName(twos.select(*keys, row, F.lit(0).alias("_t"), F.lit(1).alias("_g")))
    )
    texts = tagged.groupBy(*keys, row).agg(F.max("_t").alias("_t"), F.max("_g").alias("_g"))
    apart = texts.where("_t <> _g").groupBy(*keys).agg(
        F.count("*").alias("diff_count"), F.min(F.when(F.col("_t") == 1, F.col(row))).alias("example_diff_row"))
    out = _by_keys(base, apart, keys).withColumn("diff_count", F.when(F.col("_alike") | told, F.coalesce("diff_count", F.lit(0))))
    equal = (F.col("true_rows") == F.col("gen_rows")) & (F.col("diff_count") == 0)
    return out.drop("_alike").withColumn("equal", equal).withColumn(
        "reason",
        F.when((F.col("true_rows") == 0) & (F.col("gen_rows") == 0), "Both results are empty")
        .when(F.col("true_rows") == 0, "First result is empty, second has data")
        .when(F.col("gen_rows") == 0, "Second result is empty, first has data")
        .when(F.col("true_rows") != F.col("gen_rows"), "Different number of rows")
        .when(equal, "Results are identical (same rows, possibly different order)")
        .otherwise(F.concat(F.col("diff_count").cast("string"), F.lit(" rows differ between results"))),
    )


def with_result_tables_match(
    df: DataFrame, success: str, true_rows: DataFrame, gen_rows: DataFrame, row: str = "row", keys: list[str] | None = None,
    statements: DataFrame | None = None,
) -> DataFrame:
    """W11 on each row of a log whose results are tables of rows, keyed by the log's id and, where it has one, model.

    Adds what ``with_result_match`` adds; the example is the least row that only the true result has.  ``statements`` are rows with
    the same keys that cost less to work out than ``df``, such as the log before it was scored.
    """
    # sorts look at the first key first: a number that tells rows apart, where names of models would not
    keys = keys or [k for k in ("id", "model", "model_name") if k in df.columns and k in gen_rows.columns]
    compared = compare_result_tables(true_rows, gen_rows, keys, row, (df if statements is None else statements).select(*keys), other_lengths=False).withColumnsRenamed({
        c: f"_cmp_{c}" for c in ("true_rows", "gen_rows", "diff_count", "equal", "reason", "example_diff_row")})
    ran, n_true, n_gen = F.coalesce(success, F.lit(False)), F.col("_cmp_true_rows"), F.col("_cmp_gen_rows")
    differs = ran & (n_true > 0) & (n_true == n_gen) & ~F.col("_cmp_equal")
    return _by_keys(df, compared, keys).withColumns({
        "true_empty_result": n_true == 0,
        "gen_empty_result": n_gen == 0,
        "both_empty": (n_true == 0) & (n_gen == 0),
        "results_match": F.when(ran, F.col("_cmp_equal").cast("int")).otherwise(0),
        "result_reason": F.when(ran, F.col("_cmp_reason")).otherwise("Generated query failed to execute"),
        "result_diff_percentage": F.when(differs, F.col("_cmp_diff_count") / n_true * 100),
        "true_result_rows": n_true,
        "gen_result_rows": n_gen,
        "result_diff_count": F.when(differs, F.col("_cmp_diff_count")),
        "result_example_diff_row": F.when(differs, F.col("_cmp_example_diff_row")),
    }).drop(*[f"_cmp_{c}" for c in ("true_rows", "gen_rows", "diff_count", "equal", "reason", "example_diff_row")])


def with_text_similarity(df: DataFrame, true: str = "true_query", gen: str = "generated_sql") -> DataFrame:
    """Ratio of the whole queries and of each of the seven clauses.

    Each distinct pair is scored once, so a popular one costs no more than any other; scores come back by a
    128-bit hash of the pair, so whole texts are shuffled once only.  A NULL query counts as empty.
    """
    keyed = df.withColumns({"_a": F.coalesce(F.col(true), F.lit("")), "_b": F.coalesce(F.col(gen), F.lit(""))})
    pairs = keyed.select("_a", "_b").distinct()
    scored = pairs.select(digest("_a", "_b").alias("_pair"), similarities(F.col("_a"), F.col("_b")).alias("_sim"))
    return keyed.withColumn("_pair", digest("_a", "_b")).drop("_a", "_b").join(scored.select("_pair", "_sim.*"), "_pair").drop("_pair")


def with_edit_similarity(df: DataFrame, a: str, b: str, out: str = "edit_similarity") -> DataFrame:
    """A native (Levenshtein) text measure; another measure than W8, not a stand-in for it."""
    x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    longest = F.greatest(F.length(x), F.length(y))
    ratio = F.when(x == y, 1.0).otherwise(1.0 - edit_distance(x, y) / longest)
    return df.withColumn(out, ratio)


# a popular pair of plans meets the rows that have it in up to this many parts of a shuffle; one bit each of a bigint
PAIR_PARTS = 64


def with_plan_comparison(df: DataFrame, true: str, gen: str, spread: list[str] = ()) -> DataFrame:
    """Plan overlap, its sequence ratio, and the steps on one side only; each distinct pair is compared once.

    A log has few distinct pairs of plans, each in many rows.  ``spread`` names columns, the same whenever the rows are worked
    out again, by whose hash the rows of a pair are dealt to PAIR_PARTS keys of the join that brings its comparison back:
    without them the rows go to as many tasks as there are pairs, however long the log is.
    """
    part = F.pmod(F.xxhash64(*spread), F.lit(PAIR_PARTS)).cast("int") if spread else F.lit(0)
    keyed = df.withColumns({"_pair": digest(true, gen), "_part": part})
    pairs = keyed.groupBy(F.col(true).alias("_a"), F.col(gen).alias("_b")).agg(F.expr("bit_or(shiftleft(1L, _part))").alias("_parts"))
    compared = pairs.withColumns({"_pair": digest("_a", "_b"), **compare_plans(F.col("_a"), F.col("_b"))}).drop("_a", "_b")
    held = F.filter(F.sequence(F.lit(0), F.lit(PAIR_PARTS - 1)), lambda i: F.getbit("_parts", i) == 1)
    compared = compared.withColumn("_part", F.explode(held)).drop("_parts")
    return keyed.join(compared, ["_pair", "_part"]).drop("_pair", "_part")


# --- W16-W22: summaries -------------------------------------------------------

def model_metrics(scored: DataFrame, by: list[str] = ("model",), metrics: dict[str, str] = MODEL_METRICS) -> DataFrame:
    """Counts, rates and mean scores, for every model in one pass."""
    present = {name: col for name, col in metrics.items() if col in scored.columns}
    return scored.groupBy(*by).agg(
        F.count("*").alias("total_queries"),
        *[F.avg(F.col(col).cast("double")).alias(name) for name, col in present.items()],
        F.count_if("both_empty").alias("empty_results_both"),
    )


def error_distribution(df: DataFrame, by: list[str] = ("model",), category: str = "gen_error_category") -> DataFrame:
    """Rows per error class and model."""
    return df.groupBy(*by, category).agg(F.count("*").alias("n"))


def error_matrix(df: DataFrame, by: list[str] = ("model",), category: str = "gen_error_category") -> DataFrame:
    """W17 in wide form: one column per error class, 0 where a model has none."""
    classes = [*sql.ERROR_CLASSES, "other", "No error"]
    return df.groupBy(*by).pivot(category, classes).agg(F.count(F.lit(1))).na.fill(0, classes)


def complexity_bin(score: Column) -> Column:
    """(0,5], (5,10], (10,15], (15,inf); a score of 0 or less has no bin."""
    return (
        F.when(score <= 0, None).when(score <= 5, "Simple").when(score <= 10, "Moderate")
        .when(score <= 15, "Complex").when(score.isNotNull(), "Very Complex")
    )


def match_by_complexity(df: DataFrame, by: list[str] = ("model",), score: str = "query_complexity") -> DataFrame:
    """Match rate per model and complexity bin."""
    # exploding drops rows without a bin; a filter would be pushed down and score every row twice
    known = F.array_compact(F.array(complexity_bin(F.col(score))))
    return (
        df.select(*by, "results_match", F.explode(known).alias("complexity_bin"))
        .groupBy(*by, "complexity_bin").agg(F.avg("results_match").alias("match_rate"))
    )


def empty_breakdown(df: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Share of rows by which side came back empty, in long form."""
    true_empty, gen_empty = F.col("true_empty_result"), F.col("gen_empty_result")
    shares = {
        "Both Empty": true_empty & gen_empty,
        "True Empty Only": true_empty & ~gen_empty,
        "Generated Empty Only": ~true_empty & gen_empty,
        "Correct Non-empty": ~true_empty & ~gen_empty & (F.col("results_match") == 1),
    }
    wide = df.groupBy(*by).agg(*[F.avg(test.cast("double")).alias(name) for name, test in shares.items()])
    return wide.unpivot(list(by), list(shares), "category", "proportion")


# fixed values: the three long tables and what their labels lose
METRIC_GROUPS = {
    "overall": (("execution_success_rate", "result_match_rate", "avg_composite_score"), ""),
    "component": (
        ("avg_select_similarity", "avg_from_similarity", "avg_where_similarity"), "avg_|_similarity|_clause"),
    "structural": (
        ("avg_table_access_accuracy", "avg_column_access_accuracy", "avg_query_similarity"), "avg_"),
}


def unpivot_metrics(metrics: DataFrame, group: str, ids: list[str] = ("model",)) -> DataFrame:
    """One group of metrics in long form, under readable names."""
    columns, dropped = METRIC_GROUPS[group]
    long = metrics.unpivot(list(ids), [c for c in columns if c in metrics.columns], "metric", "value")
    label = F.regexp_replace("metric", dropped, "") if dropped else F.col("metric")
    return long.withColumn("metric", F.translate(label, "_", " ") if group == "structural" else label)


def stage_union(stages: dict[str, DataFrame], order: tuple[str, ...] = STAGE_ORDER) -> DataFrame:
    """Stages under one another, tagged, with their rank and label."""
    out = None
    for stage, df in stages.items():
        rank = order.index(stage) + 1 if stage in order else None
        tagged = df.withColumns({
            "experiment": F.lit(stage), "stage_rank": F.lit(rank).cast("int"),
            "display_stage": F.lit(STAGE_LABELS.get(stage, stage)),
        })
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def stage_lines(stages: DataFrame, metrics: tuple[str, ...] = STAGE_METRICS, model: str = "model") -> DataFrame:
    """One row per model, stage and metric, under readable names."""
    present = [m for m in metrics if m in stages.columns]
    names = F.create_map(*[F.lit(x) for m in present for x in (m, METRIC_LABELS[m])])
    long = stages.unpivot(["experiment", "stage_rank", "display_stage", model], present, "metric", "value")
    return long.withColumn("metric", names[F.col("metric")])


def stage_averages(stages: DataFrame, metrics: tuple[str, ...] = STAGE_METRICS) -> DataFrame:
    """Mean of each metric per stage."""
    present = [m for m in metrics if m in stages.columns]
    return stages.groupBy("experiment").agg(*[F.avg(m).alias(m) for m in present])


# --- W23-W26: routing failures through a repair step --------------------------

def route_failures(df: DataFrame, success: str = "success") -> DataFrame:
    """Rows that failed; an unknown outcome is not routed."""
    return df.where(~F.col(success))


def _row_keys(a: DataFrame, b: DataFrame, keys: list[str] | None) -> list[str]:
    """The id, and the model where both sides name it: an id occurs once per model."""
    return keys or [k for k in ("model", "model_name", "id") if k in a.columns and k in b.columns]


def _one_per_key(df: DataFrame, keys: list[str], value: Column, order: str | None) -> DataFrame:
    """(keys, _new): the last value of each key by ``order``; without it, differing values of a key are an error."""
    if order:
        return df.groupBy(*keys).agg(F.max_by(value, F.struct(order, value)).alias("_new"))
    least, most = F.min(value), F.max(value)
    clash = F.raise_error(F.lit(f"several values for one {'/'.join(keys)}; name the column that orders them"))
    return df.groupBy(*keys).agg(F.when(least.eqNullSafe(most), most).otherwise(clash).alias("_new"))


def apply_fix(
    df: DataFrame, fixes: DataFrame, fixed: str = "fixed_query", gen: str = "generated_sql",
    keys: list[str] | None = None, order: str | None = None,
) -> DataFrame:
    """Default ``valid_sql`` to the generated SQL; take a fix that is a SELECT; drop old outcomes.

    Fixes belong to rows by ``keys`` (default: the model, if both sides have it, and the id).  Of several fixes of one
    key the last by ``order`` counts.
    """
    keys = _row_keys(df, fixes, keys)
    fix = _one_per_key(fixes, keys, F.struct(F.col(fixed).alias("fix")), order)
    good = (F.col("_new.fix") != "ERROR") & F.startswith(F.upper(sql.strip(F.col("_new.fix"))), F.lit("SELECT"))
    good = F.coalesce(good, F.lit(False))
    return (
        df.drop(*OUTCOME_COLUMNS)
        .join(fix, keys, "left")
        .withColumn("valid_sql", F.when(good, F.col("_new.fix")).otherwise(F.col(gen)))
        .withColumn("validated", good.cast("int"))
        .drop("_new")
    )


def merge_back(
    base: DataFrame, repaired: DataFrame, gen: str = "generated_sql", order: str | None = None, keys: list[str] | None = None,
) -> DataFrame:
    """Outcomes of repaired rows replace those of the failed base rows they belong to.

    Rows belong together by ``keys`` (default: the model, if both sides have it, and the id).  Of several repaired rows
    of one key the last by ``order`` counts.  Rows that did not fail stay as they are.  A base that was merged before keeps
    the outcomes it had before any repair, so merging the same repairs again changes nothing.
    """
    keys = _row_keys(base, repaired, keys)
    taken = ["success", "valid_sql", "error", *(["results"] if "results" in repaired.columns and "results" in base.columns else [])]
    one = _one_per_key(repaired, keys, F.struct(*taken), order)

    def earlier(column: str, fresh: Column) -> Column:
        return F.col(column) if column in base.columns else fresh

    merged = base.withColumns({
        "success_before": earlier("success_before", F.col("success")), "validation_applied": earlier("validation_applied", F.lit(False)),
        "final_query": earlier("final_query", F.col(gen))}).join(one, keys, "left")
    merged = merged.withColumn("_hit", F.col("_new").isNotNull() & F.coalesce(~F.col("success_before"), F.lit(False)))
    new = {"success": "success", "error": "error", "final_query": "valid_sql", **({"results": "results"} if "results" in taken else {})}
    updates = {column: F.when(F.col("_hit"), F.col(f"_new.{source}")).otherwise(F.col(column)) for column, source in new.items()}
    return merged.withColumns({**updates, "validation_applied": F.col("_hit") | F.col("validation_applied")}).drop("_new", "_hit")


def phase_rates(merged: DataFrame, by: list[str] = ()) -> DataFrame:
    """Successes of generation, of repair, and overall, from the merged rows."""
    total = F.count("*")
    routed = F.count_if(~F.col("success_before"))
    fixed = F.count_if(F.col("validation_applied") & F.col("success"))
    return merged.groupBy(*by).agg(
        total.alias("total"),
        F.count_if("success_before").alias("generated_ok"),
        F.try_divide(F.count_if("success_before"), total).alias("generation_rate"),
        routed.alias("routed"),
        fixed.alias("repaired_ok"),
        F.try_divide(fixed, routed).alias("repair_rate"),
        F.count_if("success").alias("final_ok"),
        F.try_divide(F.count_if("success"), total).alias("final_rate"),
    )
