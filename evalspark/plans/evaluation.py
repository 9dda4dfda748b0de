"""W15 and the two whole jobs: score a query log, and push failures through a repair round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import categorise_error
from ..operators import workload as w
from .scores import ScoreStore


def compare_queries(
    log: DataFrame, truth: DataFrame | None = None, gen: str = "generated_sql", legacy: bool = False,
    text_similarity: bool = True, store: ScoreStore | None = None, extra: Callable[[DataFrame], DataFrame] | None = None,
    result_tables: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Every measure of every row of a query log, as one wide row each.

    Outcome columns of the truth carry the suffix ``_true``; a log that already
    has them needs no ``truth``.  ``legacy`` leaves the plan term out of the score.
    ``extra`` adds measures of the two queries, results and plans of a row.  ``result_tables`` are the true and the generated
    results as tables with a result row in each ``row``, keyed by id (and model), for results too large for a cell.

    With a ``store``, measures of queries, results and plans that it has seen are read from it, and others are
    worked out and kept there before this returns.
    """
    df = w.truth_join(log, truth) if truth is not None else log

    def col(name: str, kind: str):
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    gen_time, true_time = col("execution_time", "double"), col("execution_time_true", "double")
    true_results = col("results_true", "string") if "results_true" in df.columns else col("true_result", "string")
    out = df.withColumns({
        "gen_query": F.col(gen),
        "null_query": F.col("true_query").isNull().cast("int"),
        "gen_success": F.col("success"),
        "answered": F.coalesce(F.col(gen) != "", F.lit(False)),
        **w.outcome_measures(
            col("success_true", "boolean"), F.col("success"),
            col("row_count_true", "bigint"), F.col("row_count"), true_time, gen_time),
        "true_error_category": categorise_error(col("error_true", "string")),
        "gen_error_category": categorise_error(F.col("error")),
        "_true_results": true_results,
    })
    plans = [c for c in ("execution_plan_true", "execution_plan") if {"execution_plan_true", "execution_plan"} <= set(df.columns)]
    cells = [] if result_tables else ["success", "_true_results", "results"]
    inputs = ["true_query", gen, *cells, *plans]

    def measure(rows: DataFrame) -> DataFrame:
        if cells:
            rows = w.with_result_match(rows, "success", F.col("_true_results"), F.col("results"))
        # a store hands each distinct pair on once; rows with results in cells are too wide to be shuffled for it
        rows = w.with_access_overlap(rows, "true_query", gen, once=bool(result_tables) and store is None)
        if text_similarity:
            rows = w.with_text_similarity(rows, "true_query", gen)
        if plans:
            rows = w.with_plan_comparison(rows, *plans, spread=["true_query", gen, *cells])
        return extra(rows) if extra else rows

    out = (store.scored(out, inputs, measure) if store else measure(out)).drop("_true_results")
    if result_tables:
        out = w.with_result_tables_match(out, "success", *result_tables, statements=df)
    measures = {m: F.col(m) for m in w.SCORE_WEIGHTS if m in out.columns}
    return out.withColumn("composite_score", w.composite_score(measures, legacy))


def score_models(
    log: DataFrame, truth: DataFrame | None = None, model: str = "model", gen: str = "generated_sql",
    legacy: bool = False, experiment: str | None = None, store: ScoreStore | None = None,
) -> DataFrame:
    """Read log -> compare every row -> one metric row per model."""
    metrics = w.model_metrics(compare_queries(log, truth, gen, legacy, store=store), [model])
    return metrics.withColumn("experiment", F.lit(experiment)) if experiment else metrics


def repair_round(base: DataFrame, fixes: DataFrame, rerun, gen: str = "generated_sql") -> DataFrame:
    """Route failures, apply their fixes, run the fixed SQL, merge the outcomes back.

    ``rerun`` maps rows with ``valid_sql`` to rows with outcomes (W28, or a join
    with outcomes from elsewhere).
    """
    failed = w.route_failures(base)
    fixed = w.apply_fix(failed, fixes, gen=gen)
    return w.merge_back(base, rerun(fixed), gen=gen)
