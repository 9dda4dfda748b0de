"""How stable the ranking of models is under other score weights (family V)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workload import SCORE_WEIGHTS


def _means(scored: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    return scored.groupBy(model).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])


def _ranked(scores: DataFrame, model: str, by: list[str]) -> DataFrame:
    # one row per model in each draw; rounding keeps float noise from breaking ties
    order = Window.partitionBy(*by).orderBy(F.round("score", 12).desc(), F.asc(model))
    return scores.withColumn("rank", F.row_number().over(order))


def model_scores(scored: DataFrame, weights: dict[str, float] = SCORE_WEIGHTS, model: str = "model_name") -> DataFrame:
    """V1: weighted sum of each model's mean measures."""
    means = _means(scored, model, list(weights))
    total = sum((F.col(m) * w for m, w in weights.items()), F.lit(0.0))
    return means.select(model, total.alias("composite_score"))


def counter_draw(draw: Column, metric: str, seed: int = 42) -> Column:
    """A number in [0, 1) for a draw of a metric's weight: 52 bits of the md5 of seed, draw and metric.

    A counter-based generator keeps no state, so draws of any two metrics are independent, come out the same in any
    partitioning, and can be repeated by every engine that has md5.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), F.lit(metric)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def drawn_weights(
    draw: Column, spread: float = 0.2, weights: dict[str, float] = SCORE_WEIGHTS, seed: int = 42,
) -> dict[str, Column]:
    """Each weight times a factor of its own in ``1 - spread .. 1 + spread``; draw 0 keeps the weights."""
    return {
        m: F.when(draw == 0, 1.0).otherwise(1 - spread + 2 * spread * counter_draw(draw, m, seed)) * w
        for m, w in weights.items()
    }


def rank_stability(
    scored: DataFrame, draws: int = 1000, spread: float = 0.2, weights: dict[str, float] = SCORE_WEIGHTS,
    model: str = "model_name", seed: int = 42,
) -> DataFrame:
    """V2: rank correlation with the base ranking for each draw of weights, each weight drawn on its own.

    Measures are averaged once; each model row then fans out over the draws
    (draw 0 keeps the base weights), so the rows scored are models x draws.
    """
    means = _means(scored, model, list(weights))
    each = means.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    factor = drawn_weights(F.col("draw"), spread, weights, seed)
    total = sum(factor.values(), F.lit(0.0))
    score = sum((F.col(m) * f / total for m, f in factor.items()), F.lit(0.0))
    ranked = _ranked(each.select(model, "draw", score.alias("score")), model, ["draw"])
    base = ranked.where("draw = 0").select(model, F.col("rank").alias("_base"))
    gap = F.pow(F.col("rank") - F.col("_base"), 2)
    n = F.count("*")
    return (
        ranked.where("draw > 0").join(base, model)
        .groupBy("draw").agg(F.try_divide(6 * F.sum(gap), (n * (n * n - 1)).cast("double")).alias("_loss"))
        .select("draw", (1 - F.col("_loss")).alias("rho"))
    )


def stability_summary(rhos: DataFrame) -> DataFrame:
    """V2: least, median and greatest correlation."""
    return rhos.agg(F.min("rho").alias("rho_min"), F.median("rho").alias("rho_median"), F.max("rho").alias("rho_max"))


def tornado(
    scored: DataFrame, delta: float = 0.5, steps: int = 21, weights: dict[str, float] = SCORE_WEIGHTS,
    model: str = "model_name",
) -> DataFrame:
    """V3: rank of each model as one weight at a time runs over ``1 - delta .. 1 + delta``."""
    means = _means(scored, model, list(weights))
    grid = F.explode(F.array(*[F.lit(m) for m in weights]))
    each = (
        means.withColumn("metric", grid)
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
        .withColumn("_factor", 1 - delta + 2 * delta * F.col("step") / max(steps - 1, 1))
    )
    moved = {m: F.when(F.col("metric") == m, F.col("_factor")).otherwise(1.0) * w for m, w in weights.items()}
    total = sum(moved.values(), F.lit(0.0))
    score = sum((F.col(m) * f / total for m, f in moved.items()), F.lit(0.0))
    own = F.coalesce(*[F.when(F.col("metric") == m, f / total) for m, f in moved.items()])
    scores = each.select(model, "metric", "step", own.alias("weight"), score.alias("score"))
    return _ranked(scores, model, ["metric", "step"]).drop("score")
