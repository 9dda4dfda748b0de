"""Family V over scored models: the log's models split by the phase of the id, so that ranks can move."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sensitivity as v
from ..operators.workload import SCORE_WEIGHTS
from .base import over_log, register, rounded
from .workload import SCORED_SQL, native_scores

_MODEL = "concat(model_name, '-', CAST(id % 4 AS STRING))"
_WEIGHTS = list(SCORE_WEIGHTS.items())

_MEANS = "means AS (SELECT model_name, AVG(results_match) AS m0, AVG(table_access_accuracy) AS m1, " \
    "AVG(column_access_accuracy) AS m2, AVG(edit_similarity) AS m3, AVG(plan_similarity) AS m4 FROM " \
    f"(SELECT * REPLACE ({_MODEL} AS model_name) FROM scored) GROUP BY 1)"


def _scored(spark, sf):
    return native_scores(spark, sf).withColumn("model_name", F.expr(_MODEL))


def _score(weights: list[str]) -> str:
    total = " + ".join(weights)
    return " + ".join(f"m{i} * ({w}) / ({total})" for i, w in enumerate(weights))


@register("V1_model_scores", over_log(
    "SELECT model_name, round(" + " + ".join(f"m{i} * {w}" for i, (_, w) in enumerate(_WEIGHTS))
    + ", 6) AS composite_score FROM means", *SCORED_SQL, _MEANS))
def v1(spark, sf):
    return rounded(v.model_scores(_scored(spark, sf)), "composite_score")


_DRAWN = [
    f"(CASE WHEN draw = 0 THEN 1.0 ELSE 0.8 + 0.4 * (CAST(concat('0x', left(md5(concat('42:', draw, ':{m}')), 13)) AS BIGINT) / {float(1 << 52)}) END) * {w}"
    for m, w in _WEIGHTS]
_RANKED = f"""ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY draw ORDER BY round(score, 12) DESC, model_name) AS rank
  FROM (SELECT model_name, draw, {_score(_DRAWN)} AS score FROM means, (SELECT unnest(range(0, 1001)) AS draw)))"""
_RHO = """rho AS (SELECT r.draw, 1 - 6 * SUM((r.rank - b.rank) * (r.rank - b.rank))
  / CAST(COUNT(*) * (COUNT(*) * COUNT(*) - 1) AS DOUBLE) AS rho FROM ranked r JOIN ranked b
  ON r.model_name = b.model_name AND b.draw = 0 WHERE r.draw > 0 GROUP BY r.draw)"""


@register("V2_monte_carlo_ranks", over_log(
    "SELECT CAST(draw AS INT) AS draw, round(rho, 6) AS rho FROM rho", *SCORED_SQL, _MEANS, _RANKED, _RHO))
def v2(spark, sf):
    return rounded(v.rank_stability(_scored(spark, sf)), "rho")


@register("V2_stability_summary", over_log(
    """SELECT round(MIN(rho), 6) AS rho_min, round(quantile_cont(rho, 0.5), 6) AS rho_median, round(MAX(rho), 6) AS rho_max
      FROM rho""", *SCORED_SQL, _MEANS, _RANKED, _RHO))
def v2_summary(spark, sf):
    return rounded(v.stability_summary(v.rank_stability(_scored(spark, sf))), "rho_min", "rho_median", "rho_max")


_MOVED = [f"(CASE WHEN metric = '{m}' THEN 0.5 + step / 20.0 ELSE 1.0 END) * {w}" for m, w in _WEIGHTS]
_OWN = "CASE " + " ".join(
    f"WHEN metric = '{m}' THEN ({_MOVED[i]}) / ({' + '.join(_MOVED)})" for i, (m, _) in enumerate(_WEIGHTS)) + " END"


@register("V3_tornado", over_log(
    f"""SELECT model_name, metric, CAST(step AS INT) AS step, round(weight, 6) AS weight, CAST(ROW_NUMBER() OVER (PARTITION BY metric, step
      ORDER BY round(score, 12) DESC, model_name) AS INT) AS rank FROM (SELECT model_name, metric, step, {_OWN} AS weight,
      {_score(_MOVED)} AS score FROM means, (SELECT unnest({[m for m, _ in _WEIGHTS]}) AS metric),
      (SELECT unnest(range(0, 21)) AS step))""", *SCORED_SQL, _MEANS))
def v3(spark, sf):
    return rounded(v.tornado(_scored(spark, sf)), "weight")
