"""Random search over parameters (F17): trials are rows, scores are an aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitcurve.functions.hashing import md5_int


def random_trials(spark: SparkSession, n: int, bounds: dict[str, tuple[float, float]], initial: dict, seed: str) -> DataFrame:
    """``n`` trials; trial 0 is the initial setting, the others are uniform within bounds. The
    value depends only on (seed, parameter, trial), so a rerun task draws the same."""
    parameters = []
    for name, (low, high) in bounds.items():
        uniform = md5_int(f"concat('{seed}|{name}|', id)") + "/4294967296D"
        parameters.append(
            F.expr(f"CASE WHEN id = 0 THEN {initial[name]}D ELSE {low}D + ({high}D - {low}D)*{uniform} END AS {name}")
        )
    return spark.range(n).select(F.col("id").cast("int").alias("policy_id"), *parameters)


def search(trials: DataFrame, evaluate: Callable[[DataFrame], DataFrame], score: str, maximise: bool = True) -> DataFrame:
    """Evaluate every trial at once and mark the best one; the earliest of equal scores wins.

    ``evaluate`` turns trials into one row of metrics per policy_id."""
    scored = evaluate(trials).withColumn("score", F.expr(score))
    order = f"struct({'-' if maximise else ''}score, policy_id)"
    return scored.agg(
        F.expr(f"min_by(policy_id, {order}) FILTER (WHERE score IS NOT NULL) AS policy_id"),
        F.expr(f"{'max' if maximise else 'min'}(score) AS score"),
        F.count(F.lit(1)).alias("evaluations"),
    )
