"""Calibration: every policy of a grid is selected, averaged into curves, compared with the anchor,
checked and ranked. One pass over the cells serves the whole grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitcurve.operators.curves import compare, paired_points


def scores(choices: DataFrame, models=("a", "b"), keys=("policy_id", "codec"), means=(), base: str = "c0_") -> DataFrame:
    """Per (policy, codec, model): curves of choice and anchor, their deltas and extra means."""
    return compare(paired_points(choices, list(keys), models, base=base, means=means))


# A NULL metric never passes: each predicate is wrapped in coalesce(..., false) by ``decide``.
V1_ELIGIBLE = "bd_rate < 0 AND bd_accuracy >= 0 AND min_gap >= -0.01D AND rate_ratio < 1"
DUAL_ELIGIBLE = "bd_rate < 0 AND bd_accuracy > 0 AND min_gap >= -0.01D - 1e-12D"
NEAR_BASELINE = "bd_rate <= base_bd_rate + {slack}D AND bd_accuracy > 0 AND min_gap >= -0.01D"
SPATIAL_FEASIBLE = "bd_rate < -10 AND bd_accuracy > 0 AND min_gap >= -0.01D - 1e-12D"
RESCUE_FEASIBLE = SPATIAL_FEASIBLE + " AND bd_rate <= base_bd_rate + {slack}D"
RERANK_FEASIBLE = (
    "bd_rate < -10 AND bd_accuracy > 0 AND 100*min_gap >= -1 - 1e-9D AND bd_rate <= base_bd_rate + {slack}D"
)
DEV_GO = "bd_rate < base_bd_rate AND bd_accuracy > 0 AND min_gap >= -0.01D"


def with_baseline(scored: DataFrame, baseline: DataFrame, on=("codec", "model"), extra=()) -> DataFrame:
    """Attach the baseline's BD-rate (and further columns) per (codec, model): a few rows."""
    base = baseline.select(
        *on, F.col("bd_rate").alias("base_bd_rate"), *[F.col(name).alias(f"base_{name}") for name in extra]
    )
    return scored.join(F.broadcast(base), list(on), "left")


def decide(scored: DataFrame, predicate: str, keys=("policy_id", "codec"), also: str = "true", carry=()) -> DataFrame:
    """One row per policy: does every analyzer pass, and the worst and summed BD-rate if so.

    ``also`` is a per-policy condition over the carried columns."""
    verdict = scored.groupBy(*keys).agg(
        F.expr(f"bool_and(coalesce({predicate}, false)) AS _all"),
        F.max("bd_rate").alias("_worst"),
        F.sum("bd_rate").alias("_sum"),
        *[F.first(name).alias(name) for name in carry],
    )
    verdict = verdict.withColumn("eligible", F.expr(f"_all AND coalesce({also}, false)"))
    return verdict.select(
        *keys,
        *carry,
        "eligible",
        F.expr("CASE WHEN eligible THEN _worst END AS worst_bd_rate"),
        F.expr("CASE WHEN eligible THEN _sum END AS sum_bd_rate"),
    )


def best(decided: DataFrame, rank, keys=("codec",)) -> DataFrame:
    """Lexicographically best eligible policy per key, NULL if none; grid order breaks ties."""
    order = ", ".join([*rank, "policy_id"])
    return decided.groupBy(*keys).agg(
        F.expr(f"min_by(policy_id, struct({order})) FILTER (WHERE eligible) AS policy_id"),
        F.count_if("eligible").alias("n_eligible"),
        F.count(F.lit(1)).alias("n_policies"),
    )


def promoted(
    decided: DataFrame, scored: DataFrame, baseline: DataFrame, worst_gain: float = 1.0, slack: float = 0.5
) -> DataFrame:
    """Is the best eligible policy clearly better than the old one: its worst BD-rate by
    ``worst_gain`` points, and no analyzer worse than ``slack`` points. Without an eligible policy
    the answer is no."""
    chosen = best(decided, ["worst_bd_rate", "sum_bd_rate"]).select("codec", "policy_id")
    rows = F.broadcast(chosen).join(scored, ["codec", "policy_id"], "left")
    rows = rows.withColumn("model", F.coalesce("model", F.lit("")))
    return with_baseline(rows, baseline).groupBy("codec", "policy_id").agg(
        F.expr(
            f"coalesce(max(bd_rate) <= max(base_bd_rate) - {worst_gain}D"
            f" AND bool_and(bd_rate <= base_bd_rate + {slack}D), false) AS promoted"
        ),
        F.max("bd_rate").alias("worst_bd_rate"),
        F.max("base_bd_rate").alias("old_worst_bd_rate"),
    )


def safety(choices: DataFrame) -> DataFrame:
    """Teacher safety of each policy: harm rate, worst per-qp harm rate, mean regret, mean log rate
    and number of non-anchor choices, from columns ``harm``, ``regret``, ``log_rate``."""
    per_qp = choices.groupBy("policy_id", "qp").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("harm").cast("int")).alias("harm"),
        F.sum("regret").alias("regret"),
        F.sum("log_rate").alias("log_rate"),
        F.count_if(F.col("cand_idx") != 0).alias("moved"),
    )
    return per_qp.groupBy("policy_id").agg(
        F.expr("sum(harm)/sum(n) AS harm_rate"),
        F.expr("max(harm/n) AS worst_qp_harm_rate"),
        F.expr("sum(regret)/sum(n) AS mean_regret"),
        F.expr("sum(log_rate)/sum(n) AS mean_log_rate"),
        F.sum("moved").alias("non_identity"),
    )


RISK_ELIGIBLE = "harm_rate <= 0.01D AND worst_qp_harm_rate <= 0.025D AND mean_regret <= 0.02D"
RISK_USABLE = RISK_ELIGIBLE + " AND mean_log_rate < -0.01D"
