"""Policy grids as DataFrames. ``policy_id`` numbers the grid in nested-loop order, which is the
final tie break wherever a best policy is picked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitcurve.operators.quantiles import exact_quantiles

# The published grids.
V1_KL = (0.0, 0.005, 0.02, 0.05, 0.10)
V1_FEATURE = (0.0, 0.005, 0.02, 0.05)
CROSS_SLACKS = ((0.0, 0.0), (0.02, 0.005), (0.05, 0.02), (0.1, 0.05))
CROSS_CONFIDENCES = (0.6, 0.8, 1.01)
RISKS = (0.02, 0.05, 0.10, 0.20)
C3_LOW = (0.05, 0.10, 0.20)
C3_HIGH = (0.10, 0.20, 0.30)
P4_THRESHOLDS = (-0.05, 0.0, 0.05)
V6_DELTAS = (-0.05, -0.02, 0.0)
V6_WEIGHTS = (0.0, 5.0, 20.0, 80.0)
V7_THRESHOLDS = (0.0, -0.02)
V7_WEIGHTS = (0.25, 0.5, 1.0, 2.0)
V10_QUANTILES = (0.5, 0.75, 0.9)
V10_TAUS = (0.02, 0.05, 0.1)
V10_SAVINGS = (0.05, 0.1, 0.2)
V10_WEIGHTS = (0.5, 1.0, 2.0)
V11_TAUS = (0.0, 0.01, 0.025, 0.05)
V11_SLACKS = (0.0, 0.02, 0.05)
V11_QP_SETS = ((30, 35), (30, 35, 40), (30, 35, 40, 45, 50))
V12_TAUS = (0.0, 0.1, 0.25, 0.5)
V12_SLACKS = (0.1, 0.25, 0.5)
V12_QP_SETS = ((30, 35), (30, 35, 40))
RISK_CE = (0.0, 0.01, 0.02, 0.04, 0.08)
RISK_LIMITS = (0.05, 0.1, 0.2, 0.35, 0.5, 0.7)


def _literal(value):
    return F.array(*[F.lit(v) for v in value]) if isinstance(value, tuple) else F.lit(value)


def product_grid(spark: SparkSession, **axes) -> DataFrame:
    """Cartesian product of the axes; the last one varies fastest."""
    rows = spark.range(1).select(F.lit(0).alias("policy_id"))
    for name, values in axes.items():
        exploded = rows.select("*", F.posexplode(F.array(*[_literal(v) for v in values])).alias("_pos", name))
        rows = exploded.withColumn("policy_id", F.col("policy_id") * len(values) + F.col("_pos")).drop("_pos")
    return rows


def v1_grid(spark):
    return product_grid(spark, kl_slack=V1_KL, feature_slack=V1_FEATURE)


def dual_grid(spark):
    """24 A/B policies (slack pair, confidence, mode) followed by 16 C policies (two thresholds)."""
    slack = F.array(
        *[F.struct(F.lit(kl).alias("cross_kl"), F.lit(f).alias("cross_feature")) for kl, f in CROSS_SLACKS]
    )
    cross = product_grid(spark, _s=tuple(range(len(CROSS_SLACKS))), cross_confidence=CROSS_CONFIDENCES, mode=("A", "B"))
    cross = cross.select("policy_id", "mode", F.get(slack, F.col("_s")).alias("_x"), "cross_confidence").select(
        "policy_id",
        "mode",
        "_x.cross_kl",
        "_x.cross_feature",
        "cross_confidence",
        F.lit(None).cast("double").alias("risk_low_qp"),
        F.lit(None).cast("double").alias("risk_high_qp"),
    )
    risk = product_grid(spark, risk_low_qp=RISKS, risk_high_qp=RISKS).select(
        (F.col("policy_id") + 24).alias("policy_id"),
        F.lit("C").alias("mode"),
        *[F.lit(None).cast("double").alias(n) for n in ("cross_kl", "cross_feature", "cross_confidence")],
        "risk_low_qp",
        "risk_high_qp",
    )
    return cross.unionByName(risk)


def c3_grid(spark):
    return product_grid(spark, low_a=C3_LOW, low_b=C3_LOW, high_a=C3_HIGH, high_b=C3_HIGH)


def p4_grid(spark, thresholds=P4_THRESHOLDS):
    return product_grid(spark, low_a=thresholds, low_b=thresholds, high_a=thresholds, high_b=thresholds)


def v6_grid(spark):
    return product_grid(spark, min_delta=V6_DELTAS, feature_weight=V6_WEIGHTS)


def v7_grid(spark):
    return product_grid(spark, threshold=V7_THRESHOLDS, proxy_weight=V7_WEIGHTS)


def v10_grid(sources: DataFrame, complexity: str = "complexity", key: str = "source_id") -> DataFrame:
    """The complexity threshold of each policy is a quantile over the calibration sources. The three
    quantiles are computed once, distributed, and become literals of the grid."""
    quantiles = exact_quantiles(sources, [], complexity, V10_QUANTILES).collect()  # three rows
    threshold = {row["p"]: row["quantile"] for row in quantiles}
    if len(threshold) != len(V10_QUANTILES):
        raise ValueError("no calibration sources")
    grid = product_grid(
        sources.sparkSession, complexity_quantile=V10_QUANTILES, tau=V10_TAUS, min_saving=V10_SAVINGS, spatial_weight=V10_WEIGHTS
    )
    cases = " ".join(f"WHEN {q}D THEN {threshold[q]!r}D" for q in V10_QUANTILES)
    return grid.select(
        "policy_id", "complexity_quantile", F.expr(f"CASE complexity_quantile {cases} END AS complexity_threshold"),
        "tau", "min_saving", "spatial_weight",
    )


def v11_grid(spark):
    return product_grid(spark, tau=V11_TAUS, slack=V11_SLACKS, qps=V11_QP_SETS)


def v12_grid(spark):
    return product_grid(spark, tau=V12_TAUS, slack=V12_SLACKS, qps=V12_QP_SETS)


def risk_grid(spark):
    return product_grid(spark, ce_limit=RISK_CE, risk_limit=RISK_LIMITS)
