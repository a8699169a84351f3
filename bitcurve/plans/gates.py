"""Gates: long tables of checks and one-row decisions. A NULL metric fails every check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitcurve.operators.bootstrap import ci_valid
from bitcurve.session import within_broadcast_bound, written

MAX_ARMS = 100_000


def checks(scored: DataFrame, keys, conditions: dict[str, tuple[str, str]]) -> DataFrame:
    """Long table (keys, check, value, pass); ``conditions`` maps a check to (value, predicate)."""
    parts = ", ".join(
        f"'{name}', double({value}), coalesce({predicate}, false)" for name, (value, predicate) in conditions.items()
    )
    return scored.select(*keys, F.expr(f"stack({len(conditions)}, {parts}) AS (check, value, pass)"))


def all_pass(checked: DataFrame, keys=()) -> DataFrame:
    return checked.groupBy(*keys).agg(F.expr("bool_and(pass) AS go"), F.count_if(~F.col("pass")).alias("failed"))


def confirmatory(scored: DataFrame, keys=("codec",)) -> DataFrame:
    """Point gate: both primaries save over 15% at higher accuracy; the gap guard is separate."""
    return scored.groupBy(*keys).agg(
        F.expr("bool_and(coalesce(bd_rate < -15 AND bd_accuracy > 0, false)) AS gate"),
        F.expr("bool_and(coalesce(min_gap >= -0.01D - 1e-12D, false)) AS guard"),
    )


def with_intervals(scored: DataFrame, ci: DataFrame, on) -> DataFrame:
    """Attach interval bounds and validity of both metrics; the interval table is one row per
    (comparison, model, metric)."""
    wide = ci.withColumn("_valid", F.expr(ci_valid())).groupBy(*on).agg(
        F.expr("max(CASE WHEN metric = 'bd_rate' THEN lo END) AS rate_lo"),
        F.expr("max(CASE WHEN metric = 'bd_rate' THEN hi END) AS rate_hi"),
        F.expr("bool_and(_valid) AS bootstrap_valid"),
    )
    return scored.join(F.broadcast(wide), list(on), "left")


def engineering(scored: DataFrame, primary=("a", "b"), keys=("model",)) -> DataFrame:
    """Check matrix per analyzer: rate, accuracy, same-qp gap and valid intervals; a further
    analyzer only has to save rate, with the upper end of its interval at most +1%."""
    names = ", ".join(f"'{m}'" for m in primary)
    return checks(
        scored,
        keys,
        {
            "rate": ("bd_rate", f"bd_rate < CASE WHEN model IN ({names}) THEN -10 ELSE 0 END"),
            "accuracy": ("100*bd_accuracy", "bd_accuracy > 0"),
            "same_qp": ("100*min_gap", "100*min_gap >= -1 - 1e-9D"),
            "bootstrap_valid": ("int(bootstrap_valid)", "bootstrap_valid"),
            "ci_upper": ("rate_hi", f"model IN ({names}) OR (rate_lo <= rate_hi AND rate_hi <= 1)"),
        },
    )


COMPONENT = """CASE WHEN NOT coalesce(bootstrap_valid, false) THEN 'INCONCLUSIVE'
    WHEN bd_rate < 0 AND rate_hi <= 1 AND bd_accuracy > 0 AND 100*min_gap >= -1 - 1e-9D THEN 'PASS' ELSE 'FAIL' END"""

MOTION = "coalesce(bd_rate < 0 AND 100*min_gap >= -1, false)"


def component(scored: DataFrame) -> DataFrame:
    """Three-state verdict of one analyzer."""
    return scored.withColumn("verdict", F.expr(COMPONENT))


def motion(scored: DataFrame, keys=()) -> DataFrame:
    """Every analyzer saves rate without a same-qp loss above one point."""
    return scored.groupBy(*keys).agg(F.expr(f"bool_and({MOTION}) AS go"))


def chroma(trial: DataFrame, direct: DataFrame, primary=("a", "b"), third: str = "c") -> DataFrame:
    """Direct gain on the third analyzer with an interval below zero, primaries still below -10%
    against the anchor and at most +1% against the base, gaps at least -1 point. ``trial`` and
    ``direct`` hold one row per analyzer."""
    joined = trial.select("model", "bd_rate", "bd_accuracy").join(
        direct.select(
            "model", F.col("bd_rate").alias("d_rate"), F.col("min_gap").alias("d_gap"), F.col("rate_hi").alias("d_hi")
        ),
        "model",
    )
    names = ", ".join(f"'{m}'" for m in primary)
    rule = f"""100*d_gap >= -1 - 1e-9D AND CASE WHEN model = '{third}' THEN d_rate < 0 AND d_hi < 0
        WHEN model IN ({names}) THEN bd_rate < -10 AND bd_accuracy > 0 AND d_rate <= 1 ELSE true END"""
    return joined.agg(F.expr(f"bool_and(coalesce({rule}, false)) AS go"))


def probe(scored: DataFrame, source_gaps: DataFrame, arm: str = "arm") -> DataFrame:
    """Probe decision per arm over all codecs: source gap, BD-rate target and same-qp gap."""
    per_arm = scored.groupBy(arm).agg(
        F.expr("bool_and(coalesce(bd_rate <= -15, false)) AS passes_bd_target"),
        F.expr("bool_and(coalesce(min_gap >= -0.05D, false)) AS passes_qp_gap"),
        F.max("bd_rate").alias("worst_bd_rate"),
    )
    joined = per_arm.join(F.broadcast(source_gaps), arm)
    joined = joined.withColumn("passes_source_gap", F.expr("coalesce(source_gap >= -0.02D, false)"))
    return joined.withColumn("go", F.expr("passes_source_gap AND passes_bd_target AND passes_qp_gap"))


def staged_stop(n_boxes: str, anchor_map: str, prepared_map: str, min_boxes: int = 50, keep: float = 0.8) -> str:
    """Verdict of the cheap first stage, as SQL: degenerate anchor, stage A failed, or go on."""
    return (
        f"CASE WHEN {n_boxes} < {min_boxes} THEN 'degenerate_anchor'"
        f" WHEN {anchor_map} > 0 AND {prepared_map}/{anchor_map} < {keep}D THEN 'stage_A_fail' ELSE 'continue' END"
    )


def staged(first: DataFrame, second: DataFrame, anchor: str, arm: str = "arm", min_boxes: int = 50,
           keep: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(verdicts, rows of the second stage). ``first`` has one row per arm: its boxes (``n_boxes``) and ``quality``.

    The second stage keeps the anchor and the arms that the first lets through. The verdicts are a small table of
    their own by then, so a ``second`` that is stored by arm is read only where it is wanted: its partitions are
    pruned when the query runs. Up to ``MAX_ARMS`` arms are broadcast, more are joined. An arm without a quality, like one
    without a row, is held back; without a row of the anchor there is no verdict, and only the anchor goes on."""
    base = first.filter(F.col(arm) == anchor).select(F.col("n_boxes").alias("_n"), F.col("quality").alias("_q"))
    rule = f"CASE WHEN quality IS NULL OR _q IS NULL THEN 'stage_A_fail' ELSE {staged_stop('_n', '_q', 'quality', min_boxes, keep)} END"
    others = first.filter(F.col(arm) != anchor).crossJoin(F.broadcast(base))  # the anchor is one row
    judged = others.select(arm, F.expr(rule).alias("verdict"))
    own = first.sparkSession.range(1).select(F.lit(anchor).alias(arm), F.lit("continue").alias("verdict"))
    judged = written(judged.unionByName(own), "verdicts")
    wanted = judged.filter("verdict = 'continue'").select(arm)
    if within_broadcast_bound(wanted, MAX_ARMS):
        wanted = F.broadcast(wanted)
    return judged.filter(F.col(arm) != anchor), second.join(wanted, arm, "left_semi")


def matched_control(scored: DataFrame, controls: DataFrame, arm: str = "arm") -> DataFrame:
    """Local gate of an arm that must also beat its matched control. ``controls`` maps arm to
    control arm; both are compared with the anchor in ``scored``."""
    own = scored.join(F.broadcast(controls), arm)
    control = scored.select(F.col(arm).alias("control"), "codec", "model", F.col("bd_rate").alias("control_bd_rate"))
    joined = own.join(control, ["control", "codec", "model"], "left")
    return joined.select(
        arm,
        "control",
        "codec",
        "model",
        "bd_rate",
        "control_bd_rate",
        "min_gap",
        F.expr("coalesce(bd_rate < control_bd_rate, false) AS beats_control"),
        F.expr("coalesce(bd_rate <= -15 AND min_gap >= -0.05D AND bd_rate < control_bd_rate, false) AS pass"),
    )
