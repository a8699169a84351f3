"""D1, D8-D15 and their neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitcurve.operators import select as S
from bitcurve.operators.cells import to_cells
from bitcurve.operators.curves import curves_by_model
from bitcurve.plans.calibrate import scores
from workload.fixtures import duck_bd, duck_measurements, measurements
from workload.registry import query

SLACK_FIELDS = ("bpp", "correct_a", "correct_b", "a_kl_source", "a_feature_distance", "a_source_confidence",
                "a_source_top1_agrees")


def r6(column):
    return F.round(column, 6)


def r8(column):
    return F.round(column, 8)


def q8(text: str) -> str:
    return f"(round({text}, 8) + 0.0)"


def q6(text: str) -> str:
    return f"(round({text}, 6) + 0.0)"


def slack_choice(spark, sf):
    """Chosen rows of the fixed v1 policy next to the anchor of the same cell."""
    cells = to_cells(measurements(spark, sf, *SLACK_FIELDS), SLACK_FIELDS)
    rule = S.slack("0.1D", "0.05D", "0.6D")
    return S.choose(cells, rule, fields=("bpp", "correct_a", "correct_b"),
                    keep=("c0_bpp", "c0_correct_a", "c0_correct_b"))


def arms(choices):
    """Anchor and policy rows of each cell as two arms."""
    both = F.array(
        F.struct(F.lit("identity").alias("arm"), F.col("c0_bpp").alias("bpp"),
                 F.col("c0_correct_a").alias("correct_a"), F.col("c0_correct_b").alias("correct_b")),
        F.struct(F.lit("policy").alias("arm"), F.col("bpp"), F.col("correct_a"), F.col("correct_b")),
    )
    return choices.select("source_id", "codec", "qp", F.inline(both))


DUCK_V1 = f"""{duck_measurements(*SLACK_FIELDS)},
anchor AS (SELECT source_id, codec, qp, bpp AS bpp0, a_kl_source AS kl0, a_feature_distance AS f0 FROM m
           WHERE cand_idx = 0),
choice AS (
  SELECT m.* FROM m JOIN anchor USING (source_id, codec, qp)
  WHERE cand_idx = 0 OR (bpp < bpp0 AND a_kl_source <= kl0 + 0.1::DOUBLE
    AND a_feature_distance <= f0 + 0.05::DOUBLE AND (a_source_confidence < 0.6::DOUBLE OR a_source_top1_agrees))
  QUALIFY row_number() OVER (PARTITION BY source_id, codec, qp ORDER BY bpp, cand_idx) = 1),
arms AS (SELECT 'identity' AS arm, * FROM m WHERE cand_idx = 0 UNION ALL SELECT 'policy', * FROM choice),
curve AS (
  SELECT arm, codec, model, qp, avg(bpp) AS bpp, avg(ok::INT) AS quality, count(*) AS n
  FROM (SELECT arm, codec, qp, bpp, 'a' AS model, correct_a AS ok FROM arms
        UNION ALL SELECT arm, codec, qp, bpp, 'b', correct_b FROM arms) GROUP BY ALL)"""

PAIRS = """pairs AS (
  SELECT codec, model, CASE arm WHEN 'identity' THEN 'a' ELSE 't' END AS side, bpp AS rate, quality FROM curve)"""


@query("d1_curve", f"""WITH {DUCK_V1}
SELECT arm, codec, model, qp, {q8('bpp')} AS bpp, {q8('quality')} AS quality, n FROM curve""")
def d1(spark, sf):
    rows = curves_by_model(arms(slack_choice(spark, sf)), ["arm", "codec"], ["a", "b"])
    return rows.select("arm", "codec", "model", "qp", r8("bpp").alias("bpp"), r8("quality").alias("quality"), "n")


COMPARE = f"""WITH {DUCK_V1}, {PAIRS}, {duck_bd('pairs', 'codec, model')},
same AS (
  SELECT codec, model, avg(t.bpp/a.bpp) AS rate_ratio, min(t.quality - a.quality) AS min_gap
  FROM curve a JOIN curve t USING (codec, model, qp) WHERE a.arm = 'identity' AND t.arm = 'policy' GROUP BY ALL)
SELECT codec, model, {q6('bd_rate')} AS bd_rate, {q6('bd_metric')} AS bd_accuracy,
       {q6('100*bd_metric')} AS bd_accuracy_pp, {q6('rate_ratio')} AS rate_ratio, {q6('min_gap')} AS min_gap
FROM bd JOIN same USING (codec, model)"""


@query("d12_compare_policy", COMPARE)
def flagship(spark, sf):
    """Fixed v1 policy against the anchor: select, average into curves, compare."""
    result = scores(slack_choice(spark, sf), ("a", "b"), keys=("codec",))
    return result.select(
        "codec", "model", r6("bd_rate").alias("bd_rate"), r6("bd_accuracy").alias("bd_accuracy"),
        r6(100 * F.col("bd_accuracy")).alias("bd_accuracy_pp"), r6("rate_ratio").alias("rate_ratio"),
        r6("min_gap").alias("min_gap"),
    )
