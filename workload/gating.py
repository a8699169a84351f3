"""Gates and fixed-arm reports (H13-H19), and comparisons between arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitcurve.operators import curves as V
from bitcurve.plans import calibrate as C
from bitcurve.plans import gates
from bitcurve.schema import QPS
from bitcurve.session import scratch
from workload import selection as G
from workload.curves import q6, q8, r6, r8
from workload.decisions import duck_scores
from workload.fixtures import duck_bd, duck_measurements, measurements
from workload.registry import query
from workload.resampling import chosen_rows, duck_intervals, duck_slack, slack_intervals

BOTH = ("h264", "h265")
ABC = ("d", "e", "f")


def slack_scored(spark, sf, models, codecs=("h264",)):
    return C.scores(chosen_rows(spark, sf, models, codecs), models, keys=("codec",))


def duck_point(models):
    """Point scores of the slack policy, from ``v1`` with anchors."""
    return "v1_choice AS (SELECT 0 AS policy_id, * FROM v1), " + duck_scores(choice="v1_choice", models=models)


@query("h13_confirmatory_gate", f"""WITH {G.duck_wide(G.SLACK + ("correct_d", "correct_e"), BOTH)}, {G.duck_v1("v1", G.LOOSE)},
{duck_point(("d", "e"))}
SELECT codec, bool_and(coalesce(bd_rate < -15 AND bd_accuracy > 0, false)) AS gate,
  bool_and(coalesce(min_gap >= -0.01::DOUBLE - 1e-12, false)) AS guard FROM score GROUP BY codec""")
def h13(spark, sf):
    return gates.confirmatory(slack_scored(spark, sf, ("d", "e"), BOTH))


DUCK_CI = f"""{duck_intervals(ABC)}, {duck_point(ABC)},
valid AS (SELECT model, max(lo) FILTER (WHERE metric = 'bd_rate') AS rate_lo, max(hi) FILTER (WHERE metric = 'bd_rate') AS rate_hi,
  bool_and(valid_draws >= 0.95*requested_draws AND lo <= hi) AS bootstrap_valid FROM summary GROUP BY model),
full_score AS (SELECT * FROM score JOIN valid USING (model))"""


def with_ci(spark, sf):
    return gates.with_intervals(slack_scored(spark, sf, ABC), slack_intervals(spark, sf, ABC), ["model"])


@query("h14_engineering_gate", f"""WITH {DUCK_CI}, checks AS (
SELECT model, 'rate' AS "check", bd_rate AS value, bd_rate < CASE WHEN model = 'f' THEN 0 ELSE -10 END AS pass FROM full_score
UNION ALL SELECT model, 'accuracy', 100*bd_accuracy, bd_accuracy > 0 FROM full_score
UNION ALL SELECT model, 'same_qp', 100*min_gap, 100*min_gap >= -1 - 1e-9 FROM full_score
UNION ALL SELECT model, 'bootstrap_valid', bootstrap_valid::INT, bootstrap_valid FROM full_score
UNION ALL SELECT model, 'ci_upper', rate_hi, model <> 'f' OR rate_hi <= 1 FROM full_score)
SELECT model, "check", {q6('value')} AS value, coalesce(pass, false) AS pass FROM checks""")
def h14(spark, sf):
    return gates.engineering(with_ci(spark, sf), ("d", "e")).withColumn("value", r6("value"))


@query("h15_component_gate", f"""WITH {DUCK_CI}
SELECT model, CASE WHEN NOT bootstrap_valid THEN 'INCONCLUSIVE' WHEN bd_rate < 0 AND rate_hi <= 1 AND bd_accuracy > 0
  AND 100*min_gap >= -1 - 1e-9 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM full_score""")
def h15(spark, sf):
    return gates.component(with_ci(spark, sf)).select("model", "verdict")


@query("h16_motion_rule", f"""WITH {duck_slack(ABC)}, {duck_point(ABC)}
SELECT codec, bool_and(coalesce(bd_rate < 0 AND 100*min_gap >= -1, false)) AS go FROM score GROUP BY codec""")
def h16(spark, sf):
    return gates.motion(slack_scored(spark, sf, ABC), ["codec"])


@query("h16_chroma_rule", f"""WITH {DUCK_CI}
SELECT bool_and(coalesce(100*min_gap >= -1 - 1e-9 AND CASE WHEN model = 'f' THEN bd_rate < 0 AND rate_hi < 0
  ELSE bd_rate < -10 AND bd_accuracy > 0 AND bd_rate <= 1 END, false)) AS go FROM full_score""")
def h16_chroma(spark, sf):
    # The base of the direct comparison is the anchor here, so both tables hold the same scores.
    from bitcurve.session import cut_lineage

    scored = cut_lineage(with_ci(spark, sf))
    return gates.chroma(scored, scored, ("d", "e"), "f")


# --- fixed arms ------------------------------------------------------------------------------
ARM_FIELDS = ("candidate", "bpp", "correct_d", "correct_e", "target_prob_a")


def fixed_arms(spark, sf, codecs=BOTH, fields=ARM_FIELDS):
    """Every candidate as an arm of its own: the long table itself."""
    return measurements(spark, sf, *fields, codecs=codecs).withColumnRenamed("candidate", "arm")


def arm_curves(spark, sf, codecs=BOTH):
    return V.curves_by_model(fixed_arms(spark, sf, codecs), ["codec", "arm"], ["d", "e"])


DUCK_ARMS = f"""{duck_measurements(*ARM_FIELDS, codecs=BOTH)},
arm_curve AS (SELECT codec, candidate AS arm, model, qp, avg(bpp) AS bpp, avg(ok::INT) AS quality FROM (
  SELECT codec, candidate, qp, bpp, 'd' AS model, correct_d AS ok FROM m
  UNION ALL SELECT codec, candidate, qp, bpp, 'e', correct_e FROM m) GROUP BY ALL)"""


def duck_arm_score(pair_rows, curves="arm_curve"):
    """Scores for (anchor, trial) arm pairs."""
    return f"""pair(anchor, trial) AS (VALUES {pair_rows}),
sides AS (SELECT anchor, trial, codec, model, side, qp, bpp AS rate, quality FROM pair
  JOIN (SELECT 'a' AS side, * FROM {curves} UNION ALL SELECT 't', * FROM {curves}) c
    ON c.arm = CASE side WHEN 'a' THEN anchor ELSE trial END),
{duck_bd('sides', 'anchor, trial, codec, model', 'arm_bd')},
arm_same AS (SELECT anchor, trial, codec, model, avg(t.rate/a.rate) AS rate_ratio, min(t.quality - a.quality) AS min_gap
  FROM sides a JOIN sides t USING (anchor, trial, codec, model, qp) WHERE a.side = 'a' AND t.side = 't' GROUP BY ALL),
arm_score AS (SELECT * FROM arm_bd JOIN arm_same USING (anchor, trial, codec, model))"""


NAMES = ("identity128", "area112", "area96", "area112_up128", "blur020_128", "blur040_128")
VS_ANCHOR = ", ".join(f"('identity128', '{n}')" for n in NAMES[1:])
DIRECT = (("area112", "area96"), ("blur020_128", "blur040_128"))
ALL_PAIRS = VS_ANCHOR + ", " + ", ".join(f"('{a}', '{t}')" for a, t in DIRECT)
SCORE_OUT = ("bd_rate", "bd_accuracy", "rate_ratio", "min_gap")


@query("h17_probe_decision", f"""WITH {DUCK_ARMS}, {duck_arm_score(VS_ANCHOR)},
clean AS (SELECT source_id, cand_idx, clean_a FROM ({duck_measurements('clean_a', name='mc').join(['WITH ', ' SELECT * FROM mc'])}) WHERE qp = 30),
gap AS (SELECT CASE cand_idx {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES))} END AS trial, avg(clean_a::INT)
   - (SELECT avg(clean_a::INT) FROM clean WHERE cand_idx = 0) AS source_gap FROM clean WHERE cand_idx > 0 GROUP BY cand_idx)
SELECT trial AS arm, bool_and(coalesce(bd_rate <= -15, false)) AS passes_bd_target,
  bool_and(coalesce(min_gap >= -0.05::DOUBLE, false)) AS passes_qp_gap, {q6('max(bd_rate)')} AS worst_bd_rate,
  {q6('any_value(source_gap)')} AS source_gap, any_value(source_gap) >= -0.02::DOUBLE AS passes_source_gap,
  any_value(source_gap) >= -0.02::DOUBLE AND bool_and(coalesce(bd_rate <= -15 AND min_gap >= -0.05::DOUBLE, false)) AS go
FROM arm_score JOIN gap USING (trial) WHERE model = 'd' GROUP BY trial""")
def h17(spark, sf):
    scored = V.compare(V.against(arm_curves(spark, sf).filter("model = 'd'"), "arm", "identity128", ["codec", "model"]))
    clean = measurements(spark, sf, "candidate", "clean_a").filter("qp = 30")
    means = clean.groupBy(F.col("candidate").alias("arm")).agg(F.avg(F.col("clean_a").cast("int")).alias("top1"))
    # One row per arm: the anchor's value is spread over the few arms by a window.
    anchor = F.expr("max(CASE WHEN arm = 'identity128' THEN top1 END) OVER ()")
    gaps = means.select("arm", (F.col("top1") - anchor).alias("source_gap"))
    decided = gates.probe(scored, gaps)
    return decided.withColumns({"worst_bd_rate": r6("worst_bd_rate"), "source_gap": r6("source_gap")})


# One arm loses half of its sources in the first stage.
STAGE_A = "clean_a AND NOT (candidate = 'blur040_128' AND source_id % 2 = 0)"


@query("h17_staged_stop", f"""WITH {DUCK_ARMS}, {duck_arm_score(VS_ANCHOR)},
clean AS (SELECT source_id, candidate, clean_a FROM ({duck_measurements('clean_a', 'candidate', name='mc').join(['WITH ', ' SELECT * FROM mc'])}) WHERE qp = 30),
stage_a AS (SELECT candidate AS arm, count(*) AS n_boxes, avg(({STAGE_A})::INT) AS quality FROM clean GROUP BY ALL),
verdict AS (SELECT t.arm, CASE WHEN a.n_boxes < 50 THEN 'degenerate_anchor' WHEN a.quality > 0 AND t.quality/a.quality < 0.8::DOUBLE
  THEN 'stage_A_fail' ELSE 'continue' END AS verdict FROM stage_a t, stage_a a WHERE a.arm = 'identity128' AND t.arm <> 'identity128')
SELECT arm, verdict, {q6("max(bd_rate) FILTER (WHERE verdict = 'continue')")} AS worst_bd_rate,
  count(*) FILTER (WHERE verdict = 'continue') AS comparisons FROM verdict JOIN arm_score ON trial = arm GROUP BY arm, verdict""")
def h17_staged(spark, sf):
    """The second stage is stored by arm; arms that the first one holds back are never read."""
    clean = measurements(spark, sf, "candidate", "clean_a").filter("qp = 30")
    first = clean.groupBy(F.col("candidate").alias("arm")).agg(
        F.count(F.lit(1)).alias("n_boxes"), F.expr(f"avg(int({STAGE_A}))").alias("quality"))
    path = scratch(spark, "by-arm")
    fixed_arms(spark, sf).write.partitionBy("arm").parquet(path)
    verdicts, second = gates.staged(first, spark.read.parquet(path), "identity128")
    curves = V.curves_by_model(second, ["codec", "arm"], ["d", "e"])
    scored = V.compare(V.against(curves, "arm", "identity128", ["codec", "model"]))
    worst = scored.groupBy("arm").agg(F.max("bd_rate").alias("worst_bd_rate"), F.count(F.lit(1)).alias("comparisons"))
    return verdicts.join(worst, "arm", "left").select(
        "arm", "verdict", r6("worst_bd_rate").alias("worst_bd_rate"), F.coalesce("comparisons", F.lit(0)).alias("comparisons"))


@query("h18_fixed_arm_report", f"""WITH {DUCK_ARMS}, {duck_arm_score(ALL_PAIRS)}
SELECT anchor, trial, codec, model, {q6('bd_rate')} AS bd_rate, {q6('bd_metric')} AS bd_accuracy,
  {q6('rate_ratio')} AS rate_ratio, {q6('min_gap')} AS min_gap FROM arm_score""")
def h18(spark, sf):
    rows = [("identity128", n) for n in NAMES[1:]] + list(DIRECT)
    pairs = spark.createDataFrame(rows, "anchor STRING, trial STRING")
    scored = V.compare_pairs(arm_curves(spark, sf), pairs, "arm", ["codec", "model"])
    return scored.select("anchor", "trial", "codec", "model", *[r6(n).alias(n) for n in SCORE_OUT])


CONTROLS = (("area96", "area112"), ("blur040_128", "blur020_128"))


@query("h19_matched_control", f"""WITH {DUCK_ARMS}, {duck_arm_score(VS_ANCHOR)},
control(arm, control) AS (VALUES {", ".join(f"('{a}', '{c}')" for a, c in CONTROLS)})
SELECT arm, control, codec, model, {q6('s.bd_rate')} AS bd_rate, {q6('c.bd_rate')} AS control_bd_rate,
  {q6('s.min_gap')} AS min_gap, s.bd_rate < c.bd_rate AS beats_control,
  s.bd_rate <= -15 AND s.min_gap >= -0.05::DOUBLE AND s.bd_rate < c.bd_rate AS pass
FROM control JOIN arm_score s ON s.trial = arm JOIN arm_score c ON c.trial = control AND c.codec = s.codec AND c.model = s.model
""".replace("codec, model, (round", "s.codec, s.model, (round"))
def h19(spark, sf):
    scored = V.compare(V.against(arm_curves(spark, sf), "arm", "identity128", ["codec", "model"]))
    controls = spark.createDataFrame(CONTROLS, "arm STRING, control STRING")
    decided = gates.matched_control(scored, controls)
    return decided.withColumns({n: r6(n) for n in ("bd_rate", "control_bd_rate", "min_gap")})


@query("d13_compare_pp", f"""WITH {DUCK_ARMS}, {duck_arm_score(VS_ANCHOR)}
SELECT trial AS arm, codec, model, {q6('bd_rate')} AS bd_rate, {q6('100*bd_metric')} AS bd_accuracy_pp,
  {q6('100*min_gap')} AS min_gap_pp FROM arm_score""")
def d13(spark, sf):
    scored = V.compare(V.against(arm_curves(spark, sf), "arm", "identity128", ["codec", "model"]))
    return scored.select("arm", "codec", "model", r6("bd_rate").alias("bd_rate"),
                         r6(100 * F.col("bd_accuracy")).alias("bd_accuracy_pp"), r6(100 * F.col("min_gap")).alias("min_gap_pp"))


# Methods named like the reports': plain codec, prep+codec, sandwich+codec.
METHOD_SQL = ("CASE cand_idx WHEN 0 THEN '' WHEN 1 THEN 'prep+' ELSE 'sandwich+' END || codec")
METHOD_PAIRS = [(c, f"{arm}+{c}") for c in BOTH for arm in ("prep", "sandwich")] + [("h265", "prep+h264"), ("proxy", "prep+h264")]
PAIR_ROWS = ", ".join(f"('{a}', '{t}')" for a, t in METHOD_PAIRS)
SHARD_PRESENT = "(source_id*7 + qp) % 11 <> 0 AND NOT (codec = 'h265' AND cand_idx = 2 AND qp > 30)"


def methods(spark, sf):
    rows = measurements(spark, sf, "class", "bpp", "correct_a", "target_prob_a", codecs=BOTH).filter(f"cand_idx <= 2")
    return rows.filter(SHARD_PRESENT).withColumn("method", F.expr(METHOD_SQL))


DUCK_METHODS = f"""{duck_measurements("class", "bpp", "correct_a", "target_prob_a", codecs=BOTH)},
points AS (SELECT source_id, class, codec, {METHOD_SQL} AS method, qp, bpp, correct_a, target_prob_a FROM m
  WHERE cand_idx <= 2 AND {SHARD_PRESENT})"""
DUCK_SHARDED = f"""{DUCK_METHODS},
merged AS (SELECT method, qp, avg(bpp) AS bpp, avg(correct_a::INT) AS quality, count(*) AS n FROM points GROUP BY method, qp
  QUALIFY count(*) OVER (PARTITION BY method) >= 2)"""


def merged_curves(spark, sf):
    return V.merged_curve(methods(spark, sf), "method", quality="correct_a")


@query("d3_merged_shard_curve", f"""WITH {DUCK_SHARDED}
SELECT method, qp, {q8('bpp')} AS bpp, {q8('quality')} AS quality, n FROM merged""")
def d3(spark, sf):
    return merged_curves(spark, sf).select("method", "qp", r8("bpp").alias("bpp"), r8("quality").alias("quality"), "n")


@query("d14_pair_matrix", f"""WITH {DUCK_SHARDED}, arm_curve AS (SELECT 'all' AS codec, method AS arm, 'a' AS model, qp, bpp, quality
FROM merged), {duck_arm_score(PAIR_ROWS)}
SELECT anchor, trial, {q6('bd_rate')} AS bd_rate, {q6('bd_metric')} AS bd_accuracy FROM arm_score""")
def d14(spark, sf):
    pairs = spark.createDataFrame(METHOD_PAIRS, "anchor STRING, trial STRING")
    scored = V.compare_pairs(merged_curves(spark, sf), pairs, "method", [])
    return scored.select("anchor", "trial", r6("bd_rate").alias("bd_rate"), r6("bd_accuracy").alias("bd_accuracy"))


@query("d21_gap_rule", f"""WITH {DUCK_SHARDED},
preferred AS (SELECT codec, CASE WHEN bool_or(method = 'sandwich+'||codec) THEN 'sandwich+' ELSE 'prep+' END||codec AS method
  FROM (VALUES ('h264'), ('h265')) c(codec), merged GROUP BY codec),
gaps AS (SELECT codec, p.method, t.quality - a.quality AS gap FROM preferred p JOIN merged t USING (method)
  JOIN merged a ON a.method = p.codec AND a.qp = t.qp)
SELECT codec, method AS trial, {q6('min(gap)')} AS min_gap, min(gap) >= -0.05::DOUBLE AS pass, count(*) AS n_points
FROM gaps GROUP BY ALL""")
def d21(spark, sf):
    return V.gap_rule(merged_curves(spark, sf), BOTH).withColumn("min_gap", r6("min_gap"))


@query("d22_end_gaps", f"""WITH {DUCK_SHARDED},
both_ AS (SELECT a.method AS codec, a.qp, a.bpp AS bpp_a, t.bpp AS bpp_t, t.quality - a.quality AS gap FROM merged a
  JOIN merged t ON t.method = 'prep+'||a.method AND t.qp = a.qp)
SELECT codec, {q6('arg_min(gap, bpp_a)')} AS gap_first, {q6('arg_max(gap, bpp_a)')} AS gap_last,
  {q6('avg(abs(bpp_t - bpp_a)/bpp_a)')} AS rate_divergence FROM both_ GROUP BY codec""")
def d22(spark, sf):
    result = V.end_gaps(merged_curves(spark, sf), BOTH)
    return result.withColumns({n: r6(n) for n in ("gap_first", "gap_last", "rate_divergence")})


@query("d15_sequence_bd", f"""WITH {DUCK_METHODS},
shared AS (SELECT source_id, codec, qp FROM points WHERE method = codec INTERSECT
           SELECT source_id, codec, qp FROM points WHERE method = 'prep+'||codec),
usable AS (SELECT source_id, codec FROM shared GROUP BY ALL HAVING count(*) >= 2),
sides AS (SELECT source_id, codec, CASE WHEN method = codec THEN 'a' ELSE 't' END AS side, bpp AS rate, target_prob_a AS quality
  FROM points JOIN shared USING (source_id, codec, qp) JOIN usable USING (source_id, codec)
  WHERE method IN (codec, 'prep+'||codec)), {duck_bd('sides', 'source_id, codec')},
counted AS (SELECT source_id, codec, count(*) AS n_points FROM shared GROUP BY ALL)
SELECT source_id, codec, {q6('bd_rate')} AS bd_rate, {q6('bd_metric')} AS bd_accuracy, n_points
FROM bd JOIN counted USING (source_id, codec)""")
def d15(spark, sf):
    rows = V.sequence_deltas(methods(spark, sf), "source_id", "target_prob_a", BOTH, QPS)
    return rows.select("source_id", "codec", r6("bd_rate").alias("bd_rate"), r6("bd_accuracy").alias("bd_accuracy"), "n_points")
