"""Policies (G) and their grids."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from bitcurve.operators import grids
from bitcurve.operators import select as S
from bitcurve.operators.cells import to_cells
from workload.curves import q6, q8, r6, r8
from workload.fixtures import duck_measurements, measurements
from workload.registry import query

SLACK = ("bpp", "a_kl_source", "a_feature_distance", "a_source_confidence", "a_source_top1_agrees")
CROSS = ("b_kl_source", "b_feature_distance", "b_source_confidence", "b_source_top1_agrees")
RISK = ("risk_a", "risk_b")
PROB = ("bpp", "prob_a", "prob_b")
EVENTS = ("gain_a", "harm_a", "gain_b", "harm_b")
LOOSE = ("0.1D", "0.05D", "0.6D")
TIGHT = ("0.02D", "0.005D", "0.6D")
OUTCOMES = ("correct_a", "correct_b")


def cells(spark, sf, fields, keep=(), codecs=("h264",)):
    rows = measurements(spark, sf, *fields, *[k for k in keep if k != "p_brand"], codecs=codecs)
    return to_cells(rows, fields, keep=keep)


def with_base(frame, name="base_idx", limits=LOOSE):
    return frame.withColumn(name, F.expr(S.slack(*limits)))


def histogram(choices, *more):
    """Choice counts per policy and qp, with sums that pin the chosen rows."""
    return choices.groupBy("policy_id", "qp", "cand_idx", *more).agg(
        F.count(F.lit(1)).alias("n"), F.sum("source_id").alias("id_sum"), r6(F.sum("bpp")).alias("sum_bpp")
    )


HIST = f"""SELECT policy_id, qp, cand_idx, count(*) AS n, sum(source_id)::BIGINT AS id_sum,
  {q6('sum(bpp)')} AS sum_bpp FROM choice GROUP BY policy_id, qp, cand_idx"""
HIST_REASON = f"""SELECT policy_id, qp, cand_idx, reason, count(*) AS n, sum(source_id)::BIGINT AS id_sum,
  {q6('sum(bpp)')} AS sum_bpp FROM choice GROUP BY policy_id, qp, cand_idx, reason"""


def literal(value):
    if isinstance(value, tuple):
        return "[" + ", ".join(map(str, value)) + "]"
    if isinstance(value, str):
        return f"'{value}'"
    return "NULL::DOUBLE" if value is None else f"{value}::DOUBLE"


def duck_grid(names, rows, name="p"):
    values = ", ".join(f"({i}, " + ", ".join(map(literal, row)) + ")" for i, row in enumerate(rows))
    return f"{name}(policy_id, {', '.join(names)}) AS (VALUES {values})"


def product(*axes):
    return list(itertools.product(*axes))


def duck_wide(fields, codecs=("h264",)):
    """Rows with every field of the anchor (suffix _0) next to their own."""
    anchor = ", ".join(f"{c} AS {c}_0" for c in fields)
    return f"""{duck_measurements(*fields, codecs=codecs)},
anchor AS (SELECT source_id, codec, qp, {anchor} FROM m WHERE cand_idx = 0),
wide AS (SELECT * FROM m JOIN anchor USING (source_id, codec, qp))"""


def duck_v1(name, limits, source="wide"):
    kl, feature, confidence = (x.rstrip("D") for x in limits)
    return f"""{name} AS (SELECT * FROM {source}
  WHERE cand_idx = 0 OR (bpp < bpp_0 AND a_kl_source <= a_kl_source_0 + {kl}::DOUBLE
    AND a_feature_distance <= a_feature_distance_0 + {feature}::DOUBLE
    AND (a_source_confidence < {confidence}::DOUBLE OR a_source_top1_agrees))
  QUALIFY row_number() OVER (PARTITION BY source_id, codec, qp ORDER BY bpp, cand_idx) = 1)"""


def duck_based(fields, base="v1", name="based", prefix="b", source="wide"):
    """Rows with the fields of a base choice (suffix _b) next to their own."""
    cols = ", ".join(f"z.{c} AS {c}_{prefix}" for c in fields)
    return f"""{name} AS (SELECT w.*, z.cand_idx AS idx_{prefix}, {cols}
  FROM {source} w JOIN {base} z USING (source_id, codec, qp))"""


def duck_choice(feasible, order="bpp", source="wide", more=""):
    return f"""choice AS (SELECT policy_id, x.*{more} FROM {source} x CROSS JOIN p WHERE {feasible}
  QUALIFY row_number() OVER (PARTITION BY policy_id, source_id, codec, qp ORDER BY {order}, cand_idx) = 1)"""


def passes(model, kl, feature, confidence):
    return (
        f"({model}_kl_source <= {model}_kl_source_0 + {kl} AND {model}_feature_distance <= {model}_feature_distance_0"
        f" + {feature} AND ({model}_source_confidence < {confidence} OR {model}_source_top1_agrees))"
    )


PRIMARY = passes("a", "0.1::DOUBLE", "0.05::DOUBLE", "0.6::DOUBLE")
CROSS_OK = passes("b", "cross_kl", "cross_feature", "cross_confidence")

P_V1 = duck_grid(("kl_slack", "feature_slack"), product(grids.V1_KL, grids.V1_FEATURE))
DUAL_ROWS = [
    ("A" if mode == 0 else "B", kl, f, c, None, None)
    for (kl, f), c, mode in product(grids.CROSS_SLACKS, grids.CROSS_CONFIDENCES, (0, 1))
] + [("C", None, None, None, lo, hi) for lo, hi in product(grids.RISKS, grids.RISKS)]
DUAL_NAMES = ("mode", "cross_kl", "cross_feature", "cross_confidence", "risk_low_qp", "risk_high_qp")
P_DUAL = duck_grid(DUAL_NAMES, DUAL_ROWS)
BANDS = ("low_a", "low_b", "high_a", "high_b")
P_C3 = duck_grid(BANDS, product(grids.C3_LOW, grids.C3_LOW, grids.C3_HIGH, grids.C3_HIGH))
P_P4 = duck_grid(BANDS, product(*[grids.P4_THRESHOLDS] * 4))
P_V6 = duck_grid(("min_delta", "feature_weight"), product(grids.V6_DELTAS, grids.V6_WEIGHTS))
P_V7 = duck_grid(("threshold", "proxy_weight"), product(grids.V7_THRESHOLDS, grids.V7_WEIGHTS))
P_V11 = duck_grid(("tau", "slack", "qps"), product(grids.V11_TAUS, grids.V11_SLACKS, grids.V11_QP_SETS))
P_V12 = duck_grid(("tau", "slack", "qps"), product(grids.V12_TAUS, grids.V12_SLACKS, grids.V12_QP_SETS))
P_RISK = duck_grid(("ce_limit", "risk_limit"), product(grids.RISK_CE, grids.RISK_LIMITS))

# --- grids ----------------------------------------------------------------------------------
# Grids alone are parameters, not data; they are checked against the table that uses them: each
# query counts the measured cells a policy is evaluated on.


def grid_query(name, build, ctes, columns):
    @query(name, f"""WITH {ctes}, {duck_measurements()}
SELECT p.*{' REPLACE (array_to_string(qps, chr(44)) AS qps)' if 'qps' in columns else ''}, n_cells
FROM p, (SELECT count(*) AS n_cells FROM m WHERE cand_idx = 0)""")
    def run(spark, sf):
        n = measurements(spark, sf).filter("cand_idx = 0").agg(F.count(F.lit(1)).alias("n_cells"))
        grid = build(spark).select("policy_id", *columns)
        if "qps" in columns:
            grid = grid.withColumn("qps", F.array_join("qps", ","))
        return grid.crossJoin(F.broadcast(n))


grid_query("g20_grid_v1", grids.v1_grid, P_V1, ("kl_slack", "feature_slack"))
grid_query("g21_grid_dual", grids.dual_grid, P_DUAL, DUAL_NAMES)
grid_query("g22_grid_c3", grids.c3_grid, P_C3, BANDS)
grid_query("g23_grid_p4", grids.p4_grid, P_P4, BANDS)
grid_query("g24_grid_v6", grids.v6_grid, P_V6, ("min_delta", "feature_weight"))
grid_query("g25_grid_v7", grids.v7_grid, P_V7, ("threshold", "proxy_weight"))
grid_query("g27_grid_v11", grids.v11_grid, P_V11, ("tau", "slack", "qps"))
grid_query("g28_grid_v12", grids.v12_grid, P_V12, ("tau", "slack", "qps"))
grid_query("g29_grid_risk", grids.risk_grid, P_RISK, ("ce_limit", "risk_limit"))

V10_ROWS = product(range(3), grids.V10_QUANTILES, grids.V10_TAUS, grids.V10_SAVINGS, grids.V10_WEIGHTS)
P_V10 = f"""q10 AS (SELECT quantile_cont(complexity, {list(grids.V10_QUANTILES)}) AS t
         FROM (SELECT source_id, max(complexity) AS complexity FROM m GROUP BY ALL)),
{duck_grid(("complexity_quantile", "tau", "min_saving", "spatial_weight"),
           product(grids.V10_QUANTILES, grids.V10_TAUS, grids.V10_SAVINGS, grids.V10_WEIGHTS), name="p10")},
p AS (SELECT policy_id, complexity_quantile, t[CASE complexity_quantile WHEN 0.5 THEN 1 WHEN 0.75 THEN 2 ELSE 3 END]
        AS complexity_threshold, tau, min_saving, spatial_weight FROM p10, q10)"""


def source_complexity(frame):
    return frame.groupBy("source_id").agg(F.max("complexity").alias("complexity"))


@query("g26_grid_v10", f"""WITH {duck_measurements("complexity")}, {P_V10}
SELECT policy_id, complexity_quantile, {q6('complexity_threshold')} AS complexity_threshold, tau, min_saving,
  spatial_weight FROM p""")
def g26(spark, sf):
    return grids.v10_grid(source_complexity(measurements(spark, sf, "complexity"))).withColumn(
        "complexity_threshold", r6("complexity_threshold"))


# --- policies -------------------------------------------------------------------------------

@query("g1_fixed_candidate", f"""WITH {duck_measurements("bpp", "candidate")}
SELECT source_id, qp, cand_idx, candidate, {q8('bpp')} AS bpp FROM m WHERE cand_idx IN (0, 2)""")
def g1(spark, sf):
    c = cells(spark, sf, ("bpp",))
    both = [S.choose(c, S_rule) for S_rule in ("0", "2")]
    rows = both[0].unionByName(both[1])
    return rows.select("source_id", "qp", "cand_idx", F.expr(S.candidate_name()).alias("candidate"), r8("bpp").alias("bpp"))


@query("g2_slack_policy", f"""WITH {duck_wide(SLACK)}, {duck_v1("v1", LOOSE)}
SELECT source_id, qp, cand_idx, {q8('bpp')} AS bpp FROM v1""")
def g2(spark, sf):
    chosen = S.choose(cells(spark, sf, SLACK), S.slack(*LOOSE))
    return chosen.select("source_id", "qp", "cand_idx", r8("bpp").alias("bpp"))


@query("g2_slack_grid", f"""WITH {duck_wide(SLACK)}, {P_V1},
{duck_choice("cand_idx = 0 OR (bpp < bpp_0 AND " + passes("a", "kl_slack", "feature_slack", "0.6::DOUBLE") + ")")}
{HIST}""")
def g2_grid(spark, sf):
    return histogram(S.choose(cells(spark, sf, SLACK), S.slack(), grids.v1_grid(spark)))


@query("g3_cross_guard", f"""WITH {duck_wide(SLACK + CROSS)}, {duck_v1("v1", LOOSE)}, {P_DUAL},
choice AS (SELECT policy_id, source_id, codec, qp, CASE WHEN {CROSS_OK} THEN cand_idx ELSE 0 END AS cand_idx,
             CASE WHEN {CROSS_OK} THEN bpp ELSE bpp_0 END AS bpp FROM v1, p WHERE mode = 'A')
{HIST}""")
def g3(spark, sf):
    c = with_base(cells(spark, sf, SLACK + CROSS))
    return histogram(S.choose(c, S.guarded(), grids.dual_grid(spark).filter("mode = 'A'")))


@query("g4_both_analyzers", f"""WITH {duck_wide(SLACK + CROSS)}, {P_DUAL},
{duck_choice(f"mode = 'B' AND (cand_idx = 0 OR (bpp < bpp_0 AND {PRIMARY} AND {CROSS_OK}))")}
{HIST}""")
def g4(spark, sf):
    return histogram(S.choose(cells(spark, sf, SLACK + CROSS), S.both_pass(), grids.dual_grid(spark).filter("mode = 'B'")))


BAND = "(CASE WHEN qp <= 35 THEN {} ELSE {} END)"


@query("g5_learned_risk", f"""WITH {duck_wide(SLACK + RISK)}, {P_DUAL},
{duck_choice(f"mode = 'C' AND (cand_idx = 0 OR (bpp < bpp_0 AND {PRIMARY} AND greatest(risk_a, risk_b) <= "
             + BAND.format("risk_low_qp", "risk_high_qp") + "))")}
{HIST}""")
def g5(spark, sf):
    return histogram(S.choose(cells(spark, sf, SLACK + RISK), S.low_risk(), grids.dual_grid(spark).filter("mode = 'C'")))


C3_FEASIBLE = (f"cand_idx = 0 OR (bpp < bpp_0 AND {PRIMARY} AND risk_a <= {BAND.format('low_a', 'high_a')}"
               f" AND risk_b <= {BAND.format('low_b', 'high_b')})")


@query("g6_risk_per_analyzer", f"""WITH {duck_wide(SLACK + RISK)}, {P_C3}, {duck_choice(C3_FEASIBLE)} {HIST}""")
def g6(spark, sf):
    return histogram(S.choose(cells(spark, sf, SLACK + RISK), S.low_risk_per_model(), grids.c3_grid(spark)))


P4_OK = (f"prob_a - prob_a_0 >= {BAND.format('low_a', 'high_a')} AND prob_b - prob_b_0 >= "
         f"{BAND.format('low_b', 'high_b')}")


@query("g7_probability_gain", f"""WITH {duck_wide(PROB)}, {P_P4},
{duck_choice(f"cand_idx = 0 OR (bpp < bpp_0 AND {P4_OK})")} {HIST}""")
def g7(spark, sf):
    return histogram(S.choose(cells(spark, sf, PROB), S.probability(), grids.p4_grid(spark)))


AGREE = ("a_anchor_top1_agrees", "b_anchor_top1_agrees")
V5_FEASIBLE = f"cand_idx = 0 OR (bpp < bpp_0 AND a_anchor_top1_agrees AND b_anchor_top1_agrees AND {P4_OK})"


@query("g8_probability_agreement", f"""WITH {duck_wide(PROB + AGREE)}, {P_P4}, {duck_choice(V5_FEASIBLE)} {HIST}""")
def g8(spark, sf):
    return histogram(S.choose(cells(spark, sf, PROB + AGREE), S.probability_agreeing(), grids.p4_grid(spark)))


V6_FIELDS = SLACK + ("b_feature_distance",) + EVENTS
V6_FEASIBLE = "cand_idx = idx_b OR (gain_a - harm_a >= min_delta AND gain_b - harm_b >= min_delta)"
V6_ORDER = ("ln(bpp/bpp_b) + feature_weight*((a_feature_distance - a_feature_distance_b)"
            " + (b_feature_distance - b_feature_distance_b))/2")


@query("g9_residual", f"""WITH {duck_wide(V6_FIELDS)}, {duck_v1("v1", LOOSE)}, {duck_based(V6_FIELDS)}, {P_V6},
{duck_choice(V6_FEASIBLE, V6_ORDER, "based")} {HIST}""")
def g9(spark, sf):
    return histogram(S.choose(with_base(cells(spark, sf, V6_FIELDS)), S.residual(), grids.v6_grid(spark)))


@query("g10_label_oracle", f"""WITH {duck_wide(("bpp",) + OUTCOMES)}, p AS (SELECT 0 AS policy_id),
{duck_choice("(NOT correct_a_0 OR correct_a) AND (NOT correct_b_0 OR correct_b)")}
SELECT source_id, qp, cand_idx, {q8('bpp')} AS bpp FROM choice""")
def g10(spark, sf):
    chosen = S.choose(cells(spark, sf, ("bpp",) + OUTCOMES), S.label_oracle())
    return chosen.select("source_id", "qp", "cand_idx", r8("bpp").alias("bpp"))


V7_FIELDS = SLACK + EVENTS + ("proxy_error",)
V7_FEASIBLE = """cand_idx = idx_b OR (bpp <= bpp_0
    AND (gain_a - harm_a) - (gain_a_b - harm_a_b) >= threshold AND (gain_b - harm_b) - (gain_b_b - harm_b_b) >= threshold)"""
V7_ORDER = "ln(bpp/bpp_0) + proxy_weight*proxy_error"


@query("g11_transfer", f"""WITH {duck_wide(V7_FIELDS)}, {duck_v1("v1", LOOSE)}, {duck_based(V7_FIELDS)}, {P_V7},
{duck_choice(V7_FEASIBLE, V7_ORDER, "based")} {HIST}""")
def g11(spark, sf):
    return histogram(S.choose(with_base(cells(spark, sf, V7_FIELDS)), S.transfer(), grids.v7_grid(spark)))


SPATIAL = SLACK + ("proxy_error",)
GATE_FIELDS = ("bpp", "proxy_error")


def duck_pair(fields, extra=""):
    """One row per cell: anchor, tight base (suffix _b) and loose alternate (suffix _r)."""
    b = ", ".join(f"b.{c} AS {c}_b" for c in fields)
    r = ", ".join(f"r.{c} AS {c}_r" for c in fields)
    return f"""{duck_v1("tight", TIGHT)}, {duck_v1("loose", LOOSE)},
pair AS (SELECT b.source_id, b.codec, b.qp, {', '.join(f'b.{c}_0' for c in fields)}{extra}, b.cand_idx AS idx_b, {b},
                r.cand_idx AS idx_r, {r} FROM tight b JOIN loose r USING (source_id, codec, qp))"""


def admitted(s):
    excess = f"greatest(0, proxy_error_{s} - proxy_error_0)"
    return (f"(idx_{s} = 0 OR (1 - bpp_{s}/bpp_0 >= 0 AND {excess} <= tau*(CASE WHEN qp <= 35 THEN 1 ELSE 2 END)"
            f" AND (qp > 35 OR 1 - bpp_{s}/bpp_0 >= min_saving + spatial_weight*{excess})))")


def duck_gate(extra=()):
    return f"""{duck_wide(SPATIAL + ("complexity",) + extra)}, {P_V10}, {duck_pair(GATE_FIELDS, ", b.complexity")},
gate AS (SELECT *, {admitted('b')} AS ok_b, {admitted('r')} AS ok_r FROM pair, p),
fall AS (SELECT *, CASE WHEN ok_b THEN idx_b ELSE 0 END AS idx_f, CASE WHEN ok_b THEN bpp_b ELSE bpp_0 END AS bpp_f,
                CASE WHEN ok_b THEN proxy_error_b ELSE proxy_error_0 END AS err_f FROM gate),
gated AS (SELECT *, CASE WHEN qp <= 35 AND complexity > 0 AND complexity >= complexity_threshold THEN 'high_complexity_low_qp'
                    WHEN idx_r <> idx_f AND ok_r AND greatest(0, proxy_error_r - err_f) <= tau
                         AND ln(bpp_r/bpp_f) + spatial_weight*(proxy_error_r - err_f) < 0 THEN 'residual_admitted'
                    WHEN idx_f = idx_b THEN 'base_retained' ELSE 'guard_fallback' END AS reason FROM fall),
choice AS (SELECT policy_id, source_id, codec, qp, reason, bpp_0,
  CASE reason WHEN 'high_complexity_low_qp' THEN 0 WHEN 'residual_admitted' THEN idx_r ELSE idx_f END AS cand_idx,
  CASE reason WHEN 'high_complexity_low_qp' THEN bpp_0 WHEN 'residual_admitted' THEN bpp_r ELSE bpp_f END AS bpp,
  CASE reason WHEN 'high_complexity_low_qp' THEN proxy_error_0 WHEN 'residual_admitted' THEN proxy_error_r ELSE err_f END
    - proxy_error_0 AS excess
  FROM gated)"""


def gate_cells(spark, sf, extra=()):
    c = cells(spark, sf, SPATIAL + extra, keep=("complexity",))
    c = with_base(c, "base_idx", TIGHT)
    return with_base(c, "residual_idx", LOOSE)


@query("g12_spatial_gate", f"WITH {duck_gate()} {HIST_REASON}")
def g12(spark, sf):
    grid = grids.v10_grid(source_complexity(measurements(spark, sf, "complexity")))
    return histogram(S.choose_with_reason(gate_cells(spark, sf), S.spatial_gate(), grid), "reason")


def duck_rescue(extra=()):
    return f"""{duck_wide(SPATIAL + extra)}, {P_V11}, {duck_pair(GATE_FIELDS)},
swaps AS (SELECT *, idx_b <> idx_r AND list_contains(qps, qp) AND proxy_error_r - proxy_error_b > tau
    AND bpp_b <= (1 + slack)*bpp_r AND bpp_b <= bpp_0 AS swap FROM pair, p),
choice AS (SELECT policy_id, source_id, codec, qp, CASE WHEN swap THEN 'rescued' ELSE 'base_retained' END AS reason,
    CASE WHEN swap THEN idx_b ELSE idx_r END AS cand_idx, CASE WHEN swap THEN bpp_b ELSE bpp_r END AS bpp,
    idx_r AS idx_base, proxy_error_r - CASE WHEN swap THEN proxy_error_b ELSE proxy_error_r END AS reduction FROM swaps)"""


@query("g13_rescue", f"WITH {duck_rescue()} {HIST_REASON}")
def g13(spark, sf):
    c = with_base(with_base(cells(spark, sf, SPATIAL), "base_idx", LOOSE), "alternate_idx", TIGHT)
    return histogram(S.choose_with_reason(c, S.rescue(), grids.v11_grid(spark)), "reason")


def duck_rerank(pool, reason, extra=()):
    return f"""{duck_wide(SPATIAL + extra)}, {P_V12}, {duck_v1("v1", LOOSE)}, {duck_based(GATE_FIELDS)},
options AS (SELECT policy_id, x.*, idx_b = cand_idx AS stay FROM based x, p
  WHERE idx_b = cand_idx OR ({pool} AND list_contains(qps, qp)
    AND (proxy_error_b - proxy_error)/greatest(proxy_error_b, 1e-12) > tau
    AND bpp <= (1 + slack)*bpp_b AND bpp <= bpp_0)
  QUALIFY row_number() OVER (PARTITION BY policy_id, source_id, codec, qp ORDER BY stay, proxy_error, bpp, cand_idx) = 1),
choice AS (SELECT o.*, CASE WHEN NOT list_contains(qps, qp) THEN 'qp_out_of_set' WHEN stay THEN 'base_retained'
             ELSE '{reason}' END AS reason FROM options o JOIN p USING (policy_id))"""


@query("g14_rerank", f"WITH {duck_rerank('true', 'reranked')} {HIST_REASON}")
def g14(spark, sf):
    return histogram(
        S.choose_with_reason(with_base(cells(spark, sf, SPATIAL)), S.rerank(), grids.v12_grid(spark)), "reason")


@query("g14_identity_rescue", f"WITH {duck_rerank('cand_idx = 0', 'identity_rescue')} {HIST_REASON}")
def g14_identity(spark, sf):
    c = with_base(cells(spark, sf, SPATIAL))
    return histogram(S.choose_with_reason(c, S.rerank(pool="identity"), grids.v12_grid(spark)), "reason")


@query("g15_teacher", f"""WITH {duck_wide(("bpp", "ce_a", "correct_a"))}, p AS (SELECT 0 AS policy_id),
{duck_choice("cand_idx = 0 OR (bpp < bpp_0 AND ce_a - ce_a_0 <= 0.02::DOUBLE AND (NOT correct_a_0 OR correct_a))")}
SELECT source_id, qp, cand_idx, {q8('bpp')} AS bpp FROM choice""")
def g15(spark, sf):
    chosen = S.choose(cells(spark, sf, ("bpp", "ce_a", "correct_a")), S.teacher())
    return chosen.select("source_id", "qp", "cand_idx", r8("bpp").alias("bpp"))


RISK_FIELDS = ("bpp", "predicted_rate", "predicted_regret", "predicted_harm_logit")
RISK_FEASIBLE = ("cand_idx = 0 OR (predicted_rate < 0 AND predicted_regret <= ce_limit"
                 " AND 1/(1 + exp(-greatest(least(predicted_harm_logit, 30), -30))) <= risk_limit)")
RISK_ORDER = "cand_idx = 0, predicted_rate"


@query("g16_predicted_risk", f"""WITH {duck_wide(RISK_FIELDS)}, {P_RISK},
{duck_choice(RISK_FEASIBLE, RISK_ORDER)} {HIST}""")
def g16(spark, sf):
    return histogram(S.choose(cells(spark, sf, RISK_FIELDS), S.predicted_risk(), grids.risk_grid(spark)))


@query("g17_confidence_gate", f"""WITH {duck_measurements("bpp", "action_prob")},
{duck_grid(("min_confidence",), [(0.5,), (0.8,), (0.9,)])},
top AS (SELECT source_id, codec, qp, max(action_prob) AS top, arg_max(cand_idx, action_prob) AS idx FROM m GROUP BY ALL),
picked AS (SELECT policy_id, source_id, codec, qp, CASE WHEN top >= min_confidence THEN idx ELSE 0 END AS cand_idx FROM top, p),
choice AS (SELECT policy_id, m.* FROM picked JOIN m USING (source_id, codec, qp, cand_idx)) {HIST}""")
def g17(spark, sf):
    grid = grids.product_grid(spark, min_confidence=(0.5, 0.8, 0.9))
    return histogram(S.choose(cells(spark, sf, ("bpp", "action_prob")), S.confident_argmax(), grid))


LADDER = ("bpp", "a_source_top1_agrees", "a_source_top1_prob", "a_source_confidence")


@query("g18_retention_guard", f"""WITH {duck_wide(LADDER)}, {duck_grid(("retention",), [(0.5,), (0.8,), (0.95,)])},
rung AS (SELECT policy_id, source_id, qp, min(5 - cand_idx) FILTER (WHERE cand_idx > 0 AND a_source_top1_agrees
           AND a_source_top1_prob >= retention*a_source_confidence_0) AS rung FROM wide, p GROUP BY ALL)
SELECT policy_id, qp, coalesce(rung, -1) AS rung, count(*) AS n, sum(source_id)::BIGINT AS id_sum FROM rung GROUP BY ALL""")
def g18(spark, sf):
    grid = grids.product_grid(spark, retention=(0.5, 0.8, 0.95))
    rows = S.cross_policies(cells(spark, sf, LADDER), grid).withColumn("rung", F.expr(S.retention()))
    return rows.groupBy("policy_id", "qp", "rung").agg(
        F.count(F.lit(1)).alias("n"), F.sum("source_id").alias("id_sum"))
