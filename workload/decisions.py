"""Calibration, gates and decisions (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitcurve.operators import grids
from bitcurve.operators import select as S
from bitcurve.plans import calibrate as C
from bitcurve.session import cut_lineage
from workload import selection as G
from workload.curves import q6, q8, r6, r8
from workload.fixtures import duck_bd, measurements
from workload.registry import query

MODELS = ("d", "e")
OUT = ("correct_d", "correct_e")
BASE = ("c0_bpp", "c0_correct_d", "c0_correct_e")


def scored(spark, sf, fields, rule, policies, means=(), base=False, codecs=("h264",)):
    """Scores of a policy table on the fixture; ``means`` are chosen fields averaged per policy."""
    cells = G.cells(spark, sf, tuple(dict.fromkeys(fields + OUT)), codecs=codecs)
    if base:
        cells = G.with_base(cells)
    chosen = S.choose(cells, rule, policies, fields=("bpp",) + OUT + tuple(means), keep=BASE)
    return C.scores(chosen, MODELS, means=means)


def duck_scores(means=(), name="score", choice="choice", models=("d", "e")):
    """Score CTEs over ``choice(policy_id, codec, qp, bpp, correct_*, bpp_0, correct_*_0)``."""
    extra = "".join(f", {m[1]} AS {m[0]}" for m in means)
    parts = "\n    UNION ALL ".join(
        f"SELECT policy_id, codec, qp, '{m}' AS model, '{side}' AS side, bpp{z} AS bpp, correct_{m}{z} AS ok FROM {choice}"
        for m in models for side, z in (("t", ""), ("a", "_0")))
    mean_cte = f"{name}_mean AS (SELECT policy_id, codec{extra} FROM {choice} GROUP BY ALL)," if means else ""
    join = f" JOIN {name}_mean USING (policy_id, codec)" if means else ""
    names = "".join(f", {m[0]}" for m in means)
    return f"""{name}_c AS (
  SELECT policy_id, codec, qp, model, side, avg(bpp) AS rate, avg(ok::INT) AS quality, count(*) AS n FROM (
    {parts}) GROUP BY ALL),
{duck_bd(f'{name}_c', 'policy_id, codec, model', f'{name}_bd')},
{name}_same AS (SELECT policy_id, codec, model, avg(t.rate/a.rate) AS rate_ratio, min(t.quality - a.quality) AS min_gap
  FROM {name}_c a JOIN {name}_c t USING (policy_id, codec, model, qp) WHERE a.side = 'a' AND t.side = 't' GROUP BY ALL),
{mean_cte}
{name} AS (SELECT policy_id, codec, model, bd_rate, bd_metric AS bd_accuracy, rate_ratio, min_gap{names}
  FROM {name}_bd JOIN {name}_same USING (policy_id, codec, model){join})"""


def duck_decide(predicate, also="true", names=(), source="score"):
    first = "".join(f", any_value({n}) AS {n}" for n in names)
    return f"""verdict AS (SELECT policy_id, codec, bool_and(coalesce({predicate}, false)) AND coalesce({also}, false) AS eligible,
    max(bd_rate) AS worst, sum(bd_rate) AS total{first} FROM {source} GROUP BY policy_id, codec{''.join(', ' + n for n in names)}),
decided AS (SELECT policy_id, codec, eligible, CASE WHEN eligible THEN worst END AS worst_bd_rate,
    CASE WHEN eligible THEN total END AS sum_bd_rate{''.join(', ' + n for n in names)} FROM verdict)"""


V1_ELIGIBLE = "bd_rate < 0 AND bd_accuracy >= 0 AND min_gap >= -0.01::DOUBLE AND rate_ratio < 1"
DUAL_ELIGIBLE = "bd_rate < 0 AND bd_accuracy > 0 AND min_gap >= -0.01::DOUBLE - 1e-12"

# --- choices of each grid as DuckDB CTEs ----------------------------------------------------
WITH_OUT = G.SLACK + OUT
DUCK_V1_GRID = f"""{G.duck_wide(WITH_OUT)}, {G.P_V1},
{G.duck_choice("cand_idx = 0 OR (bpp < bpp_0 AND " + G.passes("a", "kl_slack", "feature_slack", "0.6::DOUBLE") + ")")}"""

DUAL_FIELDS = G.SLACK + G.CROSS + G.RISK
_DUAL_OK = (f"(mode = 'B' AND {G.PRIMARY} AND {G.CROSS_OK}) OR (mode = 'C' AND {G.PRIMARY} AND greatest(risk_a, risk_b) <= "
            + G.BAND.format("risk_low_qp", "risk_high_qp") + ")"
            " OR (mode = 'A' AND cand_idx = idx_b AND " + G.CROSS_OK + ")")
DUCK_DUAL = f"""{G.duck_wide(DUAL_FIELDS + OUT)}, {G.duck_v1("v1", G.LOOSE)}, {G.duck_based(("bpp",))}, {G.P_DUAL},
{G.duck_choice(f"cand_idx = 0 OR (bpp < bpp_0 AND ({_DUAL_OK}))", source="based")}"""


def dual_scores(spark, sf, codecs=("h264",)):
    return scored(spark, sf, DUAL_FIELDS, S.dual(), grids.dual_grid(spark), base=True, codecs=codecs)


@query("h1_calibration_grid", f"""WITH {DUCK_DUAL}, {duck_scores()}
SELECT policy_id, model, {q6('bd_rate')} AS bd_rate, {q6('bd_accuracy')} AS bd_accuracy, {q6('rate_ratio')} AS rate_ratio,
  {q6('min_gap')} AS min_gap, coalesce({DUAL_ELIGIBLE}, false) AS ok FROM score""")
def h1(spark, sf):
    s = dual_scores(spark, sf)
    return s.select("policy_id", "model", *[r6(n).alias(n) for n in ("bd_rate", "bd_accuracy", "rate_ratio", "min_gap")],
                    F.expr(f"coalesce({C.DUAL_ELIGIBLE}, false)").alias("ok"))


@query("h2_eligible_v1", f"""WITH {DUCK_V1_GRID}, {duck_scores()}, s AS (SELECT * FROM score WHERE model = 'd'),
{duck_decide(V1_ELIGIBLE, source='s')}
SELECT codec, arg_min(policy_id, (worst_bd_rate, policy_id)) FILTER (WHERE eligible) AS policy_id,
  count(*) FILTER (WHERE eligible) AS n_eligible, count(*) AS n_policies FROM decided GROUP BY codec""")
def h2(spark, sf):
    s = scored(spark, sf, G.SLACK, S.slack(), grids.v1_grid(spark)).filter("model = 'd'")
    return C.best(C.decide(s, C.V1_ELIGIBLE), ["worst_bd_rate"])


@query("h3_eligible_dual", f"""WITH {DUCK_DUAL}, {duck_scores()}, {duck_decide(DUAL_ELIGIBLE)},
armed AS (SELECT d.*, mode AS arm FROM decided d JOIN p USING (policy_id) UNION ALL SELECT *, 'all' FROM decided)
SELECT codec, arm, arg_min(policy_id, (worst_bd_rate, policy_id)) FILTER (WHERE eligible) AS policy_id,
  count(*) FILTER (WHERE eligible) AS n_eligible, count(*) AS n_policies FROM armed GROUP BY ALL""")
def h3(spark, sf):
    d = C.decide(dual_scores(spark, sf), C.DUAL_ELIGIBLE)
    modes = grids.dual_grid(spark).select("policy_id", "mode")
    armed = d.join(F.broadcast(modes), "policy_id").withColumn("arm", F.explode(F.array("mode", F.lit("all"))))
    return C.best(armed, ["worst_bd_rate"], keys=("codec", "arm"))


# Old policy of the comparisons: both risks below .05 at low and .10 at high qp.
OLD_FIELDS = G.SLACK + G.RISK
OLD_POLICY = {"low_a": (0.05,), "low_b": (0.05,), "high_a": (0.10,), "high_b": (0.10,)}
DUCK_OLD = f"""old_choice AS (SELECT 0 AS policy_id, x.* FROM wide x
  WHERE cand_idx = 0 OR (bpp < bpp_0 AND {G.PRIMARY}
    AND greatest(risk_a, risk_b) <= CASE WHEN qp <= 35 THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END)
  QUALIFY row_number() OVER (PARTITION BY source_id, codec, qp ORDER BY bpp, cand_idx) = 1)"""


def old_scores(spark, sf, means=(), fields=OLD_FIELDS):
    policy = grids.product_grid(spark, **OLD_POLICY)
    return scored(spark, sf, tuple(dict.fromkeys(fields + OLD_FIELDS)), S.low_risk_per_model(), policy, means=means)


@query("h4_promotion", f"""WITH {G.duck_wide(OLD_FIELDS + OUT)}, {G.P_C3}, {G.duck_choice(G.C3_FEASIBLE)}, {DUCK_OLD},
{duck_scores()}, {duck_scores(name='old', choice='old_choice')}, {duck_decide(DUAL_ELIGIBLE)},
best AS (SELECT codec, arg_min(policy_id, (worst_bd_rate, sum_bd_rate, policy_id)) FILTER (WHERE eligible) AS policy_id
  FROM decided GROUP BY codec)
SELECT codec, policy_id, coalesce(max(s.bd_rate) <= max(o.bd_rate) - 1 AND bool_and(s.bd_rate <= o.bd_rate + 0.5), false)
  AS promoted, {q6('max(s.bd_rate)')} AS worst_bd_rate, {q6('max(o.bd_rate)')} AS old_worst_bd_rate
FROM best b LEFT JOIN score s USING (codec, policy_id) LEFT JOIN old o USING (codec, model) GROUP BY codec, policy_id""")
def h4(spark, sf):
    s = scored(spark, sf, OLD_FIELDS, S.low_risk_per_model(), grids.c3_grid(spark))
    result = C.promoted(C.decide(s, C.DUAL_ELIGIBLE), s, old_scores(spark, sf))
    return result.withColumns({n: r6(n) for n in ("worst_bd_rate", "old_worst_bd_rate")})


def near(slack):
    return f"bd_rate <= base_bd_rate + {slack} AND bd_accuracy > 0 AND min_gap >= -0.01::DOUBLE"


def duck_based_score(names=(), base="old"):
    more = "".join(f", o.{n} AS base_{n}" for n in names)
    return f"scoreb AS (SELECT s.*, o.bd_rate AS base_bd_rate{more} FROM score s LEFT JOIN {base} o USING (codec, model))"


BEST = """SELECT codec, arg_min(policy_id, ({rank}, policy_id)) FILTER (WHERE eligible) AS policy_id,
  count(*) FILTER (WHERE eligible) AS n_eligible, count(*) AS n_policies FROM decided GROUP BY codec"""


@query("h5_feasible_near_baseline", f"""WITH {G.duck_wide(OLD_FIELDS + G.PROB[1:] + G.AGREE + OUT)}, {G.P_P4},
{G.duck_choice(G.V5_FEASIBLE)}, {DUCK_OLD}, {duck_scores()}, {duck_scores(name='old', choice='old_choice')},
{duck_based_score()}, {duck_decide(near(1), source='scoreb')} {BEST.format(rank='worst_bd_rate, sum_bd_rate')}""")
def h5(spark, sf):
    s = scored(spark, sf, G.PROB + G.AGREE, S.probability_agreeing(), grids.p4_grid(spark))
    d = C.decide(C.with_baseline(s, old_scores(spark, sf)), C.NEAR_BASELINE.format(slack=1.0))
    return C.best(d, ["worst_bd_rate", "sum_bd_rate"])


# From here on the base choice (loose slack policy) is the baseline.
V1_POLICY = "v1_choice AS (SELECT 0 AS policy_id, * FROM v1)"
DIST = ("(avg(a_feature_distance) + avg(b_feature_distance))/2",)


def slack_scores(spark, sf, fields, means=()):
    one = grids.product_grid(spark, unused=(0,))
    return scored(spark, sf, tuple(dict.fromkeys(G.SLACK + fields)), S.slack(*G.LOOSE), one, means=means)


def scored_with_base(spark, sf, fields, rule, policies, means=()):
    """Scores of a policy table, and those of the base choice, which is one more policy: cells are made once."""
    known = policies.unionByName(spark.range(1).selectExpr("-1 AS policy_id"), allowMissingColumns=True)
    either = S.Rule(f"CASE WHEN policy_id = -1 THEN base_idx ELSE {rule} END", rule.terms)
    # A few rows, read twice.
    both = cut_lineage(scored(spark, sf, fields, either, known, means=means, base=True))
    return both.filter("policy_id >= 0"), both.filter("policy_id = -1")


DISTANCES = ("a_feature_distance", "b_feature_distance")


def with_distance(s):
    return s.withColumn("distance", F.expr("(a_feature_distance + b_feature_distance)/2"))


@query("h6_feasible_lower_distance", f"""WITH {G.duck_wide(G.V6_FIELDS + OUT)}, {G.duck_v1("v1", G.LOOSE)},
{G.duck_based(G.V6_FIELDS)}, {G.P_V6}, {G.duck_choice(G.V6_FEASIBLE, G.V6_ORDER, "based")}, {V1_POLICY},
{duck_scores(means=[('distance', DIST[0])])}, {duck_scores(means=[('distance', DIST[0])], name='old', choice='v1_choice')},
{duck_based_score(('distance',))}, {duck_decide(near(1), 'any_value(distance < base_distance)', ('distance',), 'scoreb')}
{BEST.format(rank='distance, worst_bd_rate, sum_bd_rate')}""")
def h6(spark, sf):
    s, old = scored_with_base(spark, sf, G.V6_FIELDS, S.residual(), grids.v6_grid(spark), means=DISTANCES)
    rows = C.with_baseline(with_distance(s), with_distance(old), extra=("distance",))
    d = C.decide(rows, C.NEAR_BASELINE.format(slack=1.0), also="distance < base_distance", carry=("distance", "base_distance"))
    return C.best(d, ["distance", "worst_bd_rate", "sum_bd_rate"])


PROXY = [("proxy_error_mean", "avg(proxy_error)")]
H7_SQL = near(1) + " AND bd_rate < -10"


@query("h7_feasible_lower_proxy", f"""WITH {G.duck_wide(G.V7_FIELDS + OUT)}, {G.duck_v1("v1", G.LOOSE)},
{G.duck_based(G.V7_FIELDS)}, {G.P_V7}, {G.duck_choice(G.V7_FEASIBLE, G.V7_ORDER, "based")}, {V1_POLICY},
{duck_scores(means=PROXY)}, {duck_scores(means=PROXY, name='old', choice='v1_choice')}, {duck_based_score(('proxy_error_mean',))},
{duck_decide(H7_SQL, 'any_value(proxy_error_mean < base_proxy_error_mean)', ('proxy_error_mean',), 'scoreb')}
{BEST.format(rank='proxy_error_mean, worst_bd_rate, sum_bd_rate')}""")
def h7(spark, sf):
    s, old = scored_with_base(spark, sf, G.V7_FIELDS, S.transfer(), grids.v7_grid(spark), means=("proxy_error",))
    rows = C.with_baseline(s, old, extra=("proxy_error",))
    predicate = C.NEAR_BASELINE.format(slack=1.0) + " AND bd_rate < -10"
    d = C.decide(rows, predicate, also="proxy_error < base_proxy_error", carry=("proxy_error", "base_proxy_error"))
    return C.best(d, ["proxy_error", "worst_bd_rate", "sum_bd_rate"])


SPATIAL_SQL = "bd_rate < -10 AND bd_accuracy > 0 AND min_gap >= -0.01::DOUBLE - 1e-12"
OUTCOMES_OF = """chosen AS (SELECT c.*, o.correct_d, o.correct_e, o.correct_d_0, o.correct_e_0, o.bpp_0 FROM choice c
  JOIN wide o USING (source_id, codec, qp, cand_idx))"""


@query("h8_feasible_spatial_gate", f"""WITH {G.duck_gate(OUT)}, {OUTCOMES_OF},
{duck_scores(means=[('excess_mean', 'avg(greatest(0, excess))')], choice='chosen')},
{duck_decide(SPATIAL_SQL, names=('excess_mean',))}
SELECT policy_id, eligible, {q6('worst_bd_rate')} AS worst_bd_rate, {q8('excess_mean')} AS excess FROM decided""")
def h8(spark, sf):
    d = gate_decided(spark, sf)[1]
    return d.select("policy_id", "eligible", r6("worst_bd_rate").alias("worst_bd_rate"), r8("excess").alias("excess"))


def gate_decided(spark, sf):
    """The grid of spatial gates and the verdict on each policy."""
    grid = grids.v10_grid(G.source_complexity(measurements(spark, sf, "complexity")))
    chosen = S.choose_with_reason(G.gate_cells(spark, sf, OUT), S.spatial_gate(), grid,
                                  fields=("bpp", "proxy_error") + OUT, keep=BASE + ("c0_proxy_error",))
    chosen = chosen.withColumn("excess", F.expr("greatest(0D, proxy_error - c0_proxy_error)"))
    return grid, C.decide(C.scores(chosen, MODELS, means=("excess",)), C.SPATIAL_FEASIBLE, carry=("excess",))


# Policies that choose alike differ in the last bits of their sums; the grid's order, which is that of the parameters, decides.
GATE_RANK = ("round(excess, 12)", "round(worst_bd_rate, 9)", "round(sum_bd_rate, 9)")
GATE_PARAMETERS = ("complexity_quantile", "tau", "min_saving", "spatial_weight")


@query("h8_spatial_winner", f"""WITH {G.duck_gate(OUT)}, {OUTCOMES_OF},
{duck_scores(means=[('excess', 'avg(greatest(0, excess))')], choice='chosen')},
{duck_decide(SPATIAL_SQL, names=('excess',))},
winner AS ({BEST.format(rank=', '.join(GATE_RANK))})
SELECT w.*, {', '.join(GATE_PARAMETERS)} FROM winner w LEFT JOIN p ON p.policy_id = w.policy_id""")
def h8_winner(spark, sf):
    """The one policy that is confirmed: least mean excess, then worst and summed rate, then parameters."""
    grid, decided = gate_decided(spark, sf)
    return C.best(decided, GATE_RANK).join(F.broadcast(grid.select("policy_id", *GATE_PARAMETERS)), "policy_id", "left")


RESCUE_SQL = SPATIAL_SQL + " AND bd_rate <= base_bd_rate + 1"
REDUCTION = [("reduction", "avg(reduction)"), ("switches", "count(*) FILTER (WHERE cand_idx <> idx_base)")]
RANK9 = "-reduction, worst_bd_rate, sum_bd_rate, switches"


def moved(chosen, base_error="base_error"):
    """Proxy reduction and switch flag against the base choice."""
    return chosen.withColumns(
        {"reduction": F.expr(f"{base_error} - proxy_error"), "switched": F.expr("int(cand_idx <> base_idx)")}
    )


def with_switches(s):
    return s.withColumn("switches", F.expr("round(switched*n)"))


@query("h9_feasible_rescue", f"""WITH {G.duck_rescue(OUT)}, {OUTCOMES_OF}, v1_choice AS (SELECT 0 AS policy_id, * FROM loose),
{duck_scores(means=REDUCTION, choice='chosen')}, {duck_scores(name='old', choice='v1_choice')}, {duck_based_score()},
{duck_decide(RESCUE_SQL, 'any_value(reduction > 1e-6)', ('reduction', 'switches'), 'scoreb')} {BEST.format(rank=RANK9)}""")
def h9(spark, sf):
    cells = G.cells(spark, sf, G.SPATIAL + OUT)
    cells = G.with_base(G.with_base(cells, "base_idx", G.LOOSE), "alternate_idx", G.TIGHT)
    cells = cells.withColumn("base_error", F.expr(S.pick("base_idx", "proxy_error")))
    chosen = S.choose_with_reason(cells, S.rescue(), grids.v11_grid(spark), fields=("bpp", "proxy_error") + OUT,
                                  keep=BASE + ("base_idx", "base_error"))
    s = with_switches(C.scores(moved(chosen), MODELS, means=("reduction", "switched")))
    rows = C.with_baseline(s, slack_scores(spark, sf, ()))
    d = C.decide(rows, C.RESCUE_FEASIBLE.format(slack=1.0), also="reduction > 1e-6D", carry=("reduction", "switches"))
    return C.best(d, ["-reduction", "worst_bd_rate", "sum_bd_rate", "switches"])


RERANK_SQL = ("bd_rate < -10 AND bd_accuracy > 0 AND 100*min_gap >= -1 - 1e-9 AND bd_rate <= base_bd_rate + 2")
REDUCTION_LOW = [("reduction", "avg(proxy_error_b - proxy_error) FILTER (WHERE qp <= 40)"),
                 ("switches", "count(*) FILTER (WHERE cand_idx <> idx_b)")]


@query("h10_feasible_rerank", f"""WITH {G.duck_rerank('true', 'reranked', OUT)}, v1_choice AS (SELECT 0 AS policy_id, * FROM v1),
{duck_scores(means=REDUCTION_LOW)}, {duck_scores(name='old', choice='v1_choice')}, {duck_based_score()},
{duck_decide(RERANK_SQL, 'any_value(reduction > 1e-6)', ('reduction', 'switches'), 'scoreb')} {BEST.format(rank=RANK9)}""")
def h10(spark, sf):
    cells = G.with_base(G.cells(spark, sf, G.SPATIAL + OUT))
    cells = cells.withColumn("base_error", F.expr(S.pick("base_idx", "proxy_error")))
    chosen = S.choose_with_reason(cells, S.rerank(), grids.v12_grid(spark), fields=("bpp", "proxy_error") + OUT,
                                  keep=BASE + ("base_idx", "base_error"))
    chosen = moved(chosen).withColumn("reduction", F.expr("CASE WHEN qp <= 40 THEN reduction END"))
    rows = C.with_baseline(with_switches(C.scores(chosen, MODELS, means=("reduction", "switched"))), slack_scores(spark, sf, ()))
    d = C.decide(rows, C.RERANK_FEASIBLE.format(slack=2.0), also="reduction > 1e-6D", carry=("reduction", "switches"))
    return C.best(d, ["-reduction", "worst_bd_rate", "sum_bd_rate", "switches"])


TEACHER_FIELDS = G.RISK_FIELDS + ("ce_a", "ce_b", "correct_d", "correct_e")
DUCK_SAFETY = f"""{G.duck_wide(TEACHER_FIELDS)}, {G.P_RISK}, {G.duck_choice(G.RISK_FEASIBLE, G.RISK_ORDER)},
truth AS (SELECT policy_id, qp, cand_idx, ln(greatest(bpp, 1e-9)/greatest(bpp_0, 1e-9)) AS log_rate,
    greatest(ce_a - ce_a_0, ce_b - ce_b_0) AS regret,
    ((correct_d_0 AND NOT correct_d) OR (correct_e_0 AND NOT correct_e))::INT AS harm FROM choice),
per_qp AS (SELECT policy_id, qp, avg(harm) AS harm FROM truth GROUP BY ALL),
safety AS (SELECT policy_id, avg(harm) AS harm_rate, any_value(worst) AS worst_qp_harm_rate, avg(regret) AS mean_regret,
    avg(log_rate) AS mean_log_rate, count(*) FILTER (WHERE cand_idx <> 0) AS non_identity
  FROM truth JOIN (SELECT policy_id, max(harm) AS worst FROM per_qp GROUP BY ALL) USING (policy_id) GROUP BY policy_id)"""
SAFETY_OUT = ("harm_rate", "worst_qp_harm_rate", "mean_regret", "mean_log_rate")


def risk_safety(spark, sf):
    cells = G.cells(spark, sf, TEACHER_FIELDS)
    # What each candidate would do, once a cell; the 30 policies only pick from it.
    outcomes = {}
    for i in range(S.N):
        outcomes[f"c{i}_log_rate"] = F.expr(f"ln(greatest(c{i}_bpp, 1e-9D)/greatest(c0_bpp, 1e-9D))")
        outcomes[f"c{i}_regret"] = F.expr(f"greatest(c{i}_ce_a - c0_ce_a, c{i}_ce_b - c0_ce_b)")
        outcomes[f"c{i}_harm"] = F.expr(f"(c0_correct_d AND NOT c{i}_correct_d) OR (c0_correct_e AND NOT c{i}_correct_e)")
    chosen = S.choose(cells.withColumns(outcomes), S.predicted_risk(), grids.risk_grid(spark), fields=("log_rate", "regret", "harm"))
    return C.safety(chosen)


@query("d36_policy_safety", f"""WITH {DUCK_SAFETY} SELECT policy_id, {', '.join(f"{q6(n)} AS {n}" for n in SAFETY_OUT)},
  non_identity FROM safety""")
def d36(spark, sf):
    return risk_safety(spark, sf).select("policy_id", *[r6(n).alias(n) for n in SAFETY_OUT], "non_identity")


@query("h11_risk_limits", f"""WITH {DUCK_SAFETY}, ok AS (SELECT *, harm_rate <= 0.01::DOUBLE AND worst_qp_harm_rate <= 0.025::DOUBLE
  AND mean_regret <= 0.02::DOUBLE AS eligible FROM safety)
SELECT arg_min(policy_id, (mean_log_rate, policy_id)) FILTER (WHERE eligible AND mean_log_rate < -0.01::DOUBLE) AS policy_id,
  count(*) FILTER (WHERE eligible) AS n_eligible, count(*) AS n_policies FROM ok""")
def h11(spark, sf):
    return risk_safety(spark, sf).agg(
        F.expr(f"min_by(policy_id, struct(mean_log_rate, policy_id)) FILTER (WHERE {C.RISK_USABLE}) AS policy_id"),
        F.expr(f"count_if({C.RISK_ELIGIBLE}) AS n_eligible"),
        F.count(F.lit(1)).alias("n_policies"),
    )


@query("h12_dev_go", f"""WITH {G.duck_wide(OLD_FIELDS + G.PROB[1:] + OUT)}, {G.P_P4},
{G.duck_choice(f"cand_idx = 0 OR (bpp < bpp_0 AND {G.P4_OK})")}, {DUCK_OLD}, {duck_scores()},
{duck_scores(name='old', choice='old_choice')}, {duck_based_score()}
SELECT policy_id, codec, bool_and(coalesce(bd_rate < base_bd_rate AND bd_accuracy > 0 AND min_gap >= -0.01::DOUBLE, false)) AS go
FROM scoreb GROUP BY policy_id, codec""")
def h12(spark, sf):
    s = scored(spark, sf, G.PROB, S.probability(), grids.p4_grid(spark))
    d = C.decide(C.with_baseline(s, old_scores(spark, sf)), C.DEV_GO)
    return d.select("policy_id", "codec", F.col("eligible").alias("go"))
