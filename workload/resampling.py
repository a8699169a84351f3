"""Bootstrap (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitcurve.operators import bootstrap as B
from bitcurve.operators import select as S
from bitcurve.operators.cells import pick
from bitcurve.schema import QPS
from workload import selection as G
from workload.curves import q6, r6
from workload.fixtures import duck_bd, duck_measurements
from workload.registry import query

DRAWS = 2000
SEED = "20260924"
OUT = ("correct_a", "correct_b")
VALUES = ("bpp", "correct_a", "correct_b", "c0_bpp", "c0_correct_a", "c0_correct_b")


def chosen_rows(spark, sf, models=("a", "b"), codecs=("h264",)):
    """The slack policy's rows with their anchors."""
    outcomes = tuple(f"correct_{m}" for m in models)
    cells = G.cells(spark, sf, G.SLACK + outcomes, codecs=codecs)
    keep = ("c0_bpp",) + tuple(f"c0_{o}" for o in outcomes)
    return S.choose(cells, S.slack(*G.LOOSE), fields=("bpp",) + outcomes, keep=keep)


def policy_vs_identity(models=("a", "b")):
    return [("policy_vs_identity", m, "c0_bpp", f"c0_correct_{m}", "bpp", f"correct_{m}") for m in models]


def slack_intervals(spark, sf, models=("a", "b"), draws=DRAWS, method="multinomial", codecs=("h264",)):
    values = ["bpp", "c0_bpp"] + [f"{p}correct_{m}" for m in models for p in ("", "c0_")]
    keys = ["codec"] if len(codecs) > 1 else []
    wide = B.source_values(chosen_rows(spark, sf, models, codecs), values, QPS, keys=keys)
    sums = B.draw_sums(wide, B.wide_columns(values, QPS), draws, SEED, method, keys=keys)
    deltas = B.draw_deltas(sums, policy_vs_identity(models), QPS, keys=keys)
    return B.intervals(deltas, draws, method, keys=(*keys, "comparison", "model"))


def duck_picks(draws=DRAWS, source="SELECT DISTINCT source_id FROM m"):
    """Resampled sources, one row per pick."""
    return f"""pos AS (SELECT source_id, row_number() OVER (ORDER BY md5(source_id::VARCHAR), source_id) - 1 AS pos
  FROM ({source})),
picks AS (SELECT draw, ('0x'||substr(md5('{SEED}|'||draw||'|'||pos), 1, 15))::BIGINT % (SELECT count(*) FROM pos) AS pos
  FROM pos, (SELECT unnest(range(0, {draws})) AS draw)),
drawn AS (SELECT draw, source_id FROM picks JOIN pos USING (pos))"""


def duck_summary(keys="comparison, model", draws=DRAWS, method="multinomial", source="deltas"):
    return f"""summary AS (SELECT {keys}, metric, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.975) AS hi, avg(value) AS mean, avg((value < 0)::INT) AS p_lt_zero, count(value) AS valid_draws,
  {draws} AS requested_draws, '{method}' AS method
  FROM (SELECT {keys}, 'bd_rate' AS metric, bd_rate AS value FROM {source}
        UNION ALL SELECT {keys}, 'bd_accuracy_pp', 100*bd_metric FROM {source}) GROUP BY ALL)"""


def duck_slack(models=("a", "b")):
    """Arms (identity 'a', slack policy 't') of each source, qp and model."""
    fields = G.SLACK + tuple(f"correct_{m}" for m in models)
    parts = " UNION ALL ".join(
        f"SELECT source_id, codec, qp, '{m}' AS model, '{side}' AS side, bpp{z} AS bpp, correct_{m}{z} AS ok FROM v1"
        for m in models for side, z in (("t", ""), ("a", "_0")))
    return f"{G.duck_wide(fields)}, {G.duck_v1('v1', G.LOOSE)}, arms AS ({parts})"


def duck_intervals(models=("a", "b"), draws=DRAWS):
    return f"""{duck_slack(models)}, {duck_picks(draws)},
drawn_curve AS (SELECT draw, 'policy_vs_identity' AS comparison, model, side, qp, avg(bpp) AS rate, avg(ok::INT) AS quality
  FROM drawn JOIN arms USING (source_id) GROUP BY ALL),
{duck_bd('drawn_curve', 'draw, comparison, model', 'deltas')}, {duck_summary(draws=draws)}"""


CI_OUT = ("lo", "median", "hi", "mean", "p_lt_zero")
CI_SQL = ", ".join(f"{q6(n)} AS {n}" for n in CI_OUT)


def rounded(summary, keys=("comparison", "model", "metric")):
    return summary.select(*keys, *[r6(n).alias(n) for n in CI_OUT], "valid_draws", "requested_draws", "method")


@query("e1_source_bootstrap", f"""WITH {duck_intervals()}
SELECT comparison, model, metric, {CI_SQL}, valid_draws, requested_draws, method FROM summary""")
def e1(spark, sf):
    return rounded(slack_intervals(spark, sf))


@query("e1_poisson_bootstrap", f"""WITH {duck_slack()},
uniform AS (SELECT draw, source_id, ('0x'||substr(md5('{SEED}|'||draw||'|'||source_id), 1, 15))::BIGINT/1152921504606846976.0::DOUBLE AS u
  FROM (SELECT DISTINCT source_id FROM m), (SELECT unnest(range(0, {DRAWS})) AS draw)),
pmf AS (SELECT k, exp(-1)/gamma(k + 1) AS p FROM (SELECT unnest(range(0, 16)) AS k)),
cdf AS (SELECT k, sum(p) OVER (ORDER BY k) AS c FROM pmf),
weights AS (SELECT draw, source_id, count(*) AS w FROM uniform JOIN cdf ON u >= c GROUP BY ALL),
drawn_curve AS (SELECT draw, 'policy_vs_identity' AS comparison, model, side, qp, sum(w*bpp)/sum(w) AS rate,
    sum(w*ok::INT)/sum(w) AS quality FROM weights JOIN arms USING (source_id) GROUP BY ALL),
{duck_bd('drawn_curve', 'draw, comparison, model', 'deltas')}, {duck_summary(method='poisson')}
SELECT comparison, model, metric, {CI_SQL}, valid_draws, requested_draws, method FROM summary""")
def e1_poisson(spark, sf):
    return rounded(slack_intervals(spark, sf, method="poisson"))


# Arms side by side for shared resamples: identity, a fixed candidate, the policy.
ARMS = ("identity", "area112", "policy")


def three_arms(spark, sf):
    fields = ("bpp",) + OUT
    cells = G.with_base(G.cells(spark, sf, G.SLACK + OUT), "policy_idx", G.LOOSE)
    index = {"identity": "0", "area112": "1", "policy": "policy_idx"}
    return cells.select(
        "source_id", "codec", "qp", *[F.expr(f"{pick(index[a], f)} AS {a}_{f}") for a in ARMS for f in fields])


DUCK_THREE = f"""{duck_slack()},
three AS (SELECT source_id, qp, 'identity' AS arm, model, bpp, ok FROM arms WHERE side = 'a'
  UNION ALL SELECT source_id, qp, 'policy', model, bpp, ok FROM arms WHERE side = 't'
  UNION ALL SELECT source_id, qp, 'area112', 'a', bpp, correct_a FROM m WHERE cand_idx = 1
  UNION ALL SELECT source_id, qp, 'area112', 'b', bpp, correct_b FROM m WHERE cand_idx = 1)"""
THREE_PAIRS = (("policy", "identity"), ("area112", "identity"), ("policy", "area112"))


def pair_values(names):
    return ", ".join(f"('{t}_vs_{a}', '{t}', 't'), ('{t}_vs_{a}', '{a}', 'a')" for t, a in names)


@query("e2_shared_resamples", f"""WITH {DUCK_THREE}, {duck_picks()},
per_arm AS (SELECT draw, arm, model, qp, avg(bpp) AS rate, avg(ok::INT) AS quality FROM drawn JOIN three USING (source_id)
  GROUP BY ALL),
drawn_curve AS (SELECT draw, comparison, model, side, qp, rate, quality FROM per_arm
  JOIN (VALUES {pair_values(THREE_PAIRS)}) c(comparison, arm, side) USING (arm)),
{duck_bd('drawn_curve', 'draw, comparison, model', 'deltas')}, {duck_summary()}
SELECT comparison, model, metric, {CI_SQL}, valid_draws, requested_draws, method FROM summary""")
def e2(spark, sf):
    values = [f"{a}_{f}" for a in ARMS for f in ("bpp",) + OUT]
    wide = B.source_values(three_arms(spark, sf), values, QPS)
    sums = B.draw_sums(wide, B.wide_columns(values, QPS), DRAWS, SEED)
    pairs = [(f"{t}_vs_{a}", m, f"{a}_bpp", f"{a}_correct_{m}", f"{t}_bpp", f"{t}_correct_{m}")
             for t, a in THREE_PAIRS for m in ("a", "b")]
    return rounded(B.intervals(B.draw_deltas(sums, pairs, QPS), DRAWS, "multinomial"))


# Per-sequence points of three methods per codec, some (source, qp) points missing.
METHODS = ("plain", "prep", "sandwich")
POINT_FIELDS = ("bpp", "correct_a")
PRESENT = "(source_id*7 + qp) % 11 <> 0"


def sequence_points(spark, sf):
    cells = G.cells(spark, sf, POINT_FIELDS, codecs=("h264", "h265")).filter(PRESENT)
    return cells.select("source_id", "codec", "qp", *[
        F.expr(f"c{i}_{f} AS {method}_{f}") for i, method in enumerate(METHODS) for f in POINT_FIELDS])


@query("e3_clip_bootstrap", f"""WITH {duck_measurements(*POINT_FIELDS, codecs=("h264", "h265"))}, {duck_picks()},
points AS (SELECT source_id, codec, qp, CASE cand_idx WHEN 0 THEN 'plain' WHEN 1 THEN 'prep' ELSE 'sandwich' END AS method,
  bpp, correct_a AS ok FROM m WHERE cand_idx <= 2 AND {PRESENT}),
per_arm AS (SELECT draw, codec, method, qp, avg(bpp) AS rate, avg(ok::INT) AS quality FROM drawn JOIN points USING (source_id)
  GROUP BY ALL),
drawn_curve AS (SELECT draw, codec, comparison, 'a' AS model, side, qp, rate, quality FROM per_arm
  JOIN (VALUES ('prep', 'prep', 't'), ('prep', 'plain', 'a'), ('sandwich', 'sandwich', 't'), ('sandwich', 'plain', 'a'))
    c(comparison, method, side) USING (method)
  QUALIFY count(*) FILTER (WHERE side = 'a') OVER (PARTITION BY draw, codec, comparison) >= 4),
{duck_bd('drawn_curve', 'draw, codec, comparison, model', 'deltas')}, {duck_summary('codec, comparison, model')},
enough AS (SELECT count(*) >= 20 AS ok FROM pos)
SELECT codec, comparison, {q6('mean')} AS mean, {q6('lo')} AS lo, {q6('hi')} AS hi, {q6('p_lt_zero')} AS p_lt_zero,
  valid_draws FROM summary, enough WHERE metric = 'bd_rate' AND ok""")
def e3(spark, sf):
    values = [f"{m}_{f}" for m in METHODS for f in POINT_FIELDS]
    wide = B.source_values(sequence_points(spark, sf), values, QPS, keys=["codec"])
    sums = B.draw_sums(wide, B.wide_columns(values, QPS), DRAWS, SEED, keys=["codec"])
    pairs = [(m, "a", "plain_bpp", "plain_correct_a", f"{m}_bpp", f"{m}_correct_a") for m in METHODS[1:]]
    summary = B.intervals(B.draw_deltas(sums, pairs, QPS, keys=["codec"], min_points=4), DRAWS, "multinomial",
                          keys=("codec", "comparison", "model"))
    enough = wide.agg((F.count_distinct("source_id") >= 20).alias("_enough"))
    summary = summary.crossJoin(F.broadcast(enough)).filter("metric = 'bd_rate' AND _enough")
    return summary.select("codec", "comparison", *[r6(n).alias(n) for n in ("mean", "lo", "hi", "p_lt_zero")], "valid_draws")


@query("e5_paired_mean_bootstrap", f"""WITH {G.duck_wide(G.SPATIAL)}, {G.duck_v1("v1", G.LOOSE)}, {duck_picks()},
paired AS (SELECT source_id, avg(proxy_error - proxy_error_0) AS v FROM v1 GROUP BY ALL),
per_draw AS (SELECT draw, avg(v) AS mean FROM drawn JOIN paired USING (source_id) GROUP BY ALL)
SELECT {q6('(SELECT avg(v) FROM paired)')} AS point, {q6('quantile_cont(mean, 0.025)')} AS lo,
  {q6('quantile_cont(mean, 0.975)')} AS hi, count(mean) AS valid_draws, {DRAWS} AS requested_draws FROM per_draw""")
def e5(spark, sf):
    chosen = S.choose(G.cells(spark, sf, G.SPATIAL), S.slack(*G.LOOSE), fields=("proxy_error",), keep=("c0_proxy_error",))
    paired = chosen.groupBy("source_id").agg(F.expr("avg(proxy_error - c0_proxy_error) AS v"))
    point = paired.agg(r6(F.avg("v")).alias("point"))
    ci = B.mean_interval(paired, "v", DRAWS, SEED)
    return F.broadcast(point).crossJoin(ci).select("point", r6("lo").alias("lo"), r6("hi").alias("hi"), "valid_draws",
                                      "requested_draws")


@query("e6_single_analyzer", f"""WITH {duck_intervals(("c",))},
point_curve AS (SELECT model, side, qp, avg(bpp) AS rate, avg(ok::INT) AS quality FROM arms GROUP BY ALL),
{duck_bd('point_curve', 'model', 'point')}
SELECT model, metric, {q6("CASE metric WHEN 'bd_rate' THEN bd_rate ELSE 100*bd_metric END")} AS point, {q6('lo')} AS lo,
  {q6('hi')} AS hi, valid_draws, requested_draws FROM summary JOIN point USING (model)""")
def e6(spark, sf):
    from bitcurve.plans.calibrate import scores

    ci = slack_intervals(spark, sf, ("c",))
    point = scores(chosen_rows(spark, sf, ("c",)), ("c",), keys=("codec",)).select(
        "model", F.expr("stack(2, 'bd_rate', bd_rate, 'bd_accuracy_pp', 100*bd_accuracy) AS (metric, point)"))
    return F.broadcast(point).join(ci, ["model", "metric"]).select(
        "model", "metric", r6("point").alias("point"), r6("lo").alias("lo"), r6("hi").alias("hi"), "valid_draws",
        "requested_draws")


@query("e7_interval_validity", f"""WITH {duck_intervals()}
SELECT comparison, model, metric, valid_draws BETWEEN 0.95*requested_draws AND requested_draws AND isfinite(lo)
  AND isfinite(hi) AND lo <= hi AS valid FROM summary""")
def e7(spark, sf):
    return slack_intervals(spark, sf).select("comparison", "model", "metric", F.expr(B.ci_valid()).alias("valid"))


@query("e8_strict_bootstrap", f"""WITH {duck_intervals()}
SELECT model, metric, {q6('median')} AS median, {q6('lo')} AS lo, {q6('hi')} AS hi, valid_draws FROM summary""")
def e8(spark, sf):
    strict = B.require_valid(slack_intervals(spark, sf))
    return strict.select("model", "metric", *[r6(n).alias(n) for n in ("median", "lo", "hi")], "valid_draws")
