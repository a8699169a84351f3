"""Selection policies: one candidate per cell, for all policies of a table at once.

A rule is Spark SQL over nothing but cell columns (``c2_bpp``, ...) and policy columns that gives the
chosen index. ``choose`` crosses the cells with the (small, size-checked) policy table and evaluates
the rule row by row: no exchange, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitcurve.operators.cells import argmin, field, pick
from bitcurve.schema import CANDIDATES, CELL, LOW_QP
from bitcurve.session import compiled_methods, within_broadcast_bound

N = len(CANDIDATES)
OTHERS = range(1, N)
MODELS = ("a", "b")
MAX_BROADCAST_POLICIES = 100_000


class Rule(str):
    """SQL of the chosen index whose ``terms`` are SQL over the cell alone, by the names the rule calls them.
    ``choose`` computes them once a cell, before policies multiply the rows."""

    terms: dict[str, str]

    def __new__(cls, sql: str, terms: dict[str, str]):
        rule = super().__new__(cls, sql)
        rule.terms = terms
        return rule


def cross_policies(cells: DataFrame, policies: DataFrame) -> DataFrame:
    """Cells x policies. A policy table is a parameter grid; beyond the checked bound it is not
    broadcast and Spark partitions both sides."""
    compiled_methods(cells.sparkSession)
    if within_broadcast_bound(policies, MAX_BROADCAST_POLICIES):
        policies = F.broadcast(policies)
    return cells.crossJoin(policies)


def _measured(rows: DataFrame, fields) -> DataFrame:
    """An error where the chosen candidate (the anchor, if nothing else passes) has no rate."""
    name = "bpp" if "c0_bpp" in rows.columns else next(iter(fields))
    missing = f"raise_error(concat('no measurement of candidate ', cand_idx, ' of ', {', '.join(CELL)}))"
    return rows.withColumn("cand_idx", F.expr(f"CASE WHEN {pick('cand_idx', name)} IS NULL THEN int({missing}) ELSE cand_idx END"))


def choose(cells: DataFrame, rule: str, policies: DataFrame | None = None, fields=("bpp",), keep=()) -> DataFrame:
    """(policy_id, source, codec, qp) -> chosen index and the chosen candidate's fields."""
    cells = cells.withColumns({name: F.expr(term) for name, term in getattr(rule, "terms", {}).items()})
    rows = cells if policies is None else cross_policies(cells, policies)
    ids = [] if policies is None else ["policy_id"]
    rows = _measured(rows.withColumn("cand_idx", F.expr(f"coalesce({rule}, 0)")), fields)
    return rows.select(
        *ids, *CELL, "cand_idx", *keep, *[F.expr(f"{pick('cand_idx', name)} AS {name}") for name in fields]
    )


def choose_with_reason(cells: DataFrame, rule: str, policies: DataFrame, fields=("bpp",), keep=()) -> DataFrame:
    """As ``choose``, for rules that give struct<idx, reason>."""
    rows = cross_policies(cells, policies).withColumn("_choice", F.expr(rule))
    rows = _measured(rows.withColumns({"cand_idx": F.col("_choice.idx"), "reason": F.col("_choice.reason")}), fields)
    return rows.select(
        "policy_id", *CELL, "cand_idx", "reason", *keep,
        *[F.expr(f"{pick('cand_idx', name)} AS {name}") for name in fields],
    )


def candidate_name(index: str = "cand_idx") -> str:
    cases = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(CANDIDATES))
    return f"CASE {index} {cases} END"


def cheapest(passes: Callable[[int], str], *, saving: bool = True) -> str:
    """Cheapest candidate that passes; the anchor always does."""
    feasible = ["true"]
    for i in OTHERS:
        cheaper = f"{field(i, 'bpp')} < {field(0, 'bpp')} AND " if saving else ""
        feasible.append(f"{cheaper}({passes(i)})")
    return argmin(feasible, [(field(i, "bpp"),) for i in range(N)])


def within_limits(i: int, model: str, kl, feature, confidence) -> str:
    """Task signals of one analyzer stay within slack of the anchor's."""
    c, a = f"c{i}_{model}", f"c0_{model}"
    return (
        f"({c}_kl_source <= {a}_kl_source + {kl} AND {c}_feature_distance <= {a}_feature_distance + {feature}"
        f" AND ({c}_source_confidence < {confidence} OR {c}_source_top1_agrees))"
    )


def by_band(low: str, high: str) -> str:
    return f"CASE WHEN qp <= {LOW_QP} THEN {low} ELSE {high} END"


CROSS = ("cross_kl", "cross_feature", "cross_confidence")
PRIMARY = ("0.1D", "0.05D", "0.6D")

# --- rules ----------------------------------------------------------------------------------


def slack(kl="kl_slack", feature="feature_slack", confidence="0.6D", model: str = "a") -> str:
    """Cheapest candidate within KL and feature slack of the anchor, keeping confident top-1s."""
    return cheapest(lambda i: within_limits(i, model, kl, feature, confidence))


def guarded(base: str = "base_idx", model: str = "b") -> str:
    """The base choice if a second analyzer also accepts it, else the anchor."""
    accepted = " ".join(f"WHEN {i} THEN {within_limits(i, model, *CROSS)}" for i in range(N))
    return f"CASE WHEN CASE {base} {accepted} END THEN {base} ELSE 0 END"


def both_pass(primary=PRIMARY) -> str:
    return cheapest(lambda i: f"{within_limits(i, 'a', *primary)} AND {within_limits(i, 'b', *CROSS)}")


def _risk_ok(i: int, model: str, limit: str) -> str:
    risk = field(i, f"risk_{model}")
    return f"coalesce(NOT isnan({risk}) AND {risk} <= {limit}, false)"


def low_risk(primary=PRIMARY) -> str:
    """Primary slack, and every learned risk below the threshold of the qp band."""
    limit = by_band("risk_low_qp", "risk_high_qp")
    return cheapest(
        lambda i: f"{within_limits(i, 'a', *primary)} AND " + " AND ".join(_risk_ok(i, m, limit) for m in MODELS)
    )


def dual(primary=PRIMARY, base: str = "base_idx") -> str:
    """All three modes of the dual-analyzer grid, by the policy's ``mode`` column."""
    return (
        f"CASE mode WHEN 'A' THEN {guarded(base)} WHEN 'B' THEN {both_pass(primary)}"
        f" WHEN 'C' THEN {low_risk(primary)} ELSE 0 END"
    )


def low_risk_per_model(primary=PRIMARY) -> str:
    return cheapest(
        lambda i: f"{within_limits(i, 'a', *primary)} AND "
        + " AND ".join(_risk_ok(i, m, by_band(f"low_{m}", f"high_{m}")) for m in MODELS)
    )


def at_least(value: str, limit: str) -> str:
    """``value >= limit``, false where the value is NULL or NaN (which Spark orders above all numbers)."""
    return f"coalesce(NOT isnan({value}) AND {value} >= {limit}, false)"


def _probability_kept(i: int) -> str:
    return " AND ".join(
        at_least(f"{field(i, f'prob_{m}')} - {field(0, f'prob_{m}')}", by_band(f"low_{m}", f"high_{m}")) for m in MODELS
    )


def probability() -> str:
    """Predicted correctness falls by no more than the threshold of analyzer and qp band."""
    return cheapest(_probability_kept)


def probability_agreeing() -> str:
    """As ``probability``, and both analyzers agree with the anchor's class."""
    return cheapest(
        lambda i: f"c{i}_a_anchor_top1_agrees AND c{i}_b_anchor_top1_agrees AND {_probability_kept(i)}"
    )


def _expected(i: int, model: str) -> str:
    return f"({field(i, f'gain_{model}')} - {field(i, f'harm_{model}')})"


def residual(base: str = "base_idx") -> str:
    """Move away from the base choice where expected gain minus harm allows it, by log-rate change
    plus weighted feature distance. The base itself is always admissible, with score 0."""
    rate = pick(base, "bpp")
    feasible, keys, terms = [], [], {}
    for i in range(N):
        terms[f"_rate{i}"] = f"ln({field(i, 'bpp')}/({rate}))"
        terms[f"_distance{i}"] = " + ".join(
            f"({field(i, f'{m}_feature_distance')} - {pick(base, f'{m}_feature_distance')})" for m in MODELS
        )
        terms |= {f"_value{i}_{m}": _expected(i, m) for m in MODELS}
        allowed = " AND ".join(at_least(f"_value{i}_{m}", "min_delta") for m in MODELS)
        feasible.append(f"{base} = {i} OR ({allowed})")
        keys.append((f"_rate{i} + feature_weight*_distance{i}/2",))
    return Rule(argmin(feasible, keys), terms)


def transfer(base: str = "base_idx") -> str:
    """Re-rank by log rate plus weighted proxy, admitting candidates whose expected value is not
    worse than the base's by more than the threshold and whose rate does not exceed the anchor's."""
    feasible, keys, terms = [], [], {}
    for i in range(N):
        terms[f"_rate{i}"] = f"ln({field(i, 'bpp')}/c0_bpp)"
        terms |= {f"_value{i}_{m}": f"{_expected(i, m)} - ({pick(base, f'gain_{m}')} - {pick(base, f'harm_{m}')})" for m in MODELS}
        allowed = " AND ".join(at_least(f"_value{i}_{m}", "threshold") for m in MODELS)
        feasible.append(f"{base} = {i} OR ({field(i, 'bpp')} <= c0_bpp AND {allowed})")
        keys.append((f"_rate{i} + proxy_weight*{field(i, 'proxy_error')}",))
    return Rule(argmin(feasible, keys), terms)


def keeps_correct(i: int, fields=("correct_a", "correct_b")) -> str:
    return " AND ".join(f"(NOT {field(0, f)} OR {field(i, f)})" for f in fields)


def label_oracle(fields=("correct_a", "correct_b")) -> str:
    """Cheapest candidate that loses no correct prediction. Uses outcomes: an upper reference only."""
    return cheapest(lambda i: keeps_correct(i, fields), saving=False)


def spatial_gate(base: str = "base_idx", alternate: str = "residual_idx") -> str:
    """Two-step gate: the anchor for complex sources at low qp; otherwise the base if admitted
    (else the anchor), replaced by the residual choice if that is admitted and lowers the cost.
    Gives struct<idx, reason>."""

    def admitted(index: str) -> str:
        excess = f"greatest(0D, {pick(index, 'proxy_error')} - c0_proxy_error)"
        saved = f"(1 - ({pick(index, 'bpp')})/c0_bpp)"
        return (
            f"({index} = 0 OR ({saved} >= 0 AND {excess} <= tau*(CASE WHEN qp <= {LOW_QP} THEN 1 ELSE 2 END)"
            f" AND (qp > {LOW_QP} OR {saved} >= min_saving + spatial_weight*{excess})))"
        )

    def outcome(fallback: str) -> str:
        change = f"({pick(alternate, 'proxy_error')} - {pick(fallback, 'proxy_error')})"
        cost = f"ln(({pick(alternate, 'bpp')})/({pick(fallback, 'bpp')})) + spatial_weight*{change}"
        return (
            f"CASE WHEN {alternate} <> {fallback} AND {admitted(alternate)} AND greatest(0D, {change}) <= tau"
            f" AND {cost} < 0 THEN named_struct('idx', {alternate}, 'reason', 'residual_admitted')"
            f" ELSE named_struct('idx', {fallback}, 'reason',"
            f" CASE WHEN {fallback} = {base} THEN 'base_retained' ELSE 'guard_fallback' END) END"
        )

    def guarded_base() -> str:
        return f"CASE WHEN {admitted(base)} THEN {outcome(base)} ELSE {outcome('0')} END"

    return (
        f"CASE WHEN qp <= {LOW_QP} AND complexity > 0 AND complexity >= complexity_threshold"
        f" THEN named_struct('idx', 0, 'reason', 'high_complexity_low_qp') ELSE {guarded_base()} END"
    )


def rescue(base: str = "base_idx", alternate: str = "alternate_idx") -> str:
    """Swap the base for the alternate where that lowers the distance enough at a bounded rate.
    The policy's ``qps`` column lists the quality points it applies to."""
    swap = (
        f"{alternate} <> {base} AND array_contains(qps, qp)"
        f" AND {pick(base, 'proxy_error')} - {pick(alternate, 'proxy_error')} > tau"
        f" AND {pick(alternate, 'bpp')} <= (1 + slack)*({pick(base, 'bpp')}) AND {pick(alternate, 'bpp')} <= c0_bpp"
    )
    return (
        f"CASE WHEN {swap} THEN named_struct('idx', {alternate}, 'reason', 'rescued')"
        f" ELSE named_struct('idx', {base}, 'reason', 'base_retained') END"
    )


def rerank(base: str = "base_idx", pool: str = "all") -> str:
    """Relative proxy gain above tau within rate slack, from the anchor only or from all
    candidates; best by (proxy, rate, index). Gives struct<idx, reason>."""
    error, rate = f"({pick(base, 'proxy_error')})", f"({pick(base, 'bpp')})"
    members = (0,) if pool == "identity" else range(N)
    feasible = [
        f"{base} <> {i} AND ({error} - {field(i, 'proxy_error')})/greatest({error}, 1e-12D) > tau"
        f" AND {field(i, 'bpp')} <= (1 + slack)*{rate} AND {field(i, 'bpp')} <= c0_bpp"
        for i in members
    ]
    best = argmin(feasible, [(field(i, "proxy_error"), field(i, "bpp")) for i in members])
    reason = "identity_rescue" if pool == "identity" else "reranked"
    return (
        f"CASE WHEN NOT array_contains(qps, qp) THEN named_struct('idx', {base}, 'reason', 'qp_out_of_set')"
        f" ELSE transform(array({best}), x -> CASE"
        f" WHEN x IS NULL THEN named_struct('idx', {base}, 'reason', 'base_retained')"
        f" ELSE named_struct('idx', x, 'reason', '{reason}') END)[0] END"
    )


def teacher(max_regret: str = "0.02D") -> str:
    """Cheapest candidate with bounded cross-entropy regret that keeps a correct prediction."""
    return cheapest(lambda i: f"c{i}_ce_a - c0_ce_a <= {max_regret} AND (NOT c0_correct_a OR c{i}_correct_a)")


def sigmoid(z: str, bound: str) -> str:
    return f"(1/(1 + exp(-greatest(least({z}, {bound}), -{bound}))))"


def predicted_risk() -> str:
    """Lowest predicted rate change among candidates predicted to save rate safely."""
    feasible = [f"c{i}_predicted_rate < 0 AND c{i}_predicted_regret <= ce_limit AND _harm{i} <= risk_limit" for i in OTHERS]
    terms = {f"_harm{i}": sigmoid(f"c{i}_predicted_harm_logit", "30D") for i in OTHERS}
    return Rule(argmin(feasible, [(field(i, "predicted_rate"),) for i in OTHERS], first=1), terms)


def confident_argmax() -> str:
    """Most probable action if its probability reaches the policy's confidence, else the anchor."""
    best = argmin(["true"] * N, [(f"-{field(i, 'action_prob')}",) for i in range(N)])
    top = ", ".join(field(i, "action_prob") for i in range(N))
    return f"CASE WHEN greatest({top}) >= min_confidence THEN {best} ELSE 0 END"


def first_passing(passing) -> str:
    """Index of the first rung that passes, or -1."""
    cases = " ".join(f"WHEN {ok} THEN {i}" for i, ok in enumerate(passing))
    return f"CASE {cases} ELSE -1 END"


def retention(model: str = "a") -> str:
    """First (strongest) rung of the ladder that keeps the source's class and a share of its
    probability, -1 for none. The ladder runs from the last candidate down to the first."""
    return first_passing(
        [
            f"c{i}_{model}_source_top1_agrees"
            f" AND c{i}_{model}_source_top1_prob >= retention*c0_{model}_source_confidence"
            for i in reversed(OTHERS)
        ]
    )
