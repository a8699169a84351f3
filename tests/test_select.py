import pytest
from pyspark.sql import functions as F

from bitcurve.operators import bootstrap as B
from bitcurve.operators import features as Z
from bitcurve.operators import grids
from bitcurve.operators import select as S
from bitcurve.operators.cells import to_cells
from workload import decisions, selection
from workload.fixtures import measurements

SF = "/root/testdata/sf0.001"
FIELDS = decisions.DUAL_FIELDS


def candidates(spark, *overrides):
    """One cell with six candidates, rates falling by a tenth each."""
    base = {"kl": 0.0, "feat": 0.0, "conf": 0.9, "agrees": True}
    rows = []
    for i in range(6):
        values = base | (overrides[i] if i < len(overrides) else {})
        rows.append(("s", "h264", 30, i, 1 - 0.1 * i, values["kl"], values["feat"], values["conf"], values["agrees"]))
    long = spark.createDataFrame(
        rows, "source_id STRING, codec STRING, qp INT, cand_idx INT, bpp DOUBLE, a_kl_source DOUBLE,"
        " a_feature_distance DOUBLE, a_source_confidence DOUBLE, a_source_top1_agrees BOOLEAN")
    return to_cells(long, selection.SLACK)


def choice(cells, rule):
    return S.choose(cells, rule).first()["cand_idx"]


def test_cheapest_feasible_candidate_wins(spark):
    rule = S.slack("0.1D", "0.05D")
    assert choice(candidates(spark), rule) == 5
    assert choice(candidates(spark, {}, {}, {}, {}, {}, {"kl": 0.2}), rule) == 4
    assert choice(candidates(spark, {}, *[{"agrees": False}] * 5), rule) == 0
    assert choice(candidates(spark, {}, *[{"agrees": False, "conf": 0.5}] * 5), rule) == 5


def test_ties_go_to_the_lowest_index(spark):
    cells = candidates(spark).withColumn("c4_bpp", F.col("c5_bpp"))
    assert choice(cells, S.slack("0.1D", "0.05D")) == 4


@pytest.mark.parametrize("rule,grid,fields", [
    (S.dual(), grids.dual_grid, FIELDS),
    (S.probability_agreeing(), grids.p4_grid, selection.PROB + selection.AGREE),
])
def test_outcomes_never_change_a_choice(spark, rule, grid, fields):
    """Flipping every outcome leaves all choices of the grid as they are, and the plan of the
    choice does not read an outcome column."""
    rows = measurements(spark, SF, *fields, "correct_a", "correct_b")
    flipped = rows.withColumns({c: ~F.col(c) for c in ("correct_a", "correct_b")})
    results = []
    for table in (rows, flipped):
        cells = to_cells(Z.observations_only(table, fields), fields)
        if fields == FIELDS:
            cells = selection.with_base(cells)
        chosen = S.choose(cells, rule, grid(spark)).select("policy_id", "source_id", "qp", "cand_idx")
        assert "correct" not in chosen._jdf.queryExecution().optimizedPlan().toString()
        results.append(chosen.agg(F.expr("sum(hash(policy_id, source_id, qp, cand_idx))"), F.count(F.lit(1))).first())
    assert results[0] == results[1]


def test_observations_reject_bad_input(spark):
    rows = measurements(spark, SF, "candidate", "bpp", *Z.signal_fields())
    assert not [c for c in Z.observations(rows).columns if c.startswith("correct")]
    for bad in ({"bpp": "-1D"}, {"a_entropy": "double('NaN')"}, {"candidate": "'other'"}):
        broken = rows.withColumns({c: F.expr(v) for c, v in bad.items()})
        with pytest.raises(Exception, match="invalid observation"):
            Z.observations(broken).collect()


def test_selection_needs_one_exchange(spark):
    """The narrow input is spread by source once; packing and selection add no exchange."""
    chosen = S.choose(selection.cells(spark, SF, selection.SLACK), S.slack(), grids.v1_grid(spark))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "p_retailprice" in plan and "p_name" not in plan and "p_type" not in plan


def test_bootstrap_weights_are_multinomial(spark):
    sources = spark.range(137).withColumnRenamed("id", "source_id")
    weights = B.image_weights(sources, 20, "seed", "source_id")
    per_draw = weights.groupBy("draw").agg(F.sum("w").alias("n")).collect()
    assert len(per_draw) == 20 and {r["n"] for r in per_draw} == {137}
    mean = weights.agg(F.sum("w")).first()[0] / (20 * 137)
    assert mean == 1


def test_bootstrap_of_identical_arms_is_zero(spark):
    rows = spark.range(60).select(
        F.col("id").alias("source_id"), F.explode(F.array(*map(F.lit, (30, 35, 40, 45, 50)))).alias("qp")
    ).selectExpr("source_id", "qp", "(60 - qp)/50D*(1 + source_id/100D) AS bpp", "double(source_id % 10 < (58 - qp) div 3) AS ok")
    wide = B.source_values(rows, ["bpp", "ok"], (30, 35, 40, 45, 50))
    sums = B.draw_sums(wide, B.wide_columns(["bpp", "ok"], (30, 35, 40, 45, 50)), 25, "z")
    ci = B.intervals(B.draw_deltas(sums, [("same", "m", "bpp", "ok", "bpp", "ok")], (30, 35, 40, 45, 50)), 25, "multinomial")
    rate = ci.filter("metric = 'bd_rate'").first()
    assert rate["valid_draws"] == 25 and rate["lo"] == rate["hi"] == 0
    with pytest.raises(Exception, match="too few defined draws"):
        B.require_valid(ci.withColumn("valid_draws", F.lit(3).cast("bigint"))).collect()


# --- incomplete and damaged measurements -------------------------------------------------------


def incomplete(spark, drop=None, **changes):
    """One cell of six candidates with falling rates; ``drop`` leaves one out, changes are (index, value)."""
    fields = ("bpp", "prob_a", "prob_b", "gain_a", "gain_b", "harm_a", "harm_b", "action_prob", "proxy_error")
    fields += ("a_feature_distance", "b_feature_distance")
    row = {"source_id": 1, "codec": "h264", "qp": 30, "base_idx": 0, "min_delta": 0.0, "threshold": 0.0}
    row |= {f"{side}_{m}": 0.0 for side in ("low", "high") for m in ("a", "b")}
    row |= {"feature_weight": 0.0, "proxy_weight": 0.0, "min_confidence": 0.0}
    for i in range(6):
        for name in fields:
            value = {"bpp": 1 - 0.1 * i, "gain_a": 1.0, "gain_b": 1.0}.get(name, 0.5)
            row[f"c{i}_{name}"] = None if i == drop else float(value)
        for outcome in ("correct_a", "correct_b"):
            row[f"c{i}_{outcome}"] = None if i == drop else True
    row |= {name: value for name, value in changes.items()}
    kinds = ", ".join(f"{k} {'string' if k == 'codec' else 'boolean' if 'correct' in k else 'int' if k in ('qp', 'base_idx') else 'bigint' if k == 'source_id' else 'double'}" for k in row)
    return spark.createDataFrame([tuple(row.values())], kinds)


RULES = {
    "probability": S.probability(),
    "residual": S.residual(),
    "transfer": S.transfer(),
    "oracle": S.label_oracle(),
    "confident": S.confident_argmax(),
}


@pytest.mark.parametrize("name", RULES)
def test_a_candidate_that_was_not_measured_is_never_chosen(spark, name):
    chosen = S.choose(incomplete(spark, drop=5), RULES[name], fields=("bpp",)).first()
    assert chosen.cand_idx != 5 and chosen.bpp is not None


@pytest.mark.parametrize("name,column", [("probability", "prob_a"), ("residual", "gain_b"), ("transfer", "gain_a")])
def test_nan_is_not_admitted(spark, name, column):
    assert S.choose(incomplete(spark), RULES[name]).first().cand_idx == 5
    assert S.choose(incomplete(spark, **{f"c5_{column}": float("nan")}), RULES[name]).first().cand_idx == 4


@pytest.mark.parametrize("rule,drop", [(S.slack("0.1D", "0.1D"), 0), ("3", 3)])
def test_missing_anchor_or_fixed_candidate_is_an_error(spark, rule, drop):
    cells = incomplete(spark, drop=drop)
    signals = ("kl_source", "feature_distance", "source_confidence")
    for i in range(6):
        for s in signals:
            cells = cells.withColumn(f"c{i}_a_{s}", F.lit(0.1))
        cells = cells.withColumn(f"c{i}_a_source_top1_agrees", F.lit(True))
    with pytest.raises(Exception, match="no measurement"):
        S.choose(cells, rule).collect()


def test_a_repeated_measurement_is_an_error(spark):
    rows = [(1, "h264", 30, i, 1.0 - i / 10) for i in range(6)]
    schema = "source_id long, codec string, qp int, cand_idx int, bpp double"
    assert to_cells(spark.createDataFrame(rows, schema), ("bpp",)).first().c5_bpp == 0.5
    with pytest.raises(Exception, match="measured twice"):
        to_cells(spark.createDataFrame([*rows, (1, "h264", 30, 2, 0.3)], schema), ("bpp",)).collect()
