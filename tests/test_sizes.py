"""What Spark knows of a table's size decides which joins are broadcast: exploded rows must count."""

from __future__ import annotations

from workload.fixtures import measurements
from workload.registry import table

SF = "/root/testdata/sf0.001"


def estimate(df) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_measurements_count_all_their_rows(spark):
    rows = measurements(spark, SF, "bpp", codecs=("h264", "h265"))
    parts = table(spark, SF, "part").count()
    assert rows.count() == parts * 60
    assert rows.select("codec", "qp", "cand_idx").distinct().count() == 60
    assert estimate(rows.select("source_id", "qp", "cand_idx", "bpp")) >= 60 * parts * 24


def test_grids_leave_no_method_that_the_jvm_interprets(spark):
    from bitcurve.operators import grids
    from bitcurve.operators import select as S
    from workload import selection as G

    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        for given, want in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(name, given)
            S.choose(G.cells(spark, SF, G.SLACK), S.slack(), grids.v1_grid(spark))
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_values_of_a_source_are_hashed_once_a_source(spark):
    rows = measurements(spark, SF, "correct_a", "a_source_margin", "a_kl_source")
    above, below = rows._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    # Seeds of a source below the join with the 30 offers, of a candidate above it.
    assert all(f"md5(cast(concat({seed}|," in below for seed in ("c0", "s", "sm"))
    assert above.count("md5(") == 2 and all(f"concat({seed}|," in above for seed in ("d0", "k"))


def test_terms_without_policies_are_computed_once_a_cell(spark):
    from bitcurve.operators import grids
    from bitcurve.operators import select as S
    from workload import selection as G

    for rule, grid, fields, term in (
        (S.residual(), grids.v6_grid(spark), G.V6_FIELDS, "ln("),
        (S.transfer(), grids.v7_grid(spark), G.V7_FIELDS, "ln("),
        (S.predicted_risk(), grids.risk_grid(spark), G.RISK_FIELDS, "EXP("),
    ):
        chosen = S.choose(G.with_base(G.cells(spark, SF, tuple(dict.fromkeys(G.SLACK + fields)))), rule, grid)
        spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
        try:
            above, below = chosen._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
        finally:
            spark.conf.unset("spark.sql.debug.maxToStringFields")
        assert term not in above and below.count(term) >= 5


def test_base_choice_is_scored_with_the_policies(spark, monkeypatch):
    from workload import decisions as D

    made = []
    cells = D.G.cells
    monkeypatch.setattr(D.G, "cells", lambda *a, **k: made.append(a) or cells(*a, **k))
    assert D.h7(spark, SF).count() == 1
    assert len(made) == 1
