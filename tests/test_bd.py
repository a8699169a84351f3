import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitcurve.functions import bd

CURVE = "ARRAY<STRUCT<rate: DOUBLE, quality: DOUBLE>>"


def pairs(spark, rows):
    return spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(rows)], f"id INT, a {CURVE}, t {CURVE}")


def by_polyfit(anchor, test, swap):
    fits, spans = [], []
    for curve in (anchor, test):
        r, q = np.array([c for c in curve if c[0] > 0 and all(map(math.isfinite, c))]).T
        x, y = (np.log(r), q) if swap else (q, np.log(r))
        order = min(3 if len(x) >= 4 else len(x) - 1, len(set(x)) - 1)
        fits.append(np.polyint(np.polyfit(x, y, order)))
        spans.append((x.min(), x.max()))
    lo, hi = max(s[0] for s in spans), min(s[1] for s in spans)
    area = [np.polyval(f, hi) - np.polyval(f, lo) for f in fits]
    mean = (area[1] - area[0]) / (hi - lo)
    return mean if swap else (math.exp(mean) - 1) * 100


def random_curve(rng, n):
    rates = sorted(rng.uniform(0.02, 1.0) for _ in range(n))
    base = rng.uniform(0.2, 0.3)
    return [(r, base + 0.2 * math.log(r / 0.02) + rng.uniform(-0.02, 0.02)) for r in rates]


def test_deltas_agree_with_polynomial_fits(spark):
    rng = random.Random(3)
    rows = [(random_curve(rng, n), random_curve(rng, n)) for n in (2, 3, 4, 5, 6, 9) for _ in range(40)]
    got = pairs(spark, rows).select("id", bd.bd_rate("a", "t").alias("r"), bd.bd_metric("a", "t").alias("m")).collect()
    checked = 0
    for row in got:
        anchor, test = rows[row["id"]]
        if row["r"] is not None and abs(row["r"]) < 1000:
            assert row["r"] == pytest.approx(by_polyfit(anchor, test, False), rel=1e-6, abs=1e-8)
            checked += 1
        if row["m"] is not None:
            assert row["m"] == pytest.approx(by_polyfit(anchor, test, True), rel=1e-6, abs=1e-8)
    assert checked > 150


ACC = [0.60, 0.68, 0.73, 0.76]
ANCHOR = list(zip([0.10, 0.20, 0.35, 0.60], ACC))


def test_identities_and_degenerate_curves(spark):
    cheaper = [(0.8 * r, q) for r, q in ANCHOR]
    cases = {
        "same": (ANCHOR, ANCHOR),
        "cheaper": (ANCHOR, cheaper),
        "one_bad_point": (ANCHOR, [(0.0, 0.6), *cheaper[1:]]),
        "flat": (ANCHOR, [(r, 0.7) for r, _ in ANCHOR]),
        "single": (ANCHOR, [(0.1, 0.7)]),
        "no_rate": (ANCHOR, [(0.0, q) for q in ACC]),
        "apart": (ANCHOR, [(r, q - 0.5) for r, q in ANCHOR]),
        "not_a_number": (ANCHOR, [(float("nan"), 0.6), *cheaper[1:]]),
    }
    rows = pairs(spark, list(cases.values())).select(
        "id", bd.bd_rate("a", "t").alias("r"), bd.bd_metric("a", "t").alias("m")).collect()
    got = {list(cases)[row["id"]]: (row["r"], row["m"]) for row in rows}
    assert got["same"] == (0.0, 0.0)
    assert got["cheaper"][0] == pytest.approx(-20) and got["cheaper"][1] > 0
    assert got["one_bad_point"][0] is not None and got["not_a_number"][0] is not None
    assert got["flat"][0] is None and got["flat"][1] is not None
    assert got["single"] == (None, None)
    assert got["no_rate"] == (None, None)
    assert got["apart"][0] is None


def test_quadratic_form_raises_without_overlap(spark):
    apart = pairs(spark, [(ANCHOR, [(r, q - 0.5) for r, q in ANCHOR])])
    with pytest.raises(Exception, match="do not overlap"):
        apart.select(bd.bd_rate_quadratic("a", "t")).collect()
    fine = pairs(spark, [(ANCHOR, [(0.8 * r, q) for r, q in ANCHOR])])
    row = fine.select(bd.bd_rate_quadratic("a", "t").alias("r"), bd.bd_quality_quadratic("a", "t").alias("q")).first()
    assert row["r"] == pytest.approx(-20) and row["q"] > 0


def test_pareto_score_rejects_negative_rates(spark):
    assert spark.range(1).select(bd.pareto_score("0.5D", "3D")).first()[0] == pytest.approx(0.5 - 0.15 * math.log(4))
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(bd.pareto_score("0.5D", "(id - 1D)")).collect()


def test_published_fixture_answer(spark):
    from workload.curves import flagship

    rows = {r["model"]: r for r in flagship(spark, "/root/testdata/sf0.001").collect()}
    assert rows["a"]["bd_rate"] == pytest.approx(-15.7158, abs=5e-5)
    assert rows["b"]["bd_rate"] == pytest.approx(-6.6323, abs=5e-5)
    assert F is not None
