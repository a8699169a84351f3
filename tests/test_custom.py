import math

import numpy as np
import pytest

from bitcurve.functions import sql
from bitcurve.operators import custom


def test_states_merge_to_the_metric_of_the_group(spark):
    """Two thirds of the rows in one group, NULL keys and values, large keys, groups of one row."""
    rows = spark.range(0, 5000, 1, 13).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 9007199254740993L WHEN id % 30 = 2 THEN NULL ELSE id END AS k", "string(id % 2) AS g",
        "CASE WHEN id % 11 = 0 THEN NULL ELSE double(hash(id) % 1000) END AS x", "double(hash(id, 1) % 77) AS y")
    found = {(r["k"], r["g"]): r["value"] for r in custom.aggregate(rows, ["k", "g"], ["x", "y"], custom.COVARIANCE).collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault((r["k"], r["g"]), []).append((r["x"], r["y"]))
    assert set(found) == set(groups)
    for key, values in groups.items():
        both = [(x, y) for x, y in values if x is not None]
        want = np.cov(np.array(both).T, ddof=0)[0, 1] if both else None
        assert found[key] is want if want is None else math.isclose(found[key], want, rel_tol=1e-9, abs_tol=1e-9)


def test_more_groups_than_a_task_holds(spark, monkeypatch):
    largest = custom.Metric(lambda x: np.array([x.max()]), np.maximum, lambda s: s[0])
    monkeypatch.setattr(custom, "STATES_HELD", 3)
    rows = spark.range(2000).selectExpr("id % 50 AS k", "id AS x")
    found = custom.aggregate(rows, ["k"], ["x"], largest, "top").collect()
    assert {r["k"]: r["top"] for r in found} == {k: 1950.0 + k for k in range(50)}


def test_empty_table_and_missing_keys(spark):
    rows = spark.range(0).selectExpr("id AS k", "id AS x", "id AS y")
    assert custom.aggregate(rows, ["k"], ["x", "y"], custom.COVARIANCE).count() == 0
    with pytest.raises(ValueError):
        custom.aggregate(rows, [], ["x", "y"], custom.COVARIANCE)


def test_functions_from_sql(spark):
    sql.register(spark)
    row = spark.sql("""SELECT iou(named_struct('x0', 0D, 'y0', 0D, 'x1', 2D, 'y1', 2D), named_struct('x0', 1D, 'y0', 0D, 'x1', 3D, 'y1', 2D)) AS i,
        iou_xywh(named_struct('x', 0D, 'y', 0D, 'w', 2D, 'h', 2D), named_struct('x', 1D, 'y', 0D, 'w', 2D, 'h', 2D)) AS j,
        success(0.5D) AS s, softmax(array(0D, ln(3D))) AS p, argmax(array(1D, 3D, 3D)) AS a, top2(array(0.5D, 0.2D, 0.3D)) AS t,
        kl_divergence(array(0.5D, 0.5D), array(ln(0.25D), ln(0.75D))) AS kl, cosine_distance(array(1D, 0D), array(0D, 2D)) AS c,
        cross_entropy(array(0D, 0D), 1) AS ce, prob_entropy(array(0.5D, 0.5D)) AS e, iou(NULL, NULL) AS n""").first()
    assert math.isclose(row["i"], 1/3) and math.isclose(row["j"], 1/3) and math.isclose(row["s"], 10/21)
    assert np.allclose(row["p"], [0.25, 0.75]) and row["a"] == 1 and math.isclose(row["t"]["margin"], 0.2)
    assert math.isclose(row["kl"], 0.5*math.log(2) + 0.5*math.log(2/3)) and math.isclose(row["c"], 1)
    assert math.isclose(row["ce"], math.log(2)) and math.isclose(row["e"], math.log(2))
    assert row["n"] in (None, 0.0)
