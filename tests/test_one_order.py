"""Detections of all configurations in one order: batches of any size, bounds that leave no precision out, packed weights."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from bitcurve.operators import bootstrap as B
from bitcurve.operators import detection as D
from bitcurve.operators import matching as M
from bitcurve.operators import one_order as O
from tests.test_detection import CROWD_TRUTH, PRED, with_crowds


def two_arms(spark):
    pred, truth = with_crowds(2, hot=True)
    both = [(arm, *p[:4], (p[4][0] + arm, *p[4][1:])) for arm in (0, 1) for p in pred]
    return spark.createDataFrame(both, "arm INT, " + PRED), spark.createDataFrame(truth, CROWD_TRUTH)


def test_batches_of_any_size_match_alike(spark, monkeypatch):
    pred, truth = two_arms(spark)
    want = sorted(map(tuple, D.match(pred, truth, ["arm"]).collect()))
    assert want == sorted(map(tuple, D.match(pred, truth, ["arm"], salts=3).select(*D.match(pred, truth, ["arm"]).columns).collect()))
    rows = D.side_by_side(pred, truth, ["arm"])
    schema = rows.select("arm", "image_id", "pred_id", F.lit(0).alias("det_rank"), F.lit(0).alias("right"), F.lit(0).alias("ignored")).schema
    table = rows.coalesce(1).toArrow()
    found = []
    for held, pairs, size in ((M.ROWS, M.PAIRS, 10_000), (5, 3, 7)):
        monkeypatch.setattr(M, "ROWS", held)
        monkeypatch.setattr(M, "PAIRS", pairs)
        run = M.rows_of(["arm"], to_arrow_schema(schema))
        found.append(sorted(tuple(r.values()) for b in run(table.to_batches(max_chunksize=size)) for r in b.to_pylist()))
    assert found[0] == found[1] and len(found[0]) == len(want) > 200


def test_a_detection_of_all_configurations_is_one_row(spark):
    from workload import boxes as W

    near = W.by_image(W.written(W.lines(spark, "/root/testdata/sf0.001"), "lines"))
    packed = D.match_packed(W.predictions_of(W.configured(near), W.CONFIG_SHIFT), W.truth_of(near), ["arm", "qi"])
    sizes = packed.selectExpr("octet_length(entries) AS size").groupBy("size").count().collect()
    assert [tuple(r) for r in sizes] == [(8 * M.ENTRY.itemsize, near.count())]


def test_no_precision_is_left_out(monkeypatch):
    """Chunks that are not looked into hold none above the highest: against every single hit."""
    monkeypatch.setattr(O, "CHUNK", 8)
    rng = np.random.default_rng(3)
    n, groups, draws = 1500, 2, 3
    weights = rng.poisson(1, (n, draws))
    right = rng.integers(0, 1 << O.LEVELS, (n, groups)).astype(np.uint16)
    out = rng.integers(0, 1 << O.LEVELS, (n, groups)).astype(np.uint16) & ~right & np.uint16(0x111)
    positives = np.stack([((right[:, [g]] & 1) * weights).sum(0) + 900 for g in range(groups)])
    top, now = np.zeros((groups, O.LEVELS, O.STEPS, draws)), np.zeros((groups, 1 + 2 * O.LEVELS, draws))
    for first in range(0, n, 100):
        here = slice(first, first + 100)
        row, own = np.divmod(np.arange(100 * groups), groups)
        run = (0, np.arange(groups), row, own, right[here].ravel(), out[here].ravel(), weights[here])
        for _, masks, by_chunk, sums in O._slabs(run):
            ends = now + np.cumsum(sums, 0)
            O._raise_top(top, masks, by_chunk, ends - sums, sums, positives)
            now = ends[-1]
    want = np.zeros_like(top)
    for g, k, d in np.ndindex(groups, O.LEVELS, draws):
        hit, gone, w = right[:, g] >> k & 1, out[:, g] >> k & 1, weights[:, d]
        c, seen = np.cumsum(hit * w), np.cumsum(w * (1 - gone.astype(int)))
        for i in np.flatnonzero(hit * w):
            step = np.searchsorted(O.GRID, c[i] / positives[g, d], "right") - 1
            want[g, k, step, d] = max(want[g, k, step, d], c[i] / seen[i])
    above = [np.maximum.accumulate(t[:, :, ::-1], 2) for t in (top, want)]
    assert want.max() > 0 and np.array_equal(*above)


def test_drawn_images_are_the_bootstraps_weights(spark):
    images = spark.range(70).selectExpr("id*3 AS image_id")
    found, n = O.drawn_images(images, 5, "seed")
    want = O.image_draws(B.image_weights(images, 5, "seed"), 5)
    drawn = {r["image_id"]: r["w"] for r in want.collect()}
    assert n == 70 and {r["image_id"]: r["w"] for r in found.collect()} == {i * 3: drawn.get(i * 3, bytes(3)) for i in range(70)}


def test_rates_of_draws_are_weighted_means(spark):
    rates = spark.range(30).selectExpr("id AS image_id", "explode(array(0, 1)) AS arm", "CASE WHEN id <> 4 THEN id + 0.5D END AS bpp")
    weights = B.image_weights(rates.select("image_id").distinct(), 4, "seed")
    found = O.weighted_rates(rates, O.image_draws(weights, 4), 4, ["arm"]).collect()
    want = rates.join(weights, "image_id").groupBy("arm", "draw").agg(F.expr("sum(w*bpp)/sum(w) AS bpp")).collect()
    key = lambda r: (r["arm"], r["draw"])
    assert len(found) == 8 and np.allclose([r["bpp"] for r in sorted(found, key=key)], [r["bpp"] for r in sorted(want, key=key)])
