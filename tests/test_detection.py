"""Detection metrics against a plain-loop implementation of the published protocol."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from bitcurve.operators import detection as D
from bitcurve.operators import one_order as O

PRED = "image_id BIGINT, category_id INT, pred_id BIGINT, score DOUBLE, box STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>"
TRUTH = "image_id BIGINT, category_id INT, ann_id BIGINT, box STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>"


CROWD_TRUTH = TRUTH + ", iscrowd INT"


def covered(a, b):
    """Share of ``a`` that ``b`` covers."""
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return max(w, 0) * max(h, 0) / (a[2] * a[3])


def overlap(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    i = max(w, 0) * max(h, 0)
    return i / (a[2] * a[3] + b[2] * b[3] - i)


def brute_force(pred, truth):
    """``truth`` rows may end with a crowd flag."""
    scores = []
    crowd = [t for t in truth if len(t) > 4 and t[4]]
    truth = [t for t in truth if len(t) == 4 or not t[4]]
    for category in sorted({t[1] for t in truth}):
        n_pos = sum(t[1] == category for t in truth)
        for k in range(10):
            threshold = min(0.5 + 0.05 * k, 1 - 1e-10)
            rows = []
            for image in sorted({p[0] for p in pred}):
                dets = sorted((p for p in pred if p[:2] == (image, category)), key=lambda p: (-p[3], p[2]))[:100]
                boxes = [t for t in truth if t[:2] == (image, category)]
                used = set()
                for d in dets:
                    best, found = threshold, None
                    for j, t in enumerate(boxes):
                        o = overlap(d[4], t[3])
                        if j not in used and o >= best:
                            best, found = o, j
                    if found is not None:
                        used.add(found)
                    elif any(c[:2] == (image, category) and covered(d[4], c[3]) >= threshold for c in crowd):
                        continue
                    rows.append((d[3], found is not None))
            rows.sort(key=lambda r: -r[0])
            tp = np.cumsum([r[1] for r in rows])
            precision = tp / np.arange(1, len(rows) + 1)
            recall = tp / n_pos
            for r in np.linspace(0, 1, 101):
                reached = precision[recall >= r]
                scores.append((k, reached.max() if len(reached) else 0.0))
    values = np.array([s[1] for s in scores])
    return values.mean(), np.mean([s[1] for s in scores if s[0] == 0])


def crowded(seed, hot=False):
    rng = random.Random(seed)
    truth, pred = [], []
    for image in range(6):
        boxes = 140 if hot and image == 0 else 12
        for n in range(boxes):
            category = rng.randrange(2)
            box = (rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(15, 40), rng.uniform(15, 40))
            truth.append((image, category, n, box))
            for copy in range(rng.choice((0, 1, 1, 2))):
                shifted = (box[0] + rng.gauss(0, 3), box[1] + rng.gauss(0, 3), box[2] * rng.uniform(0.9, 1.1), box[3])
                pred.append((image, category, 10 * n + copy, rng.random(), shifted))
    return pred, truth


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True)])
def test_map_agrees_with_loops(spark, seed, hot):
    pred, truth = crowded(seed, hot)
    row = D.coco_map(spark.createDataFrame(pred, PRED), spark.createDataFrame(truth, TRUTH)).first()
    want = brute_force(pred, truth)
    assert row["map"] == pytest.approx(want[0], abs=1e-9)
    assert row["map50"] == pytest.approx(want[1], abs=1e-9)


def with_crowds(seed, hot=False):
    """A quarter of the boxes become crowds, large ones among them, and one category has nothing but crowds."""
    pred, truth = crowded(seed, hot)
    rng = random.Random(seed)
    marked = [(*t, int(rng.random() < 0.25)) for t in truth]
    marked += [(i, 0, 900, (0.0, 0.0, 70.0, 50.0), 1) for i in (1, 2)] + [(3, 5, 901, (0.0, 0.0, 50.0, 50.0), 1)]
    return pred + [(3, 5, 7000 + i, 0.9, (float(i), 0.0, 20.0, 20.0)) for i in range(4)], marked


@pytest.mark.parametrize("seed,hot,salts", [(1, False, 1), (2, True, 1), (6, True, 3)])
def test_crowd_boxes_agree_with_loops(spark, seed, hot, salts):
    pred, truth = with_crowds(seed, hot)
    row = D.coco_map(spark.createDataFrame(pred, PRED), spark.createDataFrame(truth, CROWD_TRUTH), salts=salts).first()
    want = brute_force(pred, truth)
    assert want != brute_force(pred, [t[:4] for t in truth])
    assert row["map"] == pytest.approx(want[0], abs=1e-9)
    assert row["map50"] == pytest.approx(want[1], abs=1e-9)


def test_one_crowd_box_absorbs_many(spark):
    pred = [(1, 1, i, 0.9 - i / 100, (float(i), 0.0, 10.0, 10.0)) for i in range(5)]
    truth = [(1, 1, 1, (0.0, 0.0, 30.0, 30.0), 1), (1, 1, 2, (0.0, 0.0, 10.0, 10.0), 0)]
    found = D.match(spark.createDataFrame(pred, PRED), spark.createDataFrame(truth, CROWD_TRUTH)).orderBy("det_rank").collect()
    assert [r["tp"][0] for r in found] == [1, 0, 0, 0, 0]
    assert [r["ignored"] for r in found] == [[0] * 10] + [[1] * 10] * 4


def test_salted_matching_is_the_same(spark):
    pred, truth = crowded(5, hot=True)
    frames = spark.createDataFrame(pred, PRED), spark.createDataFrame(truth, TRUTH)
    rows = [sorted(map(tuple, D.match(*frames, salts=n).collect())) for n in (1, 4)]
    assert rows[0] == rows[1] and len(rows[0]) > 50


def test_no_predictions_score_zero(spark):
    _, truth = crowded(3)
    empty = spark.createDataFrame([], PRED)
    row = D.coco_map(empty, spark.createDataFrame(truth, TRUTH)).first()
    assert (row["map"], row["map50"]) == (0.0, 0.0)


def test_resample_counts_repeated_images(spark):
    """Weights give the same AP as copies of the images under fresh ids."""
    pred, truth = crowded(4)
    weights = {0: 2, 1: 1, 2: 0, 3: 3, 4: 1, 5: 1}
    copies = [(i, c) for i, w in weights.items() for c in range(w)]
    p2 = [(10 * i + c, *p[1:]) for i, c in copies for p in pred if p[0] == i]
    t2 = [(10 * i + c, *t[1:]) for i, c in copies for t in truth if t[0] == i]
    copied = D.coco_map(spark.createDataFrame(p2, PRED), spark.createDataFrame(t2, TRUTH)).first()
    w = spark.createDataFrame(list(weights.items()), "image_id BIGINT, w BIGINT").filter("w > 0")
    gt = spark.createDataFrame(truth, TRUTH)
    matched = D.match(spark.createDataFrame(pred, PRED), gt).join(w, "image_id")
    positives = gt.join(w, "image_id").groupBy("category_id").agg({"w": "sum"}).withColumnRenamed("sum(w)", "n_pos")
    weighted = D.mean_ap(D.average_precision(matched, positives, weight="w")).first()
    assert weighted["map"] == pytest.approx(copied["map"], abs=1e-9)


def resampled(rows, counts):
    """Rows of an image once per copy, under fresh image ids."""
    return [(100 * r[0] + c, *r[1:]) for r in rows for c in range(counts.get(r[0], 0))]


@pytest.mark.parametrize("bytes_at_once", [O.OFFSET_BYTES, 1])
def test_draws_along_one_order_agree_with_copied_images(spark, monkeypatch, bytes_at_once):
    """Every draw of every configuration against the loops; with one byte the draws are taken one by one."""
    monkeypatch.setattr(O, "OFFSET_BYTES", bytes_at_once)
    monkeypatch.setattr(O, "ROWS", 7)
    pred, truth = with_crowds(8)
    draws, rng = 3, random.Random(9)
    counts = [{i: rng.choice((0, 0, 1, 2, 3)) for i in range(6)} for _ in range(draws)]
    both = [(arm, *p[:3], p[3] * (1 - 0.3 * arm * (p[2] % 2)), p[4]) for arm in (0, 1) for p in pred]
    weights = [(d, i, w) for d, own in enumerate(counts) for i, w in own.items() if w]
    images = O.image_draws(spark.createDataFrame(weights, "draw INT, image_id BIGINT, w BIGINT"), draws)
    gt = spark.createDataFrame(truth, CROWD_TRUTH)
    matched = D.match(spark.createDataFrame(both, "arm INT, " + PRED), gt, ["arm"])
    per_category = O.weighted_positives(D.real_boxes(gt), images, draws)
    groups = spark.createDataFrame([(a, c) for a in (0, 1) for c in per_category], "arm INT, category_id INT")
    groups = groups.withColumn("g", F.xxhash64("arm", "category_id"))
    n_pos = {r["g"]: per_category[r["category_id"]] for r in groups.collect()}
    found = O.precision_by_draw(O.ordered(matched, images, ["arm", "category_id"]), n_pos, draws)
    rows = O.mean_by_draw(found, groups, n_pos, draws, ["arm"]).collect()
    assert len(rows) == 2 * draws
    for r in rows:
        own = resampled([p[1:] for p in both if p[0] == r["arm"]], counts[r["draw"]])
        want = brute_force(own, resampled(truth, counts[r["draw"]]))
        assert (r["map"], r["map50"]) == pytest.approx(want, abs=1e-9)


def test_bootstrap_interval(spark):
    """The whole interval: no row per draw and detection in the plan, and an arm equal to the anchor changes nothing."""
    pred, truth = with_crowds(8)
    both = [(arm, qp, *p[:3], p[3], (p[4][0] + 2.0 * qp, *p[4][1:])) for arm in (0, 1) for qp in range(4) for p in pred]
    rates = [(arm, qp, i, 0.1 * (5 - qp)) for arm in (0, 1) for qp in range(4) for i in range(6)]
    frames = (
        spark.createDataFrame(both, "arm INT, qp INT, " + PRED),
        spark.createDataFrame(truth, CROWD_TRUTH),
        spark.createDataFrame(rates, "arm INT, qp INT, image_id BIGINT, bpp DOUBLE"),
    )
    row = D.bootstrap_bd(*frames, 0, 20, "seed").first()
    assert row["n_draws"] > 0 and row["lo"] == pytest.approx(0, abs=1e-6) and row["hi"] == pytest.approx(0, abs=1e-6)


def test_matching_moves_no_row_once_lines_lie_by_image(spark):
    """Eight configurations multiply the rows; none of them is exchanged to be matched."""
    from workload import boxes as B

    rows = B.by_image(B.cut_lineage(B.lines(spark, "/root/testdata/sf0.001")))
    found = D.match(B.predictions_of(B.configured(rows), B.CONFIG_SHIFT), B.truth_of(rows), ["arm", "qi"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_ordered_detections_are_packed(spark):
    """Runs of one group; a weight beyond half a byte survives."""
    pred, truth = crowded(4)
    counts = [(d, i, w) for d in range(3) for i, w in ((0, 15), (1, 16), (2, 300), (3, 1), (4, 2), (5, 7))]
    images = O.image_draws(spark.createDataFrame(counts, "draw INT, image_id BIGINT, w BIGINT"), 3)
    sizes = {r["image_id"]: len(r["w"]) for r in images.collect()}
    assert sizes == {0: 2, 1: 6, 2: 6, 3: 2, 4: 2, 5: 2}
    matched = D.match(spark.createDataFrame(pred, PRED), spark.createDataFrame(truth, TRUTH))
    fixed = O.ordered(matched, images, ["category_id"])
    assert fixed.count() < matched.count() / 2
    runs = list(O._runs(fixed.toArrow().to_batches(), 3, slice(0, 3)))
    assert sum(len(w) for *_, w in runs) == matched.count()
    weight = dict(c[1:] for c in counts)
    assert sum(w.sum() for *_, w in runs) == 3 * sum(weight[r["image_id"]] for r in matched.collect())
    plain = list(O._runs(O.ordered(matched, None, ["category_id"]).toArrow().to_batches(), 1, slice(0, 1)))
    assert sum(w.sum() for *_, w in plain) == matched.count()
