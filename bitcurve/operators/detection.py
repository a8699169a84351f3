"""COCO detection metrics.

Protocol: per image and category at most 100 detections by score; greedy matching per IoU
threshold, crowd boxes aside; 101-point interpolated precision; mean over thresholds and over categories with
ground truth. A task holds the truth boxes of one image and category and 100 detections of each configuration
(``matching``); with ``salts`` no more than 100 detections with 100 candidate boxes each. The running
counts over a category's detections are distributed (``one_order``, ``group_prefix_sums``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from bitcurve.functions import bd
from bitcurve.functions.geometry import covered_xywh, iou_xywh
from bitcurve.operators.curves import against
from bitcurve.operators.matching import CROWD, DETECTION, FIRST, MAX_DETECTIONS, THRESHOLDS, TRUTH, packed, rows_of
from bitcurve.operators.one_order import drawn_images, mean_by_draw, ordered, precision_by_draw, weighted_positives, weighted_rates
from bitcurve.operators.ranking import group_prefix_sums
from bitcurve.session import cut_lineage, within_broadcast_bound, written

MAX_BROADCAST_POSITIVES = 200_000
THRESHOLD = "least(0.5D + 0.05D*{k}, 1 - 1e-10D)"


def side_by_side(predictions: DataFrame, truth: DataFrame, keys) -> DataFrame:
    """Truth boxes and detections of an image and category one after the other, each by the order in which they are matched,
    with their ``_kind`` (``matching``). Frames that lie by image and category already are not exchanged."""
    flag = "coalesce(boolean(iscrowd), false)" if "iscrowd" in truth.columns else "false"
    kinds = dict(predictions.dtypes)
    known = "image_id IS NOT NULL AND category_id IS NOT NULL"  # no image equals an unknown one
    boxes = truth.selectExpr(
        *[f"CAST(NULL AS {kinds[k]}) AS {k}" for k in keys], "image_id", "category_id", f"CAST(NULL AS {kinds['pred_id']}) AS pred_id",
        f"CAST(NULL AS {kinds['score']}) AS score", "double(box.x) AS x", "double(box.y) AS y",
        f"CASE WHEN {known} AND (ann_id IS NOT NULL OR {flag}) THEN double(box.w) END AS w", "double(box.h) AS h",
        "coalesce(bigint(ann_id), 0L) AS _ann", f"CASE WHEN {known} AND {flag} THEN {CROWD} ELSE {TRUTH} END AS _kind")
    found = predictions.selectExpr(
        *keys, "image_id", "category_id", "pred_id", "score", "double(box.x) AS x", "double(box.y) AS y", "double(box.w) AS w",
        "double(box.h) AS h", "0L AS _ann", f"{DETECTION} AS _kind")
    by_turn = Window.partitionBy("image_id", "category_id").orderBy(
        F.expr(f"_kind = {DETECTION}"), "_ann", F.desc("score"), "pred_id", *keys)
    rows = found.union(boxes).withColumn("_n", F.row_number().over(by_turn))
    return rows.withColumn("_kind", F.expr(f"_kind + CASE WHEN _n = 1 THEN {FIRST} ELSE 0 END")).drop("_n")


def match(predictions: DataFrame, truth: DataFrame, keys=(), salts: int = 1) -> DataFrame:
    """Detections with ``tp``, an array of 0/1 per IoU threshold; with crowd boxes also ``ignored``.

    ``predictions``: (keys, image_id, category_id, pred_id, score, box); ``truth``: (image_id, category_id, ann_id,
    box[, iscrowd]). A detection takes the free truth box of highest IoU (the later one of equals). Because at most 99
    others choose before it, its 100 best boxes always suffice. A detection without a box whose overlap with a crowd
    box, over its own area, reaches the threshold is ignored: neither right nor wrong. One crowd box absorbs any number.

    Only detections that share a candidate box with another one are matched in turn; each of the others has its best box
    for itself, so the threshold alone decides.

    With ``salts`` > 1 the truth boxes of an image are spread over that many tasks, each of which keeps its own 100 best
    per detection: for images with so many boxes that one task is too few."""
    keys = list(keys)
    if salts > 1:
        return _match_salted(predictions, truth, keys, salts)
    rows = side_by_side(predictions, truth, keys)
    columns = [*keys, "image_id", "category_id", "pred_id", "det_rank", "score", "right", "ignored"]
    numbers = {c: F.lit(0).alias(c) for c in ("det_rank", "right", "ignored")}
    schema = rows.select(*[numbers.get(c, F.col(c)) for c in columns]).schema
    found = rows.mapInArrow(rows_of(keys, to_arrow_schema(schema)), schema)
    def listed(mask):
        return F.expr(f"array({', '.join(f'shiftright(`{mask}`, {k}) & 1' for k in range(THRESHOLDS))})")
    more = [listed("ignored").alias("ignored")] if "iscrowd" in truth.columns else []
    return found.select(*columns[:-2], listed("right").alias("tp"), *more)


def match_packed(predictions: DataFrame, truth: DataFrame, keys=()) -> DataFrame:
    """The same for ``one_order``: one row per detection and score, (category_id, score, image_id, pred_id, entries), where
    ``entries`` has the masks of all configurations."""
    keys = list(keys)
    rows = side_by_side(predictions, truth, keys).withColumn("g", F.xxhash64(*keys, "category_id")).drop(*keys)
    columns = ["category_id", "score", "image_id", "pred_id"]
    schema = rows.select(*columns, F.lit(b"").alias("entries")).schema
    return rows.mapInArrow(packed, schema)


def _match_salted(predictions: DataFrame, truth: DataFrame, keys, salts: int) -> DataFrame:
    crowds = "iscrowd" in truth.columns
    group = [*keys, "image_id", "category_id"]
    by_score = Window.partitionBy(*group).orderBy(F.desc("score"), "pred_id")
    top = predictions.withColumn("det_rank", F.row_number().over(by_score)).filter(
        F.col("det_rank") <= MAX_DETECTIONS
    )
    flag = F.expr("coalesce(boolean(iscrowd), false)") if crowds else F.lit(False)
    boxes = truth.select("image_id", "category_id", "ann_id", F.col("box").alias("gt_box"), flag.alias("_crowd"))
    on = ["image_id", "category_id", "_salt"]
    boxes = boxes.withColumn("_salt", F.expr(f"pmod(hash(ann_id), {salts})"))
    top = top.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = top.join(boxes, on, "left").withColumn("iou", F.expr(iou_xywh("box", "gt_box")))
    # Pairs below the lowest threshold collapse to one row per detection that has no candidate.
    hit = F.expr("coalesce(iou >= 0.5D AND NOT _crowd, false)")
    pairs = pairs.select(
        *group,
        "_salt",
        "pred_id",
        "det_rank",
        "score",
        F.when(hit, F.col("iou")).alias("iou"),
        F.when(hit, F.col("ann_id")).alias("ann_id"),
        *([F.when(F.col("_crowd"), F.expr(covered_xywh("box", "gt_box"))).alias("crowd")] if crowds else []),
    )

    def best_of(rows, *more):
        one = Window.partitionBy(*group, "pred_id", *more)
        rows = rows.withColumn("_r", F.row_number().over(one.orderBy(F.desc("iou"), F.desc("ann_id"))))
        if crowds:  # the largest overlap is what counts, whichever rows stay
            rows = rows.withColumn("crowd", F.max("crowd").over(one))
        return rows.filter(F.col("_r") <= MAX_DETECTIONS).drop("_r")

    pairs = best_of(pairs, "_salt")
    detections = best_of(pairs).groupBy(*group, "pred_id").agg(
        F.first("det_rank").alias("det_rank"),
        F.first("score").alias("score"),
        (F.max("crowd") if crowds else F.lit(None).cast("double")).alias("crowd"),
        F.expr("array_sort(collect_list(CASE WHEN ann_id IS NOT NULL THEN struct(-iou AS o, -ann_id AS a) END)) AS cands"),
    )
    packed = detections.groupBy(*group).agg(
        F.expr("array_sort(collect_list(struct(det_rank, pred_id, score, crowd, cands))) AS dets")
    )
    # A box wanted by two detections appears twice among all candidates.
    packed = packed.withColumn("wanted", F.expr("flatten(transform(dets, d -> transform(d.cands, c -> c.a)))"))
    shared = "filter(array_distinct(wanted), a -> size(filter(wanted, b -> b = a)) > 1)"
    packed = packed.withColumn(
        "shared", F.expr(f"CASE WHEN size(array_distinct(wanted)) < size(wanted) THEN {shared} ELSE CAST(array() AS ARRAY<BIGINT>) END")
    )
    packed = packed.withColumn(
        "contested",
        F.expr("CASE WHEN size(shared) > 0 THEN filter(dets, d -> exists(d.cands, c -> array_contains(shared, c.a))) END"),
    )
    chosen = "get(filter(d.cands, c -> -c.o >= {t} AND NOT array_contains(s.used, c.a)), 0).a".format(
        t=THRESHOLD.format(k="k")
    )
    fold = f"""transform(sequence(0, {THRESHOLDS - 1}), k -> aggregate(contested,
        named_struct('used', CAST(array() AS ARRAY<BIGINT>), 'ranks', CAST(array() AS ARRAY<INT>)),
        (s, d) -> transform(array({chosen}), a -> named_struct(
            'used', CASE WHEN a IS NULL THEN s.used ELSE array_append(s.used, a) END,
            'ranks', CASE WHEN a IS NULL THEN s.ranks ELSE array_append(s.ranks, d.det_rank) END))[0],
        s -> s.ranks))"""
    matched = packed.withColumn("taken", F.expr(f"CASE WHEN contested IS NOT NULL THEN {fold} END"))
    best = "-get(d.cands, 0).o"
    settled = f"transform(sequence(0, {THRESHOLDS - 1}), k -> int(coalesce({best} >= {THRESHOLD.format(k='k')}, false)))"
    tp = f"""CASE WHEN contested IS NULL OR NOT exists(d.cands, c -> array_contains(shared, c.a)) THEN {settled}
        ELSE transform(taken, ranks -> int(array_contains(ranks, d.det_rank))) END"""
    found = matched.select(
        *group,
        F.expr(f"inline(transform(dets, d -> struct(d.pred_id, d.det_rank, d.score, d.crowd, {tp} AS tp)))"),
    )
    if not crowds:
        return found.drop("crowd")
    ignored = f"transform(tp, (hit, k) -> int(hit = 0 AND coalesce(crowd >= {THRESHOLD.format(k='k')}, false)))"
    return found.withColumn("ignored", F.expr(ignored)).drop("crowd")


def _recall_bin(recall: str) -> str:
    """Largest j with j*0.01 <= recall, by the same floating comparison as the 101 thresholds."""
    f = f"floor({recall}*100)"
    return f"CASE WHEN ({f} + 1)*0.01D <= {recall} THEN {f} + 1 WHEN {f}*0.01D <= {recall} THEN {f} ELSE {f} - 1 END"


def average_precision(matched: DataFrame, positives: DataFrame, keys=(), weight: str | None = None) -> DataFrame:
    """Interpolated AP per (keys, category, threshold index).

    ``positives``: (keys, category_id, n_pos) for every category with ground truth. With
    ``weight`` (copies of the detection's image) this is the AP of a resample. Detections that are ``ignored`` at a
    threshold count for nothing there."""
    keys = list(keys)
    group = [*keys, "category_id"]
    w = weight or "1"
    # The best score first; equal scores in image order, as when images are scored one by one.
    ordered = matched.withColumn("_s", -F.col("score"))
    sums = {"_n": f"bigint({w})"} | {f"_tp{k}": f"bigint({w}*tp[{k}])" for k in range(THRESHOLDS)}
    crowds = "ignored" in matched.columns
    if crowds:
        sums |= {f"_out{k}": f"bigint({w}*ignored[{k}])" for k in range(THRESHOLDS)}
    running = group_prefix_sums(ordered, group, ["_s", "image_id", "det_rank"], sums)
    # Only true positives can raise the interpolated precision.
    seen = "_n - _out{k}" if crowds else "_n"
    rows = ", ".join(f"struct({k} AS k, tp[{k}] AS hit, _tp{k} AS c, {seen.format(k=k)} AS n)" for k in range(THRESHOLDS))
    hits = running.select(*group, F.expr(f"inline(array({rows}))")).filter("hit = 1")
    # One row per key and category; written once so that its size can be checked.
    positives = cut_lineage(positives)
    small = F.broadcast(positives) if within_broadcast_bound(positives, MAX_BROADCAST_POSITIVES) else positives
    scored = hits.join(small, group).select(
        *group, "k", (F.col("c") / F.col("n")).alias("p"), (F.col("c") / F.col("n_pos")).alias("_recall")
    )
    bins = scored.groupBy(*group, "k", F.expr(f"int({_recall_bin('_recall')})").alias("bin")).agg(F.max("p").alias("p"))
    curves = bins.groupBy(*group, "k").agg(F.expr("collect_list(struct(bin, p)) AS bins"))
    ap = curves.withColumn(
        "ap",
        F.expr("""aggregate(sequence(0, 100), 0D, (s, j) -> s + coalesce(array_max(
            transform(filter(bins, b -> b.bin >= j), b -> b.p)), 0D))/101D"""),
    )
    wanted = positives.filter("n_pos > 0").select(*group).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(THRESHOLDS - 1))))
    return wanted.join(ap.select(*group, "k", "ap"), [*group, "k"], "left").na.fill(0.0, ["ap"])


def mean_ap(ap: DataFrame, keys=()) -> DataFrame:
    """mAP over all thresholds, and at IoU .5."""
    return ap.groupBy(*keys).agg(F.avg("ap").alias("map"), F.expr("avg(CASE WHEN k = 0 THEN ap END) AS map50"))


def real_boxes(truth: DataFrame) -> DataFrame:
    """Truth boxes without those of crowds, which are no positives."""
    return truth.filter("NOT coalesce(boolean(iscrowd), false)") if "iscrowd" in truth.columns else truth


def positives(truth: DataFrame) -> DataFrame:
    return real_boxes(truth).groupBy("category_id").agg(F.count(F.lit(1)).alias("n_pos"))


def coco_map(predictions: DataFrame, truth: DataFrame, keys=(), salts: int = 1) -> DataFrame:
    """mAP@[.5:.95] and mAP@.5 per ``keys``; no predictions at all give (0, 0)."""
    keys = list(keys)
    counts = positives(truth)
    if keys:
        counts = predictions.select(*keys).distinct().crossJoin(F.broadcast(counts))
    group = [*keys, "category_id"]
    counts = cut_lineage(counts)
    if not within_broadcast_bound(counts, MAX_BROADCAST_POSITIVES):
        return mean_ap(average_precision(match(predictions, truth, keys, salts), counts, keys), keys)
    # Written before they are put in order, which looks at them twice.
    matched = match(predictions, truth, keys, salts) if salts > 1 else written(match_packed(predictions, truth, keys), "matched")
    # The whole set of images is one draw in which each counts once: a sort of narrow rows, no running sums on them.
    kind = matched.schema["category_id"].dataType
    groups = counts.withColumn("g", F.xxhash64(*keys, F.col("category_id").cast(kind)))
    n_pos = {r["g"]: np.array([r["n_pos"]]) for r in groups.collect()}  # at most MAX_BROADCAST_POSITIVES numbers
    found = precision_by_draw(ordered(matched, None, group), n_pos, 1)
    return mean_by_draw(found, groups, n_pos, 1, keys).drop("draw")


def score_filter(predictions: DataFrame, threshold: float) -> DataFrame:
    return predictions.filter(F.col("score") >= threshold)


def bootstrap_bd(
    predictions: DataFrame, truth: DataFrame, rates: DataFrame, anchor_arm, draws: int, seed: str
) -> DataFrame:
    """Paired image bootstrap of BD-rate on mAP, per arm against ``anchor_arm``.

    ``predictions`` and ``rates`` carry (arm, qp). Matching and ordering happen once; a draw only changes how
    often each image counts, so a resample with fresh image ids has exactly these weighted counts
    (``one_order``). Fewer than two images give no interval."""
    config = ["arm", "qp"]
    matched = written(match_packed(predictions, truth, config), "matched")
    drawn, n_images = drawn_images(rates.select("image_id").distinct(), draws, seed)
    images = written(drawn, "image-draws")
    per_category = weighted_positives(real_boxes(truth), images, draws)
    keys = ["draw", *config]
    # One row per configuration and category: what the report is about.
    categories = rates.sparkSession.createDataFrame([(c,) for c in per_category], "category_id long")
    kind = matched.schema["category_id"].dataType
    groups = cut_lineage(
        rates.select(*config).distinct().crossJoin(F.broadcast(categories))
        .withColumn("g", F.xxhash64(*config, F.col("category_id").cast(kind)))
    )
    n_pos = {r["g"]: per_category[r["category_id"]] for r in groups.collect()}
    found = precision_by_draw(ordered(matched, images, [*config, "category_id"]), n_pos, draws)
    quality = mean_by_draw(found, groups, n_pos, draws, config).select(*keys, "map")
    curves = weighted_rates(rates, images, draws, config).join(quality, keys)
    paired = against(curves, "arm", anchor_arm, ["draw"], quality="map")
    values = paired.select("draw", "arm", bd.bd_rate("anchor_points", "points").alias("v"))
    values = values.withColumn("v", F.expr(f"CASE WHEN {n_images} >= 2 THEN v END"))
    return values.groupBy("arm").agg(
        F.expr("percentile(v, 0.025D) AS lo"),
        F.expr("percentile(v, 0.975D) AS hi"),
        F.expr("avg(double(v < 0)) AS p_lt_zero"),
        F.count("v").alias("n_draws"),
    )
