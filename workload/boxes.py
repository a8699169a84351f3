"""Detection and tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitcurve.functions import geometry as X
from bitcurve.operators import detection as D
from bitcurve.operators import tracking as T
from bitcurve.session import cut_lineage, parallelism, written  # noqa: F401  (tests store lines by the former)
from workload.curves import q6, q8, r6, r8
from workload.fixtures import duck_bd, duck_sql, spark_sql
from workload.registry import query, table
from workload.resampling import SEED

BOX = {"x": "l_partkey % 40 * 5.0D", "y": "l_suppkey % 10 * 20.0D", "side": "20.0D + l_quantity"}
CONFIG_SHIFT = "(2.0D + 5.0D*qi + 3.0D*arm)"


def lines(spark, sf):
    """One row per (order, line number), which is not unique in the table."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        *[F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])
    return rows.selectExpr(
        "l_orderkey AS image_id", "bigint(l_linenumber) AS ann_id", "l_linenumber % 2 AS category_id",
        f"{BOX['x']} AS x", f"{BOX['y']} AS y", f"{BOX['side']} AS side", "int(l_quantity % 9 = 0) AS iscrowd")


def hashed(rows):
    """The lines' uniform values: of the score, and of the predicted box's place."""
    named = rows.withColumn("ok", F.expr("concat(CAST(image_id AS STRING), '|', ann_id)"))
    score, place = (F.expr(spark_sql(u)) for u in ("U('s|'||ok)", "U('x|'||ok)"))
    return named.select(*rows.columns, score.alias("u_score"), place.alias("u_place"))


LINES_AT_ONCE = 100_000


def by_image(rows):
    """The written lines spread by image and category: windows, joins and lists of one image then need no exchange of
    their own, however many configurations multiply its rows."""
    parts = max(parallelism(rows.sparkSession), rows.count() // LINES_AT_ONCE + 1)
    return rows.repartition(parts, "image_id", "category_id")


def truth_of(rows):
    return rows.selectExpr("image_id", "category_id", "ann_id", "named_struct('x', x, 'y', y, 'w', side, 'h', side) AS box", "iscrowd")


def predictions_of(rows, shift="12.0D"):
    return (rows if "u_score" in rows.columns else hashed(rows)).selectExpr(
        *[c for c in ("arm", "qi") if c in rows.columns], "image_id", "category_id", "ann_id AS pred_id",
        "0.05D + 0.95D*u_score AS score", f"named_struct('x', x + {shift}*u_place, 'y', y, 'w', side, 'h', side) AS box")


DUCK_LINES = duck_sql(f"""lines AS (SELECT l_orderkey AS image_id, l_linenumber::BIGINT AS ann_id, l_linenumber % 2 AS category_id,
  {BOX['x']} AS x, {BOX['y']} AS y, {BOX['side']} AS side, l_quantity % 9 = 0 AS crowd, l_orderkey||'|'||l_linenumber AS ok
  FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity
        FROM lineitem GROUP BY ALL))""")


def duck_match(keys="", shift="12.0D", configs=""):
    """Greedy matching by a recursive walk over the detections of each (keys, image, category)."""
    k = f"{keys}, " if keys else ""
    eq = "".join(f"AND p.{c.strip()} = w.{c.strip()} " for c in keys.split(",") if c.strip())
    eqn = "".join(f"AND n.{c.strip()} = w.{c.strip()} " for c in keys.split(",") if c.strip())
    return duck_sql(f"""{DUCK_LINES},
pred AS (SELECT {k}image_id, category_id, ann_id AS pred_id, 0.05D + 0.95D*U('s|'||ok) AS score,
  x + {shift}*U('x|'||ok) AS px, y, side FROM lines {configs}),
det AS (SELECT *, row_number() OVER (PARTITION BY {k}image_id, category_id ORDER BY score DESC, pred_id) AS det_rank FROM pred
  QUALIFY det_rank <= 100),
inter AS (SELECT d.*, g.ann_id, greatest(least(px + d.side, g.x + g.side) - greatest(px, g.x), 0)
    * greatest(least(d.y + d.side, g.y + g.side) - greatest(d.y, g.y), 0) AS i, g.side AS gside, g.crowd AS gcrowd
  FROM det d JOIN lines g USING (image_id, category_id)),
overlap_ AS (SELECT *, i/(side*side + gside*gside - i) AS iou FROM inter WHERE NOT gcrowd AND i/(side*side + gside*gside - i) >= 0.5),
n_det AS (SELECT {k}image_id, category_id, count(*) AS nd FROM det GROUP BY ALL),
walk AS (
  SELECT {k}image_id, category_id, k, 0::BIGINT AS det_rank, []::BIGINT[] AS used, NULL::BIGINT AS hit
  FROM n_det, (SELECT unnest(range(0, 10)) AS k)
  UNION ALL
  SELECT {k}image_id, category_id, k, det_rank + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, best
  FROM (SELECT {', '.join('w.' + c.strip() for c in keys.split(',') if c.strip()) + ', ' if keys else ''}w.image_id, w.category_id,
      w.k, w.det_rank, w.used, arg_max(p.ann_id, (p.iou, p.ann_id)) AS best
    FROM walk w JOIN n_det n ON n.image_id = w.image_id AND n.category_id = w.category_id {eqn}AND w.det_rank < n.nd
    LEFT JOIN overlap_ p ON p.image_id = w.image_id AND p.category_id = w.category_id {eq}AND p.det_rank = w.det_rank + 1
      AND p.iou >= least(0.5D + 0.05D*w.k, 1 - 1e-10::DOUBLE) AND NOT list_contains(w.used, p.ann_id)
    GROUP BY ALL)),
crowded AS (SELECT {k}image_id, category_id, det_rank, max(i/(side*side)) AS covered FROM inter WHERE gcrowd GROUP BY ALL),
tps AS (SELECT {k}image_id, category_id, k, det_rank, (hit IS NOT NULL)::INT AS tp, score FROM walk
  JOIN det USING ({k}image_id, category_id, det_rank) LEFT JOIN crowded USING ({k}image_id, category_id, det_rank)
  WHERE hit IS NOT NULL OR coalesce(covered, 0) < least(0.5D + 0.05D*k, 1 - 1e-10::DOUBLE))""")


def duck_ap(keys="", weight="1", source="tps", name="ap", npos="(SELECT category_id, count(*) AS n_pos FROM lines WHERE NOT crowd GROUP BY ALL)"):
    """Interpolated AP from true-positive rows; ``npos`` gives the positives per (keys, category)."""
    k = f"{keys}, " if keys else ""
    using = f"{k}category_id" if "n_pos_keyed" in npos else "category_id"
    return f"""{name}_run AS (SELECT {k}category_id, k, tp, sum({weight}) OVER w AS n, sum({weight}*tp) OVER w AS c FROM {source}
  WINDOW w AS (PARTITION BY {k}category_id, k ORDER BY score DESC, image_id, det_rank ROWS UNBOUNDED PRECEDING)),
{name}_pr AS (SELECT {k}category_id, k, c/n AS p, c/n_pos AS rc FROM {name}_run JOIN {npos} USING ({using}) WHERE tp = 1),
{name}_top AS (SELECT {k}category_id, k, CASE WHEN (floor(rc*100) + 1)*0.01::DOUBLE <= rc THEN floor(rc*100) + 1
    WHEN floor(rc*100)*0.01::DOUBLE <= rc THEN floor(rc*100) ELSE floor(rc*100) - 1 END AS top, max(p) AS p FROM {name}_pr GROUP BY ALL),
{name}_bin AS (SELECT {k}category_id, k, j, max(p) AS p FROM {name}_top JOIN (SELECT unnest(range(0, 101)) AS j) ON j <= top
  GROUP BY ALL),
{name} AS (SELECT {k}category_id, k, sum(p)/101 AS ap FROM {name}_bin GROUP BY ALL)"""


RECURSIVE = "WITH RECURSIVE "


@query("c9_greedy_matching", f"""{RECURSIVE}{duck_match()}
SELECT category_id, k, sum(tp)::BIGINT AS tp, count(*) AS n, sum(image_id*det_rank*tp)::BIGINT AS pin FROM tps GROUP BY ALL""")
def c9(spark, sf):
    rows = written(lines(spark, sf), "lines")
    near = by_image(rows)
    matched = D.match(predictions_of(near), truth_of(near))
    long = matched.select("category_id", "image_id", "det_rank", "ignored", F.posexplode("tp").alias("k", "tp"))
    return long.filter("ignored[k] = 0").groupBy("category_id", "k").agg(
        F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("n"), F.expr("sum(image_id*det_rank*tp)").alias("pin"))


@query("d16_coco_map", f"""{RECURSIVE}{duck_match()}, {duck_ap()}
SELECT {q6('sum(ap)/count(DISTINCT category_id)/10')} AS map,
  {q6('sum(ap) FILTER (WHERE k = 0)/count(DISTINCT category_id)')} AS map50 FROM ap""")
def d16(spark, sf):
    rows = written(lines(spark, sf), "lines")
    near = by_image(rows)
    result = D.coco_map(predictions_of(near), truth_of(near))
    return result.select(r6("map").alias("map"), r6("map50").alias("map50"))


# Anchor (arm 0) and trial (arm 1) at four quality points.
CONFIGS_SPARK = "inline(arrays_zip(array(0,0,0,0,1,1,1,1), array(0,1,2,3,0,1,2,3))) AS (arm, qi)"
CONFIGS_DUCK = ", (VALUES (0), (1)) a(arm), (VALUES (0), (1), (2), (3)) q(qi)"
IMAGE_BPP = "(0.2D + 0.1D*U('bpp|'||image_id))*pow(0.5D, qi*0.6D)*(1.0D - 0.1D*arm)"


def configured(rows):
    """Every line in every configuration; its values are hashed before."""
    return hashed(rows).select("*", F.expr(CONFIGS_SPARK))


def image_rates(rows):
    images = rows.select("image_id").distinct()
    return images.select("image_id", F.expr(CONFIGS_SPARK)).select(
        "arm", "qi", "image_id", F.expr(spark_sql(IMAGE_BPP.replace("image_id", "CAST(image_id AS STRING)"))).alias("bpp"))


DUCK_CONFIGURED = duck_match("arm, qi", CONFIG_SHIFT, CONFIGS_DUCK)
DUCK_RATES = duck_sql(f"rates AS (SELECT arm, qi, image_id, {IMAGE_BPP} AS bpp FROM (SELECT DISTINCT image_id FROM lines) {CONFIGS_DUCK})")


@query("d4_detection_curve", f"""{RECURSIVE}{DUCK_CONFIGURED}, {DUCK_RATES}, {duck_ap('arm, qi')}
SELECT arm, qi, {q8('any_value(r.bpp)')} AS bpp, {q6('sum(ap)/count(DISTINCT category_id)/10')} AS map
FROM ap JOIN (SELECT arm, qi, avg(bpp) AS bpp FROM rates GROUP BY ALL) r USING (arm, qi) GROUP BY arm, qi""")
def d4(spark, sf):
    rows = written(lines(spark, sf), "lines")
    near = by_image(rows)
    maps = D.coco_map(predictions_of(configured(near), CONFIG_SHIFT), truth_of(near), ["arm", "qi"])
    rates = image_rates(rows).groupBy("arm", "qi").agg(F.avg("bpp").alias("bpp"))
    return maps.join(rates, ["arm", "qi"]).select("arm", "qi", r8("bpp").alias("bpp"), r6("map").alias("map"))


DET_DRAWS = 100


# Walking 100 weighted draws took DuckDB over 200 s on 46,000 detections: no SQL; tests/test_detection.py holds the
# resamples to loops over copied images.
@query("e4_detection_bootstrap", None)
def e4(spark, sf):
    rows = written(lines(spark, sf), "lines")
    near = by_image(rows)
    return D.bootstrap_bd(
        predictions_of(configured(near), CONFIG_SHIFT).withColumnRenamed("qi", "qp"), truth_of(near),
        image_rates(rows).withColumnRenamed("qi", "qp"), 0, DET_DRAWS, SEED
    ).select(r6("lo").alias("lo"), r6("hi").alias("hi"), r6("p_lt_zero").alias("p_lt_zero"), "n_draws")


@query("b7_score_filter", f"""{RECURSIVE}{duck_match()} SELECT image_id, pred_id, {q6('score')} AS score FROM pred WHERE score >= 0.5""")
def b7(spark, sf):
    kept = D.score_filter(predictions_of(lines(spark, sf)), 0.5)
    return kept.select("image_id", "pred_id", r6("score").alias("score"))


@query("b8_box_conversion", f"""WITH {DUCK_LINES}
SELECT image_id, ann_id, x + side AS x1, y + side AS y1, greatest(side, 1e-3::DOUBLE) AS w,
  greatest((ann_id % 2)*side, 1e-3::DOUBLE) AS flat_h FROM lines""")
def b8(spark, sf):
    boxed = truth_of(lines(spark, sf)).select("image_id", "ann_id", F.expr(X.to_xyxy("box")).alias("c"))
    flat = boxed.withColumn("c", F.expr("named_struct('x0', c.x0, 'y0', c.y0, 'x1', c.x1, 'y1', c.y1, "
                                        "'yf', c.y0 + (ann_id % 2)*(c.y1 - c.y0))"))
    flat = flat.withColumn("f", F.expr("named_struct('x0', c.x0, 'y0', c.y0, 'x1', c.x1, 'y1', c.yf)"))
    return flat.select("image_id", "ann_id", "c.x1", "c.y1", F.expr(f"({X.to_xywh('c')}).w AS w"),
                       F.expr(f"({X.to_xywh('f')}).h AS flat_h"))


# Images of 250 + order % 200 by 180 + order % 300 pixels on a canvas of 32, so that small boxes vanish.
IW, IH = "(250 + image_id % 200)", "(180 + image_id % 300)"


@query("b9_letterbox", f"""WITH {DUCK_LINES},
s AS (SELECT *, least(12::DOUBLE/{IW}, 12::DOUBLE/{IH}) AS s FROM lines),
o AS (SELECT *, (12 - greatest(1, round_even({IW}*s, 0)::INT))//2 AS l, (12 - greatest(1, round_even({IH}*s, 0)::INT))//2 AS t FROM s)
SELECT image_id, ann_id, {q6('x*s + l')} AS x, {q6('y*s + t')} AS y, {q6('side*s')} AS w FROM o WHERE side*s >= 1""")
def b9(spark, sf):
    boxed = truth_of(lines(spark, sf)).withColumn("box", F.expr(X.letterbox("box", IW, IH, 12)))
    kept = boxed.filter(X.visible("box"))
    return kept.select("image_id", "ann_id", r6("box.x").alias("x"), r6("box.y").alias("y"), r6("box.w").alias("w"))


# --- tracking --------------------------------------------------------------------------------
TRACK_SHIFT = "30.0D*U('t|'||CAST(event_id AS STRING))"


VALID = "event_type <> 'error' AND user_id % 40 <> 7"


def tracks(spark, sf, shift=TRACK_SHIFT, extra=(), valid=VALID):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type").repartition(parallelism(spark), "event_id")
    if extra:
        events = events.select("*", *extra)
    predicted = events.selectExpr(
        "user_id AS seq_id", "event_id AS frame", *[c for c in ("arm", "qi") if c in events.columns],
        f"named_struct('x0', 10D + {spark_sql(shift)}, 'y0', 10D, 'x1', 60D + {spark_sql(shift)}, 'y1', 60D) AS box")
    truth = table(spark, sf, "events").selectExpr(
        "user_id AS seq_id", "event_id AS frame", f"{valid} AS valid",
        "named_struct('x0', 10D, 'y0', 10D, 'x1', 60D, 'y1', 60D) AS box")
    return predicted, truth


def duck_tracks(shift=TRACK_SHIFT, configs="", keys=""):
    return duck_sql(f"""frames AS (SELECT {keys}user_id AS seq_id, event_id AS frame, event_type <> 'error' AND user_id % 40 <> 7 AS valid, {shift} AS d FROM events {configs}),
all_ious AS (SELECT {keys}seq_id, frame, valid, greatest(50D - d, 0)*50D/(5000D - greatest(50D - d, 0)*50D) AS iou FROM frames),
ious AS (SELECT * FROM all_ious WHERE valid),
scored AS (SELECT {keys}seq_id, avg((SELECT count(*) FROM range(0, 21) t(i) WHERE iou > i/20D)/21D) AS auc, avg(iou) AS ao,
  avg((iou > 0.5D)::INT) AS sr50, avg((iou > 0.75D)::INT) AS sr75, count(*) AS n_frames FROM ious GROUP BY ALL),
seqs AS (SELECT {keys}seq_id, coalesce(auc, 0) AS auc, coalesce(ao, 0) AS ao, coalesce(sr50, 0) AS sr50, coalesce(sr75, 0) AS sr75,
  coalesce(n_frames, 0) AS n_frames FROM (SELECT DISTINCT {keys}seq_id FROM all_ious) LEFT JOIN scored USING ({keys}seq_id))""")


METRICS = ("auc", "ao", "sr50", "sr75")
METRIC_SQL = ", ".join(f"{q6(m)} AS {m}" for m in METRICS)


@query("d17_frame_iou", f"WITH {duck_tracks()} SELECT seq_id, frame, {q6('iou')} AS iou FROM ious")
def d17(spark, sf):
    return T.overlaps(*tracks(spark, sf)).select("seq_id", "frame", r6("iou").alias("iou"))


@query("d18_success_auc", f"""WITH {duck_tracks()}
SELECT i AS step, {q6('avg((iou > i/20::DOUBLE)::INT)')} AS success FROM ious, range(0, 21) t(i) GROUP BY i
UNION ALL SELECT -1, {q6('avg((SELECT count(*) FROM range(0, 21) t(i) WHERE iou > i/20::DOUBLE)/21::DOUBLE)')} FROM ious""")
def d18(spark, sf):
    """Success plot over all frames, and its mean (step -1)."""
    rates = ", ".join(f"avg(double(iou > {i}/20D))" for i in range(21))
    summed = T.overlaps(*tracks(spark, sf)).agg(F.expr(f"array({rates}) AS plot"), F.expr(f"avg({X.success('iou')}) AS auc"))
    return summed.select(F.expr("posexplode(plot)").alias("step", "success"), "auc").select(
        "step", r6("success").alias("success")).unionByName(summed.select(F.lit(-1).alias("step"), r6("auc").alias("success")))


@query("d19_sequence_metrics", f"WITH {duck_tracks()} SELECT seq_id, {METRIC_SQL}, n_frames FROM seqs")
def d19(spark, sf):
    per = T.sequence_metrics(T.frame_overlaps(*tracks(spark, sf)))
    return per.select("seq_id", *[r6(m).alias(m) for m in METRICS], "n_frames")


@query("d20_macro_metrics", f"""WITH {duck_tracks()}
SELECT {', '.join(f"{q6(f'avg({m})')} AS {m}" for m in METRICS)}, count(*) AS n_seqs FROM seqs WHERE n_frames > 0""")
def d20(spark, sf):
    result = T.macro(T.sequence_metrics(T.frame_overlaps(*tracks(spark, sf))))
    return result.select(*[r6(m).alias(m) for m in METRICS], "n_seqs")


QI_SHIFT = "(10.0D + 8.0D*qi)*U('t|'||CAST(event_id AS STRING))"
FRAME_BPP = "(0.1D + 0.05D*U('fb|'||CAST(frame AS STRING)))*pow(0.6D, qi)"


@query("d5_tracking_curve", f"""WITH {duck_tracks(QI_SHIFT, ", (SELECT unnest(range(0, 4)) AS qi)", "qi, ")},
rate AS (SELECT qi, avg({duck_sql(FRAME_BPP)}) AS bpp FROM frames GROUP BY ALL)
SELECT qi AS qp, {q8('any_value(bpp)')} AS bpp, {', '.join(f"{q6(f'avg({m})')} AS {m}" for m in METRICS)}, count(*) AS n_seqs
FROM seqs JOIN rate USING (qi) WHERE n_frames > 0 GROUP BY qi""")
def d5(spark, sf):
    predicted, truth = tracks(spark, sf, QI_SHIFT, (F.explode(F.sequence(F.lit(0), F.lit(3))).alias("qi"),))
    per = T.sequence_metrics(T.frame_overlaps(predicted, truth, ["qi"]), ["qi"]).withColumnRenamed("qi", "qp")
    frames = predicted.withColumn("bpp", F.expr(spark_sql(FRAME_BPP))).withColumnRenamed("qi", "qp")
    curve = T.tracking_curve(frames, per, [])
    return curve.select("qp", r8("bpp").alias("bpp"), *[r6(m).alias(m) for m in METRICS], "n_seqs")


@query("b10_frame_sampling", """WITH f AS (SELECT user_id AS seq_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS index
  FROM events)
SELECT seq_id, event_id, index, greatest(0, least(1, (event_id % 700)/640.0::DOUBLE)) AS x0 FROM f WHERE index % 3 = 0 AND index < 60""")
def b10(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("seq_id"), "ts", "event_id")
    sampled = T.sample_frames(events, ["ts", "event_id"], 3, 20)
    box = "named_struct('x0', double(event_id % 700), 'y0', 0D, 'x1', 700D, 'y1', 10D)"
    return sampled.withColumn("b", F.expr(T.normalise_box(f"({box})", "640", "480"))).select(
        "seq_id", "event_id", "index", F.col("b.x0").alias("x0"))
