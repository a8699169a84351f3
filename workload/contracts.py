"""Contract checks (L) on tables with planted faults, and the remaining projections and joins (B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitcurve.functions import params as PR
from bitcurve.operators import cells as CE
from bitcurve.operators import checks as L
from bitcurve.operators import curves as V
from bitcurve.operators import custom
from bitcurve.operators import grids
from bitcurve.operators import joins as J
from bitcurve.operators import select as S
from bitcurve.operators.ranking import prefix_sum
from bitcurve.schema import CANDIDATES, QPS
from bitcurve.session import scratch
from workload import selection as G
from workload.curves import q6, q8, r6, r8
from workload.fixtures import duck_measurements, measurements
from workload.gating import slack_scored
from workload.registry import query, table
from workload.splits import DUCK_CLIPS, clips

KEY = ["source_id", "qp", "cand_idx"]
DUCK_M = duck_measurements("candidate", "bpp", "coded_bytes", "correct_a", "proxy_error")


def rows(spark, sf, *columns):
    return measurements(spark, sf, *columns)


@query("l1_record_identity", """SELECT user_id AS source_id, event_id, CASE WHEN event_id % 41 = 0 AND event_id % 43 = 0 THEN 'schema,cache_key'
  WHEN event_id % 41 = 0 THEN 'schema' ELSE 'cache_key' END AS fields FROM events WHERE event_id % 41 = 0 OR event_id % 43 = 0""")
def l1(spark, sf):
    records = table(spark, sf, "events").selectExpr(
        "event_id", "user_id AS source_id", "CASE WHEN event_id % 41 = 0 THEN 2 ELSE 3 END AS schema", "'h264' AS codec",
        "CASE WHEN event_id % 43 = 0 THEN NULL ELSE 'k' END AS cache_key")
    wrong = L.record_identity(records, {"schema": "3", "codec": "'h264'", "cache_key": "'k'"}, "event_id")
    return wrong.join(records.select("event_id", "source_id"), "event_id").select("source_id", "event_id", "fields")


FAULTS = "NOT (source_id % 97 = 5 AND qp = 40 AND cand_idx = 3)"


@query("l2_complete_grid", """SELECT p_partkey AS source_id, 40 AS qp, 3 AS cand_idx, 'missing' AS violation FROM part WHERE p_partkey % 97 = 5
UNION ALL SELECT p_partkey, 30, 0, 'repeated' FROM part WHERE p_partkey % 89 = 7
UNION ALL SELECT p_partkey, 55, 1, 'extra' FROM part WHERE p_partkey % 83 = 9""")
def l2(spark, sf):
    good = rows(spark, sf).select(*KEY).filter(FAULTS)
    repeated = good.filter("source_id % 89 = 7 AND qp = 30 AND cand_idx = 0")
    extra = good.filter("source_id % 83 = 9 AND qp = 30 AND cand_idx = 1").withColumn("qp", F.lit(55))
    faulty = good.unionByName(repeated).unionByName(extra)
    grid = grids.product_grid(spark, qp=QPS, cand_idx=tuple(range(6)))
    return L.grid_violations(faulty, "source_id", ["qp", "cand_idx"], grid)


@query("l3_candidate_order", f"""WITH {DUCK_M} SELECT source_id, qp, cand_idx, 'area96' AS candidate FROM m WHERE cand_idx = 0 AND source_id % 71 = 2""")
def l3(spark, sf):
    swapped = rows(spark, sf, "candidate").withColumn(
        "candidate", F.expr("CASE WHEN cand_idx = 0 AND source_id % 71 = 2 THEN 'area96' ELSE candidate END"))
    return L.candidate_order(swapped, CANDIDATES, ["source_id", "qp"])


@query("l4_source_set", """SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id % 5 = 0 THEN 'repeated' END AS violation
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR d.doc_id % 5 = 0""")
def l4(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id")
    actual = labels.unionByName(labels.filter("doc_id % 5 = 0"))
    return L.source_set(actual, table(spark, sf, "documents"), "doc_id")


@query("l4_order_mismatch", f"""WITH {DUCK_CLIPS}, a AS (SELECT key, row_number() OVER (ORDER BY key)::BIGINT AS pos FROM clips),
b AS (SELECT key, row_number() OVER (ORDER BY CASE WHEN doc_id % 50 = 1 THEN 'zz'||key ELSE key END)::BIGINT AS pos FROM clips)
SELECT pos, a.key AS actual, b.key AS expected FROM a JOIN b USING (pos) WHERE a.key <> b.key""")
def l4_order(spark, sf):
    c = clips(spark, sf).selectExpr("key", "1 AS one", "CASE WHEN doc_id % 50 = 1 THEN concat('zz', key) ELSE key END AS other")
    return L.order_mismatches(prefix_sum(c, ["key"], "one", "pos"), prefix_sum(c, ["other"], "one", "pos"), "key")


@query("l5_value_rules", f"""WITH {DUCK_M}
SELECT source_id, qp, cand_idx, 'bpp' AS rule FROM m WHERE source_id % 61 = 0 AND cand_idx = 2
UNION ALL SELECT source_id, qp, cand_idx, 'error_range' FROM m WHERE proxy_error > 0.15::DOUBLE
UNION ALL SELECT source_id, qp, cand_idx, 'outcome' FROM m WHERE source_id % 67 = 1""")
def l5(spark, sf):
    faulty = rows(spark, sf, "bpp", "correct_a", "proxy_error").withColumns({
        "bpp": F.expr("CASE WHEN source_id % 61 = 0 AND cand_idx = 2 THEN double('NaN') ELSE bpp END"),
        "correct_a": F.expr("CASE WHEN source_id % 67 = 1 THEN NULL ELSE correct_a END")})
    if L.extra_fields(faulty, {*KEY, "codec", "bpp", "correct_a", "proxy_error"}):
        raise ValueError("unexpected fields")
    return L.value_violations(faulty, KEY, {
        "bpp": L.positive_finite("bpp"), "error_range": "proxy_error BETWEEN 0 AND 0.15D", "outcome": "correct_a IS NOT NULL"})


@query("l6_bytes_match_rate", f"""WITH {DUCK_M} SELECT source_id, qp, cand_idx FROM m WHERE source_id % 53 = 3""")
def l6(spark, sf):
    faulty = rows(spark, sf, "coded_bytes").withColumn(
        "bpp", F.expr("coded_bytes*8D/(16*128*128) + CASE WHEN source_id % 53 = 3 THEN 1e-6D ELSE 0D END"))
    return L.bytes_match_rate(faulty, KEY, "(16*128*128)")


@query("b6_rate_from_bytes", f"""WITH {DUCK_M} SELECT source_id, qp, cand_idx, {q8('coded_bytes*8.0/(16*112*112)*(112*112)/(128*128.0)')} AS bpp FROM m""")
def b6(spark, sf):
    native = PR.bits_per_pixel("coded_bytes", "16", "112", "112")
    return rows(spark, sf, "coded_bytes").select(*KEY, r8(F.expr(PR.normalised_bpp(native, "112", "112"))).alias("bpp"))


@query("l7_outcome_consistent", """SELECT vec_id FROM embeddings WHERE vec_id % 20 = 3 OR vec_id % 31 = 4""")
def l7(spark, sf):
    scored = table(spark, sf, "embeddings").selectExpr(
        "vec_id", "label", "CASE WHEN vec_id % 31 = 4 THEN 400 ELSE label END AS predicted", "vec_id % 20 <> 3 AS correct")
    return L.outcome_consistent(scored, ["vec_id"], 400)


@query("l8_stream_scores", f"""WITH {G.duck_wide(G.SLACK)}, {G.duck_v1("v1", G.LOOSE)}, {G.duck_v1("tight", G.TIGHT)}
SELECT source_id, qp, a.cand_idx, 2::BIGINT AS n_arms FROM v1 a JOIN tight b USING (source_id, codec, qp) WHERE a.cand_idx = b.cand_idx AND source_id % 37 = 1""")
def l8(spark, sf):
    cells = G.with_base(G.with_base(G.cells(spark, sf, G.SLACK), "x", G.LOOSE), "y", G.TIGHT)
    arms = cells.selectExpr("source_id", "qp", "stack(2, x, source_id % 3, y, source_id % 3 + int(source_id % 37 = 1)) AS (cand_idx, score)")
    return L.inconsistent_streams(arms, KEY, ["score"])


@query("l9_recomputed_choices", f"""WITH {G.duck_wide(G.SLACK)}, {G.duck_v1("v1", G.LOOSE)}
SELECT source_id, qp, 0 AS cand_idx, 'recorded' AS side FROM v1 WHERE source_id % 59 = 2 AND cand_idx <> 0
UNION ALL SELECT source_id, qp, cand_idx, 'recomputed' FROM v1 WHERE source_id % 59 = 2 AND cand_idx <> 0""")
def l9(spark, sf):
    fresh = S.choose(G.cells(spark, sf, G.SLACK), S.slack(*G.LOOSE))
    recorded = fresh.withColumn("cand_idx", F.expr("CASE WHEN source_id % 59 = 2 THEN 0 ELSE cand_idx END"))
    return L.choices_recompute(recorded, fresh, KEY)


CHANGED = "source_id % 40 = 3 AND qp = 30 AND cand_idx = 0"


@query("l10_shard_provenance", f"""WITH {DUCK_M}, s AS (SELECT *, source_id % 4 AS shard, {CHANGED} AS changed FROM m),
c AS (SELECT count(DISTINCT shard) = 4 AND min(shard) = 0 AND max(shard) = 3 AS shards,
  count(DISTINCT CASE WHEN shard = 2 THEN 'v2' ELSE 'v1' END) = 1 AS versions, count(*) FILTER (WHERE changed) = 0 AS records,
  count(DISTINCT codec) = 1 AS codecs, count(*) = (SELECT count(*) FROM m) AS trials FROM s)
SELECT 'shards' AS "check", shards AS pass FROM c UNION ALL SELECT 'same_codec', codecs FROM c UNION ALL SELECT 'same_version', versions FROM c
UNION ALL SELECT 'trials', trials FROM c UNION ALL SELECT 'records', records FROM c""")
def l10(spark, sf):
    """Manifests of four hash shards against the rows that are stored: shard 2 was made by another version, rows of
    shard 3 were changed afterwards."""
    sharded = rows(spark, sf, "bpp").withColumn("shard", F.expr("int(source_id % 4)"))
    path = scratch(spark, "shards")
    changed = F.expr(f"CASE WHEN {CHANGED} THEN bpp + 1 ELSE bpp END")
    sharded.withColumn("bpp", changed).write.partitionBy("shard").parquet(path)
    digest = "string(bit_xor(xxhash64(source_id, qp, cand_idx, bpp)))"
    manifests = sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("trials"), F.expr(f"{digest} AS records_sha"))
    stored = spark.read.parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("streams"), F.expr(f"{digest} AS actual_sha"))
    manifests = manifests.join(stored, "shard", "left").selectExpr(
        "*", "'h264' AS codec", "CASE WHEN shard = 2 THEN 'v2' ELSE 'v1' END AS version")
    return L.shard_provenance(manifests, ["codec", "version"], 4)


@query("l12_outside_grid", """SELECT doc_id, kl_slack FROM (SELECT doc_id, (doc_id % 7)*0.01::DOUBLE AS kl_slack FROM documents) WHERE doc_id % 7 NOT IN (0, 2, 5)""")
def l12(spark, sf):
    used = table(spark, sf, "documents").selectExpr("doc_id", "(doc_id % 7)*0.01D AS kl_slack")
    return L.outside_grid(used, grids.v1_grid(spark).select("kl_slack").distinct(), ["kl_slack"]).select("doc_id", "kl_slack")


@query("l13_artifact_bytes", """SELECT doc_id AS name, text = CASE WHEN doc_id % 10 = 0 THEN replace(text, chr(10), chr(13)||chr(10)) WHEN doc_id % 11 = 0 THEN text||'x' ELSE text END AS same_bytes,
  doc_id % 10 = 0 OR doc_id % 11 <> 0 AS same_text FROM documents""")
def l13(spark, sf):
    docs = table(spark, sf, "documents")
    left = docs.selectExpr("doc_id AS name", "CAST(replace(text, '\\r\\n', '\\n') AS BINARY) AS content")
    right = docs.selectExpr("doc_id AS name", """CAST(CASE WHEN doc_id % 10 = 0 THEN replace(replace(text, '\\r\\n', '\\n'), '\\n', '\\r\\n')
        WHEN doc_id % 11 = 0 THEN concat(replace(text, '\\r\\n', '\\n'), 'x') ELSE replace(text, '\\r\\n', '\\n') END AS BINARY) AS content""")
    return L.artifact_differences(left, right)


@query("l14_single_class", f"""WITH {DUCK_M} SELECT 'always' AS label, count(*) AS positives, count(*) AS total FROM m""")
def l14(spark, sf):
    return L.single_class(rows(spark, sf, "correct_a").withColumn("always", F.lit(True)), ["correct_a", "always"])


@query("l15_metric_recompute", "SELECT 'h264' AS codec, 'b' AS model WHERE (SELECT count(*) FROM part) > 0")
def l15(spark, sf):
    fresh = slack_scored(spark, sf, ("a", "b")).select("codec", "model", "bd_rate", "n")
    recorded = fresh.withColumn("bd_rate", F.expr("bd_rate + CASE model WHEN 'b' THEN 1e-6D ELSE 1e-12D END"))
    return L.metric_differences(fresh, recorded, ["codec", "model"], ["bd_rate", "n"])


@query("l16_lazy_outcomes", f"""WITH {G.duck_wide(G.SLACK)}, {G.duck_v1("v1", G.LOOSE)},
needed AS (SELECT source_id, qp, cand_idx FROM v1 UNION SELECT source_id, qp, 0 FROM v1)
SELECT * FROM needed WHERE cand_idx = 5 AND source_id % 3 = 0""")
def l16(spark, sf):
    choices = S.choose(G.cells(spark, sf, G.SLACK), S.slack(*G.LOOSE))
    outcomes = rows(spark, sf).filter("NOT (cand_idx = 5 AND source_id % 3 = 0)")
    return L.unscored(choices, outcomes, ["source_id", "qp"])


# --- projections -------------------------------------------------------------------------------

@query("b12_flatten_params", """SELECT p_partkey, unnest(['name', 'model.brand', 'model.size.value', 'model.size.list']) AS path,
  unnest([p_name, p_brand, p_size::VARCHAR, p_size||','||(p_size + 1)]) AS value FROM part""")
def b12(spark, sf):
    nested = table(spark, sf, "part").selectExpr(
        "p_partkey", "p_name AS name", "named_struct('brand', p_brand, 'size', named_struct('value', p_size, 'list', array(p_size, p_size + 1))) AS model")
    return PR.flatten_params(nested, ["p_partkey"])


@query("b13_clip_params", f"""SELECT event_id, greatest(0.0, least(1.0, value/100)) AS denoise, greatest(0.8, least(1.3, value/50)) AS contrast FROM events""")
def b13(spark, sf):
    raw = table(spark, sf, "events").selectExpr("event_id", "value/100 AS denoise", "value/50 AS contrast")
    return PR.clip_params(raw, {"denoise": (0.0, 1.0), "contrast": (0.8, 1.3)})


@query("b14_restrict", f"""WITH {duck_measurements("bpp", codecs=("h264", "h265"))}
SELECT codec, qp, count(*) AS n FROM m WHERE codec = 'h265' AND qp IN (30, 45) GROUP BY ALL""")
def b14(spark, sf):
    both = measurements(spark, sf, "bpp", codecs=("h264", "h265"))
    return PR.restrict(both, ["H265"], [45, 30], ("h264", "h265"), QPS).groupBy("codec", "qp").agg(F.count(F.lit(1)).alias("n"))


# --- joins ------------------------------------------------------------------------------------

@query("c1_anchor_of_cell", f"""WITH {G.duck_wide(("bpp", "proxy_error"))}
SELECT source_id, qp, cand_idx, {q8('bpp/bpp_0')} AS ratio, {q8('proxy_error - proxy_error_0')} AS excess FROM wide""")
def c1(spark, sf):
    joined = CE.attach_anchor(rows(spark, sf, "bpp", "proxy_error"), ["bpp", "proxy_error"])
    return joined.select(*KEY, r8(F.expr("bpp/anchor_bpp")).alias("ratio"), r8(F.expr("proxy_error - anchor_proxy_error")).alias("excess"))


@query("c2_proxy_one_to_one", """SELECT p_partkey AS source_id, CASE p_partkey % 101 WHEN 4 THEN 1 ELSE 1 END::BIGINT AS n_left,
  CASE p_partkey % 101 WHEN 4 THEN 0 ELSE 2 END::BIGINT AS n_right FROM part WHERE p_partkey % 101 IN (4, 5)""")
def c2(spark, sf):
    parts = table(spark, sf, "part").selectExpr("p_partkey AS source_id")
    proxies = parts.filter("source_id % 101 <> 4").unionByName(parts.filter("source_id % 101 = 5"))
    return J.one_to_one(parts, proxies, ["source_id"])


@query("c3_frozen_outcomes", f"""WITH {G.duck_wide(G.SLACK + ("candidate", "correct_a"))}, {G.duck_v1("v1", G.LOOSE)}, {G.duck_v1("tight", G.TIGHT)}
SELECT arm, qp, count(*) AS n, count(*) FILTER (WHERE correct_a) AS correct FROM (SELECT 'loose' AS arm, * FROM v1 UNION ALL SELECT 'tight', * FROM tight) GROUP BY ALL""")
def c3(spark, sf):
    cells = G.with_base(G.with_base(G.cells(spark, sf, G.SLACK), "x", G.LOOSE), "y", G.TIGHT)
    frozen = cells.select("source_id", "qp", F.expr(S.candidate_name("x")).alias("loose"), F.expr(S.candidate_name("y")).alias("tight"))
    joined = J.frozen_outcomes(frozen, rows(spark, sf, "candidate", "correct_a"), ["loose", "tight"], ["source_id", "qp"], ["correct_a"])
    return joined.groupBy("arm", "qp").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct_a").alias("correct"))


@query("c10_frames_paired", """SELECT user_id AS seq_id, count(*) AS n FROM events WHERE event_type <> 'error' AND event_id % 6 <> 0 GROUP BY ALL""")
def c10(spark, sf):
    from bitcurve.operators.tracking import overlaps
    from workload.boxes import tracks

    # All sequences, those too that the other queries' fixture leaves without a valid frame.
    predicted, truth = tracks(spark, sf, valid="event_type <> 'error'")
    return overlaps(predicted.filter("frame % 6 <> 0"), truth).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))


@query("c11_policies_by_cells", f"""WITH {duck_measurements("bpp")}, {G.P_DUAL}
SELECT policy_id, mode, qp, count(*) AS n FROM m, p WHERE cand_idx = 0 GROUP BY ALL""")
def c11(spark, sf):
    crossed = S.cross_policies(G.cells(spark, sf, ("bpp",)), grids.dual_grid(spark))
    return crossed.groupBy("policy_id", "mode", "qp").agg(F.count(F.lit(1)).alias("n"))


@query("c12_draw_weights", f"""WITH {duck_measurements()}, pos AS (SELECT p_partkey AS source_id, row_number() OVER (ORDER BY md5(p_partkey::VARCHAR), p_partkey) - 1 AS pos FROM part),
picks AS (SELECT draw, ('0x'||substr(md5('w1|'||draw||'|'||pos), 1, 15))::BIGINT % (SELECT count(*) FROM pos) AS pos FROM pos, (SELECT unnest(range(0, 20)) AS draw)),
w AS (SELECT draw, source_id, count(*) AS w FROM picks JOIN pos USING (pos) GROUP BY ALL)
SELECT draw, count(*) AS sources, sum(w)::BIGINT AS picks, max(w) AS most, sum(w*source_id)::BIGINT AS pin FROM w GROUP BY ALL""")
def c12(spark, sf):
    from bitcurve.operators.bootstrap import image_weights

    sources = table(spark, sf, "part").selectExpr("p_partkey AS source_id")
    w = image_weights(sources, 20, "w1", "source_id")
    return w.groupBy("draw").agg(F.count(F.lit(1)).alias("sources"), F.sum("w").alias("picks"), F.max("w").alias("most"),
                                 F.expr("sum(w*source_id)").alias("pin"))


@query("c13_rescore_tolerance", f"""WITH {DUCK_M}
SELECT source_id, qp, CASE WHEN source_id % 79 = 1 THEN 'missing' WHEN source_id % 73 = 2 THEN 'stream' ELSE 'value' END AS reason FROM m
WHERE cand_idx = 1 AND (source_id % 79 = 1 OR source_id % 73 = 2 OR source_id % 67 = 3)""")
def c13(spark, sf):
    primary = rows(spark, sf, "candidate", "bpp").filter("cand_idx = 1")
    again = primary.filter("source_id % 79 <> 1").withColumns({
        "candidate": F.expr("CASE WHEN source_id % 73 = 2 THEN 'area96' ELSE candidate END"),
        "bpp": F.expr("bpp + CASE WHEN source_id % 67 = 3 THEN 1e-6D ELSE 1e-12D END")})
    return J.tolerance_violations(primary, again, ["source_id", "qp"], "bpp", "candidate", 1e-9)


@query("c14_curves_by_qp", f"""WITH {duck_measurements("candidate", "bpp", "correct_a")},
c AS (SELECT candidate, qp, avg(bpp) AS bpp, avg(correct_a::INT) AS q FROM m GROUP BY ALL)
SELECT t.candidate AS arm, qp, {q6('t.bpp/a.bpp')} AS rate_ratio, {q6('t.q - a.q')} AS gap FROM c a JOIN c t USING (qp) WHERE a.candidate = 'identity128' AND t.candidate <> 'identity128'""")
def c14(spark, sf):
    curves = V.curve(rows(spark, sf, "candidate", "bpp", "correct_a").withColumn("g", F.lit(0)), ["g", "candidate"], quality="correct_a")
    paired = V.against(curves, "candidate", "identity128", ["g"])
    zipped = f"arrays_zip(transform(anchor_points, a -> a.qp), {V.rate_ratios('anchor_points', 'points')}, {V.quality_gaps('anchor_points', 'points')})"
    return paired.select(F.col("candidate").alias("arm"), F.expr(f"inline({zipped})").alias("qp", "rate_ratio", "gap")).select(
        "arm", "qp", r6("rate_ratio").alias("rate_ratio"), r6("gap").alias("gap"))


@query("m3_custom_aggregate", f"""WITH {duck_measurements("candidate", "bpp", "correct_a")}
SELECT candidate, qp, {q6('(avg(bpp*correct_a::INT) - avg(bpp)*avg(correct_a::INT))')} AS covariance FROM m GROUP BY ALL""")
def m3(spark, sf):
    """A caller's own metric, merged from states per task."""
    measured = rows(spark, sf, "candidate", "bpp", "correct_a").withColumn("ok", F.expr("int(correct_a)"))
    found = custom.aggregate(measured, ["candidate", "qp"], ["bpp", "ok"], custom.COVARIANCE, "covariance")
    return found.withColumn("covariance", r6("covariance"))
