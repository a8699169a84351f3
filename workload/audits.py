"""Report aggregates (D2, D6, D7, D9-D11, D23, D25-D38) and array functions (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitcurve.functions import arrays as A
from bitcurve.functions import bd, sql
from bitcurve.functions import strings as T
from bitcurve.operators import audit
from bitcurve.operators import curves as V
from bitcurve.operators import select as S
from bitcurve.operators.cells import pick
from bitcurve.session import parallelism
from workload import selection as G
from workload.curves import q6, q8, r6, r8
from workload.fixtures import duck_bd, duck_measurements, measurements
from workload.gating import DUCK_ARMS, arm_curves, duck_arm_score, VS_ANCHOR
from workload.registry import query, table
from workload.resampling import chosen_rows

OUT = ("correct_a", "correct_b")
DUCK_CHOSEN = f"{G.duck_wide(G.SPATIAL + OUT)}, {G.duck_v1('v1', G.LOOSE)}"


@query("d2_running_curve", f"""WITH b AS (SELECT event_type AS method, hour(ts) AS key, value AS bpp, 1 + event_id % 3 AS n,
  (event_id % 7)::DOUBLE AS score_sum FROM events),
s AS (SELECT method, key, sum(bpp*n)/sum(n) AS bpp, sum(score_sum)/sum(n) AS quality, sum(n)::BIGINT AS n FROM b GROUP BY ALL)
SELECT method, key::INT AS key, {q6('bpp')} AS bpp, {q6('quality')} AS quality, n,
  row_number() OVER (PARTITION BY method ORDER BY bpp, key)::INT AS rank FROM s""")
def d2(spark, sf):
    batches = table(spark, sf, "events").selectExpr(
        "event_type AS method", "hour(ts) AS key", "value AS bpp", "1 + event_id % 3 AS n", "double(event_id % 7) AS score_sum")
    return audit.running_curve(batches).withColumns({"bpp": r6("bpp"), "quality": r6("quality")})


@query("d6_choice_histogram", f"""WITH {G.duck_wide(G.SLACK)}, {G.duck_v1("v1", G.LOOSE)}, {G.duck_v1("tight", G.TIGHT)},
c AS (SELECT a.qp, a.cand_idx, a.cand_idx <> b.cand_idx AS s FROM v1 a JOIN tight b USING (source_id, codec, qp))
SELECT qp, cand_idx, count(*) AS n, count(*) FILTER (WHERE s) AS switched FROM c GROUP BY GROUPING SETS ((qp, cand_idx), (cand_idx))""")
def d6(spark, sf):
    cells = G.with_base(G.cells(spark, sf, G.SLACK), "tight_idx", G.TIGHT)
    return audit.choice_histogram(S.choose(cells, S.slack(*G.LOOSE), keep=("tight_idx",)), "tight_idx")


@query("d7_top_k", f"""WITH e AS (SELECT embedding::DOUBLE[] AS v, label FROM embeddings),
r AS (SELECT (SELECT count(*) FROM (SELECT unnest(v) AS x) WHERE x > v[label + 1]) AS better FROM e)
SELECT {q6('avg((better < 1)::INT)')} AS top1, {q6('avg((better < 5)::INT)')} AS top5, count(*) AS n FROM r""")
def d7(spark, sf):
    rows = table(spark, sf, "embeddings").selectExpr("CAST(embedding AS ARRAY<DOUBLE>) AS v", "label")
    result = audit.top_k(rows, "v", "label")
    return result.select(r6("top1").alias("top1"), r6("top5").alias("top5"), "n")


@query("d8_bd_rate", f"""WITH {DUCK_ARMS}, {duck_arm_score(VS_ANCHOR)}
SELECT trial AS arm, codec, model, {q6('bd_rate')} AS bd_rate FROM arm_score""")
def d8(spark, sf):
    paired = V.against(arm_curves(spark, sf), "arm", "identity128", ["codec", "model"])
    return paired.select("arm", "codec", "model", r6(bd.bd_rate("anchor_points", "points")).alias("bd_rate"))


@query("d9_bd_metric", f"""WITH {DUCK_ARMS}, {duck_arm_score(VS_ANCHOR)}
SELECT trial AS arm, codec, model, {q6('bd_metric')} AS bd_metric FROM arm_score""")
def d9(spark, sf):
    """Through the registered SQL function."""
    bd.register(spark)
    paired = V.against(arm_curves(spark, sf), "arm", "identity128", ["codec", "model"])
    plain = "transform({0}, p -> named_struct('rate', p.rate, 'quality', p.quality))"
    value = F.expr(f"bd_metric({plain.format('anchor_points')}, {plain.format('points')})")
    return paired.select("arm", "codec", "model", r6(value).alias("bd_metric"))


@query("d10_quadratic_bd", f"""WITH {DUCK_ARMS}, {duck_arm_score(VS_ANCHOR).replace('CASE WHEN s.n >= 4 THEN 3 WHEN s.n = 3 THEN 2 ELSE 1 END', '2')}
SELECT trial AS arm, codec, model, {q6('bd_rate')} AS bd_rate, {q6('bd_metric')} AS bd_quality FROM arm_score""")
def d10(spark, sf):
    paired = V.against(arm_curves(spark, sf), "arm", "identity128", ["codec", "model"])
    return paired.select(
        "arm", "codec", "model", r6(bd.bd_rate_quadratic("anchor_points", "points")).alias("bd_rate"),
        r6(bd.bd_quality_quadratic("anchor_points", "points")).alias("bd_quality"))


@query("d11_pareto_score", f"""WITH {DUCK_ARMS}
SELECT codec, arm, model, qp, {q6('quality - 0.15::DOUBLE*ln(1 + 1000*bpp)')} AS score FROM arm_curve""")
def d11(spark, sf):
    return arm_curves(spark, sf).select(
        "codec", "arm", "model", "qp", r6(bd.pareto_score("quality", "(1000*bpp)")).alias("score"))


@query("b2_clean_points", f"""WITH {DUCK_ARMS}, d AS (SELECT codec, arm, model, qp, CASE WHEN qp = 35 AND arm = 'area96' THEN 0 ELSE bpp END AS rate,
  CASE WHEN qp = 50 AND model = 'e' THEN 'nan'::DOUBLE ELSE quality END AS quality FROM arm_curve)
SELECT codec, arm, model, count(*) AS n, min(qp) AS first_qp, max(qp) AS last_qp FROM d WHERE rate > 0 AND isfinite(quality) GROUP BY ALL""")
def b2(spark, sf):
    dirty = arm_curves(spark, sf).withColumns({
        "bpp": F.expr("CASE WHEN qp = 35 AND arm = 'area96' THEN 0D ELSE bpp END"),
        "quality": F.expr("CASE WHEN qp = 50 AND model = 'e' THEN double('NaN') ELSE quality END")})
    cleaned = V.curve_points(dirty, ["codec", "arm", "model"]).withColumn("points", bd.clean_points("points"))
    return cleaned.select("codec", "arm", "model", F.expr("bigint(size(points)) AS n"),
                          F.expr("points[0].qp AS first_qp"), F.expr("element_at(points, -1).qp AS last_qp"))


D23 = ("p10", "p50", "p90", "gap_a_pp", "gap_b_pp")


@query("d23_saving_quantiles", f"""WITH {duck_measurements("bpp", "proxy_error", *OUT)},
p AS (SELECT t.qp, 100*(1 - t.bpp/a.bpp) AS saving_pct, t.proxy_error - a.proxy_error AS excess,
  t.correct_a::INT - a.correct_a::INT AS ga, t.correct_b::INT - a.correct_b::INT AS gb
  FROM m a JOIN m t USING (source_id, codec, qp) WHERE a.cand_idx = 0 AND t.cand_idx = 1),
l AS (SELECT qp, 'saving_pct' AS metric, saving_pct AS v, ga, gb FROM p UNION ALL SELECT qp, 'excess', excess, ga, gb FROM p)
SELECT qp, metric, {q6('quantile_cont(v, 0.1)')} AS p10, {q6('quantile_cont(v, 0.5)')} AS p50, {q6('quantile_cont(v, 0.9)')} AS p90,
  count(*) AS n, {q6('100*avg(ga)')} AS gap_a_pp, {q6('100*avg(gb)')} AS gap_b_pp FROM l GROUP BY ALL""")
def d23(spark, sf):
    cells = G.cells(spark, sf, ("bpp", "proxy_error") + OUT)
    return audit.saving_diagnostics(cells, 1).withColumns({n: r6(n) for n in D23})


DUCK_PAIRED = f"""{DUCK_CHOSEN}, o AS (SELECT qp, 'a' AS model, correct_a AS now, correct_a_0 AS before FROM v1
  UNION ALL SELECT qp, 'b', correct_b, correct_b_0 FROM v1)"""


@query("d25_paired_contingency", f"""WITH {DUCK_PAIRED}
SELECT qp, model, count(*) FILTER (WHERE now AND NOT before) AS gains, count(*) FILTER (WHERE before AND NOT now) AS losses,
  count(*) FILTER (WHERE now AND before) AS both_right, count(*) FILTER (WHERE NOT now AND NOT before) AS both_wrong,
  sum(now::INT - before::INT)::BIGINT AS net, {q6('100*avg(now::INT - before::INT)')} AS gap_pp FROM o GROUP BY ALL""")
def d25(spark, sf):
    return audit.contingency(chosen_rows(spark, sf), ("a", "b")).withColumn("gap_pp", r6("gap_pp"))


@query("d26_guard_deficit", f"""WITH {DUCK_PAIRED}, c AS (SELECT qp, model, count(*) FILTER (WHERE before) AS base_correct,
  count(*) FILTER (WHERE now) AS correct, count(*) AS n FROM o GROUP BY ALL)
SELECT *, ceil(round(base_correct - 0.01::DOUBLE*n, 9))::BIGINT AS needed,
  greatest(ceil(round(base_correct - 0.01::DOUBLE*n, 9))::BIGINT - correct, 0) AS missing FROM c""")
def d26(spark, sf):
    return audit.guard_deficit(chosen_rows(spark, sf), ("a", "b"))


@query("d27_transitions", f"""WITH {DUCK_CHOSEN}, {G.duck_v1("tight", G.TIGHT)},
t AS (SELECT o.source_id, o.qp, o.cand_idx AS old_idx, n.cand_idx AS new_idx, n.proxy_error - o.proxy_error AS dp, n.bpp - o.bpp AS db
  FROM tight o JOIN v1 n USING (source_id, codec, qp) WHERE o.cand_idx <> n.cand_idx)
SELECT qp, old_idx, new_idx, count(*) AS n, count(DISTINCT source_id) AS sources, {q6('avg(dp)')} AS mean_d_proxy, {q6('avg(db)')} AS mean_d_bpp
FROM t GROUP BY GROUPING SETS ((qp, old_idx, new_idx), (old_idx, new_idx))""")
def d27(spark, sf):
    cells = G.with_base(G.with_base(G.cells(spark, sf, G.SPATIAL), "old_idx", G.TIGHT), "new_idx", G.LOOSE)
    rows = cells.select("source_id", "qp", "old_idx", "new_idx", *[
        F.expr(f"{pick('new_idx', f)} - {pick('old_idx', f)} AS {n}") for f, n in (("proxy_error", "d_proxy"), ("bpp", "d_bpp"))])
    return audit.transitions(rows, "old_idx", "new_idx").withColumns({n: r6(n) for n in ("mean_d_proxy", "mean_d_bpp")})


def user_times(spark, sf):
    """Mean view (arm 1) and purchase (arm 2) value per user and day: the paired timings. Over a time of zero the
    ratio is infinite (NaN for zero over zero), where Spark's division would end the query."""
    return table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.expr("avg(CASE WHEN event_type = 'view' THEN value END) AS identity_s"),
        F.expr("avg(CASE WHEN event_type = 'purchase' THEN value END) AS full_s")
    ).filter("identity_s IS NOT NULL AND full_s IS NOT NULL").selectExpr(
        "concat(user_id, '|', day) AS pair", "identity_s", "full_s",
        "CASE WHEN identity_s = 0 THEN full_s*double('Infinity') ELSE full_s/identity_s END AS ratio")


DUCK_TIMES = """t AS (SELECT user_id||'|'||ts::DATE AS pair, avg(value) FILTER (WHERE event_type = 'view') AS identity_s,
  avg(value) FILTER (WHERE event_type = 'purchase') AS full_s FROM events GROUP BY user_id, ts::DATE
  HAVING identity_s IS NOT NULL AND full_s IS NOT NULL),
l AS (SELECT 'identity_s' AS metric, identity_s AS v FROM t UNION ALL SELECT 'full_s', full_s FROM t
  UNION ALL SELECT 'ratio', full_s/identity_s FROM t)"""


@query("d28_runtime_summary", f"""WITH {DUCK_TIMES}
SELECT metric, {q6('quantile_cont(v, 0.5)')} AS median, {q6('avg(v)')} AS mean, {q6('quantile_cont(v, 0.95)')} AS p95, count(*) AS n FROM l GROUP BY ALL""")
def d28(spark, sf):
    summary = audit.runtime_summary(user_times(spark, sf), ("identity_s", "full_s", "ratio"), "pair")
    return summary.select("metric", *[r6(n).alias(n) for n in ("median", "mean", "p95")], "n")


@query("d29_timing_per_arm", f"""SELECT event_type AS metric, {q6('quantile_cont(value, 0.5)')} AS median, {q6('avg(value)')} AS mean,
  count(*) AS n FROM events GROUP BY ALL""")
def d29(spark, sf):
    from bitcurve.operators.quantiles import exact_quantiles, quantile_columns

    rows = table(spark, sf, "events").select(F.col("event_type").alias("metric"), "value", "event_id")
    q = quantile_columns(exact_quantiles(rows, ["metric"], "value", [0.5]), ["metric"], {0.5: "median"})
    means = rows.groupBy("metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return q.join(means, "metric").select("metric", r6("median").alias("median"), r6("mean").alias("mean"), "n")


@query("d30_oracle_headroom", f"""WITH {G.duck_wide(("bpp",) + OUT)},
f AS (SELECT source_id, qp, bool_or(ok) AS any_ok, bool_or(ok AND bpp < bpp_0) AS saves FROM (SELECT *, (NOT correct_a_0 OR correct_a)
  AND (NOT correct_b_0 OR correct_b) AS ok FROM wide WHERE cand_idx > 0) GROUP BY ALL)
SELECT {q6('avg(any_ok::INT)')} AS nonidentity_fraction, {q6('avg(saves::INT)')} AS saving_fraction, count(*) AS n_cells FROM f""")
def d30(spark, sf):
    result = audit.headroom(G.cells(spark, sf, ("bpp",) + OUT), S.keeps_correct, S.N)
    return result.withColumns({n: r6(n) for n in ("nonidentity_fraction", "saving_fraction")})


@query("d31_clean_top1", f"""WITH {duck_measurements("candidate", "clean_a", "a_confidence")}
SELECT candidate, qp, {q6('avg(clean_a::INT)')} AS top1, {q6('avg(a_confidence)')} AS confidence, count(*) AS n FROM m GROUP BY ALL""")
def d31(spark, sf):
    rows = measurements(spark, sf, "candidate", "clean_a", "a_confidence")
    return rows.groupBy("candidate", "qp").agg(r6(F.avg(F.col("clean_a").cast("int"))).alias("top1"),
                                         r6(F.avg("a_confidence")).alias("confidence"), F.count(F.lit(1)).alias("n"))


@query("d32_class_balance", """SELECT lang, label, sum(v)::BIGINT AS positives, count(v) AS total FROM (
  SELECT lang, 'quality' AS label, quality AS v FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT lang, 'toxic', toxic FROM labels JOIN documents USING (doc_id)) GROUP BY ALL""")
def d32(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return audit.class_balance(table(spark, sf, "labels").join(docs, "doc_id"), ("quality", "toxic"), ["lang"])


# Markers and slug pattern of this scan.
MARKERS = ("copyright", "license", "password", "email")
SLUG = "(?i)spdx|all rights reserved|api[_-]?key"


@query("b11_relevance_scan", f"""SELECT doc_id, regexp_matches(text, '{SLUG}') OR {' OR '.join(f"contains(lower(text), '{m}')" for m in MARKERS)} AS relevant FROM documents
UNION ALL SELECT -1 - page_id, regexp_matches(html, '{SLUG}') OR {' OR '.join(f"contains(lower(html), '{m}')" for m in MARKERS)} FROM pages""")
def b11(spark, sf):
    rule = f"{T.has_any('body', MARKERS)} OR body RLIKE '{SLUG}'"
    docs = table(spark, sf, "documents").selectExpr("doc_id", "text AS body")
    pages = table(spark, sf, "pages").selectExpr("-1 - page_id AS doc_id", "html AS body")
    return docs.unionByName(pages).select("doc_id", F.expr(rule).alias("relevant"))


@query("d33_account_rollup", f"""WITH v AS (SELECT source, doc_id % 40 AS item, regexp_matches(text, '{SLUG}') AS relevant, n_chars < 200 AS failed FROM documents)
SELECT source, count(DISTINCT item) AS listed, count(*) AS versions, count(*) FILTER (WHERE relevant) AS relevant,
  count(*) FILTER (WHERE failed) AS errors FROM v GROUP BY ALL""")
def d33(spark, sf):
    versions = table(spark, sf, "documents").selectExpr(
        "source", "doc_id % 40 AS item", f"text RLIKE '{SLUG}' AS relevant", "n_chars < 200 AS failed")
    return audit.account_rollup(versions, "source", "item")


SEEDS = 3
SEED_SQL = "source_id % 3"


@query("d34_replicates", f"""WITH {duck_measurements("bpp", "correct_a")},
c AS (SELECT {SEED_SQL} AS seed, qp, CASE cand_idx WHEN 0 THEN 'base' WHEN 1 THEN 'control' ELSE 'trial' END AS arm, avg(bpp) AS bpp,
  avg(correct_a::INT) AS quality FROM m WHERE cand_idx <= 2 GROUP BY ALL),
s AS (SELECT seed, arm AS cmp, CASE WHEN arm = c.arm THEN 't' END AS side, bpp AS rate, quality, qp FROM c WHERE arm <> 'base'
  UNION ALL SELECT seed, x.arm, 'a', bpp, quality, qp FROM c, (VALUES ('control'), ('trial')) x(arm) WHERE c.arm = 'base'),
{duck_bd('s', 'seed, cmp')}, d AS (SELECT seed, max(bd_rate) FILTER (WHERE cmp = 'trial') - max(bd_rate) FILTER (WHERE cmp = 'control') AS diff FROM bd GROUP BY seed)
SELECT {q6('median(diff)')} AS median, {q6('max(diff)')} AS worst, {q6('avg((diff <= -2)::INT)')} AS p_improve, count(diff) AS n_seeds FROM d""")
def d34(spark, sf):
    """Three replicates (disjoint thirds of the sources): trial minus control BD-rate per seed."""
    rows = measurements(spark, sf, "bpp", "correct_a").filter("cand_idx <= 2").withColumns({
        "seed": F.expr(SEED_SQL), "arm": F.expr("CASE cand_idx WHEN 0 THEN 'base' WHEN 1 THEN 'control' ELSE 'trial' END")})
    curves = V.curve(rows, ["seed", "arm"], quality="correct_a")
    scored = V.against(curves, "arm", "base", ["seed"]).select("seed", "arm", bd.bd_rate("anchor_points", "points").alias("v"))
    paired = scored.groupBy("seed").agg(F.expr("max(CASE WHEN arm = 'trial' THEN v END) - max(CASE WHEN arm = 'control' THEN v END) AS difference"))
    return audit.replicate_summary(paired).withColumns({n: r6(n) for n in ("median", "worst", "p_improve")})


@query("d35_quality_check", f"""WITH {duck_measurements("proxy_error")}
SELECT qp, {q6('avg(proxy_error)')} AS mean, {q6('max(proxy_error)')} AS max FROM m GROUP BY qp""")
def d35(spark, sf):
    return audit.mean_max(measurements(spark, sf, "proxy_error"), "proxy_error", ["qp"]).withColumns(
        {"mean": r6("mean"), "max": r6("max")})


@query("d37_mean_rate_ratio", f"""WITH {DUCK_CHOSEN} SELECT codec, {q6('avg(bpp/bpp_0)')} AS mean_ratio FROM v1 GROUP BY codec""")
def d37(spark, sf):
    return audit.mean_ratio(chosen_rows(spark, sf), "bpp", "c0_bpp", ["codec"]).withColumn("mean_ratio", r6("mean_ratio"))


@query("d38_bit_accounting", f"""WITH {duck_measurements("candidate", "bpp", "coded_bytes")}
SELECT candidate AS arm, qp, {q8('avg(bpp)')} AS mean_bpp, {q6('avg(coded_bytes)')} AS mean_coded_bytes FROM m GROUP BY ALL""")
def d38(spark, sf):
    rows = measurements(spark, sf, "candidate", "bpp", "coded_bytes").withColumnRenamed("candidate", "arm")
    return audit.bit_accounting(rows).withColumns({"mean_bpp": r8("mean_bpp"), "mean_coded_bytes": r6("mean_coded_bytes")})


# --- arrays: source logits are a vector times ten, candidate logits those of the next vector ----

def vectors(spark, sf):
    e = table(spark, sf, "embeddings").selectExpr(
        "vec_id", "label", "transform(CAST(embedding AS ARRAY<DOUBLE>), x -> 10D*x) AS s")
    other = e.selectExpr("vec_id - 1 AS vec_id", "s AS c")
    return e.join(other, "vec_id").repartition(parallelism(spark), "vec_id")


DUCK_VECTORS = """e AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: 10*x) AS v FROM embeddings),
j AS (SELECT a.vec_id, a.label, a.v AS s, b.v AS c FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
i AS (SELECT vec_id, label, i, s[i] AS s, c[i] AS c FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM j)),
z AS (SELECT *, max(s) OVER w AS ms, max(c) OVER w AS mc, ln(sum(exp(s)) OVER w) AS ls, ln(sum(exp(c)) OVER w) AS lc FROM i
  WINDOW w AS (PARTITION BY vec_id)),
p AS (SELECT *, exp(s - ls) AS ps, exp(c - lc) AS pc, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, i) AS rc,
  row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS rs FROM z)"""
CONFIDENCE = f"""SELECT vec_id, {q6('max(pc) FILTER (WHERE rc = 1)')} AS confidence, {q6('max(pc) FILTER (WHERE rc = 1) - max(pc) FILTER (WHERE rc = 2)')} AS margin,
  {q6('-sum(pc*ln(greatest(pc, 1e-12)))')} AS entropy, {q6('max(pc) FILTER (WHERE i = 1)')} AS first_prob FROM p GROUP BY vec_id"""


@query("j1_j3_confidence", f"WITH {DUCK_VECTORS} {CONFIDENCE}")
def j1(spark, sf):
    probs = vectors(spark, sf).withColumn("p", F.expr(A.softmax("c")))
    return probs.withColumn("t", F.expr(A.top2("p"))).select(
        "vec_id", r6("t.confidence").alias("confidence"), r6("t.margin").alias("margin"),
        r6(F.expr(A.entropy("p"))).alias("entropy"), r6(F.expr("p[0]")).alias("first_prob"))


@query("m2_sql_functions", f"WITH {DUCK_VECTORS} {CONFIDENCE}")
def m2(spark, sf):
    """Through the registered SQL functions."""
    sql.register(spark)
    probs = vectors(spark, sf).selectExpr("vec_id", "softmax(c) AS p").selectExpr(
        "vec_id", "top2(p) AS t", "prob_entropy(p) AS entropy", "p[0] AS first_prob")
    return probs.select(
        "vec_id", r6("t.confidence").alias("confidence"), r6("t.margin").alias("margin"), r6("entropy").alias("entropy"),
        r6("first_prob").alias("first_prob"))


@query("j4_j8_pair_signals", f"""WITH {DUCK_VECTORS}
SELECT vec_id, {q6('sum(ps*(ln(ps) - (c - lc)))')} AS kl, {q6('1 - sum(s*c)/(sqrt(sum(s*s))*sqrt(sum(c*c)))')} AS cosine,
  max(i) FILTER (WHERE rs = 1) = max(i) FILTER (WHERE rc = 1) AS agrees, {q6('max(pc) FILTER (WHERE rs = 1)')} AS source_class_prob,
  {q6('-max(c - lc) FILTER (WHERE i = label + 1)')} AS ce FROM p GROUP BY vec_id""")
def j4(spark, sf):
    rows = vectors(spark, sf).withColumns({"ps": F.expr(A.softmax("s")), "pc": F.expr(A.softmax("c")), "lc": F.expr(A.log_softmax("c"))})
    return rows.select(
        "vec_id", r6(F.expr(A.kl("ps", "lc"))).alias("kl"), r6(F.expr(A.cosine_distance("s", "c"))).alias("cosine"),
        F.expr(A.agrees("s", "c")).alias("agrees"), r6(F.expr(A.source_class_probability("pc", "s"))).alias("source_class_prob"),
        r6(F.expr(A.cross_entropy("c", "label"))).alias("ce"))


@query("j9_j11_signal_distances", f"""WITH {DUCK_VECTORS},
d AS (SELECT vec_id, i, s, c, s - lag(s) OVER w AS ds, c - lag(c) OVER w AS dc FROM i WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
d2 AS (SELECT *, ds - lag(ds) OVER w AS es, dc - lag(dc) OVER w AS ec FROM d WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
n AS (SELECT *, sqrt(sum(s*s) OVER w) AS ns, sqrt(sum(c*c) OVER w) AS nc FROM d2 WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, {q6('least(2, (avg((ds-dc)*(ds-dc))/(avg(ds*ds) + avg(dc*dc) + 1e-12) + avg((es-ec)*(es-ec))/(avg(es*es) + avg(ec*ec) + 1e-12))/2)')} AS energy,
  {q6('greatest(least(2, avg(abs(ds-dc))/greatest(avg(abs(ds)), 1)), least(2, avg(abs(es-ec))/greatest(avg(abs(es)), 1)))')} AS l1,
  {q6('sum((s/ns - c/nc)*(s/ns - c/nc))/2')} AS unit FROM n GROUP BY vec_id""")
def j9(spark, sf):
    both = (A.derivative, A.second_derivative)
    return vectors(spark, sf).select(
        "vec_id", r6(F.expr(A.difference_energy("s", "c", both))).alias("energy"),
        r6(F.expr(A.worst_relative_l1("s", "c", both))).alias("l1"), r6(F.expr(A.unit_distance("s", "c"))).alias("unit"))
