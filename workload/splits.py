"""Dataset selection: ranks, splits, shards, exclusion, fingerprints (B, C, F, D24, L11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitcurve.functions import strings as T
from bitcurve.operators import fingerprints as P
from bitcurve.operators import joins as J
from bitcurve.operators import ranking as R
from bitcurve.operators import search as Q
from bitcurve.operators import select as S
from bitcurve.session import cut_lineage
from workload import selection as G
from workload.curves import q6, r6
from workload.decisions import duck_scores
from workload.fixtures import duck_sql
from workload.registry import query, table

PATH = "concat('/data/', lang, '_', source, '/', substring(md5(CAST(doc_id AS STRING)), 1, 11), '_000010_000020.mp4')"


def clips(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.selectExpr("doc_id", f"{PATH} AS path", "concat(lang, '_', source) AS class", "n_chars AS bytes").withColumn(
        "key", F.expr(T.clip_key("path")))


DUCK_CLIPS = """clips AS (SELECT doc_id, lang||'_'||source AS class, n_chars AS bytes,
  '/data/'||lang||'_'||source||'/'||substr(md5(doc_id::VARCHAR), 1, 11)||'_000010_000020.mp4' AS path,
  lang||'_'||source||'/'||substr(md5(doc_id::VARCHAR), 1, 11)||'_000010_000020.mp4' AS key FROM documents)"""


def duck_rank(salt, key="key", group="", source="clips", name="rank"):
    over = f"PARTITION BY {group} " if group else ""
    return f"row_number() OVER ({over}ORDER BY sha256('{salt}'||chr(0)||{key}), {key})"


@query("b3_clip_key", f"WITH {DUCK_CLIPS} SELECT doc_id, key, class AS parent FROM clips")
def b3(spark, sf):
    return clips(spark, sf).select("doc_id", "key", F.expr(T.parent_name("path")).alias("parent"))


URLS = "regexp_replace(url, '[?].*$', '')"


@query("b4_source_id", f"""WITH {DUCK_CLIPS}
SELECT doc_id, substr(md5(doc_id::VARCHAR), 1, 11) AS source_id, 'documents' AS origin FROM clips
UNION ALL SELECT page_id, list_aggregate(list_slice(string_split(rtrim(regexp_replace(url, '[?].*$', ''), '/'), '/'), -2, -1), 'string_agg', '/'), 'pages'
FROM pages""")
def b4(spark, sf):
    strict = clips(spark, sf).select("doc_id", F.expr(T.source_id("path", strict=True)).alias("source_id"),
                                     F.lit("documents").alias("origin"))
    # No page name looks like a source id, so the lenient form falls back to the clip key.
    lenient = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.expr(URLS).alias("path"))
    return strict.unionByName(lenient.select("doc_id", F.expr(T.source_id("path")).alias("source_id"),
                                             F.lit("pages").alias("origin")))


@query("b5_canonical_name", """SELECT trim(regexp_replace(lower(p_name||'--('||p_type||')'), '[^a-z0-9]+', ' ', 'g')) AS name,
  count(*) AS n FROM part GROUP BY ALL""")
def b5(spark, sf):
    named = table(spark, sf, "part").select(F.expr("concat(p_name, '--(', p_type, ')')").alias("raw"))
    return named.groupBy(F.expr(T.canon("raw")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("f1_hash_rank_top", f"""WITH {DUCK_CLIPS}
SELECT key, sha256('holdout-v1'||chr(0)||key) AS digest FROM clips ORDER BY digest, key LIMIT 50""")
def f1(spark, sf):
    return R.hash_top(clips(spark, sf), "holdout-v1", "key", 50).select("key", "digest")


@query("f1_hash_rank_full", f"""WITH {DUCK_CLIPS}
SELECT key, {duck_rank('holdout-v1')} AS rank FROM clips""")
def f1_full(spark, sf):
    return R.hash_rank(clips(spark, sf), "holdout-v1", "key").select("key", "rank")


DUCK_BALANCED = """{name} AS (SELECT *, row_number() OVER (ORDER BY depth, cls) AS pick FROM (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY sha256('{salt}'||chr(0)||{key}), {key}) AS depth,
    sha256('{salt}'||chr(0)||'class'||chr(0)||{label}) AS cls FROM {source}) QUALIFY pick <= {n})"""


@query("f2_balanced_pick", f"""WITH {DUCK_CLIPS},
{DUCK_BALANCED.format(name='picked', label='class', salt='fit-1', key='key', source='clips', n=60)}
SELECT key, class, depth, pick FROM picked""")
def f2(spark, sf):
    return R.balanced_pick(clips(spark, sf), "fit-1", "key", "class", 60).select("key", "class", "depth", "pick")


CAP = 2_000_000
SIZE = "CASE WHEN doc_id % 13 = 0 THEN 0 ELSE bytes END"
DUCK_CAPPED = """capped AS (SELECT *, sum(size) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM {source}
  WHERE size > 0),
kept AS (SELECT * FROM capped WHERE running <= {cap} OR running = size)"""


@query("f3_capped_round_robin", f"""WITH {DUCK_CLIPS},
ranked AS (SELECT *, {SIZE} AS size, {duck_rank('cap-1', group='class')} AS depth FROM clips),
{DUCK_CAPPED.format(order='depth, class', source='ranked', cap=CAP)}
SELECT key, class, depth, running AS running_bytes FROM kept""")
def f3(spark, sf):
    sized = clips(spark, sf).withColumn("size", F.expr(SIZE))
    return R.capped_round_robin(sized, "cap-1", "key", "class", "size", CAP).select("key", "class", "depth", "running_bytes")


@query("f4_capped_prefix", f"""WITH {DUCK_CLIPS}, ranked AS (SELECT *, bytes AS size, {duck_rank('cap-2')} AS rank FROM clips),
{DUCK_CAPPED.format(order='rank', source='ranked', cap=CAP)}
SELECT key, rank, running AS running_bytes FROM kept""")
def f4(spark, sf):
    return R.capped_prefix(clips(spark, sf), "cap-2", "key", "bytes", CAP).select("key", "rank", "running_bytes")


@query("f5_fraction_split", f"""WITH {DUCK_CLIPS}, n AS (SELECT count(*) AS n FROM clips),
c AS (SELECT n, CASE WHEN n > 2 THEN greatest(1, floor(n*0.1::DOUBLE)::INT) ELSE 0 END AS t FROM n),
v AS (SELECT t, CASE WHEN n - t > 1 THEN greatest(1, floor(n*0.15::DOUBLE)::INT) ELSE 0 END AS v FROM c)
SELECT key, CASE WHEN rank <= t THEN 'test' WHEN rank <= t + v THEN 'val' ELSE 'train' END AS split
FROM (SELECT key, {duck_rank('split-1')} AS rank FROM clips), v""")
def f5(spark, sf):
    return R.fraction_split(clips(spark, sf), "split-1", "key", 0.1, 0.15).select("key", "split")


MD5 = "('0x'||substr(md5({}), 1, 8))::BIGINT"
DUCK_SPLIT = f"CASE {MD5.format('key')} % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"


@query("f6_hash_split", f"WITH {DUCK_CLIPS} SELECT key, {DUCK_SPLIT} AS split FROM clips")
def f6(spark, sf):
    return R.hash_split(clips(spark, sf), "key").select("key", "split")


@query("f7_salted_shards", f"""WITH {DUCK_CLIPS}
SELECT {DUCK_SPLIT} AS split, ({MD5.format("'shard:'||key")} % 5)::INT AS shard, count(*) AS n, sum(doc_id)::BIGINT AS id_sum
FROM clips GROUP BY ALL""")
def f7(spark, sf):
    sharded = R.hash_shard(R.hash_split(clips(spark, sf), "key"), "shard", "key", 5)
    return sharded.groupBy("split", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


@query("f8_position_shards", f"""WITH {DUCK_CLIPS}
SELECT key, ((row_number() OVER (ORDER BY key) - 1) % 4)::INT AS shard FROM clips""")
def f8(spark, sf):
    return R.position_shard(clips(spark, sf).select("key"), "key", 4)


# Two clips per source, the first of which counts; splits by hash of the clip.
SIZES = {"fit": 30, "calibration": 20, "dev": 8}
SALTS = {"fit": "plan-fit", "calibration": "plan-cal", "dev": "plan-dev"}
DUCK_PLAN = f"""{DUCK_CLIPS}, rows_ AS (SELECT doc_id AS position, key, class, md5((doc_id // 2)::VARCHAR) AS source_id,
    {DUCK_SPLIT} AS split FROM clips),
pool AS (SELECT * FROM rows_ WHERE split = 'train' AND source_id NOT IN (SELECT source_id FROM rows_ WHERE split <> 'train')
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY position) = 1),
{DUCK_BALANCED.format(name='fit', label='class', salt='plan-fit', key='key', source='pool', n=30)},
rest AS (SELECT * FROM pool WHERE source_id NOT IN (SELECT source_id FROM fit)),
{DUCK_BALANCED.format(name='cal', label='class', salt='plan-cal', key='key', source='rest', n=20)},
devpool AS (SELECT * FROM rows_ WHERE split = 'val' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY position) = 1),
{DUCK_BALANCED.format(name='dev', label='class', salt='plan-dev', key='key', source='devpool', n=8)},
staged AS (SELECT 'fit' AS stage, source_id, key AS clip, class AS label, pick FROM fit
  UNION ALL SELECT 'calibration', source_id, key, class, pick FROM cal UNION ALL SELECT 'dev', source_id, key, class, pick FROM dev)"""


def staged(spark, sf):
    rows = R.hash_split(clips(spark, sf), "key").selectExpr(
        "doc_id AS position", "key AS clip", "class AS label", "md5(string(doc_id div 2)) AS source_id", "split")
    return R.staged_plan(rows, SIZES, SALTS)


@query("f9_staged_plan", f"WITH {DUCK_PLAN} SELECT * FROM staged")
def f9(spark, sf):
    return staged(spark, sf)


STATUS = "CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 19 = 0 THEN 'multiple' ELSE 'ok' END"
DUCK_VALID = f"""{DUCK_CLIPS}, ranked AS (SELECT key, {duck_rank('holdout-2')} AS rank, {STATUS} AS status FROM clips),
counted AS (SELECT *, sum((status = 'ok')::INT) OVER (ORDER BY rank)::BIGINT AS n_valid FROM ranked),
walked AS (SELECT * FROM counted WHERE n_valid < 100 OR (n_valid = 100 AND status = 'ok'))"""


def walked(spark, sf):
    ranked = R.hash_rank(clips(spark, sf), "holdout-2", "key").withColumn("status", F.expr(STATUS))
    return ranked.select("key", "rank", "status")


@query("f10_first_valid", f"WITH {DUCK_VALID} SELECT key, rank, status, n_valid FROM walked")
def f10(spark, sf):
    rows = clips(spark, sf).withColumn("status", F.expr(STATUS)).select("key", "status")
    return R.first_valid_hashed(rows, "holdout-2", "key", 100).select("key", "rank", "status", "n_valid")


@query("f11_prefix_violations", f"""WITH {DUCK_VALID}, selected AS (SELECT key FROM walked WHERE status = 'ok' AND rank % 29 <> 0),
failures AS (SELECT key FROM walked WHERE status <> 'ok' AND rank % 7 <> 0), last AS (SELECT max(rank) AS last FROM ranked JOIN selected USING (key)),
expected AS (SELECT key FROM ranked, last WHERE rank <= last AND key NOT IN (SELECT key FROM failures))
SELECT key, 'omitted' AS violation FROM (SELECT key FROM expected EXCEPT ALL SELECT key FROM selected)
UNION ALL SELECT key, 'unexpected' FROM (SELECT key FROM selected EXCEPT ALL SELECT key FROM expected)""")
def f11(spark, sf):
    ranked = cut_lineage(walked(spark, sf))
    done = cut_lineage(R.first_valid(ranked, 100))
    selected = done.filter("status = 'ok' AND rank % 29 <> 0")
    failures = done.filter("status <> 'ok' AND rank % 7 <> 0")
    return R.prefix_violations(ranked, selected, failures, "key")


@query("f12_group_holdout", f"""WITH n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations),
r AS (SELECT conv_id, row_number() OVER (ORDER BY sha256('hold-1'||chr(0)||conv_id), conv_id::VARCHAR) AS rank
  FROM (SELECT DISTINCT conv_id FROM conversations)),
p AS (SELECT conv_id, CASE WHEN rank <= greatest(1, n//5) THEN 'calibration' WHEN rank <= greatest(1, n//5) + greatest(1, n//10)
  THEN 'stop' ELSE 'fit' END AS part FROM r, n)
SELECT conv_id, turn, part FROM conversations JOIN p USING (conv_id)""")
def f12(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    return R.group_holdout(turns, "hold-1", "conv_id").select("conv_id", "turn", "part")


@query("f16_balanced_order", f"""WITH {DUCK_CLIPS}
SELECT key, (('0x'||right(sha256('order-1'||chr(0)||key), 1))::INT % 2)::INT AS first_arm FROM clips""")
def f16(spark, sf):
    return R.balanced_order(clips(spark, sf), "order-1", "key").select("key", "first_arm")


@query("f13_constrained_argmin", f"""WITH {G.duck_wide(("bpp", "proxy_error"))}
SELECT source_id, qp, cand_idx FROM wide WHERE cand_idx = 0 OR proxy_error <= proxy_error_0 + 0.03::DOUBLE
QUALIFY row_number() OVER (PARTITION BY source_id, codec, qp ORDER BY bpp, cand_idx) = 1""")
def f13(spark, sf):
    """The kernel itself with a caller's own feasibility: policies are plain expressions."""
    rule = S.cheapest(lambda i: f"c{i}_proxy_error <= c0_proxy_error + 0.03D", saving=False)
    return S.choose(G.cells(spark, sf, ("bpp", "proxy_error")), rule).select("source_id", "qp", "cand_idx")


@query("f14_first_passing_rung", f"""WITH {G.duck_wide(("bpp", "proxy_error"))}
SELECT source_id, qp, coalesce(min(cand_idx) FILTER (WHERE cand_idx > 0 AND proxy_error < proxy_error_0 + 0.01::DOUBLE*cand_idx) - 1, -1)::INT AS rung
FROM wide GROUP BY source_id, qp""")
def f14(spark, sf):
    rule = S.first_passing([f"c{i}_proxy_error < c0_proxy_error + {i / 100}D" for i in S.OTHERS])
    return G.cells(spark, sf, ("bpp", "proxy_error")).select("source_id", "qp", F.expr(rule).alias("rung"))


@query("f15_best_policy", f"""WITH {G.duck_wide(G.SLACK)}, {G.P_V1},
{G.duck_choice("cand_idx = 0 OR (bpp < bpp_0 AND " + G.passes("a", "kl_slack", "feature_slack", "0.6::DOUBLE") + ")")},
scored AS (SELECT policy_id, round(avg(bpp), 6) AS rate, round(avg(a_feature_distance), 6) AS distance, class FROM choice
  JOIN (SELECT p_partkey AS source_id, p_brand AS class FROM part) USING (source_id) GROUP BY policy_id, class)
SELECT class, arg_min(policy_id, (distance, rate, policy_id)) FILTER (WHERE rate < 0.12) AS policy_id FROM scored GROUP BY class""")
def f15(spark, sf):
    """Lexicographic best feasible policy per class."""
    cells = G.cells(spark, sf, G.SLACK, keep=("class",))
    chosen = S.choose(cells, S.slack(), G.grids.v1_grid(spark), fields=("bpp", "a_feature_distance"), keep=("class",))
    scored = chosen.groupBy("policy_id", "class").agg(
        r6(F.avg("bpp")).alias("rate"), r6(F.avg("a_feature_distance")).alias("distance"))
    return scored.groupBy("class").agg(
        F.expr("min_by(policy_id, struct(distance, rate, policy_id)) FILTER (WHERE rate < 0.12D) AS policy_id"))


TRIALS = 40
BOUNDS = {"kl_slack": (0.0, 0.1), "feature_slack": (0.0, 0.05)}
INITIAL = {"kl_slack": 0.0, "feature_slack": 0.0}
DUCK_TRIALS = duck_sql(f"""p AS (SELECT id::INT AS policy_id, CASE id WHEN 0 THEN 0.0D ELSE 0.1D*U('s7|kl_slack|'||id) END AS kl_slack,
  CASE id WHEN 0 THEN 0.0D ELSE 0.05D*U('s7|feature_slack|'||id) END AS feature_slack FROM range({TRIALS}) r(id))""")
DUCK_SEARCH = f"""{G.duck_wide(G.SLACK + ("correct_a", "correct_b"))}, {DUCK_TRIALS},
{G.duck_choice("cand_idx = 0 OR (bpp < bpp_0 AND " + G.passes("a", "kl_slack", "feature_slack", "0.6::DOUBLE") + ")")}"""


def trial_choices(spark, sf, trials):
    cells = G.cells(spark, sf, G.SLACK + ("correct_a",))
    return S.choose(cells, S.slack(), trials, fields=("bpp", "correct_a"), keep=("c0_bpp", "c0_correct_a"))


@query("f17_random_search", f"""WITH {DUCK_SEARCH},
scored AS (SELECT policy_id, round(avg(correct_a::INT) - 0.15::DOUBLE*ln(1 + 1000*avg(bpp)), 9) AS score FROM choice GROUP BY ALL)
SELECT arg_min(policy_id, (-score, policy_id)) AS policy_id, {q6('max(score)')} AS score, count(*) AS evaluations FROM scored""")
def f17(spark, sf):
    def evaluate(trials):
        return trial_choices(spark, sf, trials).groupBy("policy_id").agg(
            F.avg(F.col("correct_a").cast("double")).alias("quality"), (1000 * F.avg("bpp")).alias("rate"))

    trials = Q.random_trials(spark, TRIALS, BOUNDS, INITIAL, "s7")
    return Q.search(trials, evaluate, "round(quality - 0.15D*log1p(rate), 9)").withColumn("score", r6("score"))


@query("f17_bd_rate_search", f"""WITH {DUCK_SEARCH}, {duck_scores(models=('a', 'b'))},
top AS (SELECT policy_id, max(quality) AS q FROM score_c WHERE model = 'a' AND side = 't' GROUP BY ALL),
scored AS (SELECT policy_id, round(bd_rate + 100*greatest(0, 0.9::DOUBLE - q), 6) AS score FROM score JOIN top USING (policy_id) WHERE model = 'a')
SELECT arg_min(policy_id, (score, policy_id)) FILTER (WHERE score IS NOT NULL) AS policy_id, min(score) + 0.0 AS score, count(*) AS evaluations FROM scored""")
def f17_bd(spark, sf):
    from bitcurve.plans.calibrate import scores

    def evaluate(trials):
        return scores(trial_choices(spark, sf, trials), ("a",)).withColumn(
            "top", F.expr("array_max(transform(points, p -> p.quality))"))

    trials = Q.random_trials(spark, TRIALS, BOUNDS, INITIAL, "s7")
    return Q.search(trials, evaluate, "round(bd_rate + 100*greatest(0D, 0.9D - top), 6)", maximise=False)


# --- joins -----------------------------------------------------------------------------------

@query("c4_label_lookup", f"""WITH {DUCK_CLIPS}, labels_(name, label) AS (VALUES ('en src0', 0), ('en src1', 1), ('de src0', 2), ('fr src2', 3)),
canonical AS (SELECT key, trim(regexp_replace(lower(class), '[^a-z0-9]+', ' ', 'g')) AS name FROM clips)
SELECT name, label, count(*) AS n, label IS NULL AS unmapped FROM canonical LEFT JOIN labels_ USING (name) GROUP BY ALL""")
def c4(spark, sf):
    labels = spark.createDataFrame([("en src0", 0), ("en src1", 1), ("de src0", 2), ("fr src2", 3)], "name STRING, label INT")
    named = clips(spark, sf).withColumn("name", F.expr(T.canon("class")))
    missing = J.unmapped(named, labels, "name").withColumn("unmapped", F.lit(True))
    joined = J.label_lookup(named, labels, "name").groupBy("name", "label").agg(F.count(F.lit(1)).alias("n"))
    return joined.join(missing, "name", "left").na.fill(False, ["unmapped"])


@query("c5_locked_annotation", """SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'no_annotation' WHEN toxic = 1 THEN 'span'
  WHEN quality = 0 AND d.doc_id % 3 = 0 THEN 'hash' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE l.doc_id IS NULL OR toxic = 1 OR (quality = 0 AND d.doc_id % 3 = 0)""")
def c5(spark, sf):
    docs = table(spark, sf, "documents")
    locked = docs.selectExpr("doc_id", "n_chars AS t_start", "n_chars + 10 AS t_end", "md5(text) AS sha")
    annotated = table(spark, sf, "labels").join(locked, "doc_id").selectExpr(
        "doc_id", "t_start + toxic AS t_start", "t_end",
        "CASE WHEN quality = 0 AND doc_id % 3 = 0 THEN 'changed' ELSE sha END AS sha")
    return J.span_mismatches(locked, annotated, "doc_id")


@query("c6_source_exclusion", f"""WITH {DUCK_CLIPS}, s AS (SELECT *, {DUCK_SPLIT} AS split, class AS source_id FROM clips)
SELECT doc_id FROM clips WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  AND doc_id NOT IN (SELECT doc_id FROM s WHERE split = 'test')""")
def c6(spark, sf):
    c = clips(spark, sf)
    held = R.hash_split(c, "key").filter("split = 'test'")
    return J.exclude(c, [table(spark, sf, "labels"), held], "doc_id").select("doc_id")


@query("c7_overlap_audit", f"""WITH {DUCK_CLIPS}, tagged AS (SELECT doc_id, 'labels' AS tag FROM labels
  UNION ALL SELECT doc_id, {DUCK_SPLIT} FROM clips UNION ALL SELECT page_id, 'pages' FROM pages)
SELECT a.tag AS left_set, b.tag AS right_set, count(*) AS n FROM (SELECT DISTINCT * FROM tagged) a
JOIN (SELECT DISTINCT * FROM tagged) b ON a.doc_id = b.doc_id AND a.tag < b.tag GROUP BY ALL""")
def c7(spark, sf):
    tagged = (
        table(spark, sf, "labels").select("doc_id", F.lit("labels").alias("tag"))
        .unionByName(R.hash_split(clips(spark, sf), "key").select("doc_id", F.col("split").alias("tag")))
        .unionByName(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.lit("pages").alias("tag")))
    )
    return J.overlap_matrix(tagged, "tag", "doc_id")


@query("c8_wanted_files", """WITH w AS (SELECT doc_id, lang AS class, md5(text) AS sha FROM documents WHERE doc_id % 5 <> 0),
f AS (SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN 'xx' ELSE lang END AS class, CASE WHEN doc_id % 23 = 0 THEN '' ELSE md5(text) END AS sha
  FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, lang, md5(text) FROM documents WHERE doc_id % 11 = 0),
g AS (SELECT doc_id, count(*) AS n, min(class) AS fc, min(sha) AS fs FROM f GROUP BY ALL)
SELECT coalesce(w.doc_id, g.doc_id) AS doc_id, coalesce(n, 0) AS n_files, CASE WHEN w.doc_id IS NULL THEN 'unexpected'
  WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN class <> fc THEN 'wrong_class' WHEN sha <> fs THEN 'hash_changed'
  ELSE 'ok' END AS status FROM w FULL JOIN g ON w.doc_id = g.doc_id""")
def c8(spark, sf):
    docs = table(spark, sf, "documents")
    wanted = docs.filter("doc_id % 5 <> 0").selectExpr("doc_id", "lang AS class", "md5(text) AS sha")
    files = docs.filter("doc_id % 7 <> 0").selectExpr(
        "doc_id", "CASE WHEN doc_id % 31 = 0 THEN 'xx' ELSE lang END AS class",
        "CASE WHEN doc_id % 23 = 0 THEN '' ELSE md5(text) END AS sha"
    ).unionByName(docs.filter("doc_id % 11 = 0").selectExpr("doc_id", "lang AS class", "md5(text) AS sha"))
    return J.locate(wanted, files, "doc_id")


@query("l11_split_leakage", f"""WITH {DUCK_PLAN}
SELECT source_id, count(DISTINCT split) AS n_splits FROM rows_ GROUP BY ALL HAVING count(DISTINCT split) > 1""")
def l11(spark, sf):
    from bitcurve.operators.checks import leakage

    rows = R.hash_split(clips(spark, sf), "key").selectExpr("md5(string(doc_id div 2)) AS source_id", "split")
    return leakage(rows, "source_id", "split")


# --- fingerprints and sets ---------------------------------------------------------------------

@query("d24_fingerprints", f"""WITH {DUCK_CLIPS}, chosen AS (SELECT key, path FROM clips ORDER BY sha256('holdout-v1'||chr(0)||key), key LIMIT 200)
SELECT sha256(string_agg(key, chr(10) ORDER BY key))[1:16] AS sha_short, md5(string_agg(key, ',' ORDER BY key))[1:12] AS md5_short,
  sha256(string_agg(key||chr(9)||md5(path)||chr(10), '' ORDER BY key)) AS tree, count(*) AS n FROM chosen""")
def d24(spark, sf):
    """Fingerprints of a selection of asked size; of whole tables see the tree fingerprint."""
    c = cut_lineage(R.hash_top(clips(spark, sf), "holdout-v1", "key", 200))
    sha = P.fingerprint(c, "key", 200, length=16).select(F.col("fingerprint").alias("sha_short"), "n")
    md5 = P.fingerprint(c, "key", 200, ",", "md5", 12).select(F.col("fingerprint").alias("md5_short"))
    tree = P.ordered_tree(c.withColumn("h", F.md5("path")), "key", "h", 200).select("tree")
    return sha.crossJoin(F.broadcast(md5)).crossJoin(F.broadcast(tree))


@query("d24_tree_fingerprint", f"""WITH {DUCK_CLIPS}, h AS (SELECT sha256(key) AS h FROM clips),
s AS (SELECT count(*) AS n, {', '.join(f"sum(('0x'||h[{1 + 15 * i}:{15 + 15 * i}])::BIGINT::HUGEINT) AS s{i}" for i in range(4))} FROM h)
SELECT sha256(n||'|'||s0||'|'||s1||'|'||s2||'|'||s3) AS tree_fingerprint, n FROM s""")
def d24_tree(spark, sf):
    return P.tree_fingerprint(clips(spark, sf), "key")


@query("d24_record_digest", """SELECT doc_id, sha256('{"doc_id":'||doc_id||',"lang":"'||lang||'","n_chars":'||n_chars||',"source":"'||source||'"}') AS digest
FROM documents""")
def d24_json(spark, sf):
    columns = ["source", "n_chars", "lang", "doc_id"]
    return table(spark, sf, "documents").select("doc_id", F.expr(f"sha2({P.canonical_json(columns)}, 256) AS digest"))


@query("k1_set_operations", f"""WITH {DUCK_CLIPS}, a AS (SELECT doc_id FROM labels), b AS (SELECT page_id AS doc_id FROM pages),
c AS (SELECT doc_id FROM clips)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM a)""")
def k1(spark, sf):
    a = table(spark, sf, "labels").select("doc_id")
    b = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"))
    c = clips(spark, sf).select("doc_id")
    results = {"union": a.unionByName(b).distinct(), "intersect": a.intersect(b), "except": c.exceptAll(a)}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n") for op, df in results.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
