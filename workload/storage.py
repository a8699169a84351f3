"""Sources, sinks and streams (A, K2, K3). Inputs are derived from the driver tables, written once in
the format under test and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitcurve.operators import audit
from bitcurve.operators import fingerprints as P
from bitcurve.operators import select as S
from bitcurve.schema import SIGNALS
from bitcurve.session import scratch
from bitcurve.sources import files, records, sinks
from bitcurve.streaming import curves as stream_curves
from bitcurve.streaming import ingest
from workload import selection as G
from workload.curves import DUCK_V1, arms, q6, q8, r6, r8, slack_choice
from workload.fixtures import duck_measurements, measurements
from workload.gating import DUCK_METHODS, methods
from workload.registry import query, table
from workload.splits import DUCK_CLIPS, clips

MODELS = {"a": "r2plus1d_18", "b": "r3d_18"}
OUTCOMES = {"a": "correct", "b": "cross_correct"}
RECORD_FIELDS = ("candidate", "bpp", "coded_bytes", *[f"{m}_{s}" for m in MODELS for s in SIGNALS], "correct_a", "correct_b")


def stored_records(spark, sf):
    path = scratch(spark, "records")
    records.write_records(records.nest(measurements(spark, sf, *RECORD_FIELDS, batches=False), MODELS, OUTCOMES), path)
    return records.read_records(spark, path)


DUCK_FLAT = f"""WITH {duck_measurements("candidate", "bpp", "b_kl_source", "a_source_top1_agrees", "correct_b")}
SELECT qp, cand_idx, candidate, count(*) AS n, {q8('avg(bpp)')} AS bpp, {q8('avg(b_kl_source)')} AS kl,
  count(*) FILTER (WHERE a_source_top1_agrees) AS agrees, count(*) FILTER (WHERE correct_b) AS correct FROM m GROUP BY ALL"""


@query("a1_a2_a13_record_files", DUCK_FLAT)
def a1(spark, sf):
    """Nest, write as JSON lines, read with the fixed schema, flatten."""
    flat = records.flatten(stored_records(spark, sf), MODELS, OUTCOMES)
    return flat.groupBy("qp", "cand_idx", "candidate").agg(
        F.count(F.lit(1)).alias("n"), r8(F.avg("bpp")).alias("bpp"), r8(F.avg("b_kl_source")).alias("kl"),
        F.count_if("a_source_top1_agrees").alias("agrees"), F.count_if("correct_b").alias("correct"))


@query("a1_mixed_schemas", f"""WITH {duck_measurements("candidate", "bpp", "a_kl_source", "b_kl_source", "correct_b")},
v AS (SELECT *, 1 + source_id % 3 AS "schema" FROM m)
SELECT "schema"::INT AS "schema", candidate, count(*) AS n, {q8('avg(bpp)')} AS bpp, {q8('avg(a_kl_source)')} AS kl_a,
  {q8('avg(b_kl_source) FILTER (WHERE "schema" = 3)')} AS kl_b,
  count(*) FILTER (WHERE correct_b AND ("schema" <> 2 OR cand_idx = 0)) AS cross_correct FROM v GROUP BY ALL""")
def a1_mixed(spark, sf):
    """Records of all three schemas in the same files; the second scores the cross model on the anchor alone."""
    nested = records.nest(measurements(spark, sf, *RECORD_FIELDS, batches=False), MODELS, OUTCOMES)
    number = "int(1 + bigint(sequence_id) % 3)"
    key = MODELS["a"]
    flat = ", ".join(f"'{s}', c.signals['{key}'].{s}" for s in SIGNALS)
    old = f"""transform(measurements, p -> named_struct('qp', p.qp, 'candidates', transform(p.candidates, (c, i) -> named_struct(
        'name', c.name, 'bpp', c.bpp, 'coded_bytes', c.coded_bytes, 'encoded_size', c.encoded_size, {flat}, 'correct', c.correct,
        'cross_correct', CASE WHEN {number} = 1 OR i = 0 THEN c.cross_correct END))))"""
    lines = nested.selectExpr(
        f"""CASE WHEN {number} = 3 THEN to_json(struct(3 AS schema, sequence_id, codec, cache_key, measurements))
            ELSE to_json(named_struct('schema', {number}, 'sequence_id', sequence_id, 'codec', codec, 'measurements', {old})) END AS value""")
    path = scratch(spark, "mixed")
    lines.write.option("compression", "gzip").text(path)
    read = records.read_mixed_records(spark, path, key)
    flat_rows = records.flatten(read, MODELS, OUTCOMES).withColumn("schema", F.expr("int(1 + bigint(source_id) % 3)"))
    return flat_rows.groupBy("schema", "candidate").agg(
        F.count(F.lit(1)).alias("n"), r8(F.avg("bpp")).alias("bpp"), r8(F.avg("a_kl_source")).alias("kl_a"),
        r8(F.avg("b_kl_source")).alias("kl_b"), F.count_if("correct_b").alias("cross_correct"))


@query("a2_cells_from_records", f"""WITH {G.duck_wide(G.SLACK)}, {G.duck_v1("v1", G.LOOSE)}
SELECT source_id::VARCHAR AS source_id, qp, cand_idx FROM v1""")
def a2(spark, sf):
    """Nested records to cells without any exchange, then the slack policy."""
    from bitcurve.operators.cells import cells_from_records

    signal = lambda s: (lambda c: c["signals"][MODELS["a"]][s])
    fields = {"bpp": lambda c: c["bpp"]} | {
        f"a_{s}": signal(s) for s in ("kl_source", "feature_distance", "source_confidence", "source_top1_agrees")}
    chosen = S.choose(cells_from_records(stored_records(spark, sf), fields), S.slack(*G.LOOSE))
    return chosen.select("source_id", "qp", "cand_idx")


@query("a3_map_shaped_records", f"""WITH {duck_measurements("candidate", "bpp", "correct_a", "correct_b")}
SELECT candidate, model, count(*) AS n, {q8('avg(bpp)')} AS bpp, count(*) FILTER (WHERE ok) AS correct FROM (
  SELECT candidate, bpp, 'a' AS model, correct_a AS ok FROM m UNION ALL SELECT candidate, bpp, 'b', correct_b FROM m) GROUP BY ALL""")
def a3(spark, sf):
    """Arms as a map of structs with a map of analyzers."""
    rows = measurements(spark, sf, "candidate", "bpp", "correct_a", "correct_b")
    value = "named_struct('name', candidate, 'bpp', bpp, 'analyzers', map('a', named_struct('correct', correct_a), 'b', named_struct('correct', correct_b)))"
    nested = rows.groupBy("source_id", "qp").agg(F.expr(f"map_from_entries(collect_list(struct(candidate, {value}))) AS arms"))
    path = scratch(spark, "arms")
    records.write_records(nested, path)
    schema = ("source_id BIGINT, qp INT, arms MAP<STRING, STRUCT<name: STRING, bpp: DOUBLE,"
              " analyzers: MAP<STRING, STRUCT<correct: BOOLEAN>>>>")
    flat = records.flatten_arms(records.read_records(spark, path, schema), ["source_id", "qp"])
    return flat.groupBy(F.col("arm").alias("candidate"), "model").agg(
        F.count(F.lit(1)).alias("n"), r8(F.avg("bpp")).alias("bpp"), F.count_if("correct").alias("correct"))


POINT_SELECT = ("string(source_id) AS sequence_id", "concat(class, '/', source_id) AS path", "class", "method AS codec", "qp",
                "bpp", "int(correct_a) AS top1", "target_prob_a AS target_prob")


@query("a4_a15_point_files", f"""{'WITH ' + DUCK_METHODS},
p AS (SELECT source_id, method, qp, round(bpp, 8) AS bpp, correct_a::INT AS top1, source_id % 4 = 0 AND qp = 40 AS again, source_id % 10 = 0 AS moved FROM points)
SELECT method AS codec, qp, count(*) AS n, {q6('avg(bpp)')} AS bpp, sum(CASE WHEN again THEN 1 - top1 ELSE top1 END)::BIGINT AS top1,
  (SELECT count(*) FROM p WHERE again AND moved) AS mismatches FROM p GROUP BY method, qp""")
def a4(spark, sf):
    """Two shards; the second repeats some points with another outcome and another path."""
    rows = methods(spark, sf).selectExpr(*POINT_SELECT)
    folders = [scratch(spark, "points") for _ in range(2)]
    sinks.write_csv(sinks.point_csv(rows), folders[0])
    again = rows.filter("int(sequence_id) % 4 = 0 AND qp = 40").withColumns({
        "top1": F.expr("1 - top1"), "path": F.expr("CASE WHEN int(sequence_id) % 10 = 0 THEN concat(path, '_moved') ELSE path END")})
    sinks.write_csv(sinks.point_csv(again), folders[1])
    merged = records.read_points(spark, folders).groupBy("codec", "qp").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("bpp")).alias("bpp"), F.sum("top1").alias("top1"))
    return merged.crossJoin(F.broadcast(records.path_mismatches(records.tagged_points(spark, folders))))


@query("a5_cache_folder", """SELECT conv_id AS pos, 'clip_'||conv_id AS sequence_id, CASE WHEN conv_id % 9 = 0 THEN NULL ELSE count(*)::VARCHAR END AS codec
FROM conversations GROUP BY conv_id""")
def a5(spark, sf):
    """One JSON document per clip and file; some clips have no record. Those that have one are read strictly."""
    clips_ = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    path = scratch(spark, "cache")
    stored = clips_.filter("conv_id % 9 <> 0").selectExpr("concat('clip_', conv_id) AS sequence_id", "string(turns) AS codec")
    records.write_cache(stored, path)
    ids = clips_.selectExpr("conv_id AS pos", "concat('clip_', conv_id) AS sequence_id")
    kind = "sequence_id STRING, codec STRING"
    read = records.read_cache(spark, path, ids, kind, strict="pos % 9 <> 0")
    return read.select("pos", "sequence_id", "codec")


@query("a6_a18_file_scan", """SELECT lang AS class, 1 AS n, (sum(strlen(text)) + count(*))::BIGINT AS bytes FROM documents GROUP BY lang""")
def a6(spark, sf):
    """Text files in class folders: listing, sizes and inventory."""
    path = scratch(spark, "files")
    table(spark, sf, "documents").selectExpr("lang", "text AS value").write.partitionBy("lang").text(path)
    listing = files.scan_files(spark, path, [".txt"])
    inventory = files.file_inventory(spark, path).filter("name LIKE '%.txt'")
    checked = listing.withColumn("name", F.expr("element_at(split(path, '/'), -1)")).withColumn(
        "class", F.expr("replace(class, 'lang=', '')"))
    by_class = checked.groupBy("class").agg(F.sum("bytes").alias("bytes"))
    total = inventory.agg(F.sum("bytes").alias("all_bytes"), F.count(F.lit(1)).alias("files"))
    guard = by_class.agg(F.sum("bytes").alias("seen")).crossJoin(F.broadcast(total))
    return by_class.crossJoin(F.broadcast(guard)).filter("seen = all_bytes").select("class", F.lit(1).alias("n"), "bytes")


@query("a7_coco_index", """WITH a AS (SELECT l_orderkey AS image_id, l_linenumber AS id FROM lineitem GROUP BY ALL),
k AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY sha256('coco-1'||chr(0)||o_orderkey), o_orderkey) AS rank FROM orders
  WHERE o_orderkey IN (SELECT image_id FROM a))
SELECT CASE WHEN rank <= 400 THEN 'train' WHEN rank <= 600 THEN 'val' ELSE 'test' END AS split, count(DISTINCT k.id) AS images, count(*) AS boxes,
  sum(k.id)::BIGINT AS id_sum FROM k JOIN a ON a.image_id = k.id GROUP BY 1""")
def a7(spark, sf):
    images = table(spark, sf, "orders").selectExpr("o_orderkey AS id")
    notes = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct().selectExpr(
        "l_orderkey AS image_id", "l_linenumber AS id", "1 AS category_id", "array(0D, 0D, 10D, 10D) AS bbox")
    index, boxes = files.coco_index(images, notes, 400, 200, "coco-1")
    per_image = index.groupBy("split").agg(F.count(F.lit(1)).alias("images"))
    per_box = boxes.groupBy("split").agg(F.count(F.lit(1)).alias("boxes"), F.sum("image_id").alias("id_sum"))
    return per_image.join(per_box, "split")


@query("a8_track_files", """WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, event_type FROM events)
SELECT 'user_id='||user_id AS seq_id, count(*) AS frames, count(*) FILTER (WHERE event_type = 'error' AND frame < 5) AS absent, sum(frame + 10)::DOUBLE AS x1_sum FROM f GROUP BY user_id""")
def a8(spark, sf):
    """Box files with mixed separators and short absence files, one folder per sequence."""
    path = scratch(spark, "tracks")
    from bitcurve.operators.tracking import sample_frames

    events = table(spark, sf, "events").select(F.col("user_id").alias("seq_id"), "event_id", "event_type")
    frames = sample_frames(events, ["event_id"], 1)
    lines = frames.selectExpr(
        "seq_id AS user_id", "index", "event_type",
        "CASE index % 3 WHEN 0 THEN concat(index, ',0,10,10') WHEN 1 THEN concat(index, '\\t0\\t10\\t10') ELSE concat(index, ' 0  10 10') END AS value")
    boxes, labels = f"{path}/boxes", f"{path}/absence"
    sinks.write_folders(lines, "user_id", ["index"], ["value"], boxes)
    absent = lines.filter("index < 5").withColumn("value", F.expr("CASE WHEN event_type = 'error' THEN '1' ELSE '0' END"))
    sinks.write_folders(absent, "user_id", ["index"], ["value"], labels)
    tracks = files.tracks_of(files.numbered_lines(spark, boxes, "*.txt"), files.numbered_lines(spark, labels, "*.txt"))
    return tracks.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("frames"), F.expr("count_if(NOT valid)").alias("absent"), F.sum("box.x1").alias("x1_sum"))


@query("a9_annotation_file", f"""WITH {DUCK_CLIPS} SELECT substr(md5(doc_id::VARCHAR), 1, 11) AS youtube_id, bytes::VARCHAR AS time_start, (bytes + 10)::VARCHAR AS time_end FROM clips""")
def a9(spark, sf):
    path = scratch(spark, "annotation")
    rows = clips(spark, sf).selectExpr("substring(md5(string(doc_id)), 1, 11) AS youtube_id", "bytes AS time_start", "bytes + 10 AS time_end")
    sinks.write_csv(rows, path)
    return files.read_annotations(spark, path, ["youtube_id", "time_start", "time_end"], "youtube_id", "[A-Za-z0-9_-]{11}")


@query("a10_inventory_checks", f"""WITH {DUCK_CLIPS}, top AS (SELECT key FROM clips ORDER BY sha256('lock-1'||chr(0)||key), key LIMIT 100),
i AS (SELECT 'whole' AS inventory, key FROM top UNION ALL SELECT 'short', key FROM top WHERE key <> (SELECT min(key) FROM top)),
c AS (SELECT inventory, count(*) = count(DISTINCT key) AS sorted_unique, count(*) = (SELECT count(*) FROM top) AS same_count,
  sha256(string_agg(key, chr(10) ORDER BY key)) = (SELECT sha256(string_agg(key, chr(10) ORDER BY key)) FROM top) AS same FROM i GROUP BY 1)
SELECT inventory, 'sorted_unique' AS "check", sorted_unique AS pass FROM c UNION ALL SELECT inventory, 'count', same_count FROM c
UNION ALL SELECT inventory, 'fingerprint', same FROM c""")
def a10(spark, sf):
    """A locked id list (of asked size), as written and with its least id lost, read back and verified."""
    from bitcurve.operators import ranking as R
    from bitcurve.session import cut_lineage

    top = cut_lineage(R.hash_top(clips(spark, sf), "lock-1", "key", 100))
    ids = top.agg(F.expr("sort_array(collect_list(key)) AS source_ids")).crossJoin(F.broadcast(P.fingerprint(top, "key", 100)))
    checked = None
    for name, kept in (("whole", "source_ids"), ("short", "slice(source_ids, 2, 100)")):
        path = scratch(spark, "inventory")
        ids.selectExpr("n AS source_count", "fingerprint AS source_fingerprint", f"{kept} AS source_ids").write.json(path)
        lines, count, digest = files.read_inventory(spark, path)
        one = files.inventory_checks(lines, count, digest, P.fingerprint(lines, "id", 100)).withColumn("inventory", F.lit(name))
        checked = one if checked is None else checked.unionByName(one)
    return checked


@query("a11_archive_parts", """WITH p AS (SELECT (doc_id % 20)::INT AS number FROM documents WHERE doc_id % 20 <> 7)
SELECT number, 'missing' AS violation FROM (SELECT unnest(range(0, 20))::INT AS number) WHERE number NOT IN (SELECT number FROM p)
UNION ALL SELECT 11, 'overlap'""")
def a11(spark, sf):
    """Part manifests with retained rows; part 7 is missing and part 11 reaches into 12."""
    docs = table(spark, sf, "documents").filter("doc_id % 20 <> 7").selectExpr("int(doc_id % 20) AS number", "doc_id")
    parts = docs.groupBy("number").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "number", "number*10L AS first", "number*10L + CASE WHEN number = 11 THEN 12 ELSE 9 END AS last",
        "array(named_struct('source_id', string(number), 'filename', 'f', 'bytes', n)) AS retained")
    path = scratch(spark, "parts")
    parts.write.json(path)
    return files.part_violations(files.read_parts(spark, path), 20)


@query("a12_a19_sealed_report", f"WITH {duck_measurements()} SELECT true AS unchanged, true AS reproduces, count(*) AS n FROM m WHERE cand_idx = 0")
def a12(spark, sf):
    """Seal the choices of a frozen policy, then verify them by recomputation."""
    def choices():
        return S.choose(G.cells(spark, sf, G.SLACK), S.slack(*G.LOOSE)).select("source_id", "codec", "qp", "cand_idx", "bpp")

    path = scratch(spark, "sealed")
    sinks.seal(choices(), path)
    n = choices().agg(F.count(F.lit(1)).alias("n"))
    return sinks.verify_report(choices(), path).crossJoin(F.broadcast(n))


@query("a14_curve_file", f"""WITH {DUCK_V1}
SELECT arm||'+'||model AS method, qp::VARCHAR AS rate_point, printf('%.6f', floor(round(bpp*1e6::DOUBLE, 3) + 0.5::DOUBLE)/1e6::DOUBLE) AS bpp,
  printf('%.6f', floor(round(quality*1e6::DOUBLE, 3) + 0.5::DOUBLE)/1e6::DOUBLE) AS accuracy FROM curve""")
def a14(spark, sf):
    from bitcurve.operators.curves import curves_by_model

    curve = curves_by_model(arms(slack_choice(spark, sf)), ["arm"], ["a", "b"])
    rows = sinks.curve_csv(curve.selectExpr("concat(arm, '+', model) AS method", "qp AS rate_point", "bpp", "quality AS accuracy"))
    path = scratch(spark, "curves")
    sinks.write_csv(rows, path)
    return spark.read.option("header", True).csv(path)


@query("a16_arm_records", f"""WITH {DUCK_V1} SELECT arm, qp, cand_idx, count(*) AS n, {q6('sum(bpp)')} AS sum_bpp FROM arms GROUP BY ALL""")
def a16(spark, sf):
    long = measurements(spark, sf, "bpp")
    chosen = S.choose(G.cells(spark, sf, G.SLACK), S.slack(*G.LOOSE)).select(
        "source_id", "codec", "qp", F.expr("inline(array(struct('policy' AS arm, cand_idx), struct('identity' AS arm, 0 AS cand_idx)))"))
    path = scratch(spark, "arms")
    sinks.write_arm_records(sinks.arm_records(long, chosen, ["bpp"]), path)
    return spark.read.parquet(path).groupBy("arm", "qp", "cand_idx").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("bpp")).alias("sum_bpp"))


@query("a17_markdown_table", """SELECT event_type AS arm, 'a' AS model, '| `'||event_type||'` | `a` | '||printf('%+.2f', v)||' | '||
  CASE WHEN event_type = 'view' THEN 'NA' ELSE '['||printf('%+.2f', v - 1)||', '||printf('%+.2f', v + 1)||']' END||' | NA | '||printf('%+.2f', -v)||' |' AS line
FROM (SELECT event_type, round(avg(value), 3) + 0.0004 AS v FROM events GROUP BY ALL)""")
def a17(spark, sf):
    report = table(spark, sf, "events").groupBy(F.col("event_type").alias("arm")).agg(F.expr("round(avg(value), 3) + 0.0004D AS v"))
    rows = report.selectExpr("arm", "'a' AS model", "v AS bd_rate", "CASE WHEN arm <> 'view' THEN v - 1 END AS lo", "v + 1 AS hi",
                             "CAST(NULL AS DOUBLE) AS bd_accuracy_pp", "-v AS min_gap_pp")
    return sinks.markdown_rows(rows)


# --- streams ---------------------------------------------------------------------------------

def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("k2_streaming_curve", f"""WITH s AS (SELECT event_type AS method, hour(ts)::INT AS key, sum(value*(1 + event_id % 3))/sum(1 + event_id % 3) AS bpp,
  sum(event_id % 7)/sum(1 + event_id % 3) AS quality, sum(1 + event_id % 3)::BIGINT AS n FROM events GROUP BY ALL)
SELECT method, key, {q6('bpp')} AS bpp, {q6('quality')} AS quality, n, row_number() OVER (PARTITION BY method ORDER BY bpp, key)::INT AS rank FROM s""")
def k2(spark, sf):
    batches = event_stream(spark, sf).selectExpr(
        "event_type AS method", "hour(ts) AS key", "value AS bpp", "1 + event_id % 3 AS n", "double(event_id % 7) AS score_sum")
    path = scratch(spark, "curve-stream")
    stream_curves.run_to_table(stream_curves.accumulate(batches), path + "/table", path + "/checkpoint")
    result = audit.curve_of_sums(stream_curves.latest(spark, path + "/table"))
    return result.withColumns({"bpp": r6("bpp"), "quality": r6("quality")})


STALE = "user_id % 5 = 3"


@query("k3_resumable_ingest", f"""WITH r AS (SELECT DISTINCT user_id AS source_id, event_type AS codec, CASE WHEN {STALE} THEN 'old' ELSE 'key-1' END AS cache_key FROM events)
SELECT CASE cache_key WHEN 'old' THEN 'stale' ELSE 'records' END AS kind, codec, count(*) AS n, sum(source_id)::BIGINT AS id_sum FROM r GROUP BY ALL""")
def k3(spark, sf):
    """A first run over part of the records, then the whole stream: known clips are skipped."""
    def rows(df):
        return df.selectExpr("user_id AS source_id", "event_type AS codec", f"CASE WHEN {STALE} THEN 'old' ELSE 'key-1' END AS cache_key", "event_id")

    store = scratch(spark, "ingest")
    ingest.merge_batch(rows(table(spark, sf, "events").filter("user_id % 2 = 0")), -1, store, "'key-1'")
    ingest.ingest(rows(event_stream(spark, sf)), store, store + "-checkpoint", "'key-1'")
    kinds = [spark.read.parquet(f"{store}/{kind}").select(F.lit(kind).alias("kind"), "source_id", "codec", "cache_key") for kind in ("records", "stale")]
    # Stale records are set aside per batch, so the same one may be set aside twice.
    unique = kinds[0].unionByName(kinds[1].distinct())
    return unique.groupBy("kind", "codec").agg(F.count(F.lit(1)).alias("n"), F.sum("source_id").alias("id_sum"))
