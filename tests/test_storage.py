import pathlib

import pytest
from pyspark.sql import functions as F

from bitcurve.operators import checks
from bitcurve.session import scratch
from bitcurve.sources import files, records, sinks
from bitcurve.streaming import ingest


def test_report_refuses_overwrite_and_non_finite(spark):
    path = scratch(spark, "report")
    rows = spark.range(5).withColumn("v", F.lit(0.5))
    sinks.write_report(rows, path)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_report(rows, path)
    with pytest.raises(Exception, match="non-finite"):
        sinks.write_report(rows.withColumn("v", F.expr("double('NaN')")), scratch(spark, "report"))


def test_changed_report_is_noticed(spark):
    path = scratch(spark, "sealed")
    rows = spark.range(5).withColumn("v", F.lit(0.5))
    sinks.seal(rows, path)
    same = sinks.verify_report(rows, path).first()
    assert same["unchanged"] and same["reproduces"]
    other = sinks.verify_report(rows.withColumn("v", F.expr("v + int(id = 3)")), path).first()
    assert other["unchanged"] and not other["reproduces"]
    rows.limit(1).write.mode("append").json(path)
    assert not sinks.verify_report(rows, path).first()["unchanged"]


def test_malformed_record_is_an_error(spark):
    path = scratch(spark, "bad")
    spark.createDataFrame([('{"schema": 3, "sequence_id": ',)], "value STRING").write.text(path)
    with pytest.raises(Exception):
        records.read_records(spark, path).collect()


def test_repeated_cache_record_is_an_error(spark):
    path = scratch(spark, "cache")
    twice = spark.createDataFrame([("c1", "h264"), ("c1", "h265")], "sequence_id STRING, codec STRING")
    twice.write.option("maxRecordsPerFile", 1).json(path)
    ids = spark.createDataFrame([(0, "c1")], "pos INT, sequence_id STRING")
    with pytest.raises(Exception, match="repeated record"):
        records.read_cache(spark, path, ids, "sequence_id STRING, codec STRING").collect()


def test_retried_batch_changes_nothing(spark):
    store = scratch(spark, "ingest")
    rows = spark.range(10).selectExpr("id AS source_id", "'h264' AS codec", "CASE WHEN id = 4 THEN 'old' ELSE 'k' END AS cache_key", "id AS v")
    ingest.merge_batch(rows.filter("id < 6"), 0, store, "'k'")
    for _ in range(2):
        ingest.merge_batch(rows, 1, store, "'k'")
    stored = spark.read.parquet(f"{store}/records")
    assert stored.count() == 9 and stored.select("source_id").distinct().count() == 9
    assert {r["source_id"] for r in spark.read.parquet(f"{store}/stale").collect()} == {4}


def test_batches_read_only_the_slices_of_their_sources(spark):
    store = scratch(spark, "ingest")
    rows = spark.range(400).selectExpr("id AS source_id", "'h264' AS codec", "'k' AS cache_key", "id AS v")
    ingest.merge_batch(rows, 0, store, "'k'")
    few = rows.filter("source_id IN (3, 77)")
    slices = [r[0] for r in few.selectExpr(f"int(pmod(hash(source_id), {ingest.SLICES}))").distinct().collect()]
    known = ingest.known_keys(spark, store, 1, slices)
    everything = spark.read.parquet(f"{store}/records")
    assert "PartitionFilters: [isnotnull(batch" in known._jdf.queryExecution().executedPlan().toString()
    assert {3, 77} <= {r.source_id for r in known.collect()} and known.count() < 40
    assert known.select(F.input_file_name()).distinct().count() == len(slices) < everything.select("slice").distinct().count()
    # Nothing new: no record is added, whether the batch is new or tried again.
    for _ in range(2):
        ingest.merge_batch(few, 1, store, "'k'")
    ingest.merge_batch(rows.filter("source_id < 0"), 2, store, "'k'")
    ingest.merge_batch(rows.selectExpr("source_id + 399 AS source_id", "codec", "cache_key", "v"), 3, store, "'k'")
    assert spark.read.parquet(f"{store}/records").agg(F.count("*"), F.count_distinct("source_id")).first()[:] == (799, 799)


def test_damaged_store_is_an_error(spark):
    store = scratch(spark, "ingest")
    rows = spark.range(5).selectExpr("id AS source_id", "'h264' AS codec", "'k' AS cache_key", "id AS v")
    ingest.merge_batch(rows, 0, store, "'k'")
    for part in pathlib.Path(store).glob("records/batch=0/slice=*/*.parquet"):
        part.with_name("." + part.name + ".crc").unlink(missing_ok=True)
        part.write_bytes(b"damaged")
    with pytest.raises(Exception, match="(?i)parquet|footer|read"):
        ingest.merge_batch(rows, 1, store, "'k'")


def test_strict_cache_wants_the_ids_of_the_manifest(spark):
    path = scratch(spark, "cache")
    kind = "sequence_id STRING, codec STRING"
    spark.createDataFrame([("c1", "h264"), ("c2", "h265")], kind).write.option("maxRecordsPerFile", 1).json(path)
    ids = spark.createDataFrame([(0, "c2"), (1, "c1"), (2, "c3")], "pos INT, sequence_id STRING")
    whole = records.read_cache(spark, path, ids.filter("pos < 2"), kind, strict=True)
    assert sorted((r.pos, r.codec) for r in whole.collect()) == [(0, "h265"), (1, "h264")]
    with pytest.raises(Exception, match="no record: c3"):
        records.read_cache(spark, path, ids, kind, strict=True).collect()
    with pytest.raises(Exception, match="not in the manifest: c1"):
        records.read_cache(spark, path, ids.filter("pos = 0"), kind, strict=True).select("codec").collect()
    loose = records.read_cache(spark, path, ids.filter("pos <> 1"), kind)
    assert sorted((r.pos, r.codec) for r in loose.collect()) == [(0, "h265"), (2, None)]


def test_tampered_tables_are_reported(spark):
    rows = spark.range(4).selectExpr("id AS source_id", "30 AS qp", "int(id) AS n")
    grid = spark.createDataFrame([(30,), (35,)], "qp INT")
    missing = checks.grid_violations(rows, "source_id", ["qp"], grid).collect()
    assert {(r["source_id"], r["qp"], r["violation"]) for r in missing} == {(i, 35, "missing") for i in range(4)}
    assert checks.metric_differences(rows, rows, ["source_id", "qp"], ["n"]).count() == 0
    assert checks.metric_differences(rows, rows.withColumn("n", F.expr("n + int(source_id = 2)")), ["source_id", "qp"], ["n"]).count() == 1


OLD = ('{"schema": %d, "sequence_id": "%s", "codec": "h264", "source_correct": true, "measurements": [{"qp": 30, "candidates": '
       '[{"name": "identity128", "bpp": 0.5, "coded_bytes": 7, "encoded_size": [128, 128], "kl_source": 0.25, "correct": true%s}]}]}')
NEW = ('{"schema": 3, "sequence_id": "n", "codec": "h265", "cache_key": "k", "measurements": [{"qp": 35, "candidates": '
       '[{"name": "area96", "bpp": 1, "signals": {"m": {"kl_source": 0.5}, "other": {"kl_source": 0.75}}, "correct": false}]}]}')


def test_schemas_mix_in_one_file(spark):
    path = scratch(spark, "mixed")
    lines = [OLD % (1, "o1", ', "cross_correct": false'), OLD % (2, "o2", ""), NEW, '{"schema": 1, "sequence_id": "e", "measurements": []}']
    spark.createDataFrame([(x,) for x in lines], "value STRING").coalesce(1).write.text(path)
    read = records.read_mixed_records(spark, path, "m")
    flat = records.flatten(read, {"a": "m", "b": "other"}, {"a": "correct", "b": "cross_correct"})
    rows = {r["source_id"]: r for r in flat.collect()}
    assert set(rows) == {"o1", "o2", "n"} and read.count() == 4
    assert [rows[k]["a_kl_source"] for k in ("o1", "o2", "n")] == [0.25, 0.25, 0.5]
    assert [rows[k]["b_kl_source"] for k in ("o1", "o2", "n")] == [None, None, 0.75]
    assert [rows[k]["correct_b"] for k in ("o1", "o2", "n")] == [False, None, None]
    assert [rows[k]["cache_key"] for k in ("o1", "o2", "n")] == [None, None, "k"]
    assert rows["n"]["bpp"] == 1.0 and rows["o1"]["a_entropy"] is None and rows["o1"]["coded_bytes"] == 7
    assert flat.select("cand_idx").dtypes == [("cand_idx", "int")]


@pytest.mark.parametrize("line", ['{"schema": 4, "sequence_id": "x"}', '{"sequence_id": "x"}', '{"schema": 3, "sequence_id": '])
def test_unknown_schema_is_an_error(spark, line):
    path = scratch(spark, "mixed")
    spark.createDataFrame([(OLD % (1, "o", ""),), (line,)], "value STRING").write.text(path)
    with pytest.raises(Exception):
        records.read_mixed_records(spark, path, "m").collect()


def test_inventory_without_a_count_is_an_error(spark):
    path = scratch(spark, "inventory")
    spark.createDataFrame([('{"source_fingerprint": "f", "source_ids": ["a"]}',)], "value STRING").write.text(path)
    with pytest.raises(ValueError, match="no inventory"):
        files.read_inventory(spark, path)
