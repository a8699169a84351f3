"""Queries on small tables made for them, against their SQL."""

from __future__ import annotations

import datetime

import duckdb

from workload import load
from workload.check import compare

QUERIES, ORACLES = load()


def agrees(spark, folder, name, **tables):
    connection = duckdb.connect()
    for table, frame in tables.items():
        frame.write.parquet(f"{folder}/{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    ok, message = compare(spark, connection, str(folder), name, QUERIES[name], ORACLES[name])
    assert ok, message


def events(spark, rows):
    """(user, type, value) rows of one day."""
    ts = datetime.datetime(2024, 1, 1)
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.createDataFrame([(i, ts, u, t, v, "") for i, (u, t, v) in enumerate(rows)], kind).coalesce(1)


def test_ratio_over_a_time_of_zero(spark, tmp_path):
    rows = [(u, t, float(u + len(t))) for u in range(3) for t in ("view", "purchase")] + [(9, "view", 0.0), (9, "purchase", 2.0)]
    agrees(spark, tmp_path, "d28_runtime_summary", events=events(spark, rows))


def test_every_sequence_is_paired(spark, tmp_path):
    rows = [(u, t, 1.0) for u in (7, 8, 47) for t in ("view", "error", "purchase")]
    agrees(spark, tmp_path, "c10_frames_paired", events=events(spark, rows))
    seen = {r["seq_id"] for r in QUERIES["c10_frames_paired"](spark, str(tmp_path)).collect()}
    assert seen == {7, 8, 47}


def test_cache_is_strict_for_the_ids_that_need_a_record(spark, tmp_path):
    import pytest

    from bitcurve.sources import records

    rows = spark.range(40).selectExpr("concat('c', id) AS sequence_id", "string(id) AS codec").filter("codec % 4 <> 0")
    root = str(tmp_path / "cache")
    records.write_cache(rows.coalesce(1), root)
    names = [p.name for p in (tmp_path / "cache").iterdir() if p.name.endswith(".json")]
    assert len(names) == 30 and len({n.split("-")[1] for n in names}) > 1  # written by more than one task
    ids = spark.range(40).selectExpr("id AS pos", "concat('c', id) AS sequence_id")
    kind = "sequence_id STRING, codec STRING"
    read = records.read_cache(spark, root, ids, kind, strict="pos % 4 <> 0").collect()
    assert {(r["pos"], r["codec"]) for r in read} == {(i, str(i) if i % 4 else None) for i in range(40)}
    for condition, fault in (("pos % 4 <> 0 AND pos <> 5", "record not in the manifest"), ("pos % 8 <> 0", "no record")):
        with pytest.raises(Exception, match=fault):
            records.read_cache(spark, root, ids, kind, strict=condition).select("pos").collect()


def test_record_files_are_compressed(spark, tmp_path):
    from bitcurve.sources import records

    rows = spark.range(2000).selectExpr("id", "'the same words again and again' AS text")
    records.write_records(rows, str(tmp_path / "r"))
    assert sum(p.stat().st_size for p in (tmp_path / "r").glob("part-*")) < 2000 * 20
    assert records.read_records(spark, str(tmp_path / "r"), "id LONG, text STRING").count() == 2000


def test_folders_are_written_by_several_tasks(spark, tmp_path):
    from bitcurve.sources import sinks

    rows = spark.range(200).selectExpr("id % 20 AS k", "id AS i", "string(id) AS value").coalesce(1)
    sinks.write_folders(rows, "k", ["i"], ["value"], str(tmp_path / "t"))
    files = list((tmp_path / "t").glob("k=*/part-*"))
    assert len(files) == 20 and len({f.name.split("-")[1] for f in files}) > 1
    for f in files:
        k = int(f.parent.name[2:])
        assert f.read_text().split() == [str(i) for i in range(k, 200, 20)]
