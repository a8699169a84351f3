"""Wide measurements are nested where they lie."""

from bitcurve.sources import records
from workload import fixtures, storage


def test_records_are_nested_without_an_exchange(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(records, "write_records", lambda nested, path, _write=records.write_records: (
        plans.append(nested._jdf.queryExecution().executedPlan().toString()), _write(nested, path))[1])
    assert storage.stored_records(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert "REPARTITION_BY_NUM" in plans[0] and "ENSURE_REQUIREMENTS" not in plans[0] and "ArrowEval" not in plans[0]


def test_digests_are_the_same_either_way(spark):
    both = [fixtures.measurements(spark, "/root/testdata/sf0.001", *storage.RECORD_FIELDS, batches=b) for b in (True, False)]
    assert both[0].exceptAll(both[1]).isEmpty() and both[1].exceptAll(both[0]).isEmpty()
