"""Many values of a row are hashed in batches, to the same numbers as one by one in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from workload import fixtures as X
from workload import learning as W

SF = "/root/testdata/sf0.001"


def test_batches_give_the_values_of_sql(spark, monkeypatch):
    many = X.measurements(spark, SF, *W.FIELDS, codecs=("h264", "h265"))
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "md5(" not in plan.split("ArrowEvalPython", 1)[0]
    monkeypatch.setattr(X, "MANY_SEEDS", 1_000)
    one_by_one = X.measurements(spark, SF, *W.FIELDS, codecs=("h264", "h265"))
    assert "ArrowEvalPython" not in one_by_one._jdf.queryExecution().optimizedPlan().toString()
    assert many.count() == one_by_one.count() > 0
    assert many.exceptAll(one_by_one).isEmpty()


def test_long_and_odd_keys(spark):
    keys = spark.createDataFrame([("",), ("x"*200,), ("é|中",)], "ck string")
    sql = X.spark_sql("U('s|'||ck)")
    assert keys.select((F.col("ck") != "?") & (X.uniform_values(["s|"])("ck")["u0"] == F.expr(sql))).distinct().collect() == [(True,)]
