from pyspark.sql import functions as F

from bitcurve.plans import gates
from bitcurve.session import scratch


def stages(spark, rows):
    first = spark.createDataFrame(rows, "arm STRING, n_boxes BIGINT, quality DOUBLE")
    path = scratch(spark, "by-arm")
    arms = ["base", "good", "bad", "none"]
    spark.range(40).select("id", F.element_at(F.array(*map(F.lit, arms)), F.expr("int(id % 4) + 1")).alias("arm")).write.partitionBy(
        "arm").parquet(path)
    return gates.staged(first, spark.read.parquet(path), "base")


def test_second_stage_reads_only_arms_let_through(spark):
    rows = [("base", 50, 0.5), ("good", 3, 0.4), ("bad", 90, 0.39), ("none", 90, None), ("unstored", 90, 0.5)]
    verdicts, second = stages(spark, rows)
    assert dict(verdicts.collect()) == {"good": "continue", "bad": "stage_A_fail", "none": "stage_A_fail", "unstored": "continue"}
    assert {tuple(r) for r in second.groupBy("arm").count().collect()} == {("base", 10), ("good", 10)}
    plan = second._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_degenerate_anchor_stops_all_arms(spark):
    verdicts, second = stages(spark, [("base", 49, 0.5), ("good", 90, 0.5), ("bad", 90, 0.1)])
    assert {r["verdict"] for r in verdicts.collect()} == {"degenerate_anchor"}
    assert {r["arm"] for r in second.select("arm").distinct().collect()} == {"base"}


def test_anchor_of_zero_lets_all_go_on(spark):
    verdicts, _ = stages(spark, [("base", 50, 0.0), ("good", 90, 0.0)])
    assert [r["verdict"] for r in verdicts.collect()] == ["continue"]


def test_no_anchor_row(spark):
    verdicts, second = stages(spark, [("good", 90, 0.5)])
    assert verdicts.count() == 0 and {r["arm"] for r in second.select("arm").distinct().collect()} == {"base"}
