"""The library's scalar functions for SQL (M2)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from bitcurve.functions import arrays as A
from bitcurve.functions import bd
from bitcurve.functions import geometry as X

VECTOR = "ARRAY<DOUBLE>"
CORNERS = "STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
SIDES = "STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>"

# name: (parameters, result, text)
FUNCTIONS = {
    "softmax": ({"v": VECTOR}, VECTOR, A.softmax("v")),
    "log_softmax": ({"v": VECTOR}, VECTOR, A.log_softmax("v")),
    "argmax": ({"v": VECTOR}, "INT", A.argmax("v")),
    "top2": ({"v": VECTOR}, "STRUCT<confidence: DOUBLE, margin: DOUBLE>", A.top2("v")),
    "prob_entropy": ({"v": VECTOR}, "DOUBLE", A.entropy("v")),
    "kl_divergence": ({"p": VECTOR, "log_q": VECTOR}, "DOUBLE", A.kl("p", "log_q")),
    "cosine_distance": ({"a": VECTOR, "b": VECTOR}, "DOUBLE", A.cosine_distance("a", "b")),
    "cross_entropy": ({"v": VECTOR, "target": "INT"}, "DOUBLE", A.cross_entropy("v", "target")),
    "iou": ({"a": CORNERS, "b": CORNERS}, "DOUBLE", X.iou("a", "b")),
    "iou_xywh": ({"a": SIDES, "b": SIDES}, "DOUBLE", X.iou_xywh("a", "b")),
    "success": ({"overlap": "DOUBLE"}, "DOUBLE", X.success("overlap")),
}


def register(spark: SparkSession) -> None:
    """Make all of them, and the deltas, callable from SQL. They are SQL themselves: no Python runs."""
    bd.register(spark)
    for name, (parameters, result, text) in FUNCTIONS.items():
        typed = ", ".join(f"{p} {kind}" for p, kind in parameters.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({typed}) RETURNS {result} RETURN {text}")
