"""Names and types of the measurement model."""

from __future__ import annotations

from pyspark.sql import types as T

# Candidate order (the anchor is first), signal names, quality points.
CANDIDATES = ("identity128", "area112", "area96", "area112_up128", "blur020_128", "blur040_128")
SIGNALS = (
    "kl_source",
    "feature_distance",
    "source_confidence",
    "source_margin",
    "source_top1_agrees",
    "confidence",
    "margin",
    "entropy",
    "source_top1_prob",
    "kl_anchor",
    "anchor_top1_agrees",
)
QPS = (30, 35, 40, 45, 50)
LOW_QP = 35

AGREEMENTS = ("source_top1_agrees", "anchor_top1_agrees")

CELL = ("source_id", "codec", "qp")

_signal_struct = T.StructType(
    [T.StructField(name, T.BooleanType() if name in AGREEMENTS else T.DoubleType()) for name in SIGNALS]
)

RECORD = T.StructType(
    [
        T.StructField("schema", T.IntegerType()),
        T.StructField("sequence_id", T.StringType()),
        T.StructField("codec", T.StringType()),
        T.StructField("cache_key", T.StringType()),
        T.StructField(
            "measurements",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("qp", T.IntegerType()),
                        T.StructField(
                            "candidates",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("name", T.StringType()),
                                        T.StructField("bpp", T.DoubleType()),
                                        T.StructField("coded_bytes", T.LongType()),
                                        T.StructField("encoded_size", T.ArrayType(T.IntegerType())),
                                        T.StructField("signals", T.MapType(T.StringType(), _signal_struct)),
                                        T.StructField("correct", T.BooleanType()),
                                        T.StructField("cross_correct", T.BooleanType()),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)

POINTS = "sequence_id STRING, path STRING, class STRING, codec STRING, qp INT, bpp DOUBLE, top1 INT, target_prob DOUBLE"
