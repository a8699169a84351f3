"""Parameters, rates and codec/qp subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH = 5


def bits_per_pixel(size: str, frames: str, height: str, width: str) -> str:
    return f"({size}*8D/({frames}*{height}*{width}))"


def normalised_bpp(native: str, height: str, width: str, reference: int = 128) -> str:
    """Rate of a resized stream on the pixel count of the reference size."""
    return f"({native}*({height}*{width})/({reference}D*{reference}D))"


def _leaves(data_type: T.DataType, path: str, depth: int) -> list[tuple[str, str]]:
    """(dotted path, SQL value as string) of every leaf below a column."""
    if isinstance(data_type, T.StructType) and depth <= MAX_DEPTH:
        return [leaf for f in data_type.fields for leaf in _leaves(f.dataType, f"{path}.{f.name}", depth + 1)]
    if isinstance(data_type, T.ArrayType) and depth <= MAX_DEPTH:
        return [(path, f"array_join(transform({path}, x -> string(x)), ',')")]
    if isinstance(data_type, (T.StructType, T.MapType)):
        return [(path, f"to_json({path})")]
    return [(path, f"string({path})")]


def flatten_params(df: DataFrame, keys) -> DataFrame:
    """(keys, path, value) of nested parameter columns: dotted paths down to the sixth level,
    lists comma-joined, anything deeper as one string. The schema is walked, not the data."""
    leaves = [leaf for f in df.schema.fields if f.name not in keys for leaf in _leaves(f.dataType, f.name, 0)]
    stacked = ", ".join(f"'{path}', {value}" for path, value in leaves)
    return df.select(*keys, F.expr(f"stack({len(leaves)}, {stacked}) AS (path, value)"))


def clip_params(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Clip parameters to their legal range."""
    return df.withColumns({n: F.expr(f"greatest({lo}D, least({hi}D, {n}))") for n, (lo, hi) in bounds.items()})


def restrict(df: DataFrame, codecs, qps, known_codecs, known_qps) -> DataFrame:
    """Rows of the asked codecs and qps, which must be non-empty unique subsets of the known ones."""
    codecs = [c.lower() for c in codecs]
    for asked, known, what in ((codecs, known_codecs, "codecs"), (list(qps), known_qps, "qps")):
        if not asked or len(asked) != len(set(asked)) or not set(asked) <= set(known):
            raise ValueError(f"{what} must be a non-empty unique subset of {list(known)}")
    return df.filter(F.col("codec").isin(codecs) & F.col("qp").isin(list(qps)))
