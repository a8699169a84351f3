"""Fingerprints of key sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitcurve.session import within_broadcast_bound


def _asked(df: DataFrame, n: int) -> None:
    if not within_broadcast_bound(df, n):
        raise ValueError(f"more than the {n} keys of the selection: a whole table has a tree_fingerprint")


def fingerprint(
    df: DataFrame, key: str, n: int, separator: str = "\\n", algorithm: str = "sha256", length: int = 64
) -> DataFrame:
    """Digest of the sorted keys joined by a separator, cut to ``length`` hex digits.

    This is one digest of one string: it is for a selection of ``n`` keys, a size the caller has asked
    for; ``tree_fingerprint`` is for everything else."""
    _asked(df, n)
    joined = f"array_join(sort_array(collect_list(string({key}))), '{separator}')"
    digest = f"sha2({joined}, 256)" if algorithm == "sha256" else f"md5({joined})"
    return df.agg(F.expr(f"substring({digest}, 1, {length}) AS fingerprint"), F.count(F.lit(1)).alias("n"))


def tree_fingerprint(df: DataFrame, key: str) -> DataFrame:
    """Order-free digest of any number of keys: the keys' sha256 values are added up in four 60-bit
    limbs (an aggregate that combines map-side) and the sums, with the count, are hashed once.
    It is a different fingerprint from ``fingerprint`` and is named so."""
    digests = df.select(F.expr(f"sha2(string({key}), 256) AS _h"))
    limbs = [
        F.expr(f"sum(CAST(conv(substring(_h, {1 + 15 * i}, 15), 16, 10) AS DECIMAL(38, 0))) AS _s{i}") for i in range(4)
    ]
    sums = digests.agg(*limbs, F.count(F.lit(1)).alias("n"))
    text = ", ".join(f"coalesce(string(_s{i}), '0')" for i in range(4))
    return sums.select(F.expr(f"sha2(concat_ws('|', n, {text}), 256) AS tree_fingerprint"), "n")


def ordered_tree(df: DataFrame, name: str, digest: str, n: int, separator: str = "\\t") -> DataFrame:
    """Digest of ``name<TAB>hash`` lines in name order, as an inventory of ``n`` files is recorded."""
    _asked(df, n)
    lines = f"transform(array_sort(collect_list(struct({name} AS k, {digest} AS h))), z -> concat(z.k, '{separator}', z.h, '\\n'))"
    return df.agg(F.expr(f"sha2(array_join({lines}, ''), 256) AS tree"), F.count(F.lit(1)).alias("n"))


def canonical_json(columns) -> str:
    """JSON text of the given columns in name order, for digests of a record."""
    ordered = ", ".join(f"'{c}', {c}" for c in sorted(columns))
    return f"to_json(named_struct({ordered}))"
