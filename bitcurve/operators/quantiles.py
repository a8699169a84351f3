"""Exact quantiles of groups of any size, by radix selection.

``percentile`` gathers all values of a group in one task, and ranking them sorts the table. Here every double is
mapped to the 64-bit integer that has its order. Counts by the leading 16 bits, which combine map-side, tell which
bucket holds a wanted position; only that bucket's rows are counted again by the next 16 bits, until a bucket
holds one value. No row is sorted or shuffled, whatever a group's share of the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitcurve.session import within_broadcast_bound, written

DIGIT = 16  # bits a pass: at most 65,536 counts per group and bucket
BROADCAST_KEYS = 500_000  # groups and buckets sent to all tasks; beyond, Spark joins them


def with_ordinal(df: DataFrame, value: str, name: str) -> DataFrame:
    """The integer of a double's order: its IEEE bits for positive values, their negative below zero, 0 for both
    zeros, then infinity and NaN. Exact, since Java's powers of two are."""
    size, exponent = f"abs({value})", "_exponent"
    finite = f"{size} <= 1.7976931348623157E308D"
    guess = f"CASE WHEN {finite} THEN greatest(-1022L, least(1023L, coalesce(floor(log2({size})), -1022L))) END"
    # The logarithm is rounded, so the guess may be one off next to a power of two.
    settled = f"""CASE WHEN {exponent} > -1022 AND {size} < pow(2D, {exponent}) THEN {exponent} - 1
        WHEN {exponent} < 1023 AND {size} >= pow(2D, {exponent} + 1) THEN {exponent} + 1 ELSE {exponent} END"""
    unsigned = f"""CASE WHEN isnan({value}) THEN {2047 * 2**52 + 1}L WHEN {finite}
        THEN ({exponent} + 1022)*{2**52}L + bigint({size}/pow(2D, {exponent})*{float(2**52)!r}D) ELSE {2047 * 2**52}L END"""
    shaped = df.withColumn(exponent, F.expr(guess)).withColumn(exponent, F.expr(settled))
    return shaped.withColumn(name, F.expr(f"({unsigned})*CASE WHEN {value} < 0 THEN -1L ELSE 1L END")).drop(exponent)


def _same(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Inner join on ``keys``, a NULL matching a NULL; the right side's keys go."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_r_{k}")), keys, F.lit(True))
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])


def exact_quantiles(df: DataFrame, group, value: str, probabilities) -> DataFrame:
    """(group, p, quantile), interpolated linearly between the two neighbours of the position p*(n - 1).

    NULL values are left out, a NULL group is a group, NaN counts as the largest value. At most four passes over
    one narrow table of (group, value)."""
    group = list(group)
    named = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    rows = written(with_ordinal(named, "_v", "_o"), "quantiles")
    counted = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    at = "p*(_total - 1)"
    wanted = f"""flatten(transform(array({', '.join(f'{float(p)!r}D' for p in probabilities)}), p -> transform(
        array(floor({at}), ceil({at})), k -> struct(p AS p, {at} - floor({at}) AS _part, bigint(k) AS _k))))"""
    shift = 64 - DIGIT
    counts = rows.groupBy(*group, F.expr(f"shiftright(_o, {shift})").alias("_prefix")).agg(*counted)
    ahead = Window.partitionBy(*group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select("*", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
                           F.sum("_n").over(Window.partitionBy(*group)).alias("_total"))
    here = placed.withColumn("_w", F.explode(F.expr(f"filter({wanted}, w -> w._k >= _before AND w._k < _before + _n)")))
    found = here.select(*group, "_prefix", "_low", "_high", "_w.p", "_w._part", (F.col("_w._k") - F.col("_before")).alias("_k"))
    settled, small = [], None
    while True:
        found = written(found, "positions")  # a row or two per group and probability, fewer from pass to pass
        unsettled = found.filter("NOT _low <=> _high")
        if shift == 0 or unsettled.isEmpty():
            settled.append(found)
            break
        settled.append(found.filter("_low <=> _high"))
        # What is below the bucket is counted no more: the position is now one inside the bucket.
        inside = unsettled.select(*group, F.col("_prefix").alias("_parent"), "p", "_part", "_k")
        keys = inside.select(*group, "_parent").distinct()
        small = within_broadcast_bound(inside, BROADCAST_KEYS) if small is None else small
        keys = F.broadcast(keys) if small else keys
        part = _same(rows.withColumn("_parent", F.expr(f"shiftright(_o, {shift})")), keys, [*group, "_parent"])
        shift -= DIGIT
        counts = part.groupBy(*group, "_parent", F.expr(f"shiftright(_o, {shift})").alias("_prefix")).agg(*counted)
        ahead = Window.partitionBy(*group, "_parent").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        here = _same(placed, inside, [*group, "_parent"]).filter("_k >= _before AND _k < _before + _n")
        found = here.select(*group, "_prefix", "_low", "_high", "p", "_part", (F.col("_k") - F.col("_before")).alias("_k"))
    return reduce(DataFrame.unionByName, settled).groupBy(*group, "p").agg(
        F.expr("CASE WHEN min(_low) = max(_high) THEN min(_low) ELSE min(_low) + (max(_high) - min(_low))*max(_part) END")
        .alias("quantile")
    )


def quantile_columns(quantiles: DataFrame, group, names: dict[float, str]) -> DataFrame:
    """One column per probability."""
    return quantiles.groupBy(*group).agg(
        *[F.expr(f"max(CASE WHEN p = {p}D THEN quantile END) AS {name}") for p, name in names.items()]
    )
