"""Rate-quality curves and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitcurve.functions import bd


def curve(rows: DataFrame, keys, rate: str = "bpp", quality="correct", extra=()) -> DataFrame:
    """Mean rate, mean quality and count per (keys, qp); partial aggregation happens map-side."""
    return rows.groupBy(*keys, "qp").agg(
        F.avg(rate).alias("bpp"),
        F.avg(F.col(quality).cast("double")).alias("quality"),
        F.count(F.lit(1)).alias("n"),
        *[F.avg(name).alias(name) for name in extra],
    )


def curves_by_model(rows: DataFrame, keys, models, prefix: str = "correct_", rate: str = "bpp") -> DataFrame:
    """Curves of all analyzers from one pass: the means are computed side by side, and only the
    few aggregated rows are turned long."""
    means = rows.groupBy(*keys, "qp").agg(
        F.avg(rate).alias("bpp"),
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(prefix + m).cast("double")).alias(f"quality_{m}") for m in models],
    )
    per_model = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(f"quality_{m}").alias("quality")) for m in models]
    )
    return means.select(*keys, "qp", "bpp", "n", F.inline(per_model))


def points(rate: str = "bpp", quality: str = "quality") -> Column:
    """Aggregate a curve to ``array<struct<qp, rate, quality>>`` in qp order."""
    return F.expr(
        f"array_sort(collect_list(named_struct('qp', qp, 'rate', {rate}, 'quality', {quality})))"
    )


def curve_points(curves: DataFrame, keys, quality: str = "quality") -> DataFrame:
    return curves.groupBy(*keys).agg(points(quality=quality).alias("points"))


def _shared(anchor: str, test: str, value: str) -> str:
    """``value`` of (a, t) for every qp present in both curves, in anchor order."""
    pairs = f"transform({anchor}, a -> struct(a AS a, get(filter({test}, t -> t.qp = a.qp), 0) AS t))"
    value = value.replace("a.", "z.a.").replace("t.", "z.t.")
    return f"transform(filter({pairs}, z -> z.t IS NOT NULL), z -> {value})"


def mean_sql(values: str) -> str:
    return f"transform(array({values}), v -> aggregate(v, 0D, (s, x) -> s + x)/nullif(size(v), 0))[0]"


def rate_ratios(anchor: str, test: str) -> str:
    return _shared(anchor, test, "t.rate/nullif(a.rate, 0D)")


def quality_gaps(anchor: str, test: str) -> str:
    return _shared(anchor, test, "t.quality - a.quality")


def compare(pairs: DataFrame, anchor: str = "anchor_points", test: str = "points") -> DataFrame:
    """BD-rate, BD-accuracy, mean same-qp rate ratio and worst same-qp gap of two point arrays."""
    return pairs.withColumns(
        {
            "bd_rate": bd.bd_rate(anchor, test),
            "bd_accuracy": bd.bd_metric(anchor, test),
            "rate_ratio": F.expr(mean_sql(rate_ratios(anchor, test))),
            "min_gap": F.expr(f"array_min({quality_gaps(anchor, test)})"),
        }
    )


def paired_points(rows: DataFrame, keys, models, base: str = "c0_", means=()) -> DataFrame:
    """Curves of a choice and of the anchor in the same cell, per (keys, model).

    Both come out of one aggregation because every chosen row carries its anchor's values, so
    there is neither a join nor a second scan. ``means`` are further columns averaged over the
    rows of ``keys`` where they are not NULL."""
    qualities = ", ".join(f"'{m}', avg(double(correct_{m})), '{m}_base', avg(double({base}correct_{m}))" for m in models)
    extra = [F.expr(f"{f}(double({name})) AS _{f}_{name}") for name in means for f in ("sum", "count")]
    per_qp = rows.groupBy(*keys, "qp").agg(
        F.expr(f"named_struct('bpp', avg(bpp), 'base', avg({base}bpp), {qualities}) AS point"),
        F.count(F.lit(1)).alias("n"),
        *extra,
    )
    packed = per_qp.groupBy(*keys).agg(
        F.expr("array_sort(collect_list(named_struct('qp', qp, 'v', point))) AS _points"),
        F.sum("n").alias("n"),
        *[F.expr(f"sum(_sum_{name})/nullif(sum(_count_{name}), 0) AS {name}") for name in means],
    )
    per_model = ", ".join(
        f"""struct('{m}' AS model,
        transform(_points, p -> named_struct('qp', p.qp, 'rate', p.v.base, 'quality', p.v.{m}_base)) AS anchor_points,
        transform(_points, p -> named_struct('qp', p.qp, 'rate', p.v.bpp, 'quality', p.v.{m})) AS points)"""
        for m in models
    )
    return packed.select(*keys, "n", *means, F.expr(f"inline(array({per_model}))"))


def against(curves: DataFrame, arm: str, anchor_value, keys, quality: str = "quality") -> DataFrame:
    """Pair every arm's curve with the anchor arm's, within ``keys``: one row per arm, so the
    window holds as many (small) rows as there are arms."""
    packed = curve_points(curves, [*keys, arm], quality)
    within = Window.partitionBy(*keys)
    anchor = F.max(F.when(F.col(arm) == anchor_value, F.col("points"))).over(within)
    return packed.withColumn("anchor_points", anchor).filter(F.col(arm) != anchor_value)


def compare_pairs(curves: DataFrame, pairs: DataFrame, name: str, keys) -> DataFrame:
    """Deltas for an explicit (anchor, trial) pair table; a missing curve gives no row.

    ``pairs`` is a short list of arm names and is broadcast."""
    packed = curve_points(curves, [*keys, name])
    anchor = packed.select(*keys, F.col(name).alias("anchor"), F.col("points").alias("anchor_points"))
    trial = packed.select(*keys, F.col(name).alias("trial"), "points")
    joined = anchor.join(F.broadcast(pairs), "anchor").join(trial, [*keys, "trial"])
    return compare(joined)


def merged_curve(rows: DataFrame, method: str, quality: str, least_points: int = 2) -> DataFrame:
    """Curve of merged shards: a method with fewer than ``least_points`` quality points is dropped."""
    curves = curve(rows, [method], quality=quality)
    # One row per (method, qp): the window holds a handful of rows.
    counted = curves.withColumn("_points", F.count(F.lit(1)).over(Window.partitionBy(method)))
    return counted.filter(F.col("_points") >= least_points).drop("_points")


def _codec_pairs(curves: DataFrame, codecs, prefixes) -> DataFrame:
    """Points of each plain codec next to those of its prefixed methods (NULL if absent)."""
    packed = curve_points(curves, ["method"])
    wanted = ", ".join(f"'{p}{c}'" for c in codecs for p in ("", *prefixes))
    tagged = packed.filter(f"method IN ({wanted})").withColumn("codec", F.expr("element_at(split(method, '[+]'), -1)"))
    return tagged.groupBy("codec").agg(
        F.expr("max(CASE WHEN method = codec THEN points END) AS anchor_points"),
        *[F.expr(f"max(CASE WHEN method = concat('{p}', codec) THEN points END) AS points_{i}") for i, p in enumerate(prefixes)],
    )


def gap_rule(curves: DataFrame, codecs, limit: float = -0.05) -> DataFrame:
    """Worst same-qp quality gap of the sandwich curve (else the prep curve) against the codec."""
    paired = _codec_pairs(curves, codecs, ("sandwich+", "prep+"))
    paired = paired.withColumns(
        {
            "trial": F.expr("concat(CASE WHEN points_0 IS NOT NULL THEN 'sandwich+' ELSE 'prep+' END, codec)"),
            "points": F.coalesce("points_0", "points_1"),
        }
    ).filter("anchor_points IS NOT NULL AND points IS NOT NULL")
    gaps = paired.withColumn("gaps", F.expr(quality_gaps("anchor_points", "points")))
    return gaps.select(
        "codec",
        "trial",
        F.array_min("gaps").alias("min_gap"),
        F.expr(f"coalesce(array_min(gaps) >= {limit}D, false) AS pass"),
        F.expr("bigint(size(gaps)) AS n_points"),
    )


def end_gaps(curves: DataFrame, codecs) -> DataFrame:
    """Quality gap at the lowest and highest rate, and the mean relative rate divergence."""
    paired = _codec_pairs(curves, codecs, ("prep+",)).filter("anchor_points IS NOT NULL AND points_0 IS NOT NULL")
    by_rate = "array_sort(anchor_points, (l, r) -> CASE WHEN l.rate < r.rate THEN -1 WHEN l.rate > r.rate THEN 1 ELSE 0 END)"
    paired = paired.withColumn("anchor_points", F.expr(by_rate))
    paired = paired.withColumn("_gaps", F.expr(quality_gaps("anchor_points", "points_0")))
    divergence = mean_sql(_shared("anchor_points", "points_0", "abs(t.rate - a.rate)/a.rate"))
    return paired.select(
        "codec",
        F.expr("element_at(_gaps, 1) AS gap_first"),
        F.expr("element_at(_gaps, -1) AS gap_last"),
        F.expr(f"{divergence} AS rate_divergence"),
    )


def sequence_deltas(rows: DataFrame, sequence: str, quality: str, codecs, qps, trial_prefix: str = "prep+") -> DataFrame:
    """Per-sequence deltas on a continuous quality over the qps both methods have (at least two).

    Points are aggregated into one slot per qp, so repeated rows of a hot sequence combine before
    the exchange and no list grows with the data."""
    wanted = ", ".join(f"'{p}{c}'" for c in codecs for p in ("", trial_prefix))
    slot = "max(CASE WHEN qp = {q} AND method {op} codec THEN struct(qp, bpp AS rate, double({v}) AS quality) END) AS _{s}{q}"
    grouped = rows.filter(f"method IN ({wanted})").groupBy(sequence, "codec").agg(
        *[F.expr(slot.format(q=q, op=op, v=quality, s=s)) for s, op in (("a", "="), ("t", "<>")) for q in qps]
    )
    both = [" AND ".join((f"_a{q} IS NOT NULL", f"_t{q} IS NOT NULL")) for q in qps]

    def points_of(side: str) -> str:
        slots = ", ".join(f"CASE WHEN {ok} THEN _{side}{q} END" for q, ok in zip(qps, both, strict=True))
        return f"filter(array({slots}), z -> z IS NOT NULL)"

    shared = grouped.select(
        sequence, "codec", F.expr(f"{points_of('a')} AS anchor_points"), F.expr(f"{points_of('t')} AS points")
    ).filter("size(points) >= 2")
    return compare(shared).withColumn("n_points", F.expr("bigint(size(points))"))
