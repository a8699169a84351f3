"""Report aggregates over choices and paired outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitcurve.operators.quantiles import exact_quantiles, quantile_columns


def running_curve(batches: DataFrame, method: str = "method", key: str = "key") -> DataFrame:
    """Curve from weighted batches (bpp, score_sum, n): sums merge, the ratio comes last. ``rank``
    orders a method's points by mean rate."""
    sums = batches.groupBy(method, key).agg(
        F.expr("sum(bpp*n) AS bpp_sum"), F.sum("score_sum").alias("score_sum"), F.sum("n").alias("n")
    )
    return curve_of_sums(sums, method, key)


def curve_of_sums(sums: DataFrame, method: str = "method", key: str = "key") -> DataFrame:
    # A method has as many rows as rate points.
    ranked = sums.selectExpr(method, key, "bpp_sum/n AS bpp", "score_sum/n AS quality", "n")
    return ranked.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY {method} ORDER BY bpp, {key})"))


def choice_histogram(choices: DataFrame, base: str | None = None) -> DataFrame:
    """Choice counts per qp and overall (qp NULL), with switches against a base index."""
    switched = F.count_if(F.col("cand_idx") != F.col(base)) if base else F.lit(0)
    return choices.groupingSets([("qp", "cand_idx"), ("cand_idx",)], "qp", "cand_idx").agg(
        F.count(F.lit(1)).alias("n"), switched.alias("switched")
    )


def top_k(rows: DataFrame, logits: str, target: str, ks=(1, 5)) -> DataFrame:
    """Accuracy at k: the target's logit is beaten by fewer than k others."""
    better = f"size(filter({logits}, x -> x > get({logits}, {target})))"
    return rows.agg(*[F.expr(f"avg(double({better} < {k})) AS top{k}") for k in ks], F.count(F.lit(1)).alias("n"))


def saving_diagnostics(cells: DataFrame, index: int, models=("a", "b")) -> DataFrame:
    """Per qp: p10/p50/p90 of the rate saving and proxy excess of one candidate, and mean gaps."""
    pairs = cells.selectExpr(
        "source_id", "codec", "qp",
        f"stack(2, 'saving_pct', 100*(1 - c{index}_bpp/c0_bpp), 'excess', c{index}_proxy_error - c0_proxy_error)"
        " AS (metric, value)",
    )
    q = exact_quantiles(pairs, ["qp", "metric"], "value", [0.1, 0.5, 0.9])
    table = quantile_columns(q, ["qp", "metric"], {0.1: "p10", 0.5: "p50", 0.9: "p90"})
    gaps = cells.groupBy("qp").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(f"100*avg(int(c{index}_correct_{m}) - int(c0_correct_{m})) AS gap_{m}_pp") for m in models],
    )
    return table.join(F.broadcast(gaps), "qp")


def contingency(rows: DataFrame, models, keys=("qp",), base: str = "c0_") -> DataFrame:
    """Paired gains, losses, both right and both wrong per (keys, model)."""
    stacked = ", ".join(f"'{m}', correct_{m}, {base}correct_{m}" for m in models)
    long = rows.select(*keys, F.expr(f"stack({len(models)}, {stacked}) AS (model, now, before)"))
    counted = long.groupBy(*keys, "model").agg(
        F.expr("count_if(now AND NOT before) AS gains"),
        F.expr("count_if(NOT now AND before) AS losses"),
        F.expr("count_if(now AND before) AS both_right"),
        F.expr("count_if(NOT now AND NOT before) AS both_wrong"),
    )
    return counted.withColumns(
        {
            "net": F.expr("gains - losses"),
            "gap_pp": F.expr("100*(gains - losses)/(gains + losses + both_right + both_wrong)"),
        }
    )


def guard_deficit(rows: DataFrame, models, keys=("qp",), base: str = "c0_", guard: float = 0.01) -> DataFrame:
    """Correct predictions needed for the same-qp guard, and how many are missing."""
    stacked = ", ".join(f"'{m}', correct_{m}, {base}correct_{m}" for m in models)
    long = rows.select(*keys, F.expr(f"stack({len(models)}, {stacked}) AS (model, now, before)"))
    counted = long.groupBy(*keys, "model").agg(
        F.expr("count_if(before) AS base_correct"), F.expr("count_if(now) AS correct"), F.count(F.lit(1)).alias("n")
    )
    needed = f"bigint(ceil(round(base_correct - {guard}D*n, 9)))"
    return counted.withColumn("needed", F.expr(needed)).withColumn("missing", F.expr("greatest(needed - correct, 0)"))


def transitions(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Changes ``old -> new`` per qp and overall: counts, sources touched, mean deltas.

    ``rows`` has source_id, qp and the deltas d_proxy and d_bpp. The distinct sources are counted
    by one row per (source, level) first, which combines map-side."""
    changed = rows.filter(f"{old} <> {new}")
    per_source = changed.groupBy("source_id", "qp", old, new).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("d_proxy").alias("_p"), F.sum("d_bpp").alias("_b")
    )
    levels = per_source.groupingSets(
        [("source_id", "qp", old, new), ("source_id", old, new)], "source_id", "qp", old, new
    ).agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"), F.sum("_b").alias("_b"))
    return levels.groupBy("qp", old, new).agg(
        F.sum("_n").alias("n"),
        F.count(F.lit(1)).alias("sources"),
        F.expr("sum(_p)/sum(_n) AS mean_d_proxy"),
        F.expr("sum(_b)/sum(_n) AS mean_d_bpp"),
    )


def runtime_summary(rows: DataFrame, metrics, key: str) -> DataFrame:
    """Median, mean and p95 of each metric over one row per ``key``."""
    stacked = ", ".join(f"'{m}', double({m})" for m in metrics)
    long = rows.select(key, F.expr(f"stack({len(metrics)}, {stacked}) AS (metric, value)")).filter("value IS NOT NULL")
    q = quantile_columns(exact_quantiles(long, ["metric"], "value", [0.5, 0.95]), ["metric"], {0.5: "median", 0.95: "p95"})
    means = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return q.join(F.broadcast(means), "metric")


def headroom(cells: DataFrame, keeps, candidates: int) -> DataFrame:
    """Share of cells with a feasible non-anchor choice, and with one that also saves rate."""
    feasible = " OR ".join(f"({keeps(i)})" for i in range(1, candidates))
    saving = " OR ".join(f"(({keeps(i)}) AND c{i}_bpp < c0_bpp)" for i in range(1, candidates))
    return cells.agg(
        F.expr(f"avg(double({feasible})) AS nonidentity_fraction"),
        F.expr(f"avg(double({saving})) AS saving_fraction"),
        F.count(F.lit(1)).alias("n_cells"),
    )


def class_balance(rows: DataFrame, labels, keys=()) -> DataFrame:
    """Positives and totals per label column."""
    stacked = ", ".join(f"'{label}', int({label})" for label in labels)
    long = rows.select(*keys, F.expr(f"stack({len(labels)}, {stacked}) AS (label, value)"))
    return long.groupBy(*keys, "label").agg(F.sum("value").alias("positives"), F.count("value").alias("total"))


def account_rollup(versions: DataFrame, account: str, item: str) -> DataFrame:
    """Per account: items listed, versions, relevant versions and errors; columns relevant, failed.

    Items are reduced to one row each before they are counted."""
    per_item = versions.groupBy(account, item).agg(
        F.count(F.lit(1)).alias("_v"), F.count_if("relevant").alias("_r"), F.count_if("failed").alias("_e")
    )
    return per_item.groupBy(account).agg(
        F.count(F.lit(1)).alias("listed"), F.sum("_v").alias("versions"), F.sum("_r").alias("relevant"), F.sum("_e").alias("errors")
    )


def replicate_summary(paired: DataFrame, keys=(), better: float = 2.0) -> DataFrame:
    """Across seeds (one paired difference each): median, worst regression and the share of seeds
    that improve by at least ``better``."""
    return paired.groupBy(*keys).agg(
        F.expr("percentile(difference, 0.5D) AS median"),
        F.max("difference").alias("worst"),
        F.expr(f"avg(double(difference <= -{better}D)) AS p_improve"),
        F.count("difference").alias("n_seeds"),
    )


def mean_max(rows: DataFrame, value: str, keys=()) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))


def mean_ratio(rows: DataFrame, numerator: str, denominator: str, keys=()) -> DataFrame:
    """Mean of the rows' ratios, not the ratio of means."""
    return rows.groupBy(*keys).agg(F.expr(f"avg({numerator}/nullif({denominator}, 0)) AS mean_ratio"))


def bit_accounting(rows: DataFrame, keys=("arm", "qp")) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg("bpp").alias("mean_bpp"), F.avg("coded_bytes").alias("mean_coded_bytes"))
