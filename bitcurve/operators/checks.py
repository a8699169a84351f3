"""Contract checks (L). Every check returns the violating rows; an empty result means it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitcurve.functions.bd import finite_sql


def record_identity(records: DataFrame, expected: dict[str, str], key: str) -> DataFrame:
    """Rows whose identifying fields differ from the expected SQL expressions."""
    wrong = ", ".join(f"CASE WHEN NOT ({field} <=> ({value})) THEN '{field}' END" for field, value in expected.items())
    found = records.select(key, F.expr(f"filter(array({wrong}), x -> x IS NOT NULL) AS fields"))
    return found.filter("size(fields) > 0").select(key, F.expr("array_join(fields, ',') AS fields"))


def grid_violations(rows: DataFrame, source: str, point, expected: DataFrame) -> DataFrame:
    """Missing, repeated or unknown grid points per source. ``expected`` lists the (few) points a
    source must have; points are counted before they meet it."""
    point = list(point)
    counted = rows.groupBy(source, *point).agg(F.count(F.lit(1)).alias("n"))
    sources = rows.select(source).distinct()
    wanted = sources.crossJoin(F.broadcast(expected.select(*point))).withColumn("_want", F.lit(1))
    joined = wanted.join(counted, [source, *point], "full_outer")
    reason = "CASE WHEN n IS NULL THEN 'missing' WHEN _want IS NULL THEN 'extra' WHEN n > 1 THEN 'repeated' END"
    return joined.select(source, *point, F.expr(f"{reason} AS violation")).filter("violation IS NOT NULL")


def candidate_order(rows: DataFrame, candidates, keys) -> DataFrame:
    """Rows whose name does not belong at their position."""
    names = ", ".join(f"'{c}'" for c in candidates)
    return rows.filter(f"NOT (candidate <=> get(array({names}), cand_idx))").select(*keys, "cand_idx", "candidate")


def source_set(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Repeated, missing and unexpected keys."""
    counted = actual.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(expected.select(key).distinct().withColumn("_want", F.lit(1)), key, "full_outer")
    reason = "CASE WHEN n IS NULL THEN 'missing' WHEN _want IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' END"
    return joined.select(key, F.expr(f"{reason} AS violation")).filter("violation IS NOT NULL")


def order_mismatches(actual: DataFrame, expected: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """Positions at which two numbered lists differ."""
    left = actual.select(position, F.col(key).alias("actual"))
    right = expected.select(position, F.col(key).alias("expected"))
    return left.join(right, position, "full_outer").filter("NOT (actual <=> expected)")


def value_violations(rows: DataFrame, keys, rules: dict[str, str]) -> DataFrame:
    """Long (keys, rule) rows for every rule that does not hold; NULL does not hold."""
    broken = ", ".join(f"CASE WHEN NOT coalesce({rule}, false) THEN '{name}' END" for name, rule in rules.items())
    return rows.select(*keys, F.expr(f"explode(filter(array({broken}), x -> x IS NOT NULL)) AS rule"))


def positive_finite(value: str) -> str:
    return f"({finite_sql(value)} AND {value} > 0)"


def extra_fields(df: DataFrame, allowed) -> list[str]:
    """Field names outside the allowlist; a schema check, no job."""
    return sorted(set(df.columns) - set(allowed))


def bytes_match_rate(rows: DataFrame, keys, pixels: str, tolerance: float = 1e-9) -> DataFrame:
    """Coded bytes must give the rate on the common denominator."""
    return rows.filter(f"NOT coalesce(abs(coded_bytes*8D/({pixels}) - bpp) <= {tolerance}D, false)").select(*keys)


def outcome_consistent(rows: DataFrame, keys, classes: int) -> DataFrame:
    """Correctness must equal prediction = label, with the prediction in class range."""
    rule = f"predicted BETWEEN 0 AND {classes - 1} AND correct = (predicted = label)"
    return rows.filter(f"NOT coalesce({rule}, false)").select(*keys)


def inconsistent_streams(rows: DataFrame, stream, values) -> DataFrame:
    """Streams selected by several arms whose recorded scores differ. Distinct values are counted by
    minimum and maximum, which combine map-side."""
    differing = " OR ".join(f"NOT (min({v}) <=> max({v}))" for v in values)
    return rows.groupBy(*stream).agg(F.expr(f"{differing} AS _bad"), F.count(F.lit(1)).alias("n_arms")).filter("_bad").drop("_bad")


def choices_recompute(recorded: DataFrame, recomputed: DataFrame, columns) -> DataFrame:
    """Recorded choices that the frozen policy does not reproduce, and the reverse."""
    a, b = recorded.select(*columns), recomputed.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("recorded")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("recomputed")))


def shard_provenance(manifests: DataFrame, common, shards: int) -> DataFrame:
    """Checks over one manifest row per shard: exact shard set, equal common values, and counts."""
    rows = [("shards", f"count(*) = {shards} AND count(DISTINCT shard) = {shards} AND min(shard) = 0 AND max(shard) = {shards - 1}")]
    rows += [(f"same_{name}", f"count(DISTINCT {name}) = 1 AND count({name}) = count(*)") for name in common]
    rows += [("trials", "bool_and(coalesce(trials = streams, false))"), ("records", "bool_and(coalesce(records_sha = actual_sha, false))")]
    checked = manifests.agg(*[F.expr(f"{rule} AS c{i}") for i, (_, rule) in enumerate(rows)])
    stacked = ", ".join(f"'{name}', c{i}" for i, (name, _) in enumerate(rows))
    return checked.select(F.expr(f"stack({len(rows)}, {stacked}) AS (check, pass)"))


def leakage(rows: DataFrame, source: str, split: str) -> DataFrame:
    """Sources that occur in more than one split."""
    return rows.groupBy(source).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def outside_grid(policies: DataFrame, grid: DataFrame, parameters) -> DataFrame:
    return policies.join(grid.select(*parameters), list(parameters), "left_anti")


def artifact_differences(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """Files whose bytes differ, with and without newline normalisation; columns name, content."""
    normal = "sha2(replace(string({c}), '\\r\\n', '\\n'), 256)"
    joined = left.select(name, F.col("content").alias("_l")).join(
        right.select(name, F.col("content").alias("_r")), name, "full_outer")
    return joined.select(
        name,
        F.expr("coalesce(sha2(_l, 256) = sha2(_r, 256), false) AS same_bytes"),
        F.expr(f"coalesce({normal.format(c='_l')} = {normal.format(c='_r')}, false) AS same_text"),
    )


def single_class(rows: DataFrame, labels) -> DataFrame:
    """Labels of which only one class occurs (or none)."""
    balance = rows.agg(
        *[F.expr(f"count_if({label}) AS p_{label}") for label in labels],
        *[F.expr(f"count({label}) AS n_{label}") for label in labels],
    )
    stacked = ", ".join(f"'{label}', p_{label}, n_{label}" for label in labels)
    long = balance.select(F.expr(f"stack({len(labels)}, {stacked}) AS (label, positives, total)"))
    return long.filter("positives = 0 OR positives = total")


def metric_differences(recomputed: DataFrame, recorded: DataFrame, keys, values, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose recorded metrics or counts differ from the recomputed ones."""
    right = recorded.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    same = " AND ".join(f"(({v} <=> _{v}) OR coalesce(abs({v} - _{v}) <= {tolerance}D, false))" for v in values)
    return recomputed.join(right, list(keys), "full_outer").filter(f"NOT ({same})").select(*keys)


def unscored(choices: DataFrame, outcomes: DataFrame, keys) -> DataFrame:
    """Chosen or anchor streams without an outcome, where outcomes are scored lazily."""
    needed = choices.select(*keys, "cand_idx").unionByName(choices.select(*keys, F.lit(0).alias("cand_idx"))).distinct()
    return needed.join(outcomes.select(*keys, "cand_idx"), [*keys, "cand_idx"], "left_anti")
