"""Joins with contracts (C): completeness, exclusion, overlap, tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_lookup(rows: DataFrame, labels: DataFrame, canonical: str) -> DataFrame:
    """Class label of every row by canonical name; NULL where the class is unknown.

    ``labels`` is the fixed class list of the task and is broadcast."""
    return rows.join(F.broadcast(labels), canonical, "left")


def unmapped(rows: DataFrame, labels: DataFrame, canonical: str) -> DataFrame:
    return rows.select(canonical).distinct().join(labels, canonical, "left_anti")


def one_to_one(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Full-outer audit of a strict 1:1 join: counts on both sides of every key that is not 1:1."""
    keys = list(keys)
    counted = [
        side.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)) for side, name in ((left, "n_left"), (right, "n_right"))
    ]
    joined = counted[0].join(counted[1], keys, "full_outer").na.fill(0, ["n_left", "n_right"])
    return joined.filter("n_left <> 1 OR n_right <> 1")


def frozen_outcomes(frozen: DataFrame, outcomes: DataFrame, arms, keys, fields) -> DataFrame:
    """Outcomes of several frozen arms: the arm columns are turned long and joined once."""
    stacked = ", ".join(f"'{a}', {a}" for a in arms)
    long = frozen.select(*keys, F.expr(f"stack({len(arms)}, {stacked}) AS (arm, candidate)"))
    return long.join(outcomes.select(*keys, "candidate", *fields), [*keys, "candidate"], "left")


def exclude(rows: DataFrame, exclusions, key: str) -> DataFrame:
    """Rows whose key is in none of the exclusion sets."""
    union = None
    for other in exclusions:
        keys = other.select(key)
        union = keys if union is None else union.unionByName(keys)
    return rows.join(union.distinct(), key, "left_anti")


def overlap_matrix(tagged: DataFrame, tag: str, key: str) -> DataFrame:
    """Number of keys shared by every two tags. A key keeps the set of its tags, whose size is
    bounded by the number of sets compared, never by the data."""
    tags = tagged.groupBy(key).agg(F.expr(f"sort_array(collect_set({tag})) AS _tags")).filter("size(_tags) > 1")
    pairs = """inline(flatten(transform(_tags, x -> transform(filter(_tags, y -> y > x),
        y -> named_struct('left_set', x, 'right_set', y)))))"""
    return tags.select(F.expr(pairs)).groupBy("left_set", "right_set").agg(F.count(F.lit(1)).alias("n"))


def locate(wanted: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Status of every wanted or found key: ok, missing, ambiguous, unexpected, wrong class or
    changed hash. ``wanted`` has class and sha columns; files are counted per key first."""
    found = files.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_files"), F.min("class").alias("found_class"), F.min("sha").alias("found_sha")
    )
    joined = wanted.withColumn("_wanted", F.lit(True)).join(found, key, "full_outer")
    status = """CASE WHEN _wanted IS NULL THEN 'unexpected' WHEN n_files IS NULL THEN 'missing'
        WHEN n_files > 1 THEN 'ambiguous' WHEN NOT (class <=> found_class) THEN 'wrong_class'
        WHEN NOT (sha <=> found_sha) THEN 'hash_changed' ELSE 'ok' END AS status"""
    return joined.select(key, F.expr("coalesce(n_files, 0) AS n_files"), F.expr(status))


def span_mismatches(locked: DataFrame, annotation: DataFrame, key: str) -> DataFrame:
    """Locked rows whose annotation is absent, or differs in time span or content hash."""
    other = annotation.select(
        key, F.col("t_start").alias("_s"), F.col("t_end").alias("_e"), F.col("sha").alias("_h"), F.lit(True).alias("_f")
    )
    reason = """CASE WHEN _f IS NULL THEN 'no_annotation' WHEN NOT (t_start <=> _s AND t_end <=> _e) THEN 'span'
        WHEN NOT (sha <=> _h) THEN 'hash' END AS reason"""
    return locked.join(other, key, "left").select(key, F.expr(reason)).filter("reason IS NOT NULL")


def tolerance_violations(primary: DataFrame, rescored: DataFrame, keys, value: str, name: str, tolerance: float) -> DataFrame:
    """Keys missing on either side, or whose stream name or value differs beyond the tolerance."""
    right = rescored.select(*keys, F.col(name).alias("_name"), F.col(value).alias("_value"), F.lit(1).alias("_r"))
    joined = primary.select(*keys, name, value, F.lit(1).alias("_l")).join(right, list(keys), "full_outer")
    reason = f"""CASE WHEN _l IS NULL THEN 'extra' WHEN _r IS NULL THEN 'missing' WHEN NOT ({name} <=> _name) THEN 'stream'
        WHEN NOT coalesce(abs({value} - _value) <= {tolerance}D, false) THEN 'value' END AS reason"""
    return joined.select(*keys, F.expr(reason)).filter("reason IS NOT NULL")
