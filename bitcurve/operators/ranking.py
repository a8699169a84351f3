"""Deterministic hash ranks, balanced picks, capped prefixes and splits (F).

A rank inside a group is never computed by sorting the whole group in one task. Rows are spread
over buckets taken from the leading digits of their hash, which are uniform and agree with the
hash order; each bucket is ranked on its own and shifted by the counts of the buckets before it.
A class holding a third of all rows is therefore sorted by as many tasks as there are buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitcurve.functions.hashing import md5_int, salted_sha
from bitcurve.session import cut_lineage, within_broadcast_bound, written

REACH_DIGITS = 3  # hex digits of a bucket in a search for the cap: 4,096 sums per class
BROADCAST_CLASSES = 500_000  # classes whose last bucket is sent to all tasks; beyond, Spark joins them
BUCKET_ROWS = 50_000  # rows that a bucket of a rank should hold; the number of buckets follows the table


def group_rank(df: DataFrame, group, digest: str, tie, name: str = "rank") -> DataFrame:
    """1-based position by (digest, tie) within ``group`` columns; ``digest`` is a hex column.

    ``df`` is read three times (rows, bucket counts and ranks), so pass a table or a cheap projection."""
    hex_digits = 2
    rows = df.count()
    while rows > BUCKET_ROWS * 16**hex_digits:
        hex_digits += 1
    bucketed = df.withColumn("_bucket", F.substring(digest, 1, hex_digits))
    local = Window.partitionBy(*group, "_bucket").orderBy(digest, *tie)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # A NULL group is a group of its own, so the join compares NULL-safely.
    keys = [*group, "_bucket"]
    right = offsets.select([F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)] + ["_offset"])
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    ranked = bucketed.withColumn("_local", F.row_number().over(local)).join(right, condition)
    return ranked.withColumn(name, (F.col("_local") + F.col("_offset")).cast("long")).select(*df.columns, name)


def dense_index(df: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """0-based dense position by md5 of the key."""
    hashed = df.withColumn("_digest", F.expr(f"md5(string({key}))"))
    ranked = group_rank(hashed, [], "_digest", [key], name)
    return ranked.withColumn(name, F.col(name) - 1).drop("_digest")


def hash_top(df: DataFrame, salt: str, key: str, n: int, separator: str = "char(0)") -> DataFrame:
    """The ``n`` rows of smallest (sha256(salt, key), key). The limit is the operator: each task
    keeps its own ``n`` best before they are merged."""
    ranked = df.withColumn("digest", F.expr(salted_sha(salt, key, separator)))
    return ranked.orderBy("digest", key).limit(n)


def hash_rank(df: DataFrame, salt: str, key: str, group=(), name: str = "rank", separator: str = "char(0)") -> DataFrame:
    """Position of every row by salted hash, within ``group``."""
    hashed = df.withColumn("_digest", F.expr(salted_sha(salt, key, separator)))
    return group_rank(hashed, list(group), "_digest", [key], name).drop("_digest")


def balanced_pick(df: DataFrame, salt: str, key: str, label: str, n: int) -> DataFrame:
    """Class-balanced selection: hash rank inside the class, then round-robin over the classes in
    hash order until ``n`` rows are taken. ``pick`` is the 1-based position."""
    # A row deeper than ``n`` in its class is never picked; Spark applies such a limit in every task before
    # rows travel, so a class of any size sends no more than ``n`` rows per task.
    hashed = df.withColumn("_digest", F.expr(salted_sha(salt, key)))
    depth = F.row_number().over(Window.partitionBy(label).orderBy("_digest", key))
    ranked = hashed.withColumn("depth", depth).filter(F.col("depth") <= n).withColumn("depth", F.col("depth").cast("long")).drop("_digest")
    digest = F.expr(f"sha2(concat('{salt}', char(0), 'class', char(0), string({label})), 256)")
    ordered = ranked.withColumn("_class", digest).orderBy("depth", "_class", label).limit(n)
    # ``ordered`` has at most n rows: the requested size of the pick, not a share of the data.
    position = F.row_number().over(Window.orderBy("depth", "_class", label)).cast("long")
    return ordered.withColumn("pick", position).drop("_class")


def group_prefix_sums(df: DataFrame, group, order, sums: dict[str, str], totals_of=()) -> DataFrame:
    """Running sums over a unique order within groups of any size; for the names in ``totals_of``
    also the group's total, as ``<name>_total``.

    Rows are range-partitioned by (group, order) and written once as a table, so that both passes see
    the same partitions and read no more columns than they need; every partition's piece of a group is
    summed on its own and shifted by the totals of the pieces before it. A group holding most of the rows
    is spread over many tasks. A NULL group is a group of its own. Pass only the columns that are wanted:
    all of them are sorted."""
    group, order = list(group), list(order)
    spread = df.repartitionByRange(*group, *order)
    fixed = written(spread.withColumn("_part", F.spark_partition_id()), "prefix-sums")
    totals = fixed.groupBy("_part", *group).agg(*[F.expr(f"sum({v}) AS _total_{n}") for n, v in sums.items()])
    # One row per partition and group met in it.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        *group,
        *[F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_offset_{n}") for n in sums],
        *[F.sum(f"_total_{n}").over(Window.partitionBy(*group)).alias(f"{n}_total") for n in totals_of],
    )
    local = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = fixed.select("*", *[F.sum(F.expr(v)).over(local).alias(n) for n, v in sums.items()])
    keys = ["_part", *group]
    right = offsets.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    joined = summed.join(right, condition).drop(*[f"_r{i}" for i in range(len(keys))])
    shifted = joined.withColumns({n: F.col(n) + F.col(f"_offset_{n}") for n in sums})
    return shifted.drop("_part", *[f"_offset_{n}" for n in sums])


def prefix_sum(df: DataFrame, order, value: str, name: str = "running") -> DataFrame:
    """Running sum of ``value`` over a global order that is unique."""
    return group_prefix_sums(df, [], order, {name: value})


def prefix_within_cap(df: DataFrame, order, size: str, cap: int) -> DataFrame:
    """The longest prefix of the order whose running size stays within ``cap``; everything from
    the first row that breaks it is dropped, except that the first row is always kept."""
    usable = df.filter(F.col(size) > 0)
    summed = prefix_sum(usable, order, size, "running_bytes")
    return summed.filter((F.col("running_bytes") <= cap) | (F.col("running_bytes") == F.col(size)))


def within_reach(df: DataFrame, salt: str, key: str, group, weight: str, cap: int) -> DataFrame:
    """The rows that a round-robin over ``group`` in salted hash order can meet before the sum of the positive
    ``weight`` exceeds ``cap``, and at most the rest of one hash bucket per class beyond them.

    Counts and sums per class and bucket combine map-side. Once the buckets that end by depth d hold more than
    the cap, the walk has stopped by d, and a bucket that begins beyond d is never entered: its rows are
    dropped in the scan. Whole buckets stay, so hash ranks within the rows kept are those of the table. ``df`` is
    read twice, so pass a table or a cheap projection."""
    group = list(group)
    bucketed = df.withColumn("_bucket", F.expr(f"substring({salted_sha(salt, key)}, 1, {REACH_DIGITS})"))
    positive = F.expr(f"coalesce(sum(CASE WHEN {weight} > 0 THEN {weight} END), 0)")
    sums = bucketed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"), positive.alias("_weight"))
    along = Window.partitionBy(*group).orderBy("_bucket")
    reach = written(sums.withColumn("_end", F.sum("_n").over(along)), "reach")
    # Depths rounded up to seven binary digits: some thousands of sums for any table, and still no depth too low.
    digits = reach.withColumn("_low", F.expr("greatest(0, int(floor(log2(_end))) - 6)"))
    rounded = F.expr("shiftleft(shiftright(_end + shiftleft(1L, _low) - 1, _low), _low)")
    by_depth = digits.groupBy(rounded.alias("_depth")).agg(F.sum("_weight").alias("_w"))
    walked = by_depth.withColumn("_sum", F.sum("_w").over(Window.orderBy("_depth")))
    depth = walked.filter(F.col("_sum") > cap).agg(F.min("_depth").alias("_depth")).first()["_depth"]
    if depth is None:  # all of it is within the cap
        return df
    last = reach.filter(F.col("_end") - F.col("_n") < depth).groupBy(*group).agg(F.max("_bucket").alias("_last"))
    last = last.withColumnsRenamed({g: f"_r{i}" for i, g in enumerate(group)})
    condition = F.col("_bucket") <= F.col("_last")
    for i, g in enumerate(group):
        condition = condition & F.col(g).eqNullSafe(F.col(f"_r{i}"))
    right = F.broadcast(last) if within_broadcast_bound(last, BROADCAST_CLASSES) else last
    return bucketed.join(right, condition).select(*df.columns)


def capped_round_robin(df: DataFrame, salt: str, key: str, label: str, size: str, cap: int) -> DataFrame:
    """Round-robin over the classes in name order, stopping at the first file that breaks the cap.
    Empty files take their turn in the class but are never selected."""
    near = written(within_reach(df, salt, key, [label], size, cap), "reach")
    return prefix_within_cap(hash_rank(near, salt, key, [label], "depth"), ["depth", label], size, cap)


def capped_prefix(df: DataFrame, salt: str, key: str, size: str, cap: int) -> DataFrame:
    """Hash order over all rows (``rank``), stopping at the first file that breaks the cap."""
    near = written(within_reach(df, salt, key, [], size, cap), "reach")
    return prefix_within_cap(hash_rank(near, salt, key), ["rank"], size, cap)


def fraction_split(df: DataFrame, salt: str, key: str, test: float, validation: float) -> DataFrame:
    """Test, validation and train by hash order with floor counts (at least one where possible)."""
    ranked = hash_rank(df, salt, key, name="rank")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    counts = total.select(
        F.expr(f"CASE WHEN _n > 2 THEN greatest(1, int(floor(_n*{test}D))) ELSE 0 END AS _n_test"), "_n"
    ).select(
        "_n_test",
        F.expr(f"CASE WHEN _n - _n_test > 1 THEN greatest(1, int(floor(_n*{validation}D))) ELSE 0 END AS _n_val"),
    )
    split = "CASE WHEN rank <= _n_test THEN 'test' WHEN rank <= _n_test + _n_val THEN 'val' ELSE 'train' END AS split"
    return ranked.crossJoin(F.broadcast(counts)).select(*df.columns, "rank", F.expr(split))


def hash_split(df: DataFrame, key: str) -> DataFrame:
    """md5 bucket of ten: 0 is test, 1 validation, the rest train."""
    bucket = f"{md5_int(key)} % 10"
    return df.withColumn("split", F.expr(f"CASE {bucket} WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"))


def hash_shard(df: DataFrame, salt: str, key: str, shards: int) -> DataFrame:
    """Salted shard number, independent of ``hash_split`` on the same key."""
    return df.withColumn("shard", F.expr(f"int({md5_int(f'''concat('{salt}:', {key})''')} % {shards})"))


def position_shard(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Stride sharding by position in key order."""
    numbered = prefix_sum(df.withColumn("_one", F.lit(1)), [key], "_one", "_pos").drop("_one")
    return numbered.withColumn("shard", ((F.col("_pos") - 1) % shards).cast("int")).drop("_pos")


def first_per_source(df: DataFrame, source: str, order) -> DataFrame:
    """One row per source, the first in ``order``. An aggregate, so repeated sources of any number
    combine before the exchange."""
    rest = [c for c in df.columns if c != source]
    columns = ", ".join(rest)
    picked = df.groupBy(source).agg(F.expr(f"min_by(struct({columns}), struct({', '.join(order)})) AS _row"))
    return picked.select(source, *[F.col(f"_row.{c}").alias(c) for c in rest])


def staged_plan(clips: DataFrame, sizes: dict[str, int], salts: dict[str, str]) -> DataFrame:
    """Disjoint fit, calibration and dev sources: one clip per source, sources seen in validation
    or test excluded from training, fit and calibration picked from train one after the other and
    dev from validation. ``clips`` has split, source_id, clip, label and a unique ``position``.
    Raises an error if a stage comes out short."""
    excluded = clips.filter("split IN ('val', 'test')").select("source_id").distinct()
    train = clips.filter("split = 'train'").join(excluded, "source_id", "left_anti")
    pool = cut_lineage(first_per_source(train, "source_id", ["position"]))
    fit = balanced_pick(pool, salts["fit"], "clip", "label", sizes["fit"])
    # The picked stages are as large as asked for; both sides of the join are distributed.
    fit = cut_lineage(fit)
    rest = pool.join(fit.select("source_id"), "source_id", "left_anti")
    calibration = balanced_pick(rest, salts["calibration"], "clip", "label", sizes["calibration"])
    dev_pool = first_per_source(clips.filter("split = 'val'"), "source_id", ["position"])
    dev = balanced_pick(dev_pool, salts["dev"], "clip", "label", sizes["dev"])
    stages = {"fit": fit, "calibration": calibration, "dev": dev}
    plan = None
    for stage, rows in stages.items():
        named = rows.select(F.lit(stage).alias("stage"), "source_id", "clip", "label", "pick")
        plan = named if plan is None else plan.unionByName(named)
    short = plan.groupBy("stage").count().withColumn(
        "want", F.expr("CASE stage " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in sizes.items()) + " END")
    )
    found = {row["stage"]: row["count"] for row in short.collect()}  # at most three rows
    missing = {s: n for s, n in sizes.items() if found.get(s, 0) != n}
    if missing:
        raise ValueError(f"not enough disjoint sources for {sorted(missing)}")
    return plan


def first_valid(ranked: DataFrame, n: int) -> DataFrame:
    """First ``n`` valid rows along ``rank`` and the failures met before the last of them.

    ``ranked`` has a unique rank, a key and a status ('ok' or the reason of failure)."""
    flagged = ranked.withColumn("_ok", F.expr("int(status = 'ok')"))
    counted = prefix_sum(flagged, ["rank"], "_ok", "n_valid")
    return counted.filter((F.col("n_valid") < n) | ((F.col("n_valid") == n) & (F.col("_ok") == 1))).drop("_ok")


def first_valid_hashed(df: DataFrame, salt: str, key: str, n: int) -> DataFrame:
    """``first_valid`` along the salted hash order of a table with ``status``: only rows near the n-th valid one
    are ranked."""
    flagged = df.withColumn("_valid", F.expr("int(status = 'ok')"))
    near = written(within_reach(flagged, salt, key, [], "_valid", n - 1).drop("_valid"), "reach")
    return first_valid(hash_rank(near, salt, key), n)


def prefix_violations(ranked: DataFrame, selected: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """Keys by which a selection differs from "the rank prefix minus the failures"."""
    last = selected.select(key).join(ranked, key).agg(F.max("rank").alias("_last"))
    prefix = ranked.crossJoin(F.broadcast(last)).filter("rank <= _last").select(key)
    expected = prefix.join(failures.select(key), key, "left_anti")
    actual = selected.select(key)
    return expected.exceptAll(actual).withColumn("violation", F.lit("omitted")).unionByName(
        actual.exceptAll(expected).withColumn("violation", F.lit("unexpected"))
    )


def group_holdout(df: DataFrame, salt: str, source: str) -> DataFrame:
    """Every row's source-level part: a fifth for calibration, a tenth for early stop, rest fit."""
    sources = df.select(source).distinct()
    ranked = hash_rank(sources, salt, source)
    total = df.agg(F.count_distinct(source).alias("_n"))
    part = """CASE WHEN rank <= greatest(1, _n div 5) THEN 'calibration'
        WHEN rank <= greatest(1, _n div 5) + greatest(1, _n div 10) THEN 'stop' ELSE 'fit' END AS part"""
    parts = ranked.crossJoin(F.broadcast(total)).select(source, F.expr(part))
    return df.join(parts, source)


def balanced_order(df: DataFrame, salt: str, key: str) -> DataFrame:
    """Which of two arms runs first: the parity of the whole sha256, i.e. of its last digit."""
    digit = f"conv(right({salted_sha(salt, key)}, 1), 16, 10)"
    return df.withColumn("first_arm", F.expr(f"int(CAST({digit} AS BIGINT) % 2)"))
