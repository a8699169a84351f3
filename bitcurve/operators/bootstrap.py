"""Paired source bootstrap (E).

Sources are first reduced to one wide row each: for every arm and qp the values whose mean makes
the curve. All arms, qps and analyzers of a source stay together, so every comparison of a report
shares the same resamples. A draw is then a weighted sum over the wide rows:

* ``multinomial``: slot j of draw b picks the source at position md5(seed|b|j) mod n. Exactly n
  picks per draw, reproducible anywhere.
* ``poisson``: every source gets an independent Poisson(1) count per draw from a hash. No exchange
  but the final one of draws; meant for very many sources.

No row exists per pick: positions are cut into blocks of ``BLOCK``, tasks hash a run of slots of one draw and send
each block how often its positions were picked, and a block multiplies the counts of all draws with its
values. What travels is below a byte per source and draw, and then one row per draw and block. A task holds at most
``SLOTS`` picks, or one block with ``DRAWS`` draws.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from bitcurve.functions import bd, digests
from bitcurve.functions.hashing import md5_wide
from bitcurve.operators.ranking import dense_index
from bitcurve.session import cut_lineage, parallelism

BLOCK = 1 << 14  # positions whose values are multiplied at once
DRAWS = 1 << 12  # draws that meet a block at once
SLOTS = 1 << 22  # picks that a task holds at once
DIGITS = 10_000  # slots hashed at once: all that share the digits before their last four
HASHES = 30_000_000  # a task's share of them


def source_values(rows: DataFrame, values, qps, source: str = "source_id", keys=()) -> DataFrame:
    """One row per source: ``n_<qp>`` and ``<value>_<qp>`` for every value and qp."""
    aggregates = [F.expr(f"count_if(qp = {q}) AS n_{q}") for q in qps]
    aggregates += [
        F.expr(f"coalesce(sum(CASE WHEN qp = {q} THEN double({v}) END), 0D) AS {v}_{q}") for v in values for q in qps
    ]
    return rows.groupBy(source, *keys).agg(*aggregates)


def _picked(seed: str, draw: int, first: int, last: int, n: int) -> np.ndarray:
    """Positions that the slots ``first`` to ``last - 1`` of a draw pick."""
    found, start = [], first
    while start < last:
        if start < DIGITS:  # slots of one number of digits, without zeros in front
            width = len(str(start))
            end, head = min(10**width, last), b""
        else:
            width, head = 4, b"%d" % (start // DIGITS)
            end = min((start // DIGITS + 1) * DIGITS, last)
        hashed = digests.md5_wide(f"{seed}|{draw}|".encode() + head, _tails(width, bool(head)))
        offset = start % DIGITS - (10 ** (width - 1) if not head and width > 1 else 0)
        found.append(hashed[offset : offset + end - start] % n)
        start = end
    return np.concatenate(found)


_digit_tails: dict[object, digests.Tails] = {}


def _tails(width: int, padded: bool) -> digests.Tails:
    """Decimal numbers of ``width`` digits; ``padded``: all of them, with zeros in front."""
    if (width, padded) not in _digit_tails:
        least = 0 if padded or width == 1 else 10 ** (width - 1)
        text = b"".join(b"%0*d" % (width, i) for i in range(least, 10**width))
        _digit_tails[width, padded] = digests.Tails(np.frombuffer(text, np.uint8).reshape(-1, width))
    return _digit_tails[width, padded]


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes(), 1)


def _unpack(packed: bytes, size: int) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, np.uint8 if len(raw) == size else np.uint32)


def _counts_of(seed: str, n: int, chunks: int):
    """Of every (draw, chunk of slots) how often the positions of each block were picked."""

    def run(batches):
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                draw, chunk = divmod(unit, chunks)
                picked = _picked(seed, draw, chunk * SLOTS, min((chunk + 1) * SLOTS, n), n)
                for start in range(0, n, SLOTS):
                    size = min(SLOTS, n - start)
                    here = picked[(picked >= start) & (picked < start + size)] if n > SLOTS else picked
                    counts = np.bincount(here - start, minlength=size)
                    blocks = range(0, size, BLOCK)
                    packed = [_pack(counts[b : b + BLOCK]) for b in blocks]
                    yield pa.record_batch(
                        [pa.array([draw] * len(packed), pa.int32()), pa.array([(start + b) // BLOCK for b in blocks], pa.int64()),
                         pa.array(packed, pa.binary())], ["draw", "block", "counts"])

    return run


def _values(table, columns) -> np.ndarray:
    return np.column_stack([
        table.column(c).cast(pa.float64()).fill_null(0.0).to_numpy().astype(np.float64, copy=False) for c in columns
    ]) if table.num_rows else np.zeros((0, len(columns)))


def _weighted(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values by the counts of every draw; a value that is not finite spoils only draws that hold it."""
    odd = np.flatnonzero(~np.isfinite(values).all(axis=1))
    sums = counts @ np.where(np.isfinite(values), values, 0.0)
    for i in odd:
        sums[counts[:, i] > 0] += np.where(np.isfinite(values[i]), 0.0, values[i])
    return sums


def _by_key(table, keys):
    """(key values, row numbers) of every key of a table."""
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*[table.column(k).to_pylist() for k in keys], strict=True)):
        groups.setdefault(key, []).append(i)
    return groups if keys else {(): range(table.num_rows)}


def _sum_rows(draws: np.ndarray, key: tuple, sums: np.ndarray, hit: np.ndarray, schema) -> pa.RecordBatch:
    """Rows (draw, keys, sums) of the draws that hold the key at all."""
    draws, sums = draws[hit], sums[hit]
    arrays = [pa.array(draws, pa.int32())]
    arrays += [pa.array([k] * len(draws), schema.field(1 + i).type) for i, k in enumerate(key)]
    arrays += [pa.array(np.ascontiguousarray(sums[:, i])) for i in range(sums.shape[1])]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _block_sums(columns, keys, schema, step: int = 128):
    """Sums of one block: the counts of its positions times the values there."""

    def run(values, counted):
        found = []
        groups = _by_key(values, keys)
        matrix, at = _values(values, columns), values.column("_at").to_numpy()
        for start in range(0, counted.num_rows if values.num_rows else 0, step):
            part = counted.slice(start, step)
            rows = [np.zeros(0)] * part.num_rows
            for i, packed in enumerate(part.column("counts").to_pylist()):
                raw = _unpack(packed, int(part.column("size")[i].as_py()))
                rows[i] = raw.astype(np.float64)
            counts, draws = np.stack(rows), part.column("draw").to_numpy()
            for key, where in groups.items():
                mine = counts[:, at[where]]
                found.append(_sum_rows(draws, key, _weighted(mine, matrix[where]), mine.any(axis=1), schema))
        return pa.Table.from_batches(found, schema)

    return run


def _poisson_sums(columns, keys, schema, source: str, draws: int, seed: str, cumulative):
    """Sums of a task's rows by their Poisson counts."""

    def run(batches):
        found: dict[tuple, list[np.ndarray]] = {}
        steps = np.array(cumulative)
        for batch in batches:
            for start in range(0, batch.num_rows, DIGITS):
                part = pa.Table.from_batches([batch.slice(start, DIGITS)])
                matrix = _values(part, columns)
                groups = {k: np.array(v) for k, v in _by_key(part, keys).items()}
                tails = digests.tails_of([x.encode() for x in part.column(source).to_pylist()])
                for first in range(0, draws, 128):
                    last = min(first + 128, draws)
                    counts = np.empty((last - first, part.num_rows))
                    for at, texts in tails:
                        for draw in range(first, last):
                            u = digests.md5_wide(f"{seed}|{draw}|".encode(), texts) / 1152921504606846976.0
                            counts[draw - first, at] = np.searchsorted(steps, u, side="right")
                    for key, where in groups.items():
                        sums, hit = found.setdefault(key, [np.zeros((draws, len(columns))), np.zeros(draws, bool)])
                        mine = counts[:, where]
                        sums[first:last] += _weighted(mine, matrix[where])
                        hit[first:last] |= mine.any(axis=1)
        for key, (sums, hit) in found.items():
            yield _sum_rows(np.arange(draws), key, sums, hit, schema)

    return run


def draw_sums(
    wide: DataFrame, columns, draws: int, seed: str, method: str = "multinomial", source: str = "source_id", keys=()
) -> DataFrame:
    """Sum of every column over the resampled sources, per draw (0-based) and ``keys``.

    ``keys`` are columns of ``wide`` (one row per source and key, few keys); a source is drawn as a whole,
    for all keys alike."""
    keys, columns = list(keys), list(columns)
    kinds = dict(wide.dtypes)
    kind = ", ".join(["draw int"] + [f"`{k}` {kinds[k]}" for k in keys] + [f"`{c}` double" for c in columns])
    schema = to_arrow_schema(wide.select(F.lit(0).alias("draw"), *keys, *[F.lit(0.0).alias(c) for c in columns]).schema)
    values = [*keys, *[F.col(c).cast("double").alias(c) for c in columns]]
    if method == "poisson":
        # Cumulative Poisson(1) probabilities; the tail beyond the table is below 1e-12.
        cumulative, term, total = [], math.exp(-1), 0.0
        for k in range(16):
            term = term if k == 0 else term / k
            total += term
            cumulative.append(total)
        rows = wide.filter(F.col(source).isNotNull()).select(F.col(source).cast("string").alias("_source"), *values)
        # A task's work is its rows times the draws: spread evenly, whatever the size of the rows.
        rows = rows.repartition(parallelism(wide.sparkSession))
        sums = rows.mapInArrow(_poisson_sums(columns, keys, schema, "_source", draws, seed, cumulative), kind)
    elif method == "multinomial":
        # The wide table is small next to the facts; it is written once and then read for the
        # positions and the values.
        fixed = cut_lineage(wide)
        sources = fixed.select(source).distinct() if keys else fixed.select(source)
        positions = cut_lineage(dense_index(sources, source))
        n = positions.count()
        counts = block_counts(wide.sparkSession, n, draws, seed).withColumn("_part", F.expr(f"int(draw DIV {DRAWS})"))
        placed = fixed.join(positions.hint("merge"), source).select(
            F.expr(f"pos DIV {BLOCK} AS block"), F.expr(f"int(pos % {BLOCK}) AS _at"), *values)
        placed = placed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAWS))))
        sums = placed.groupBy("block", "_part").cogroup(counts.groupBy("block", "_part")).applyInArrow(
            _block_sums(columns, keys, schema), kind)
    else:
        raise ValueError(f"unknown bootstrap method: {method}")
    return sums.groupBy("draw", *keys).agg(*[F.sum(c).alias(c) for c in columns])


def block_counts(spark, n: int, draws: int, seed: str) -> DataFrame:
    """(draw, block, counts, size): how often every position of a block was picked, packed; some rows for one
    draw and block if there are very many slots."""
    chunks = -(-n // SLOTS)
    tasks = min(draws * chunks, max(parallelism(spark), -(-draws * n // HASHES)))
    units = spark.range(0, draws * chunks, 1, max(tasks, 1))
    counts = units.mapInArrow(_counts_of(seed, n, chunks), "draw int, block long, counts binary")
    return counts.withColumn("size", F.expr(f"int(least({BLOCK}, {n} - block*{BLOCK}))"))


def multinomial_picks(sources: DataFrame, source: str, draws: int, seed: str):
    """(source positions, one (draw, pos) row per pick) of the multinomial bootstrap."""
    positions = cut_lineage(dense_index(sources, source))
    n = max(positions.count(), 1)
    # A cross join, not an explode: Spark then knows that the picks are many, and broadcasts none of them.
    every = sources.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))
    slots = positions.select(F.col("pos").alias("slot")).repartition(parallelism(sources.sparkSession), "slot")
    slots = slots.crossJoin(F.broadcast(every))
    pick = md5_wide(f"concat('{seed}|', draw, '|', slot)")
    # coalesce: the hash is never NULL, and saying so keeps the join from evaluating it twice.
    return positions, slots.select("draw", F.expr(f"coalesce({pick} % {n}L, 0L) AS pos"))


def image_weights(sources: DataFrame, draws: int, seed: str, source: str = "image_id") -> DataFrame:
    """(draw, source, w): how often each source occurs in each draw."""
    positions, picks = multinomial_picks(sources, source, draws, seed)
    weights = picks.groupBy("draw", "pos").agg(F.count(F.lit(1)).alias("w"))
    return weights.join(positions, "pos").select("draw", source, "w")


def wide_columns(values, qps):
    return [f"n_{q}" for q in qps] + [f"{v}_{q}" for v in values for q in qps]


def curve_sql(rate: str, quality: str, qps) -> str:
    """Points of one arm from summed columns, as SQL; qps without rows are left out."""
    points = ", ".join(
        f"named_struct('qp', {q}, 'n', n_{q}, 'rate', {rate}_{q}/nullif(n_{q}, 0), 'quality', {quality}_{q}/nullif(n_{q}, 0))"
        for q in qps
    )
    return f"filter(array({points}), z -> z.n > 0)"


def draw_deltas(sums: DataFrame, comparisons, qps, keys=(), min_points: int = 0) -> DataFrame:
    """BD-rate and BD-accuracy of every comparison in every draw.

    ``comparisons`` is a list of (name, model, anchor rate, anchor quality, test rate, test
    quality) giving value columns."""
    parts = ", ".join(
        f"named_struct('comparison', '{name}', 'model', '{model}', 'anchor_points', {curve_sql(ar, aq, qps)},"
        f" 'points', {curve_sql(tr, tq, qps)})"
        for name, model, ar, aq, tr, tq in comparisons
    )
    rows = sums.select("draw", *keys, F.expr(f"inline(array({parts}))"))
    enough = f"size(anchor_points) >= {min_points}"
    return rows.select(
        "draw",
        *keys,
        "comparison",
        "model",
        F.when(F.expr(enough), bd.bd_rate("anchor_points", "points")).alias("bd_rate"),
        F.when(F.expr(enough), 100 * bd.bd_metric("anchor_points", "points")).alias("bd_accuracy_pp"),
    )


def intervals(deltas: DataFrame, draws: int, method: str, keys=("comparison", "model")) -> DataFrame:
    """Percentile interval of every metric over its defined draws."""
    metrics = "stack(2, 'bd_rate', bd_rate, 'bd_accuracy_pp', bd_accuracy_pp) AS (metric, value)"
    long = deltas.select(*keys, F.expr(metrics))
    summary = long.groupBy(*keys, "metric").agg(
        F.count("value").alias("valid_draws"),
        F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("_p"),
        F.avg("value").alias("mean"),
        F.avg(F.expr("double(value < 0)")).alias("p_lt_zero"),
    )
    return summary.select(
        *keys,
        "metric",
        F.expr("_p[0] AS lo"),
        F.expr("_p[1] AS median"),
        F.expr("_p[2] AS hi"),
        "mean",
        "p_lt_zero",
        "valid_draws",
        F.lit(draws).alias("requested_draws"),
        F.lit(method).alias("method"),
    )


def ci_valid(least: float = 0.95) -> str:
    """A usable interval: enough defined draws, no more than requested, finite ends in order."""
    return (
        f"coalesce(valid_draws BETWEEN {least}D*requested_draws AND requested_draws AND lo <= hi"
        f" AND {bd.finite_sql('lo')} AND {bd.finite_sql('hi')}, false)"
    )


def require_valid(summary: DataFrame, least: float = 0.95) -> DataFrame:
    """Raise an error where fewer than the given share of draws is defined."""
    message = "raise_error(concat('too few defined draws: ', valid_draws))"
    return summary.withColumn(
        "valid_draws",
        F.expr(f"CASE WHEN valid_draws >= {least}D*requested_draws THEN valid_draws ELSE bigint({message}) END"),
    )


def mean_interval(wide: DataFrame, value: str, draws: int, seed: str, method: str = "multinomial") -> DataFrame:
    """Bootstrap of a paired mean: one value per source."""
    rows = wide.select("source_id", F.col(value).alias("v"), F.expr(f"int({value} IS NOT NULL) AS n"))
    per_draw = draw_sums(rows, ["v", "n"], draws, seed, method).selectExpr("draw", "v/nullif(n, 0) AS mean")
    return per_draw.agg(
        F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("_p"), F.count("mean").alias("valid_draws")
    ).select(F.expr("_p[0] AS lo"), F.expr("_p[1] AS hi"), "valid_draws", F.lit(draws).alias("requested_draws"))
