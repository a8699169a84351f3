"""A caller's own aggregates (M3): functions of numpy columns whose states merge, so that no group is gathered."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATES_HELD = 20_000


@dataclass(frozen=True)
class Metric:
    """``partial`` makes a state (a vector of doubles of one length) of some rows' columns, ``merge`` joins two states
    in either order, ``finish`` makes the value of a state; None and non-finite values become NULL."""

    partial: Callable[..., np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], float | None]


def aggregate(df: DataFrame, keys: list[str], columns: list[str], metric: Metric, name: str = "value", salts: int = 32) -> DataFrame:
    """(keys, ``name``): the metric of each group, NULL keys being a group like others.

    ``columns`` reach ``partial`` as doubles in this order, NULL as NaN. Only states are shuffled: at most one per group and
    task, or a few where a task meets more than ``STATES_HELD`` groups. They are merged in two steps, the first of
    which deals a group's states to ``salts`` tasks by where they were made. An empty table gives no row."""
    keys, columns = list(keys), list(columns)
    if not keys or not columns:
        raise ValueError("keys and columns are needed")
    narrow = df.select(*keys, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    key_fields = [T.StructField(f.name, f.dataType) for f in narrow.schema[: len(keys)]]
    state_type = T.StructField("_state", T.ArrayType(T.DoubleType()))
    inputs = [f"_c{i}" for i in range(len(columns))]

    def out(first: list, key_type: pa.Schema, states: list) -> pa.RecordBatch:
        fields = [pa.array([k[i] for k in first], key_type.field(i).type) for i in range(len(keys))]
        lists = pa.array([s.tolist() for s in states], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*fields, lists], [*keys, "_state"])

    def partials(batches):
        held, kind = {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            kind = kind or table.select(keys).schema
            values = [table[c].to_numpy() for c in inputs]
            table = table.select(keys).append_column("_at", pa.array(np.arange(batch.num_rows)))
            groups = table.group_by(keys).aggregate([("_at", "list")])
            rows = zip(*[groups[k].to_pylist() for k in keys])
            for key, at in zip(rows, groups["_at_list"]):
                at = at.values.to_numpy()
                state = np.asarray(metric.partial(*[v[at] for v in values]), dtype=float)
                held[key] = metric.merge(held[key], state) if key in held else state
            if len(held) > STATES_HELD:
                yield out(list(held), kind, list(held.values()))
                held = {}
        if held:
            yield out(list(held), kind, list(held.values()))

    def merged(table: pa.Table) -> np.ndarray:
        state = None
        for item in table["_state"].to_pylist():
            item = np.array([math.nan if x is None else x for x in item])
            state = item if state is None else metric.merge(state, item)
        return state

    def merge(table: pa.Table) -> pa.Table:
        state = pa.array([np.asarray(merged(table), dtype=float).tolist()], pa.list_(pa.float64()))
        return table.slice(0, 1).select(keys).append_column("_state", state)

    def finish(table: pa.Table) -> pa.Table:
        value = metric.finish(merged(table))
        value = None if value is None or not math.isfinite(value) else float(value)
        return table.slice(0, 1).select(keys).append_column(name, pa.array([value], pa.float64()))

    with_state = T.StructType([*key_fields, state_type])
    states = narrow.mapInArrow(partials, with_state).withColumn("_salt", F.spark_partition_id() % salts)
    fewer = states.groupBy(*keys, "_salt").applyInArrow(merge, with_state)
    return fewer.groupBy(*keys).applyInArrow(finish, T.StructType([*key_fields, T.StructField(name, T.DoubleType())]))


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = x[both], y[both]
    if not len(x):
        return np.zeros(4)
    return np.array([len(x), x.mean(), y.mean(), ((x - x.mean())*(y - y.mean())).sum()])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    if n == 0:
        return a
    dx, dy = b[1] - a[1], b[2] - a[2]
    return np.array([n, a[1] + dx*b[0]/n, a[2] + dy*b[0]/n, a[3] + b[3] + dx*dy*a[0]*b[0]/n])


#: Population covariance of two columns over the rows that have both.
COVARIANCE = Metric(_moments, _joined, lambda s: s[3]/s[0] if s[0] else None)
