"""Average precision of many resamples along one order of the detections.

Detections are ordered once per category by score, those of all configurations in one order; a draw of a bootstrap changes only
how often an image counts, never the order. So each detection carries the weights of its image in all draws, once, whatever
the number of configurations that have it, and all counters (seen, right and ignored detections per configuration, threshold and
draw) run along that one order: no row exists per draw and detection. The order is range-partitioned and checkpointed, packed:
some thousand detections a row, masks and weights compressed. A first pass adds up each partition's counters per group
(configuration and category), a second one starts from the sums of the partitions before it and keeps, per draw, threshold and
hundredth of recall, the highest precision; partitions' maxima meet by group and draw.

Both passes take ``CHUNK`` detections as one matrix product. The second looks into a chunk only where its sums say that a
precision above the highest so far, or another hundredth of recall, may lie in it.

The sums of the partitions go through the driver: (partitions x groups) vectors. Draws are taken in blocks so that these hold at
most OFFSET_BYTES and a task's maxima at most TOP_BYTES, whatever the number of draws."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitcurve.operators.bootstrap import BLOCK, _unpack, block_counts
from bitcurve.operators.matching import ENTRY
from bitcurve.operators.ranking import dense_index
from bitcurve.session import cut_lineage, parallelism

LEVELS = 10  # IoU thresholds
STEPS = 101  # recall 0, .01, ... 1
OFFSET_BYTES = 64 << 20
TOP_BYTES = 256 << 20
ROWS = 2048  # detections whose counters are in memory at once
CHUNK = 64  # detections whose counters are added up at once
GROUPS = 16  # groups whose counters are in memory at once
LOOKED = 1 << 13  # chunks looked into at once

GRID = np.arange(STEPS) * 0.01


def _nibbles(counts: np.ndarray) -> list[bytes]:
    """Weights of one image a row, half a byte each; if one of them exceeds 15, little-endian 16-bit numbers."""
    draws = counts.shape[1]
    even = counts if draws % 2 == 0 else np.column_stack([counts, np.zeros(len(counts), counts.dtype)])
    half = (even[:, ::2] | even[:, 1::2] << 4).astype(np.uint8)
    wide = counts.max(1, initial=0) > 15
    return [(c.astype("<u2") if big else h).tobytes() for c, h, big in zip(counts, half, wide)]


def image_draws(weights: DataFrame, draws: int) -> DataFrame:
    """(image_id, w): the weights (draw, image_id, w) of an image, half a byte per draw; if one of them exceeds 15,
    little-endian 16-bit numbers."""

    def run(batches):
        for batch in batches:
            rows = batch.column(1)
            size = np.diff(rows.offsets.to_numpy())
            out = np.zeros((batch.num_rows, draws), "<u2")
            entries = rows.flatten()
            out[np.repeat(np.arange(batch.num_rows), size), entries.field("draw").to_numpy()] = entries.field("w").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_nibbles(out), pa.binary())], ["image_id", "w"])

    # One entry per draw at most: a group of bounded size.
    entry = F.struct(F.col("draw").cast("int").alias("draw"), F.col("w").cast("int").alias("w"))
    grouped = weights.groupBy("image_id").agg(F.collect_list(entry).alias("entries"))
    return grouped.mapInArrow(run, "image_id long, w binary")


def drawn_images(images: DataFrame, draws: int, seed: str) -> tuple[DataFrame, int]:
    """(image_id, w) of the multinomial bootstrap of ``images``, one row each, and their number. The counts come packed from the
    tasks that hash the picks, a block of positions at a time: no row exists per draw and image."""
    positions = cut_lineage(dense_index(images, "image_id"))
    n = positions.count()
    placed = positions.select(F.expr(f"pos DIV {BLOCK} AS block"), F.expr(f"int(pos % {BLOCK}) AS _at"), "image_id")

    def run(values, counted):
        size = counted.column("size")[0].as_py() if counted.num_rows else 0
        counts = np.zeros((size, draws), np.uint16)
        for draw, packed in zip(counted.column("draw").to_pylist(), counted.column("counts").to_pylist()):
            counts[:, draw] += _unpack(packed, size).astype(np.uint16)
        own = counts[values.column("_at").to_numpy()] if values.num_rows else counts[:0]
        return pa.table([values.column("image_id").cast(pa.int64()), pa.array(_nibbles(own), pa.binary())], ["image_id", "w"])

    counts = block_counts(images.sparkSession, n, draws, seed)
    found = placed.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, "image_id long, w binary")
    return found, n


def _weights(one: bytes, draws: int) -> np.ndarray:
    """Rows of weights in the short form."""
    half = np.frombuffer(one, np.uint8).reshape(-1, (draws + 1) // 2)
    return np.stack([half & 15, half >> 4], 2).reshape(len(half), -1)[:, :draws]


def _matrix(rows: list[bytes], draws: int) -> np.ndarray:
    out = np.zeros((len(rows), draws), np.int64)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    wide = size > (draws + 1) // 2
    if not wide.all():
        out[~wide] = _weights(b"".join(r for r, w in zip(rows, wide) if not w), draws)
    if wide.any():
        out[wide] = np.frombuffer(b"".join(r for r, w in zip(rows, wide) if w), "<u2").reshape(-1, draws)
    return out


def weighted_positives(truth: DataFrame, images: DataFrame, draws: int) -> dict[int, np.ndarray]:
    """Positives per category in every draw. ``truth``: one row per positive box."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            category, count = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            weights = _matrix(batch.column(2).to_pylist(), draws)
            for c in np.unique(category).tolist():
                total[c] = total.get(c, 0) + count[category == c] @ weights[category == c]
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([total[c].tobytes() for c in keys], pa.binary())], ["category_id", "sums"]
        )

    counts = truth.groupBy("image_id", F.col("category_id").cast("long").alias("category_id")).agg(F.count(F.lit(1)).alias("n"))
    partial = counts.join(images, "image_id").select("category_id", "n", "w").mapInArrow(run, "category_id long, sums binary")
    out: dict[int, np.ndarray] = {}
    table = partial.toArrow()  # one row per task and category
    for c, sums in zip(table["category_id"].to_pylist(), table["sums"].to_pylist()):
        out[c] = out.get(c, 0) + np.frombuffer(sums, np.int64)
    return out


def weighted_rates(rates: DataFrame, images: DataFrame, draws: int, keys) -> DataFrame:
    """(keys, draw, bpp): the mean rate of every draw. ``rates``: (keys, image_id, bpp), few keys."""
    keys = list(keys)
    entry = F.struct(F.xxhash64(*keys).alias("c"), F.col("bpp").cast("double").alias("bpp"))
    own = rates.groupBy("image_id").agg(F.collect_list(entry).alias("entries")).join(images, "image_id").select("entries", "w")

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column(0)
            image = np.repeat(np.arange(batch.num_rows), np.diff(rows.offsets.to_numpy()))
            entries, weights = rows.flatten(), _matrix(batch.column(1).to_pylist(), draws).astype(float)
            config, bpp = entries.field("c").to_numpy(), entries.field("bpp").to_numpy(zero_copy_only=False)
            for c in np.unique(config).tolist():
                here = config == c
                values = np.stack([np.where(np.isnan(bpp[here]), 0.0, bpp[here]), np.ones(here.sum())])
                total[c] = total.get(c, 0) + values @ weights[image[here]]
        for c, sums in total.items():
            arrays = [pa.array([c] * draws, pa.int64()), pa.array(np.arange(draws, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])]
            yield pa.RecordBatch.from_arrays(arrays, ["c", "draw", "v", "n"])

    sums = own.mapInArrow(run, "c long, draw int, v double, n double").groupBy("c", "draw").agg(F.expr("sum(v)/sum(n) AS bpp"), F.sum("n").alias("n"))
    names = rates.select(*keys).distinct().withColumn("c", F.xxhash64(*keys))
    return sums.filter("n > 0").join(F.broadcast(names), "c").select(*keys, "draw", "bpp")


def _packed(batches):
    """Runs of at most ROWS consecutive rows of one category, one row each."""
    for batch in batches:
        category = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.append(True, category[1:] != category[:-1])[: len(category)]).tolist()
        runs = [(i, min(i + ROWS, b)) for a, b in zip(cuts, [*cuts[1:], len(category)]) for i in range(a, b, ROWS)]
        columns = [[], [], []]
        for a, b in runs:
            blobs = batch.column(1).slice(a, b - a).to_pylist()
            entries = np.frombuffer(b"".join(blobs), ENTRY)
            groups, own = np.unique(entries["g"], return_inverse=True)
            size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // ENTRY.itemsize
            masks = [x.tobytes() for x in (size.astype("<u4"), own.astype("<u4"), entries["right"], entries["out"])]
            columns[0].append(groups.astype("<i8").tobytes())
            columns[1].append(np.array([len(size), len(own)], "<u4").tobytes() + zlib.compress(b"".join(masks), 1))
            weights = None
            if batch.num_columns > 2:
                rows = batch.column(2).slice(a, b - a).to_pylist()
                weights = np.fromiter(map(len, rows), "<u4", len(rows)).tobytes() + zlib.compress(b"".join(rows), 1)
            columns[2].append(weights)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["groups", "entries", "w"])


def _runs(batches, draws: int, block: slice):
    """(part, groups, row, group, right, ignored, weights) of some consecutive rows of one category: a number of entries, each of a
    row and a group, and the rows' weights."""
    for batch in batches:
        for part, groups, entries, w in zip(*(c.to_pylist() for c in batch.columns)):
            rows, number = np.frombuffer(entries[:8], "<u4").tolist()
            raw = zlib.decompress(entries[8:])
            size, own = np.frombuffer(raw, "<u4", rows), np.frombuffer(raw, "<u4", number, 4 * rows)
            right, out = (np.frombuffer(raw, "<u2", number, 4 * rows + (4 + 2 * i) * number) for i in (0, 1))
            if w is None:
                weights = np.ones((rows, block.stop - block.start), np.int64)
            else:
                lengths, packed = np.frombuffer(w[: 4 * rows], "<u4"), zlib.decompress(w[4 * rows :])
                ends = np.cumsum(lengths, dtype=np.int64)
                weights = _matrix([packed[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())], draws)[:, block]
            yield part, np.frombuffer(groups, "<i8"), np.repeat(np.arange(rows), size), own, right, out, weights


def _masks(rows: int, groups: int, row, own, right, out) -> np.ndarray:
    """(chunk, group, 1 + 2*LEVELS, CHUNK): what each detection adds to the counters of seen, right and ignored ones."""
    chunks = -(-rows // CHUNK)
    masks = np.zeros((groups, 1 + 2 * LEVELS, chunks * CHUNK), np.float32)
    masks[own, 0, row] = 1
    for k in range(LEVELS):
        masks[own, 1 + k, row] = (right >> k) & 1
        masks[own, 1 + LEVELS + k, row] = (out >> k) & 1
    return masks.reshape(groups, 1 + 2 * LEVELS, chunks, CHUNK).transpose(2, 0, 1, 3)


def _chunked(weights: np.ndarray) -> np.ndarray:
    """(chunk, CHUNK, draw)"""
    chunks = -(-len(weights) // CHUNK)
    padded = np.zeros((chunks * CHUNK, weights.shape[1]), np.float32)
    padded[: len(weights)] = weights
    return padded.reshape(chunks, CHUNK, -1)


def _slabs(run):
    """GROUPS groups at a time: (groups, masks, weights by chunk, sums of the chunks)."""
    _, groups, row, own, right, out, weights = run
    by_chunk = _chunked(weights)
    for first in range(0, len(groups), GROUPS):
        here = slice(None) if len(groups) <= GROUPS else (own >= first) & (own < first + GROUPS)
        some = groups[first : first + GROUPS]
        masks = _masks(len(weights), len(some), row[here], own[here].astype(np.int64) - first, right[here], out[here])
        flat = np.ascontiguousarray(masks).reshape(len(masks), -1, CHUNK)
        # Exact: a chunk's sums are far below 2**24.
        sums = np.matmul(flat, by_chunk).reshape(len(masks), len(some), 1 + 2 * LEVELS, -1).astype(np.float64)
        yield some.tolist(), flat.reshape(masks.shape), by_chunk, sums


def _step(recall: np.ndarray) -> np.ndarray:
    """The last step of GRID that a recall reaches."""
    step = np.clip((recall * (STEPS - 1)).astype(np.int64), 0, STEPS - 1)
    step += (step < STEPS - 1) & (GRID[np.minimum(step + 1, STEPS - 1)] <= recall)
    return step - (GRID[step] > recall)


def _raise_top(top, masks, weights, before, sums, positives) -> None:
    """Raise ``top`` (group, threshold, step, draw) by the precisions in some chunks. ``before``: the counters at their starts."""
    c0, c1 = before[:, :, 1 : 1 + LEVELS], before[:, :, 1 : 1 + LEVELS] + sums[:, :, 1 : 1 + LEVELS]
    n0 = before[:, :, :1] - before[:, :, 1 + LEVELS :]
    total = np.where(positives > 0, positives, 1)[:, None, :]
    # If all chunks lie in one step of recall: no hit of a chunk is more precise than if all its hits came first, and the
    # precision at the start of a chunk is that of an earlier hit of this step, or lower.
    step = _step(c1[-1] / total)
    one_step = (c0[0] > 0) & (_step(np.maximum(c0[0], 1) / total) == step)
    with np.errstate(divide="ignore", invalid="ignore"):
        most = c1 / (n0 + (c1 - c0))
        known = np.maximum(np.take_along_axis(top, step[:, :, None], 2)[:, :, 0], np.maximum.accumulate(c0 / n0, 0))
    known = np.where(one_step, known, -1.0)
    at = np.nonzero((most > known) & (c1 > c0) & (positives > 0)[:, None, :])
    # Else each chunk has its own steps.
    chunk, group, level, draw = at
    total = positives[group, draw]
    last = _step(c1[at] / total)
    across = np.zeros(len(chunk), bool)
    some = np.flatnonzero(~one_step[group, level, draw])
    across[some] = _step((c0[tuple(a[some] for a in at)] + 1) / total[some]) != last[some]
    looked = across | (most[at] > top[group, level, last, draw])
    at, last, across = tuple(a[looked] for a in at), last[looked], across[looked]
    turned = np.ascontiguousarray(weights.transpose(0, 2, 1))  # (chunk, draw, CHUNK)
    for i in range(0, len(at[0]), LOOKED):
        chunk, group, level, draw = (a[i : i + LOOKED] for a in at)
        own = turned[chunk, draw]
        right = masks[chunk, group, 1 + level] * own
        seen = (masks[chunk, group, 0] - masks[chunk, group, 1 + LEVELS + level]) * own
        c = c0[chunk, group, level, draw][:, None] + np.cumsum(right, 1)
        n = n0[chunk, group, level, draw][:, None] + np.cumsum(seen, 1)
        precision = np.where(right > 0, c, 0.0) / np.where(right > 0, n, 1.0)
        spread = across[i : i + LOOKED]
        whole = ~spread
        np.maximum.at(top, (group[whole], level[whole], last[i : i + LOOKED][whole], draw[whole]), precision[whole].max(1))
        if spread.any():
            of, place = np.nonzero((right > 0) & spread[:, None])
            steps = _step(c[of, place] / positives[group[of], draw[of]])
            np.maximum.at(top, (group[of], level[of], steps, draw[of]), precision[of, place])


def ordered(matched: DataFrame, images: DataFrame | None, group) -> DataFrame:
    """The detections in order, with masks of thresholds: fixed partitions (part, groups, entries, w) of packed runs. ``w`` is
    NULL without ``images``: every detection counts once. ``matched`` is of ``match`` or ``match_packed``; ``group`` ends with the
    category."""
    category = group[-1]
    if "entries" in matched.columns:
        rows = matched.select(category, (-F.col("score")).alias("s"), "image_id", "pred_id", "entries")
    else:
        rows = _single(matched, group)
    wanted = [category, "entries"]
    if images is not None:
        rows, wanted = rows.join(images, "image_id"), [*wanted, "w"]
    # The best score first; equal scores in image order, as when images are scored one by one.
    order = (category, "s", "image_id", "pred_id")
    # A given number: packed rows look small, but each stands for counters of all draws.
    along = rows.repartitionByRange(2 * parallelism(rows.sparkSession), *order).sortWithinPartitions(*order).select(*wanted)
    fixed = cut_lineage(along.mapInArrow(_packed, "groups binary, entries binary, w binary"))
    return fixed.select(F.spark_partition_id().alias("part"), "groups", "entries", "w")


def _single(matched: DataFrame, group) -> DataFrame:
    """A row of ``match`` as one entry."""
    def mask(name):
        return " + ".join(f"{1 << k}*{name}[{k}]" for k in range(LEVELS))

    def run(batches):
        for batch in batches:
            entries = np.zeros(batch.num_rows, ENTRY)
            for name, column in zip(ENTRY.names, batch.columns[-3:], strict=True):
                entries[name] = column.to_numpy()
            cuts = (np.arange(batch.num_rows + 1) * ENTRY.itemsize).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cuts), pa.py_buffer(entries.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], blobs], [*batch.schema.names[:-3], "entries"])

    out = mask("ignored") if "ignored" in matched.columns else "0"
    rows = matched.select(
        group[-1], (-F.col("score")).alias("s"), "image_id", "pred_id", F.xxhash64(*group).alias("g"),
        F.expr(f"int({mask('tp')})").alias("right"), F.expr(f"int({out})").alias("ignored"),
    )
    return rows.mapInArrow(run, rows.select(*rows.columns[:-3], F.lit(b"").alias("entries")).schema)


def precision_by_draw(fixed: DataFrame, n_pos: dict[int, np.ndarray], draws: int) -> DataFrame:
    """(g, draw, ap): the average precision at every threshold. ``fixed`` is of ``ordered``; ``n_pos`` the positives of
    every group in every draw."""
    spark = fixed.sparkSession
    groups = max(len(n_pos), 1)
    vectors = max(fixed.rdd.getNumPartitions(), 1) * groups
    size = min(draws, OFFSET_BYTES // (vectors * (2 * LEVELS + 1) * 8), TOP_BYTES // (groups * LEVELS * STEPS * 8))
    size = max(1, size)
    out = None
    for first in range(0, draws, size):
        block = slice(first, min(draws, first + size))
        found = _block(spark, fixed, {g: n[block] for g, n in n_pos.items()}, draws, block)
        out = found if out is None else out.unionByName(found)
    return out


def _block(spark, fixed: DataFrame, n_pos: dict[int, np.ndarray], draws: int, block: slice) -> DataFrame:
    width = block.stop - block.start

    def totals(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for run in _runs(batches, draws, block):
            for groups, _, _, own in _slabs(run):
                for group, one in zip(groups, own.sum(0)):
                    sums[run[0], group] = sums.get((run[0], group), 0) + one
        keys = list(sums)
        columns = [pa.array([k[i] for k in keys], t) for i, t in ((0, pa.int32()), (1, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([sums[k].tobytes() for k in keys], pa.binary())], ["part", "g", "sums"])

    table = fixed.mapInArrow(totals, "part int, g long, sums binary").toArrow().sort_by([("g", "ascending"), ("part", "ascending")])
    before, held, last = {}, None, None
    for part, group, sums in zip(table["part"].to_pylist(), table["g"].to_pylist(), table["sums"].to_pylist()):
        if group != last:
            held, last = np.zeros((2 * LEVELS + 1, width)), group
        before[part, group] = held
        held = held + np.frombuffer(sums).reshape(held.shape)
    shared = spark.sparkContext.broadcast((before, n_pos))

    def maxima(batches):
        start, positives = shared.value
        now: dict[int, np.ndarray] = {}  # counters of each group
        tops: dict[int, np.ndarray] = {}
        for run in _runs(batches, draws, block):
            for groups, masks, weights, sums in _slabs(run):
                for group in groups:
                    if group not in now:
                        now[group] = start[run[0], group]
                state = np.stack([now[g] for g in groups])
                ends = state + np.cumsum(sums, 0)
                now |= zip(groups, ends[-1])
                known = [i for i, g in enumerate(groups) if g in positives]
                if not known:
                    continue
                pos = np.stack([positives[groups[i]] for i in known])
                top = np.stack([tops.get(groups[i], np.zeros((LEVELS, STEPS, width))) for i in known])
                if len(known) < len(groups):
                    masks, sums, ends = masks[:, known], sums[:, known], ends[:, known]
                _raise_top(top, masks, weights, ends - sums, sums, pos)
                tops |= zip([groups[i] for i in known], top)
        for group, top in tops.items():
            rows = [zlib.compress(np.ascontiguousarray(top[:, :, d]).tobytes(), 1) for d in range(width)]
            arrays = [pa.array([group] * width, pa.int64()), pa.array(np.arange(block.start, block.stop, dtype=np.int32)), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["g", "draw", "best"])

    def joined(batches):
        held, key = None, None

        def done():
            # The highest precision at this recall or beyond, averaged over the steps.
            above = np.maximum.accumulate(held[:, ::-1], 1)
            ap = (above.sum(1) / STEPS).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([ap])], ["g", "draw", "ap"]
            )

        for batch in batches:
            for group, draw, best in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(zlib.decompress(best)).reshape(LEVELS, STEPS)
                if (group, draw) == key:
                    held = np.maximum(held, own)
                else:
                    if key is not None:
                        yield done()
                    held, key = own, (group, draw)
        if key is not None:
            yield done()

    pieces = fixed.mapInArrow(maxima, "g long, draw int, best binary")
    sorted_ = pieces.repartition("g", "draw").sortWithinPartitions("g", "draw")
    return sorted_.mapInArrow(joined, "g long, draw int, ap array<double>")


def mean_by_draw(found: DataFrame, groups: DataFrame, n_pos: dict[int, np.ndarray], draws: int, keys) -> DataFrame:
    """(keys, draw, map, map50): means over the categories with positives in the draw, those without detections counting
    as 0. ``groups``: (keys, g), one row per group."""
    spark = found.sparkSession
    rows = [(g, [d for d in range(draws) if n[d] > 0]) for g, n in n_pos.items()]
    wanted = spark.createDataFrame(rows, "g long, draws array<int>").select("g", F.explode("draws").alias("draw"))
    scored = wanted.join(found, ["g", "draw"], "left").join(groups, "g")
    zero = F.array(*[F.lit(0.0)] * LEVELS)
    scored = scored.withColumn("ap", F.coalesce("ap", zero))
    mean = F.expr(f"aggregate(ap, 0D, (s, v) -> s + v)/{LEVELS}")
    return scored.groupBy(*keys, "draw").agg(F.avg(mean).alias("map"), F.avg(F.col("ap")[0]).alias("map50"))

