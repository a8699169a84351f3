"""Greedy matching of detections to truth boxes, for many images at once.

Rows of truth and detections of one image and category lie one after the other, truth first, detections by score. A task
reads them in batches, keeps what belongs to an unfinished group, and matches all finished groups of a batch together: overlaps
of all pairs of a group, then one step for the first detection of every group, one for the second, and so on. Of a group
the truth boxes and the ``MAX_DETECTIONS`` best detections per configuration are held, whatever its number of rows; pairs
are made ``PAIRS`` at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MAX_DETECTIONS = 100  # fixed value of the protocol
THRESHOLDS = 10  # IoU .50 to .95 in steps of .05
LEVELS = np.array([min(0.5 + 0.05 * k, 1 - 1e-10) for k in range(THRESHOLDS)])
BITS = 1 << np.arange(THRESHOLDS)
ROWS = 1 << 15  # rows matched at once
PAIRS = 1 << 17  # pairs whose overlaps are in memory at once

# The kind of a row; FIRST is added to that of the first row of an image and category.
TRUTH, CROWD, DETECTION, FIRST = 0, 1, 2, 3

# What a detection is at every threshold in one configuration: right, or neither right nor wrong.
ENTRY = np.dtype([("g", "<i8"), ("right", "<u2"), ("out", "<u2")])


def _codes(table: pa.Table, names) -> np.ndarray:
    """A number for the values that a row has in the named columns, equal where they are."""
    out = np.zeros(table.num_rows, np.int64)
    for name in names:
        column = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        own = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = out * (len(column.dictionary) + 1) + own
        if out.max(initial=0) > 1 << 24:
            out = np.unique(out, return_inverse=True)[1]
    return out


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _kinds(table: pa.Table):
    """(kind of every row, whether it is the first of its group)"""
    kind = _column(table, "_kind")
    return kind % FIRST, kind >= FIRST


def _ranked(table: pa.Table, keys):
    """(rows, group, number of the group and configuration, rank from 0) of the best detections, by group, configuration, rank."""
    kind, first = _kinds(table)
    group = np.cumsum(first) - 1
    rows = np.flatnonzero(kind == DETECTION)
    codes = _codes(table, keys)[rows] if keys else np.zeros(len(rows), np.int64)
    lists = group[rows] * (codes.max(initial=0) + 1) + codes
    order = np.argsort(lists, kind="stable")
    rows, lists = rows[order], lists[order]
    new = np.append(True, lists[1:] != lists[:-1])[: len(rows)]
    own = np.cumsum(new) - 1
    rank = np.arange(len(rows)) - np.flatnonzero(new)[own] if len(rows) else own
    best = rank < MAX_DETECTIONS
    return rows[best], group[rows[best]], own[best], rank[best], group


def _pruned(table: pa.Table, keys) -> pa.Table:
    """Truth boxes and the best detections: a later row takes no better rank."""
    rows = _ranked(table, keys)[0]
    kept = np.union1d(rows, np.flatnonzero(_kinds(table)[0] != DETECTION))
    return table.take(pa.array(kept))


def _candidates(group, rows, truth, start, size, table):
    """Pairs with enough overlap (detection, truth box, IoU), the best of each detection first; and the largest share of each
    detection that a crowd box covers. A missing coordinate counts as the other box's, as in SQL."""
    x, y, w, h = (_column(table, c) for c in "xywh")
    crowd = (_kinds(table)[0] == CROWD)[truth]
    cover = np.full(len(rows), -1.0)
    count = size[group]
    ends = np.cumsum(count)
    found, first = [], 0
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        own = np.repeat(np.arange(first, last), count[first:last])
        box = np.arange(len(own)) - np.repeat(ends[first:last] - count[first:last] - (ends[first - 1] if first else 0), count[first:last])
        box += start[group[own]]
        a, b = rows[own], truth[box]
        with np.errstate(divide="ignore", invalid="ignore"):
            wide = np.fmax(np.fmin(x[a] + w[a], x[b] + w[b]) - np.fmax(x[a], x[b]), 0.0)
            high = np.fmax(np.fmin(y[a] + h[a], y[b] + h[b]) - np.fmax(y[a], y[b]), 0.0)
            both, area = wide * high, w[a] * h[a]
            union = area + w[b] * h[b] - both
            iou = np.where(union != 0, both / union, np.nan)
            hit = (iou >= LEVELS[0]) & ~crowd[box]
            over = np.flatnonzero(crowd[box])
            share = np.where(area[over] != 0, both[over] / area[over], np.nan)
        np.fmax.at(cover, own[over], share)
        own, box, iou = own[hit], box[hit], iou[hit]
        order = np.lexsort((-box, -iou, own))  # the later one of equals
        own, box, iou = own[order], box[order], iou[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        best = place < MAX_DETECTIONS  # at most 99 others choose before
        found.append((own[best], box[best], iou[best], place[best]))
        first = last
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    return *(np.concatenate(c) for c in zip(empty, *found)), cover


def _matched(table: pa.Table, keys):
    """(rows, rank from 0, masks of the thresholds at which a detection is right, and at which it is ignored)."""
    rows, group, lists, rank, groups = _ranked(table, keys)
    truth = np.flatnonzero(_kinds(table)[0] != DETECTION)
    number = int(groups[-1]) + 1 if len(groups) else 0
    size = np.bincount(groups[truth], minlength=number)
    start = np.cumsum(size) - size
    own, box, iou, place, cover = _candidates(group, rows, truth, start, size, table)

    # Rows of one box id are one box, and lie one after the other.
    ann = _column(table, "_ann")[truth]
    new = np.append(True, (ann[1:] != ann[:-1]) | (groups[truth][1:] != groups[truth][:-1]))[: len(truth)]
    box = np.flatnonzero(new)[np.cumsum(new) - 1][box] if len(truth) else box
    # A place for each box in each list of detections.
    room = size[group[np.flatnonzero(np.append(True, lists[1:] != lists[:-1])[: len(lists)])]]
    slot = (np.cumsum(room) - room)[lists[own]] + box - start[group[own]]

    best = np.zeros(len(rows))
    best[own[place == 0]] = iou[place == 0]
    right = (1 << np.searchsorted(LEVELS, best, "right")) - 1
    # Only detections that share a box with another are matched in turn.
    wanted = np.bincount(slot, minlength=int(room.sum()))
    contested = np.zeros(len(rows), bool)
    contested[own[wanted[slot] > 1]] = True
    if contested.any():
        first = np.searchsorted(own, np.arange(len(rows)))
        many = np.bincount(own, minlength=len(rows))
        dets = np.flatnonzero(contested)
        turn = np.arange(len(dets)) - np.searchsorted(lists[dets], lists[dets])
        order = np.argsort(turn, kind="stable")
        dets, cuts = dets[order], np.searchsorted(turn[order], np.arange(turn.max() + 2))
        names, place_of = np.unique(slot[contested[own]], return_inverse=True)
        narrow = np.zeros(len(slot), np.int64)
        narrow[contested[own]] = place_of
        used = np.zeros((len(names), THRESHOLDS), bool)
        for a, b in zip(cuts, cuts[1:]):
            now = dets[a:b]  # one of each list
            taken = np.zeros((len(now), THRESHOLDS), bool)
            for c in range(int(many[now].max(initial=0))):
                at = np.flatnonzero(many[now] > c)
                cand = first[now[at]] + c
                free = ~taken[at] & (iou[cand][:, None] >= LEVELS) & ~used[narrow[cand]]
                used[narrow[cand]] |= free
                taken[at] |= free
            right[now] = taken @ BITS
    out = ((1 << np.searchsorted(LEVELS, cover, "right")) - 1) & ~right
    return rows, rank, right, out


def _finished(batches, keys):
    """Tables of whole groups."""
    held, waiting, most = [], 0, ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        waiting += batch.num_rows
        if waiting < most:
            continue
        table = pa.Table.from_batches(held)
        last = int(np.flatnonzero(_kinds(table)[1])[-1])
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
        if rest.num_rows >= ROWS:  # one group: the worst of its detections go
            rest = _pruned(rest, keys)
        held, waiting = rest.combine_chunks().to_batches(), rest.num_rows
        most = max(ROWS, 2 * waiting)
    if waiting:
        yield pa.Table.from_batches(held)


def rows_of(keys, schema: pa.Schema):
    """A function of batches: one row per detection with its rank and masks."""
    def run(batches):
        for table in _finished(batches, keys):
            rows, rank, right, out = _matched(table, keys)
            numbers = {"det_rank": rank + 1, "right": right, "ignored": out}
            picked = table.select([c for c in schema.names if c not in numbers]).take(pa.array(rows))
            arrays = [pa.array(numbers[c].astype(np.int32)) if c in numbers else picked.column(c).combine_chunks() for c in schema.names]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return run


def packed(batches):
    """One row per detection and score, with an entry for each configuration that has it. ``g`` is the number of a row's
    configuration and category."""
    names = ["category_id", "score", "image_id", "pred_id"]
    for table in _finished(batches, ["g"]):
        rows, _, right, out = _matched(table, ["g"])
        order = np.argsort(rows)
        rows = rows[order]
        entries = np.zeros(len(rows), ENTRY)
        entries["g"], entries["right"], entries["out"] = _column(table, "g")[rows], right[order], out[order]
        here = table.take(pa.array(rows))
        group = (np.cumsum(_kinds(table)[1]) - 1)[rows]
        same = _codes(here, ["score", "pred_id"])
        # Equal detections lie by configuration: one that has two of them begins another row.
        again = (group[1:] == group[:-1]) & (same[1:] == same[:-1]) & (entries["g"][1:] != entries["g"][:-1])
        firsts = np.flatnonzero(np.append(True, ~again)[: len(rows)])
        cuts = (np.append(firsts, len(rows)) * ENTRY.itemsize).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(cuts), pa.py_buffer(entries.tobytes())])
        picked = here.select(names).take(pa.array(firsts))
        yield pa.RecordBatch.from_arrays([*(picked.column(c).combine_chunks() for c in names), blobs], [*names, "entries"])
