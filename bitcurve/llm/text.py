"""Words, shingles and sentences of whole Arrow batches as NumPy arrays.

Texts are read as the UTF-8 bytes that Arrow hands over, so no Python string is made per row or word.
Batches are cut into a few megabytes and worked through in smaller pieces, which bounds the temporary memory. A null text has no words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 17  # bytes worked on at once; small enough for a core's cache
ROWS_BYTES = 1 << 21  # bytes of text in the rows handed out at once

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, bool)  # the separators of [^\x20\x09-\x0D]+
SPACE[[32, *range(9, 14)]] = True

NOT_ALNUM = np.zeros(256, bool)  # the separators of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

# Random odd constants of the hash functions; any other ones would do.
_RANDOM = np.random.default_rng(20240717)
_BYTES = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.array([0x9E3779B97F4A7C15], np.uint64)  # an array, because arrays wrap around silently
_BASE, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` powers of the word hash's base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(2 * n, base, np.uint64)
            table[0] = 1
            _POWERS[k] = np.multiply.accumulate(table)
    return _POWERS[0][:n], _POWERS[1][:n]


def row_pieces(batch: pa.RecordBatch, column: int, limit: int = ROWS_BYTES):
    """The batch in runs of rows with about ``limit`` bytes of text each (at least a row)."""
    _, offsets = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; row i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[where[0] : where[-1]], where - where[0]


class Words:
    """The words of a batch: ``start`` and ``end`` bytes, ``hash``, ``row``; ``first[i]:first[i + 1]``
    are the words of row i."""

    def __init__(self, column, separators: np.ndarray = SPACE, hashed: bool = True):
        self.data, self.offsets = utf8(column)
        cuts = self._cuts(separators)
        parts = [self._piece(a, b, separators, hashed) for a, b in zip(cuts[:-1], cuts[1:])]
        self.start = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        self.end = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        self.hash = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def _cuts(self, separators) -> list[int]:
        """Byte positions at which no word is cut: a row's start or a separator."""
        cuts, at, n = [0], 0, len(self.data)
        while n - at > PIECE:
            to = at + PIECE
            end = self.offsets[np.searchsorted(self.offsets, to)]
            while to < end:
                hit = np.flatnonzero(separators[LOWER[self.data[to : min(end, to + 4096)]]])
                if len(hit):
                    to += int(hit[0])
                    break
                to = min(end, to + 4096)
            cuts.append(int(to))
            at = int(to)
        return cuts + [n] if n > at else cuts

    def _piece(self, a: int, b: int, separators, hashed):
        d = LOWER[self.data[a:b]]
        inside = ~separators[d]
        border = np.zeros(b - a + 1, bool)
        lo, hi = np.searchsorted(self.offsets, [a, b])
        border[self.offsets[lo : hi + 1][self.offsets[lo : hi + 1] <= b] - a] = True
        border[0] = border[-1] = True
        before = np.empty(b - a, bool)
        before[0] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | border[:-1]))
        after = np.empty(b - a, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | border[1:])) + 1
        if not hashed or not len(start):
            return start + a, end + a, np.zeros(0, np.uint64)
        up, down = powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTES[d] * up[: b - a], out=total[1:])
        value = (total[end] - total[start]) * down[start]
        return start + a, end + a, mix(value + (end - start).astype(np.uint64) * _STEP)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of every run of ``k`` words that lies in one row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        p = powers(k + 1)[0]
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += self.hash[j : j + n] * p[j]
        return at, mix(total[at] + np.array([k], np.uint64) * _STEP)

    def shingle_sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(values, first): the sorted distinct hashes of row i's k-word shingles are
        values[first[i]:first[i + 1]]. A row of fewer words has its whole sequence as its one shingle, a row
        without words none."""
        at, value = self.runs(k)
        row = self.row[at]
        short = np.flatnonzero((np.diff(self.first) > 0) & (np.diff(self.first) < k))
        if len(short):
            p = powers(k + 1)[0]
            whole = [self.hash[self.first[i] : self.first[i + 1]] for i in short]
            sums = np.array([(w * p[: len(w)]).sum(dtype=np.uint64) for w in whole], np.uint64)
            own = mix(sums + np.array([len(w) for w in whole], np.uint64) * _STEP)
            row = np.concatenate([row, short])
            order = np.argsort(row, kind="stable")
            row, value = row[order], np.concatenate([value, own])[order]
        first = np.searchsorted(row, np.arange(len(self.offsets)))
        for a, b in zip(first[:-1], first[1:]):
            value[a:b].sort()
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        return value[new], np.searchsorted(row[new], np.arange(len(self.offsets)))
