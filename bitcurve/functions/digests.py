"""First 60 bits of md5 of many short texts at once, equal to ``hashing.md5_wide``: numpy inside a task.

The texts of one call are a common prefix and tails of one length, so only the words that hold the tails are arrays."""

from __future__ import annotations

import math

import numpy as np

_SHIFTS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_CONSTANTS = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


class Tails:
    """Texts of one length, one per row of a byte matrix."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.n, self.length = rows.shape
        self._words: dict[int, np.ndarray] = {}

    def words(self, offset: int) -> np.ndarray:
        """Little-endian words with the tails (and the bit that ends a message) ``offset`` bytes in."""
        if offset not in self._words:
            width = -(-(offset + self.length + 1) // 4) * 4
            padded = np.zeros((self.n, width), np.uint8)
            padded[:, offset : offset + self.length] = self.rows
            padded[:, offset + self.length] = 0x80
            self._words[offset] = np.ascontiguousarray(padded.view("<u4").T)
        return self._words[offset]


def md5_wide(prefix: bytes, tails: Tails) -> np.ndarray:
    """First 60 bits of md5(prefix + tail) of every tail, as int64."""
    size = len(prefix) + tails.length
    words: list = [0] * (16 * ((size + 8) // 64 + 1))
    whole, offset = divmod(len(prefix), 4)
    for i in range(whole):
        words[i] = int.from_bytes(prefix[4 * i : 4 * i + 4], "little")
    for i, w in enumerate(tails.words(offset)):
        words[whole + i] = w
    if offset:
        words[whole] = words[whole] | np.uint32(int.from_bytes(prefix[4 * whole :], "little"))
    words[-2], words[-1] = (8 * size) & 0xFFFFFFFF, (8 * size) >> 32
    state = [np.full(tails.n, v, np.uint32) for v in _START]
    f, t = np.empty(tails.n, np.uint32), np.empty(tails.n, np.uint32)
    for first in range(0, len(words), 16):
        a, b, c, d = (v.copy() for v in state)
        for i in range(64):
            if i < 16:
                g = i
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:
                g = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                g = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                g = (7 * i) % 16
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            word, added = words[first + g], _CONSTANTS[i]
            if isinstance(word, int):
                added = (added + word) & 0xFFFFFFFF
            else:
                np.add(f, word, out=f)
            np.add(f, np.uint32(added), out=f)
            np.add(f, a, out=f)
            s = _SHIFTS[i // 16][i % 4]
            np.left_shift(f, np.uint32(s), out=t)
            np.right_shift(f, np.uint32(32 - s), out=f)
            np.bitwise_or(f, t, out=f)
            np.add(f, b, out=a)
            a, b, c, d = d, a, b, c
        for total, part in zip(state, (a, b, c, d), strict=True):
            np.add(total, part, out=total)
    high, low = state[0].byteswap().astype(np.uint64), state[1].byteswap().astype(np.uint64)
    return ((high << np.uint64(28)) | (low >> np.uint64(4))).astype(np.int64)


def tails_of(texts: list[bytes]) -> list[tuple[np.ndarray, Tails]]:
    """(positions, tails) of the texts, one pair per length."""
    lengths = np.array([len(x) for x in texts])
    found = []
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        joined = np.frombuffer(b"".join(texts[i] for i in at), np.uint8)
        found.append((at, Tails(joined.reshape(len(at), int(length)))))
    return found
