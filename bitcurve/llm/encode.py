"""Token ids of whole texts by a public tokenizer whose pre-tokenizer drops white space.

Such a tokenizer never looks across white space, so a text's ids are those of its white-space-separated
chunks one after the other. Chunks repeat, and each worker keeps the ids of those it has met: most of a
corpus is then encoded by dictionary look-ups. New words are encoded together, many at a call."""

from __future__ import annotations

import ctypes
import os
import re

import numpy as np
import pyarrow as pa

CHUNKS_KEPT = 900_000  # chunks a worker remembers; only memory and speed depend on it
LONGEST_KEPT = 64
ROWS_AT_ONCE = 256
CALL = 4096  # words encoded by one call

# A word of Latin letters (those of two bytes are U+00C0 to U+00FF), and marks after it: two pieces for any pre-tokenizer that splits letters from marks.
WORD = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,!?;:%&*$#|()]*)")

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Chunks (bytes) and their ids as little-endian integers of ``width`` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.known: dict[bytes, bytes] = {}
        # Whether upper case and marks make no difference to a word's ids, as with a lower-casing tokenizer.
        self.lowers = self.whole("Ab") == self.whole("ab") and self.whole("ab,") == self.whole("ab") + self.whole(",")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters, each one piece for the pre-tokenizer."""
        found = self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False)
        piece = np.asarray([-1 if w is None else w for w in found.word_ids], np.int64)
        if not len(piece) or piece.min() < 0 or piece[-1] != len(words) - 1 or (np.diff(piece) > 1).any():
            return [self.whole(w.decode()) for w in words]
        ids = np.asarray(found.ids, self.kind).tobytes()
        cuts = (np.searchsorted(piece, np.arange(len(words) + 1)) * self.width).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def learn(self, chunks: set[bytes]) -> None:
        """Find the ids of new chunks."""
        known, parts, odd = self.known, [], chunks
        if self.lowers:
            matches = [(c, WORD.fullmatch(c)) for c in chunks]
            parts = [(c, m[1].lower(), m[2]) for c, m in matches if m]
            odd = [c for c, m in matches if not m]
        for chunk in odd:
            known[chunk] = self.whole(chunk.decode("utf-8", "replace"))
        ids = {tail: self.whole(tail.decode()) for tail in {p[2] for p in parts}}
        heads = list({p[1] for p in parts}.difference(known))
        for at in range(0, len(heads), CALL):
            known.update(zip(heads[at : at + CALL], self.words(heads[at : at + CALL])))
        for chunk, head, tail in parts:
            known[chunk] = known[head] + ids[tail]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        chunks = [t.split() if t else [] for t in texts]
        if len(self.known) > CHUNKS_KEPT:
            self.known = {}
        new = set().union(*chunks).difference(self.known)
        self.learn(new)
        out = [b"".join(map(self.known.__getitem__, c)) for c in chunks]
        for chunk in new:
            if len(chunk) > LONGEST_KEPT:
                del self.known[chunk]
        return out


def encoder(path: str) -> Encoder:
    """This process's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(column: pa.Array, path: str):
    """The ids of each text of a column (null: none), a few rows at a time."""
    own = encoder(path)
    for at in range(0, len(column), ROWS_AT_ONCE):
        yield from own.encode(column.slice(at, ROWS_AT_ONCE).cast(pa.binary()).to_pylist())


def lengths(column: pa.Array, path: str) -> np.ndarray:
    """Token count of every text."""
    width = encoder(path).width
    return np.fromiter((len(ids) // width for ids in encoded(column, path)), np.int64, len(column))


def forget() -> None:
    """Give up the encoders of this process: workers outlive their stage, and what comes next needs the memory."""
    if _encoders:
        _encoders.clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
