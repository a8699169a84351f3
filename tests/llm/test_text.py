import random
import re

import numpy as np
import pyarrow as pa
import pytest

from bitcurve.llm import text as T

PATTERNS = {"space": (T.SPACE, rb"[^\x20\x09-\x0D]+"), "alnum": (T.NOT_ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}
TEXTS = ["", None, "One", "a b c d", "x\x0by\tz é—ü Ÿ", " lead  trail ", "A" * 300_000, "one two three four five six one two three four five"]


def lower(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


@pytest.mark.parametrize("kind", PATTERNS)
def test_words(kind):
    separators, pattern = PATTERNS[kind]
    random.seed(1)
    texts = TEXTS + ["".join(random.choices("abAB é.,\n\t9", k=random.randrange(200_000))) for _ in range(8)]
    words = T.Words(pa.array(texts), separators)
    seen = {}
    for i, text in enumerate(texts):
        want = re.findall(pattern, lower(text))
        own = range(words.first[i], words.first[i + 1])
        got = [bytes(T.LOWER[words.data[words.start[j] : words.end[j]]]) for j in own]
        assert got == want
        for j, word in zip(own, want):
            assert seen.setdefault(word, words.hash[j]) == words.hash[j]
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets():
    words = T.Words(pa.array(TEXTS + ["a b c d e", "A b c d E"]))
    values, first = words.shingle_sets(5)
    sizes = np.diff(first)
    for text, n in zip(TEXTS, sizes):
        w = re.findall(rb"[^\x20\x09-\x0D]+", lower(text))
        assert n == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ())
    assert values[first[-2]] == values[first[-3]]


def test_row_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c" * 50, "", "d"])], ["t"])
    parts = list(T.row_pieces(batch, 0, 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == ["ab", None, "c" * 50, "", "d"]
    assert len(parts) >= 2
