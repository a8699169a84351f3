"""Resampling by blocks: hashes, counts and sums against plain loops, and no join that takes picks for few."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from bitcurve.functions import digests
from bitcurve.operators import bootstrap as B


def pick(seed, draw, slot):
    return int(hashlib.md5(f"{seed}|{draw}|{slot}".encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("prefix", [b"", b"s|1|", b"x" * 55, b"y" * 130])
def test_digests(prefix):
    texts = [b"%d" % i for i in range(120)] + [b"", b"abc", b"q" * 70, "ü".encode()]
    for at, tails in digests.tails_of(texts):
        want = [int(hashlib.md5(prefix + texts[i]).hexdigest()[:15], 16) for i in at]
        assert digests.md5_wide(prefix, tails).tolist() == want


@pytest.mark.parametrize("first, last", [(0, 1), (0, 7), (5, 12_345), (9_998, 10_003), (123_450, 123_459)])
def test_picked(first, last):
    assert B._picked("s", 3, first, last, 977).tolist() == [pick("s", 3, j) % 977 for j in range(first, last)]


def test_counts_in_several_chunks_and_blocks(monkeypatch):
    monkeypatch.setattr(B, "SLOTS", 400)
    monkeypatch.setattr(B, "BLOCK", 100)
    n, found = 1_050, np.zeros((2, 1_100), int)
    units = pa.record_batch([pa.array(range(6), pa.int64())], ["id"])
    for batch in B._counts_of("s", n, 3)([units]):
        for draw, block, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            counts = B._unpack(packed, min(100, n - block * 100))
            found[draw, block * 100 : block * 100 + len(counts)] += counts
    for draw in range(2):
        want = np.bincount([pick("s", draw, j) % n for j in range(n)], minlength=1_100)
        assert found[draw].tolist() == want.tolist()


@pytest.mark.parametrize("method", ["multinomial", "poisson"])
def test_sums_keep_odd_values_to_their_draws(spark, method):
    rows = [(i, "x", float(i)) for i in range(40)] + [(7, "y", float("nan")), (9, "y", None), (11, "y", 2.0)]
    wide = spark.createDataFrame(rows, "source_id long, codec string, v double")
    got = {(r["draw"], r["codec"]): r["v"] for r in B.draw_sums(wide, ["v"], 30, "s", method, keys=["codec"]).collect()}
    order = sorted(range(40), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    cumulative = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1))) for k in range(16)])
    for draw in range(30):
        if method == "multinomial":
            times = np.bincount([order[pick("s", draw, j) % 40] for j in range(40)], minlength=40)
        else:
            times = [int((pick("s", draw, i) / 2.0**60 >= cumulative).sum()) for i in range(40)]
        assert got[draw, "x"] == sum(i * t for i, t in enumerate(times))
        if times[7]:
            assert np.isnan(got[draw, "y"])
        elif times[9] or times[11]:
            assert got[draw, "y"] == 2.0 * times[11]
        else:
            assert (draw, "y") not in got


def test_picks_count_as_many(spark):
    sources = spark.range(1_000).withColumnRenamed("id", "source_id")
    _, picks = B.multinomial_picks(sources, "source_id", 500, "s")
    assert int(str(picks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 500 * 1_000 * 12
