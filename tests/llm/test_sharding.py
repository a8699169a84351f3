import hashlib

import pytest
from pyspark.sql import functions as F

from bitcurve.llm import sharding as S


def key(doc, text):
    def bits(v):
        return int(hashlib.md5(v.encode()).hexdigest()[:8], 16)

    return (bits(text or "") << 30) + (bits("" if doc is None else str(doc)) >> 2)


def brute(rows, shards):
    """Shard and slot of every row, in key order, by one pass over the sorted rows and the definition of a boundary."""
    rows = sorted((key(d, t), len((t or "").encode()) + 8) for d, t in rows)
    total, cuts = sum(s for _, s in rows), []
    for k in range(1, shards):
        before = 0
        for x, s in rows:
            same = sum(t for y, t in rows if y == x)
            if shards * before <= k * total < shards * (before + same):
                break
            before += s
        for shift in S.SHIFTS:
            low = x >> shift << shift
            below = k * total - shards * sum(s for y, s in rows if y < low)
            above = shards * sum(s for y, s in rows if y < low + (1 << shift)) - k * total
            if min(below, above) * 200 <= total or not shift:
                cuts.append(low if below <= above else low + (1 << shift))
                break
    out, seen = [], {}
    for x, s in rows:
        shard = sum(c <= x for c in cuts)
        out.append((x, s, shard, seen.setdefault(shard, 0)))
        seen[shard] += 1
    return out


def result(df, shards, **options):
    rows = S.histogram_sort(df, shards, **options).select("doc_id", "text", "size", "shard", "slot").collect()
    return sorted((key(r[0], r[1]), *r[2:]) for r in rows)


def hot(n=400):
    rows = [(i, "one text that a third of all rows hold") for i in range(n // 3)]
    return rows + [(1000 + i, f"text {i} " + "word " * (i % 7)) for i in range(n - n // 3)]


@pytest.mark.parametrize("piece", [S.PIECE_BYTES, 500])
def test_hot_text_and_pieces(spark, piece):
    rows = hot()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = result(df, 6, piece_bytes=piece)
    assert found == sorted(brute(rows, 6))
    sizes = [sum(r[1] for r in found if r[2] == s) for s in range(6)]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 6 + 2 * max(r[1] for r in found)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "word " * 50_000), (4, "same"), (4, "same"), (5, "same"), (-6, "é😀")]
    df = spark.createDataFrame([(d, t, 9, "x") for d, t in rows], "doc_id long, text string, shard int, key string")
    found = S.histogram_sort(df, 4)
    assert found.columns == ["doc_id", "text", "key", "size", "shard", "slot"]
    got = result(df, 4)
    assert [(k, s, h) for k, s, h, _ in got] == [(k, s, h) for k, s, h, _ in sorted(brute(rows, 4))]
    for shard in {r[2] for r in got}:
        slots = sorted(r[3] for r in got if r[2] == shard)
        assert slots == list(range(len(slots)))


def test_empty_table(spark):
    assert S.shard_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_copies_stay_together(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = S.histogram_sort(df)
    sizes = [r[1] for r in found.groupBy("shard").agg(F.sum("size")).collect()]
    copies = found.groupBy("text").agg(F.count("*").alias("n"), F.count_distinct("shard").alias("shards")).filter("n > 1")
    assert len(sizes) == 24 and max(sizes) < 1.05 * sum(sizes) / 24
    assert copies.filter("shards > 1").count() <= 2 < copies.count()


def test_no_python_and_one_exchange(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = S.histogram_sort(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame(hot(), "doc_id long, text string")
    S.write_shards(S.histogram_sort(df, 4), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(hot()) and back.select("shard").distinct().count() == 4
