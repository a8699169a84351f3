import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitcurve.operators import quantiles as Q
from bitcurve.operators import ranking as R


def clips(spark, n=900):
    """A third of all rows belongs to one class."""
    return spark.range(n).selectExpr(
        "string(id) AS key", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('c', id % 7) END AS label", "id % 50 AS bytes", "id")


def digest(salt, key):
    return hashlib.sha256(f"{salt}\0{key}".encode()).hexdigest()


def test_rank_in_a_hot_group_is_exact(spark):
    rows = R.hash_rank(clips(spark), "s", "key", ["label"]).collect()
    groups = {}
    for row in rows:
        groups.setdefault(row["label"], []).append(row)
    for members in groups.values():
        ordered = sorted(members, key=lambda r: (digest("s", r["key"]), r["key"]))
        assert [r["rank"] for r in ordered] == list(range(1, len(members) + 1))


def test_null_group_is_ranked(spark):
    rows = clips(spark, 90).withColumn("label", F.expr("CASE WHEN id % 2 = 0 THEN label END"))
    ranked = R.hash_rank(rows, "s", "key", ["label"])
    assert ranked.count() == 90
    assert sorted(r["rank"] for r in ranked.filter("label IS NULL").collect()) == list(range(1, 46))


def test_balanced_pick_takes_turns(spark):
    picked = sorted(R.balanced_pick(clips(spark), "p", "key", "label", 20).collect(), key=lambda r: r["pick"])
    assert [r["pick"] for r in picked] == list(range(1, 21))
    assert len({r["label"] for r in picked[:8]}) == 8
    again = sorted(R.balanced_pick(clips(spark).repartition(5), "p", "key", "label", 20).collect(), key=lambda r: r["pick"])
    assert [r["key"] for r in again] == [r["key"] for r in picked]


def test_group_prefix_sums_agree_with_a_loop(spark):
    rows = R.group_prefix_sums(clips(spark), ["label"], ["id"], {"total": "bytes"}).collect()
    running = {}
    for row in sorted(rows, key=lambda r: r["id"]):
        running[row["label"]] = running.get(row["label"], 0) + row["bytes"]
        assert row["total"] == running[row["label"]]


def test_cap_stops_at_the_first_breach_and_keeps_the_first(spark):
    rows = spark.createDataFrame([("a", "x", 5), ("b", "x", 0), ("c", "y", 9), ("d", "y", 1)], "key STRING, label STRING, size INT")
    ranked = R.hash_rank(rows, "s", "key", ["label"], "depth")
    order = [r for r in sorted(ranked.collect(), key=lambda r: (r["depth"], r["label"])) if r["size"] > 0]
    kept, total = [], 0
    for row in order:
        if total + row["size"] > 6 and kept:
            break
        kept.append(row["key"])
        total += row["size"]
    got = R.capped_round_robin(rows, "s", "key", "label", "size", 6).collect()
    assert sorted(r["key"] for r in got) == sorted(kept)
    alone = R.capped_round_robin(rows.filter("key = 'c'"), "s", "key", "label", "size", 6).collect()
    assert [r["key"] for r in alone] == ["c"]


def in_hash_order(rows, salt):
    return sorted(rows, key=lambda r: hashlib.sha256(f"{salt}\0{r['key']}".encode()).hexdigest())


def sized_clips(spark, n=6000):
    """A third of all rows in one class, one NULL class, sizes of 0, negative and NULL among them."""
    return spark.range(n).selectExpr(
        "concat('k', id) AS key", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 97 = 1 THEN NULL ELSE concat('c', id % 11) END AS label",
        "CASE WHEN id % 13 = 0 THEN 0 WHEN id % 41 = 0 THEN -5 WHEN id % 43 = 0 THEN NULL ELSE int(id*7919 % 1000) END AS size")


@pytest.mark.parametrize("cap", [0, 700, 60_000, 900_000, 10**9])
def test_capped_walks_against_a_loop(spark, cap):
    table = sized_clips(spark)
    rows = table.collect()

    def walk(order):
        kept, total = {}, 0
        for r in order:
            if (r["size"] or 0) <= 0:
                continue
            total += r["size"]
            if total > cap and kept:
                break
            kept[r["key"]] = total
        return kept

    depth, seen = {}, {}
    for r in in_hash_order(rows, "a"):
        seen[r["label"]] = depth[r["key"]] = seen.get(r["label"], 0) + 1
    turns = sorted(rows, key=lambda r: (depth[r["key"]], r["label"] is not None, r["label"] or ""))
    got = R.capped_round_robin(table, "a", "key", "label", "size", cap).collect()
    assert {r["key"]: r["running_bytes"] for r in got} == walk(turns)
    assert all(r["depth"] == depth[r["key"]] for r in got)
    got = R.capped_prefix(table, "b", "key", "size", cap).collect()
    assert {r["key"]: r["running_bytes"] for r in got} == walk(in_hash_order(rows, "b"))


@pytest.mark.parametrize("n", [1, 40, 10**6])
def test_first_valid_against_a_loop(spark, n):
    table = sized_clips(spark).selectExpr("key", "CASE WHEN size > 100 THEN 'ok' ELSE 'small' END AS status")
    want, valid = {}, 0
    for rank, r in enumerate(in_hash_order(table.collect(), "v"), 1):
        valid += r["status"] == "ok"
        want[r["key"]] = (rank, valid)
        if valid == n:
            break
    got = R.first_valid_hashed(table, "v", "key", n).collect()
    assert {r["key"]: (r["rank"], r["n_valid"]) for r in got} == want


def test_rows_beyond_the_cap_are_dropped_in_the_scan(spark):
    table = sized_clips(spark, 60_000)
    near = R.within_reach(table, "a", "key", [], "size", 20_000)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(key" not in plan and "rangepartitioning" not in plan
    assert 0 < near.count() < 600
    assert R.within_reach(table.limit(0), "a", "key", ["label"], "size", 5).count() == 0


def test_shards_do_not_alias_the_split(spark):
    rows = R.hash_shard(R.hash_split(clips(spark), "key"), "salt", "key", 5)
    test_part = rows.filter("split = 'test'").groupBy("shard").count().collect()
    assert len(test_part) == 5 and rows.count() == 900


def test_staged_plan_is_disjoint_and_rejects_short_pools(spark):
    rows = clips(spark).selectExpr(
        "id AS position", "key AS clip", "label", "string(id div 2) AS source_id", "CASE WHEN id % 10 = 0 THEN 'val' ELSE 'train' END AS split")
    sizes, salts = {"fit": 30, "calibration": 20, "dev": 20}, {"fit": "a", "calibration": "b", "dev": "c"}
    plan = R.staged_plan(rows, sizes, salts).collect()
    assert len({r["source_id"] for r in plan}) == len(plan) == 70
    with pytest.raises(ValueError, match="dev"):
        R.staged_plan(rows, sizes | {"dev": 500}, salts)


def test_exact_quantiles_in_a_hot_group(spark):
    values = clips(spark).withColumn("v", F.expr("double(id*7919 % 1009)"))
    got = Q.exact_quantiles(values, ["label"], "v", [0.0, 0.1, 0.5, 0.95, 1.0])
    want = values.groupBy("label").agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.1, 0.5, 0.95, 1.0)))).alias("p"))
    expected = {r["label"]: r["p"] for r in want.collect()}
    for row in got.collect():
        position = [0.0, 0.1, 0.5, 0.95, 1.0].index(row["p"])
        assert row["quantile"] == pytest.approx(expected[row["label"]][position])


def test_ordinals_are_the_bits_of_doubles(spark):
    rng = np.random.default_rng(3)
    edges = [0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, 1.0]
    powers = [2.0**k for k in range(-1074, 1024)]
    around = [math.nextafter(x, y) for x in powers for y in (0.0, math.inf)]
    anything = np.frombuffer(rng.bytes(8 * 3000), np.float64)
    values = [*edges, *powers, *around, *[abs(float(x)) for x in anything if not math.isnan(x)]]
    rows = spark.createDataFrame([(x,) for x in values] + [(-x,) for x in values], "v double")
    for row in Q.with_ordinal(rows, "v", "o").collect():
        bits = int(np.float64(abs(row.v)).view(np.int64))
        assert row.o == (-bits if row.v < 0 else bits), row.v
    nan = Q.with_ordinal(spark.createDataFrame([(math.nan,)], "v double"), "v", "o").first()
    assert nan.o > int(np.float64(math.inf).view(np.int64))


def test_quantiles_against_numpy_without_a_sort(spark, monkeypatch):
    rng = np.random.default_rng(5)
    groups = {
        "hot": np.concatenate([rng.normal(size=3000), np.full(500, 0.25), 0.25 + 1e-15 * rng.random(500)]),
        "wide": np.exp(rng.uniform(-600, 600, 301)) * rng.choice([-1, 1], 301),
        "ties": np.repeat([-0.0, 0.0, 7.0], 40),
        "one": np.array([3.5]),
        None: np.array([1e300, -1e300, math.inf, 2.0, 5e-324]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("none", None), ("one", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(7)

    def refuse(*_):
        raise AssertionError("rows are sorted")

    monkeypatch.setattr(type(table), "repartitionByRange", refuse)
    wanted = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    got = {(r.g, r.p): r["quantile"] for r in Q.exact_quantiles(table, ["g"], "v", wanted).collect()}
    assert len(got) == len(groups) * len(wanted)
    for g, values in groups.items():
        ordered = sorted(values)
        for p in wanted:
            at = p * (len(ordered) - 1)
            low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
            assert got[g, p] == (low if low == high else pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-14)), (g, p)
    alone = Q.exact_quantiles(table.filter("g = 'hot'"), [], "v", [0.5]).collect()
    assert [r["quantile"] for r in alone] == [got["hot", 0.5]]
    assert Q.exact_quantiles(table.filter("v IS NULL"), ["g"], "v", [0.5]).count() == 0


def test_null_groups_stay(spark):
    rows = spark.createDataFrame([(None, 1, 3.0), (None, 2, 5.0), ("a", 3, 7.0), ("a", 4, 9.0)], "g string, id long, v double")
    sums = R.group_prefix_sums(rows, ["g"], ["id"], {"total": "v"}, totals_of=["total"]).collect()
    assert sorted((str(r.g), r.total, r.total_total) for r in sums) == [("None", 3.0, 8.0), ("None", 8.0, 8.0), ("a", 7.0, 16.0), ("a", 16.0, 16.0)]
    assert Q.exact_quantiles(rows, ["g"], "v", [0.5]).count() == 2
    ranks = R.group_rank(rows.withColumn("d", F.md5(F.col("id").cast("string"))), ["g"], "d", ["id"]).collect()
    assert sorted((str(r.g), r["rank"]) for r in ranks) == [("None", 1), ("None", 2), ("a", 1), ("a", 2)]


def test_picks_reach_beyond_32_bits(spark):
    from bitcurve.functions.hashing import md5_wide

    got = spark.range(1000).selectExpr(f"{md5_wide('string(id)')} AS h").collect()
    assert max(r.h for r in got) > 2**59 and sum(r.h % 10**10 >= 2**32 for r in got) > 400


def test_limit_per_class_stands_below_the_exchange(spark):
    picked = R.balanced_pick(clips(spark), "s", "id", "label", 7)
    plan = picked._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and picked.count() == 7
