import numpy as np

from bitcurve.llm import pivots as P


def brute(rows, threshold=0.98):
    n = len(rows)
    usable = []
    for _, e, label in rows:
        x = None if e is None or any(v is None for v in e) else np.asarray(e, float)
        good = label is not None and x is not None and len(x) and np.isfinite(x).all() and (x != 0).any()
        usable.append(x if good else None)
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = usable[i], usable[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    return links


def components(rows, links):
    out = [None] * len(rows)
    for i in range(len(rows)):
        if out[i] is None:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            for j in seen:
                out[j] = min(ids, default=None)
    return out


def run(spark, rows):
    frame = spark.createDataFrame([(i, e, c, "x") for i, e, c in rows], "vec_id long, embedding array<float>, label int, point string")
    return P.near_duplicates(frame).collect()


def clouds(rng, n, dim=64):
    rows = []
    while len(rows) < n:
        centre = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 12))):
            noise = rng.normal(size=dim) * rng.choice([0.01, 0.05, 0.1, 0.14])
            rows.append((len(rows), np.float32(centre + noise).tolist(), int(rng.integers(2))))
    return rows


def test_recall_and_precision_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16)
    rows = clouds(np.random.default_rng(2), 1500)
    links = brute(rows)
    got = {r.vec_id: r for r in run(spark, rows)}
    total = sum(map(len, links))
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= len(links[i]) for i in range(len(rows)))  # none below the threshold
    assert found >= 0.99 * total > 1000
    want = components(rows, links)
    assert np.mean([got[i].component_id == want[i] for i in range(len(rows))]) > 0.99


def test_hot_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 32)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    rows = [(i, np.float32(centre + rng.normal(size=16) * 0.01).tolist(), 1) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(50)]
    got = {r.vec_id: r for r in run(spark, rows)}
    assert {(r.n_links, r.component_id) for r in got.values()} == {(349, 0)}
    assert [i for i, r in got.items() if r.kept] == [0]


def test_odd_rows(spark):
    a = [1.0, 2.0, 3.0]
    rows = [(1, a, 1), (2, a, None), (3, None, 1), (4, [], 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 3.0], 1)]
    rows += [(7, [float("nan"), 1.0, 1.0], 1), (8, [float("inf"), 1.0, 1.0], 1), (9, [2.0, 4.0, 6.0], 1), (None, a, 1)]
    rows += [(10, [1.0, 2.0], 1), (11, a, 2), (12, a, 2), (12, a, 2)]
    got = sorted(((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in run(spark, rows)))
    links = brute(rows)
    parts = components(rows, links)
    want = sorted((str(i), len(links[k]), parts[k], i is not None and i == parts[k]) for k, (i, _, _) in enumerate(rows))
    assert got == want
    assert run(spark, []) == []
    assert [tuple(r) for r in run(spark, [(1, None, None)])] == [(1, 0, 1, True)]
