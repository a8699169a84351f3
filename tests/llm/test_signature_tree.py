import random
import re

import numpy as np

from bitcurve.llm import signature_tree as T


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def varied(seed, n_groups=12):
    """Chains and clouds of edited copies around the threshold, texts with a common passage, short and odd ones."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choices("abcdefghij", k=5))

    passage = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(n_groups):
        words = [word() for _ in range(rng.choice([6, 12, 40, 90, 200]))]
        for _ in range(rng.randrange(1, 9)):
            for _ in range(rng.randrange(0, 1 + len(words) // 20)):
                words[rng.randrange(len(words))] = word()
            if rng.random() < 0.3:
                words = words + [word() for _ in range(len(words) // 10)]
            texts.append(" ".join(words))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(3, 30))) for _ in range(50)]
    texts += ["", None, " \t", "a", "A", "a b c d", "a b c D", "x " * 400, "x " * 401]
    rng.shuffle(texts)
    return texts


def check(spark, texts, monkeypatch=None):
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, set_id int, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in T.jaccard_components(frame).collect()}
    sizes, roots = groups(texts)
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}


def test_against_brute_force(spark):
    check(spark, varied(1))


def test_cells_alone_find_every_link(spark, monkeypatch):
    """Without known groups, and with small blocks, the trees must find all links."""
    monkeypatch.setattr(T, "BLOCK", 8)
    monkeypatch.setattr(T, "HOT", 4)
    empty = spark.createDataFrame([], "u long, v long")
    monkeypatch.setattr(T, "hub_links", lambda *a: empty)
    check(spark, varied(2))


def test_traversal_keeps_all_pairs_that_may_link():
    rng = np.random.default_rng(1)
    for trial in range(20):
        base = [rng.integers(0, 2**63, rng.integers(5, 120), dtype=np.uint64) for _ in range(6)]
        sets = []
        for _ in range(40):
            own = base[rng.integers(6)]
            new = rng.integers(0, 2**63, rng.integers(0, 1 + len(own) // 8), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([own[rng.random(len(own)) > 0.08], new])))
        sets = [s for s in sets if len(s)]
        size = np.array([len(s) for s in sets])
        bits = [T.bitmaps(s, np.array([len(s)]), int(T.width_of(np.array([len(s)]), T.NARROW)[0]))[0] for s in sets]
        group = np.arange(len(sets))
        side = np.zeros(len(sets), int) if trial % 2 else 1 + (np.arange(len(sets)) % 2)
        found = {tuple(sorted(p)) for p in T.cell_pairs(size, group, side, bits).T.tolist()}
        for i in range(len(sets)):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if T.linked(common, size[i], size[j]) and (trial % 2 or side[i] != side[j]):
                    assert (j, i) in found


def test_first_of_groups_and_odd_rows(spark):
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(7, near), (3, near + " x"), (3, near + " x"), (None, near + " y"), (9, None), (9, ""), (11, "alone in the world today")]
    rows += [(None, "only without any id here"), (None, "only without any id here")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, key int")
    kept = T.first_of_groups(docs)
    assert kept.columns == docs.columns
    want = [("3", near + " x"), ("9", None), ("9", ""), ("11", "alone in the world today"), ("None", "only without any id here")]
    assert sorted(((str(r.doc_id), r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.jaccard_components(docs).count() == 0
    assert T.first_of_groups(docs).count() == 0
