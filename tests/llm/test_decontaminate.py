import hashlib
import random
import re

from bitcurve.llm.decontaminate import decontaminate, without_contaminated


def words(text):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        m = min(10, len(w))
        windows += [(item, tuple(w[i : i + m])) for i in range(len(w) - m + 1) if m]
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, window in set(windows):
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
        names = sorted(str(x) for x in found if x is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((str(doc), len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out)


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, k1 int, size int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, spelling int")
    got = [(str(r[0]), *tuple(r)[1:6]) for r in decontaminate(d, b).collect()]
    assert sorted(got) == brute(docs, items)
    clean = without_contaminated(d, b)
    assert clean.columns == d.columns
    assert clean.count() == sum(not r[5] for r in got)


def test_odd_rows(spark):
    rng = random.Random(1)
    item = [f"w{i}" for i in range(24)]
    items = [(1, " ".join(item)), (2, " ".join(item[5:17])), (3, "Only, four words here"), (4, "one"), (5, None), (6, "..."), (None, "zz yy xx")]
    items += [(7, " ".join(item)), (7, " ".join(item)), (8, "aa aa aa aa aa aa aa aa aa aa aa")]
    docs = [(1, "x " + "!! ".join(item).upper() + " y"), (2, " ".join(item[:9])), (3, " ".join(item[3:13]) + " q " + " ".join(item[2:14]))]
    docs += [(4, "only four (words) here: one-two"), (5, None), (6, ""), (None, "zz yy xx"), (None, "zz yy xx"), (8, "aa " * 30)]
    docs += [(9, " ".join(rng.choice(item) for _ in range(300))), (9, "nothing"), (10, "é one é")]
    check(spark, docs, items)
    check(spark, docs, [])
    check(spark, [], items)
