import random
import re

import numpy as np
import pyarrow as pa

from bitcurve.llm import sentence_spans as S


def sentences(text):
    """Sentences as (start byte, words), by a plain loop."""
    raw = (text or "").encode()
    out, words, start = [], [], None
    found = list(re.finditer(rb"[^\x20\x09-\x0D]+", raw))
    for m, after in zip(found, [*found[1:], None]):
        start = m.start() if start is None else start
        words.append(re.sub(rb"[A-Z]", lambda x: x[0].lower(), m[0]))
        gap = raw[m.end() : after.start()] if after else b"\n"
        if m[0][-1:] in (b".", b"!", b"?") or b"\n" in gap:
            out.append((start, tuple(words)))
            words, start = [], None
    return out


def spans(own):
    """All (first sentence, sentences) that count."""
    n, out = len(own), set()
    size = [len(w) for _, w in own]
    for i in range(n):
        for j in range(i + 1, n + 1):
            if j - i >= S.RUN and sum(size[i:j]) >= S.RUN_WORDS:
                out.add((i, j))
                break
    for j in range(1, n + 1):
        for i in range(j - 1, -1, -1):
            if j - i >= S.RUN and sum(size[i:j]) >= S.RUN_WORDS:
                out.add((i, j))
                break
    out |= {(i, i + 2) for i in range(n - 1) if sum(size[i : i + 2]) >= S.RUN_WORDS}
    return out | {(i, i + 1) for i in range(n) if size[i] >= S.LONE_WORDS}


def brute(rows):
    first, places = {}, []
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, rows[r][1]))
    parsed = [sentences(text) for _, _, text in rows]
    for r in order:
        for i, j in spans(parsed[r]):
            words = sum((w for _, w in parsed[r][i:j]), ())
            places.append((words, r, i, j))
            key = (rows[r][0] is not None, rows[r][0] or 0, rows[r][1], 16 * i + j - i)
            first[words] = min(first.get(words, key), key)
    gone = [set() for _ in rows]
    for words, r, i, j in places:
        if (rows[r][0] is not None, rows[r][0] or 0, rows[r][1], 16 * i + j - i) != first[words]:
            gone[r].update(range(i, j))
    out = []
    for (_, _, text), own, cut in zip(rows, parsed, gone):
        raw = (text or "").encode()
        ends = [s for s, _ in own[1:]] + [len(raw)]
        kept = raw[: own[0][0]] if own else b""
        kept += b"".join(raw[s:e] for k, ((s, _), e) in enumerate(zip(own, ends)) if k not in cut)
        out.append((kept.decode().rstrip() if cut else text, len(cut)))
    return out


def check(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(rows)], "doc_id long, h long, text string")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("k"), "text", "h").orderBy("h").collect()
    got = S.remove_repeated_spans(docs).orderBy("h").collect()
    assert [(r.text, r.n_removed) for r in got] == brute([(r.doc_id, r.k, r.text) for r in keyed])
    return got


def test_against_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = check(spark, [(r.doc_id, r.text) for r in docs])
    assert sum(r.n_removed for r in got) > 50


def test_odd_rows(spark):
    random.seed(4)
    words = [random.choice(["a", "b.", "c!", "d\n", "é", "x?"]) for _ in range(120)]
    passage = "One two three four five six. Seven eight nine ten eleven. Twelve thirteen fourteen fifteen sixteen."
    rows = [(1, None), (2, ""), (3, "  \n "), (None, passage), (None, passage), (5, " lead " + passage + " tail  "), (5, passage)]
    rows += [(6, " ".join(words[:80])), (7, " ".join(words[20:])), (7, " ".join(words[20:])), (8, "w " * 100), (9, "w " * 100)]
    check(spark, rows)
    assert S.remove_repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passage_is_cut_and_the_rest_stays(spark):
    random.seed(5)

    def prose(n):
        return " ".join("".join(random.choices("abcdefgh", k=6)) + random.choice(["", "", "", "", "."]) for _ in range(n))

    passage = "Start here. " + ". ".join(prose(9).replace(".", "") for _ in range(7)) + "."
    rows = [(i, prose(60) + ". " + passage + " " + prose(60)) for i in range(6)] + [(50 + i, prose(100)) for i in range(5)]
    got = {r.doc_id: r for r in check(spark, rows)}
    assert all(got[i].n_removed >= 7 and passage[20:] not in got[i].text for i in range(1, 6))
    assert all(got[i].n_removed == 0 for i in (0, *range(50, 55)))


def test_sentences_split_like_the_plain_loop():
    texts = ["A b. C d!\nE", None, "x\n\ny. z", "no stop"]
    s = S.Sentences(pa.array(texts))
    assert np.diff(s.rows).tolist() == [len(sentences(t)) for t in texts]


def test_a_passage_of_two_short_sentences_is_covered(spark):
    passage = "One two three four five six seven eight nine. Ten up to nineteen makes nine further words here."
    rows = [(1, f"First text with its own opening. {passage} Its end."), (2, f"Another page begins here. {passage} It closes.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in S.remove_repeated_spans(docs).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("Another page begins here. It closes.", 2)


def test_clashing_columns(spark):
    passage = "This sentence has seven words in it. And this one here has just as many."
    rows = [(i, passage, "kept", i + 70) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, n_removed long")
    found = S.remove_repeated_spans(df)
    assert found.columns == ["doc_id", "text", "a.b", "n_removed"]
    assert sorted(map(tuple, found.collect())) == [(0, passage, "kept", 0), (1, "", "kept", 2), (2, "", "kept", 2)]
