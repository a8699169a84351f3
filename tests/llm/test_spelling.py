import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitcurve.llm import spelling as S

LOW = str.maketrans(S.UPPER, S.LOWER)


def near(a, b):
    """One insertion, deletion or replacement."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    forms, n_near = {}, {}
    for w in words:
        found = [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)]
        n_near[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, n_near[w], words[forms[w]] if forms[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


WORDS = st.lists(st.text("abcé", min_size=4, max_size=9), min_size=1, max_size=60, unique=True)


@given(WORDS)
@settings(max_examples=150, deadline=None)
def test_both_searches_find_each_near_word_once(words):
    words = sorted(words)
    lexicon = S.Lexicon(words)
    every = np.arange(len(words))
    found = [lexicon.search(every, lexicon.length // 2, left) for left in (True, False)]
    pairs = [(int(q), int(x)) for a, b in found for q, x in zip(a, b)]
    assert sorted(pairs) == [(i, j) for i in every for j in every if near(words[i], words[j])]


def variants():
    rows = []
    for i in range(60):
        rows.append((i, "Weather weather WEATHER wether's weathers weathr Écoles écoles ecolesx ÿabcdefg " * (1 + i % 3)))
        rows.append((1000 + i, "aaaaaaaa aaaaaaaaa aaaaaaaaaa bananas banannas bandanas " + "banana " * 7))
    return rows + [(None, "weather " * 40), (5, None), (6, ""), (7, "x" * 3000 + " " + "y" * 9), (7, "y" * 9)] + [(8, "z" * 4000)] * 6


@pytest.mark.parametrize("symbols", [S.BUCKET_SYMBOLS, 60])
def test_against_brute_force(spark, symbols):
    rows = variants()
    df = spark.createDataFrame([(d, t, "w") for d, t in rows], "doc_id long, text string, word string")
    assert rows_of(S.spelling_groups(df, symbols=symbols)) == brute(rows)


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute(rows)
    assert want and rows_of(S.spelling_groups(df)) == want


def test_one_half_that_all_words_share_is_dealt(spark):
    words = [f"common{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]
    rows = [(i, " ".join(words)) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = S.word_counts(df)
    chunks = S.bucketed(counts, 300).agg({"chunks": "max"}).first()[0]
    assert chunks > 1
    assert rows_of(S.spelling_groups(df, symbols=300)) == brute(rows)


def test_empty_table(spark):
    assert rows_of(S.spelling_groups(spark.createDataFrame([], "doc_id long, text string"))) == []
