import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitcurve.llm.alignment import alignment_digests, byte_characters, shared_ends

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """Whole texts through both tokenizers, ends compared as sets."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {c: v for v, c in byte_characters().items()}
    out, count = [], Counter()
    for doc, text in rows:
        links, digest, n = [], "", (0, 0)
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xs = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
            ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(xs) == b"".join(ys) == (" " + text).encode():
                n = len(x), len(y)
                ends = [[sum(map(len, p[: i + 1])) for i in range(len(p))] for p in (xs, ys)] if n[0] < 500 else None
                if ends is None:
                    ends = []
                    for p in (xs, ys):
                        total, own = 0, []
                        for v in p:
                            total += len(v)
                            own.append(total)
                        ends.append(own)
                both, parts, i, j = set(ends[0]) & set(ends[1]), [], 0, 0
                for e in sorted(both):
                    p, q = ends[0].index(e, i), ends[1].index(e, j)
                    parts.append(",".join(map(str, x[i : p + 1])) + "|" + ",".join(map(str, y[j : q + 1])))
                    links.append((x[p], y[q]))
                    i, j = p + 1, q + 1
                digest = hashlib.sha256(";".join(parts).encode()).hexdigest()
        count.update(links)
        out.append((doc, n, links, digest))
    top = defaultdict(int)
    for (_, y), m in count.items():
        top[y] = max(top[y], m)
    return sorted(
        [(d, *n, len(k), len(k), sum(count[p] == top[p[1]] for p in k), sum(count[p] for p in k), s) for d, n, k, s in out],
        key=str,
    )


ODD = [
    (1, "Plain words, plain words and <|endoftext|> or <s> <0x0A> </s>."),
    (2, None),
    (3, ""),
    (4, " "),
    (5, "  two  spaces\n\n  and lines \t\n x  y　 z  w  "),
    (6, "a▁b never comes back"),
    (7, "résumé naïve Ångström 中文 рус 😀 don't we'll"),
    (8, "x" * 3000 + " " + "word " * 2000),
    (1, "Plain words, plain words and <|endoftext|> or <s> <0x0A> </s>."),
    (None, "an id that is null"),
    (9, "\x00 \x01 \r\n"),
]


def rows_of(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=str)


@pytest.mark.parametrize("most", [1 << 19, 16, 0])
def test_against_whole_texts(spark, most):
    df = spark.createDataFrame([(d, t, 5) for d, t in ODD], "doc_id long, text string, links int").repartition(3)
    assert rows_of(alignment_digests(df, A, B, most=most)) == brute(ODD)


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert rows_of(alignment_digests(df, A, B)) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment_digests(df, A, B).collect() == []


@given(st.lists(st.booleans(), max_size=200), st.lists(st.booleans(), max_size=200))
@settings(max_examples=200, deadline=None)
def test_divide_and_conquer(x, y):
    n = max(len(x), len(y)) + 1
    a = [i + 1 for i, v in enumerate(x) if v] + [n]
    b = [i + 1 for i, v in enumerate(y) if v] + [n]
    a, b = sorted(set(a)), sorted(set(b))
    i, j = shared_ends(np.array(a), np.array(b))
    assert list(zip(i.tolist(), j.tolist())) == [(a.index(e), b.index(e)) for e in sorted(set(a) & set(b))]
